"""Words of organisation names: normalisation, a lexicon of concepts, and spelling correction.

Used by the mapping to a canonical list (problem 4) and the linking of variant
spellings (problem 5).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

# Words and abbreviations of organisation names in several languages, by the concept they stand for.
CONCEPTS: dict[str, str] = {
    "university": "university univ univers uni u universite universitat universitaet universita universidad universidade universitaria universiteit",
    "state": "state st",
    "medical": "medical med medicine medizinische medica",
    "institute": "institute inst institut instituto istituto institutes ist",
    "technology": "technology tech technol technical technische technique tecnologia tecnologico techn",
    "center": "center centre ctr cent centro zentrum",
    "central": "central",
    "genome": "genome genom genomic",
    "research": "research res recherche",
    "hospital": "hospital hospitals hosp h hospitalier klinikum ospedale hopital krankenhaus",
    "academy": "academy acad academie akademie academia",
    "national": "national nat natl nacional nazionale",
    "federal": "federal fed",
    "polytechnic": "polytechnic polytech politecnico politecnica polytechnique politec polit polytec",
    "molecular": "molecular mol molekular",
    "biology": "biology biol biologie biologia",
    "genetics": "genetics genet genetica",
    "biomedicine": "biomedicine biomed biomedicina",
    "biophysics": "biophysics biophys biofisica",
    "clinic": "clinic clinics clin clinica klinik",
    "analytics": "analytics analytic analyt",
    "robotics": "robotics robotic robot",
    "observatory": "observatory observatories obs observ observatorio",
    "biosciences": "biosciences bioscience biosci biosc",
    "laboratory": "laboratory laboratories lab labs laboratoire laboratorio",
    "software": "software softw soft sw",
    "foundation": "foundation foundations found fdn fundacion fundation stiftung",
    "seed": "seed seeds",
    "company": "company comp co",
    "diagnostics": "diagnostics diagnostic diagn diag",
    "therapeutics": "therapeutics therapeutic tx ther therap",
    "group": "group grp",
}
#: One word that stands for several concepts.
COMPOUNDS = {
    "universitatsklinikum": ("university", "hospital"),
    "uniklinikum": ("university", "hospital"),
    "uniklinik": ("university", "hospital"),
    "molekularbiologie": ("molecular", "biology"),
    "tu": ("technology", "university"),
    "bio sciences": ("biosciences",),
}
#: Words that carry nothing.
FILLERS = frozenset("the of de di da do du des del della degli studi for fur fuer la le el and et y e und a an in at d f ecole".split())
#: Legal forms of companies.
LEGAL = frozenset("inc ltd llc gmbh sa co corp corporation limited plc ag bv srl spa oy ab kg pty".split())
WORD_OF = {w: c for c, ws in CONCEPTS.items() for w in ws.split()}

_SEP = re.compile(r"[,;()\[\]/|:]|\s[-–—]\s|\s-$|^-\s")
_TOKEN = re.compile(r"[^\W_]+|\|")  # letters and digits of any script


_DAMAGED = re.compile("[\u00c2-\u00f4](?:[\u0080-\u00bf]|[\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178]){1,3}")


def _again(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m[0].encode(code).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return m[0]


def repair(s: str) -> str:
    """Text parts whose UTF-8 was read as Latin-1 or Windows-1252 are read again."""
    return _DAMAGED.sub(_again, s) if not s.isascii() else s


_PLAIN = str.maketrans({"ß": "ss", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "œ": "oe", "ł": "l", "Ł": "L", "đ": "d", "ı": "i"})


def fold(s: str) -> str:
    """Lower-case ASCII letters for accented ones; letters of other scripts stay."""
    s = unicodedata.normalize("NFKD", repair(s).translate(_PLAIN))
    return "".join(c for c in s if not unicodedata.combining(c)).casefold()


def tokens(s: str) -> list[str]:
    """Words of a folded name, with '|' where a comma, bracket or dash parts it; points vanish inside abbreviations."""
    f = _SEP.sub(" | ", fold(s))
    f = re.sub(r"(?<=\b[a-z])\.(?=[a-z]\b)", "", f)  # s.a. -> sa
    out: list[str] = []
    for t in _TOKEN.findall(f):
        if t != "|" or (out and out[-1] != "|"):
            out.append(t)
    while out and out[-1] == "|":
        out.pop()
    return out


class Memo:
    """A function that remembers its results, and forgets all of them when they are ``most``.

    Unlike the library's cache it travels to workers with its function's code, without what it remembers.
    """

    def __init__(self, fn: Callable, most: int = 1 << 17) -> None:
        self.fn, self.most, self.seen = fn, most, {}
        self.__doc__, self.__name__ = fn.__doc__, fn.__name__

    def __call__(self, *args: object) -> object:
        got = self.seen.get(args)
        if got is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            got = self.seen[args] = self.fn(*args)
        return got

    def __getstate__(self) -> dict:
        return {"fn": self.fn, "most": self.most, "seen": {}, "__doc__": self.__doc__, "__name__": self.__name__}


@Memo
def distance(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance (a swap of neighbours is one edit); ``most + 1`` when greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1] if one[-1] <= most else most + 1


def deletes(w: str, most: int = 1) -> set[str]:
    """``w`` and all words got by deleting up to ``most`` letters."""
    out = last = {w}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


class Speller:
    """Symmetric-delete index over a vocabulary."""

    def __init__(self, words: set[str], most: int = 1, least_chars: int = 4) -> None:
        self.words, self.most, self.least = words, most, least_chars
        self.index: dict[str, list[str]] = {}
        for w in sorted(words):
            if len(w) >= least_chars:
                for d in deletes(w, most):
                    self.index.setdefault(d, []).append(w)
        self.memo: dict[str, tuple[str, ...]] = {}

    def near(self, w: str) -> tuple[str, ...]:
        """The nearest vocabulary words within ``most`` edits, all of the least distance."""
        if w in self.words:
            return (w,)
        if len(w) < self.least:
            return ()
        if (got := self.memo.get(w)) is None:
            cand = {c for d in deletes(w, self.most) for c in self.index.get(d, ())}
            scored = sorted((distance(w, c, self.most), c) for c in cand)
            best = scored[0][0] if scored else self.most + 1
            got = tuple(c for d, c in scored if d == best) if best <= self.most else ()
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[w] = got
        return got
