"""Problem 4: free-entered values mapped to the entries of a reference list.

Names are reduced to concepts ("Univ", "Université" -> university) and proper
words ("Snarkiville"), after correcting spelling with a symmetric-delete index
over the words of the list.  One Aho-Corasick automaton holds, as sequences of
such words, every canonical name and its aliases (other orders, shortened kinds,
inverted with a comma); in a value the longest non-overlapping match wins.
Values without a match go to token-set similarity against the entries that share
a proper word, and against those without any.  An entry that stands for several countries is chosen by the
country the value names.  Values that mean no entry are reported as ``none``.

The list is broadcast after a check of its size.  Values are mapped where they
are read, each distinct one once per worker, so no string moves.

Defined results: null, empty and placeholder values give ``none``; equal rows
give one row; an empty list maps everything to ``none``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm import names as N

NONE = "none"
#: Entries of a reference list beyond this many are refused rather than broadcast.
MAX_ENTRIES = 500_000
#: Least share of concepts in common for a match by token-set similarity.
SIMILAR = 0.75

# Words that begin the name of a part of an organisation.
HEADS = frozenset("department dept division faculty school section chair program programme laboratory lab unit group".split())
# Concepts that name a subject rather than a kind of body.
SUBJECTS = frozenset("biology genetics biomedicine biophysics".split())
# Shorter kinds under which a kind is known too.
SHORT_KINDS = {
    ("institute", "technology"): [("technology",)],
    ("center", "genome", "research"): [("center", "genome")],
    ("hospital", "university"): [("clinic", "university")],
    ("polytechnic",): [("polytechnic", "university"), ("polytechnic", "institute")],
    ("polytechnic", "university"): [("polytechnic",)],
    ("institute", "biology", "molecular"): [("biology", "molecular")],
    ("federal", "university"): [("university",)],
    ("technology", "university"): [("technology",)],
}
# Other names of countries.
COUNTRY_ALIASES = {
    "GB": "uk|great britain|england|scotland|wales", "US": "usa|united states of america", "KR": "south korea|republic of korea|korea",
    "CD": "democratic republic of the congo|dr congo|congo", "CN": "pr china|p r china|peoples republic of china", "RU": "russia",
    "NL": "the netherlands|holland", "DE": "deutschland", "ES": "espana", "BR": "brasil", "IT": "italia", "TR": "turkiye", "MX": "mexico",
}
# Mail addresses and what announces them; where a part of an address ends.
_MAIL = re.compile(r"(?i)electronic address:?|[^\s,;()]+@[^\s,;()]+")
_PART = re.compile(r"[,;()\[\]/|:]|\.(?=\s|$)|\s[-–—]\s")
# A code in capitals; "DE", "LA" and the like before another word are parts of names.
_CODE = re.compile(r"\b(?!(?:" + "|".join(sorted(w.upper() for w in N.FILLERS if len(w) == 2)) + r")\s+[^\W\d_])[A-Z]{2}\b")


class Canon:
    """The automaton and the indexes of one reference list."""

    def __init__(self, entries: list[tuple[str, str | None, str | None, int]], countries: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.country_of = {i: c for i, _, c, _ in entries}
        self.size = {i: n for i, _, _, n in entries}
        self.codes = {c for c, _ in countries} | {c for _, _, c, _ in entries if c}
        self.names = {" ".join(N.tokens(n.split(",")[0])): c for c, n in countries if n}
        self.names |= {a: c for c, al in COUNTRY_ALIASES.items() for a in al.split("|")}
        self.long_names = sorted((n for n in self.names if len(n) > 2), key=len, reverse=True)
        self.by_key: dict[tuple, list[str]] = {}  # (kind, proper) -> ids
        self.keys_at: dict[str, list[tuple]] = {}  # proper word -> (kind, proper)
        self.bodies: dict[str, list[tuple]] = {}  # concept -> (kind, ()) of entries without a proper word
        proper_words: set[str] = set()
        self.initials: set[str] = set()
        short: list[tuple[str, tuple]] = []
        for i, name, _, _ in entries:
            kind, proper = [], []
            for t in N.tokens(name or ""):
                if t in N.COMPOUNDS:
                    kind += N.COMPOUNDS[t]
                elif t in N.WORD_OF:
                    kind.append(N.WORD_OF[t])
                elif t != "|" and t not in N.FILLERS:
                    proper.append(t)
            key = (tuple(sorted(set(kind))), tuple(proper))
            if not proper and not kind:
                continue
            if key not in self.by_key:
                for w in set(proper):
                    self.keys_at.setdefault(w, []).append(key)
                for c in key[0] if not proper else ():
                    self.bodies.setdefault(c, []).append(key)
            self.by_key.setdefault(key, []).append(i)
            if proper and len(kind) > 1:
                short.append(("".join(k[0] for k in kind), key))
                self.initials.add(short[-1][0])
            proper_words |= set(proper)
        self.proper = N.Speller(proper_words, 1, 5)
        self.kind_words = N.Speller({w for w in [*N.WORD_OF, *N.COMPOUNDS] if " " not in w}, 1, 5)
        self.number: dict[str, int] = {}
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        given: dict[tuple[int, ...], tuple] = {}
        for full in (True, False):  # a canonical kind has precedence over another's short form
            for key in self.by_key:
                kind, proper = key
                if not proper:  # concepts alone stand in other names too, so they are left to the similarity
                    continue
                for k in [kind] if full else SHORT_KINDS.get(kind, []):
                    for seq in self._orders(tuple(k), proper):
                        given.setdefault(tuple(self.number.setdefault(w, len(self.number) + 1) for w in seq), key)
        for word, key in short:  # "UF Zabnonholt", "Zabnonholt UF"
            for seq in ((f"={word}", *key[1]), (*key[1], f"={word}")):
                given.setdefault(tuple(self.number.setdefault(w, len(self.number) + 1) for w in seq), key)
        for seq, key in given.items():
            self.auto.add_word(seq, (len(seq), key))
        if given:
            self.auto.make_automaton()
        self.sought = bool(given)
        self.empty = not self.by_key
        self.memo: dict[str, tuple[str, str, float]] = {}

    @staticmethod
    def _orders(kind: tuple[str, ...], proper: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        """A name's words in any order of its concepts, its proper words together at any place, or set off by a comma."""
        for p in permutations(kind) if len(kind) <= 4 else [kind]:
            for i in range(len(p) + 1):
                yield (*p[:i], *proper, *p[i:])
            yield (*proper, "|", *p)
            yield (*p, "|", *proper)

    def countries(self, raw: str, proper: tuple[str, ...]) -> set[str]:
        """Country codes named in a value, by name anywhere or by code in capitals in a part after the first with a proper word.

        Mail addresses are left out.  A code begins or ends its part of the address, or
        stands near the end of the value; "DE ULM" and "Department of IT" name no country.
        """
        plain = _MAIL.sub(" ", N.repair(raw))
        whole = _PART.split(plain)
        parts = [[t for t in re.findall(r"[^\W_]+", x) if not t.isdigit()] for x in whole]
        at = next((i for i, x in enumerate(parts) if set(proper) & set(self.words(N.tokens(" ".join(x))))), 0)
        out = {t for t in _CODE.findall(plain.rstrip()[-12:]) if t in self.codes}
        for x in parts[at:]:
            if not x or any(t.lower() in HEADS for t in x):
                continue
            out |= {x[-1]} & self.codes
            if len(x) > 1 and x[1].islower():
                out |= {x[0]} & self.codes
        out |= {t for t in re.findall(r"\b([A-Z]{2})-?\d", " ; ".join(whole[at:])) if t in self.codes}
        text = " " + " ".join(N.tokens(plain)) + " "
        return out | {c for n, c in self.names.items() if f" {n} " in text}

    def words(self, toks: list[str]) -> list[str]:
        """The corrected words of a value: concepts, proper words of the list, '|', and '?' for anything else."""
        seen: dict[str, int] = {}
        for t in toks:
            seen[t] = seen.get(t, 0) + 1
        exact = {t for t in toks if t in self.proper.words}
        out: list[str] = []
        masked = part = False
        for t in toks:
            if t in N.FILLERS:
                continue
            if masked and t != "|":
                out.append("?")
                masked = False
                part = True
                continue
            if part and N.WORD_OF.get(t) in SUBJECTS:  # "Systems Biology": a part's name goes on
                out.append("?")
                continue
            masked = part = False
            if t == "|":
                if out and out[-1] != "|":
                    out.append(t)
            elif t in self.proper.words:
                out.append(t)
            elif t == "school" and out[-1:] == ["polytechnic"]:
                continue
            elif t in HEADS and t not in ("group",):
                out.append("?")
                masked = True
            elif t in N.COMPOUNDS:
                out += N.COMPOUNDS[t]
            elif t in N.WORD_OF:
                out.append(N.WORD_OF[t])
            elif t.isdigit():
                continue
            elif t in self.initials:
                out.append(f"={t}")
            else:
                kinds = {N.WORD_OF.get(w, w) for w in self.kind_words.near(t)}
                # a word written twice alike is a place of its own, not a slip
                places = self.proper.near(t) if seen[t] == 1 else ()
                close = [p for p in places if p in exact] or places
                if len(kinds) == 1 and not (len(close) == 1 and N.distance(t, close[0], 2) == 1):
                    k = kinds.pop()
                    out += N.COMPOUNDS.get(k, (k,))
                elif len(close) == 1:
                    out.append(close[0])
                else:
                    out.append("?")
        return out

    def pick(self, key: tuple, raw: str) -> str | None:
        """One of the entries of one name: the one in the country the value names, else the largest."""
        ids = self.by_key[key]
        if len(ids) == 1:
            return ids[0]
        named = self.countries(raw, key[1])
        fit = [i for i in ids if self.country_of[i] in named]
        if not fit and named and all(self.country_of[i] for i in ids):
            return None
        return max(fit or ids, key=lambda i: (self.size[i], i))

    def resolve(self, raw: str | None) -> tuple[str, str, float]:
        """(id or none, how, score)."""
        if not raw or self.empty:
            return NONE, "empty", 0.0
        if (got := self.memo.get(raw)) is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[raw] = self._resolve(raw)
        return got

    def _resolve(self, raw: str) -> tuple[str, str, float]:
        toks = N.tokens(re.sub(r"(?i)electronic address:.*|\S+@\S+", " ", raw))
        text = " " + " ".join(toks) + " "
        for n in self.long_names:  # their words are no part of an organisation's name
            text = text.replace(f" {n} ", " | ") if f" {n} " in text else text
        toks = text.split()
        ws = self.words(toks)
        ids = tuple(self.number.get(w, 0) for w in ws)
        hits = [(n, end - n + 1, key) for end, (n, key) in self.auto.iter(ids)] if ids and self.sought else []
        # a concept beside a match makes it another kind of body ("Medical University of X" is not the University of X)
        hits = [h for h in hits if not (set(ws[max(0, h[1] - 1) : h[1]]) | set(ws[h[1] + h[0] : h[1] + h[0] + 1])) & N.CONCEPTS.keys()]
        spans = sorted(((n, -at, key) for n, at, key in hits), reverse=True)
        if spans:
            hit = self.pick(spans[0][2], raw)
            return (hit, "automaton", 1.0) if hit else (NONE, "country", 0.0)
        return self.similar(ws, raw)

    def similar(self, ws: list[str], raw: str) -> tuple[str, str, float]:
        """Token-set similarity with the entries that share a proper word, or, if they have none, a part without others.

        The score is the likeness of the concepts times the share of the entry's proper words that the value has.
        """
        have = set(ws) - {"|", "?"}
        mine = {x for x in have if x in N.CONCEPTS}
        scored: list[tuple[float, int, tuple]] = []

        def score(concepts: set[str], key: tuple, share: float) -> None:
            scored.append((share * 2 * len(concepts & set(key[0])) / (len(concepts) + len(key[0])), len(key[1]), key))

        if mine:
            for key in {k for w in have for k in self.keys_at.get(w, ())}:
                score(mine, key, len(have & set(key[1])) / len(set(key[1])))
        for part in " ".join(ws).split("|") if self.bodies else ():
            if (own := set(part.split())) and own <= N.CONCEPTS.keys():
                for key in {k for c in own for k in self.bodies.get(c, ())}:
                    score(own, key, 1.0)
        best = max(scored, default=None)
        if best and best[0] >= SIMILAR and (hit := self.pick(best[2], raw)):
            return hit, "similar", best[0]
        return NONE, "unmatched", best[0] if best else 0.0


def read_list(institutions: DataFrame, country_regions: DataFrame) -> tuple[list, list]:
    """The reference list and the countries, on the driver, after a check of their sizes."""
    rows = institutions.select("institution_id", "institution_name", "country_code", F.coalesce("n_works", F.lit(0)).alias("n"))
    rows = rows.where("institution_id is not null").dropDuplicates(["institution_id"]).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    codes = country_regions.where("country_code is not null").select("country_code", "country_name").distinct().limit(MAX_ENTRIES + 1).collect()
    if len(codes) > MAX_ENTRIES:
        raise ValueError(f"the list of countries has more than {MAX_ENTRIES} rows")
    return [tuple(r) for r in sorted(rows)], [tuple(r) for r in codes]


def mapped(values: DataFrame, institutions: DataFrame, country_regions: DataFrame) -> DataFrame:
    """(affil_id, institution_id, method, score) of (affil_id, raw_affiliation)."""
    shared = values.sparkSession.sparkContext.broadcast(read_list(institutions, country_regions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(*shared.value)
        for b in batches:
            got = [canon.resolve(v) for v in b.column(1).to_pylist()]
            cols = list(zip(*got)) if got else [()] * 3
            arrays = [b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64())))]
            yield pa.RecordBatch.from_arrays(arrays, ["affil_id", "institution_id", "method", "score"])

    rows = values.select(F.col("affil_id").cast("bigint").alias("affil_id"), F.col("raw_affiliation").cast("string").alias("v"))
    return rows.mapInArrow(run, "affil_id bigint, institution_id string, method string, score double")


def found(affiliations: DataFrame, institutions: DataFrame, country_regions: DataFrame) -> DataFrame:
    """(affil_id, institution_id) of every string the provider left unresolved."""
    open_ = affiliations.where("n_resolved_institutions = 0 and affil_id is not null")
    return mapped(open_, institutions, country_regions).select("affil_id", "institution_id").distinct()
