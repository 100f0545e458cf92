"""Problem 5: variant spellings of one organisation.

Every spelling is parsed into its proper name (accents, case, blanks and hyphens
removed), its kind of work (a concept, from any abbreviation of it) and nothing
else: departments, addresses and legal forms make no difference.

Distinct proper names meet in a symmetric-delete neighbourhood index: names
within one edit share a key, as does a name and the shortened form of a longer
one.  A key has few owners by construction (words one letter away), so no group
is large.  Candidates are verified by aligning tokens by optimal assignment,
which permits abbreviations, initials and small edits.  Names of several words
have keys of their words in any order too, and are aligned word by word.  A slip is linked to the
written form that most spellings share, a shortened name to the one full name
that it can stand for.  An organisation is then a proper name and a kind; a
spelling without a kind belongs to the only kind of that name, if there is only
one.

The more organisations a table has, the more of them one spelling can mean.  So
each spelling that could be of several is settled by what stands beside it: what
else is written for the same author of the same work, the address, the country.  Only
where these don't decide either, a shortened name of several is not linked.

Defined results: null, empty and unreadable spellings are linked to nothing;
equal spellings are one; a pair stands once, smaller name first by code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm import names as N
from stemma.session import materialize

#: Letters a shortened proper name may lack at its end.
SHORTENED = (2, 3, 4)
#: Shortest proper name that is compared letter by letter.
LEAST_CHARS = 6

# Parts of organisations, and what they are called after.
HEADS = frozenset("department dept faculty school division section chair program programme unit".split())
LABS = frozenset("laboratory laboratories lab labs".split())
DISCIPLINES = frozenset(
    "biology genetics genomics bioinformatics statistics medicine computing computer science sciences data systems cell imaging life".split()
)
# Words between the parts of a name.
LINKS = frozenset("the of for and de di da do du y et und".split())
KINDS = frozenset(
    "analytics clinic hospital robotics observatory biosciences laboratory software foundation seed diagnostics therapeutics "
    "university institute academy center polytechnic".split()
)
_KIND_WORDS = N.Speller({w for w, c in N.WORD_OF.items() if c in KINDS}, 1, 6)


_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑](?=[^\W\d_])")


def _segments(s: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in N.tokens(_HYPHEN.sub("", s)):
        if t == "|":
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def _is_part(seg: list[str]) -> bool:
    """Whether a segment names a department rather than an organisation."""
    if seg[0] in HEADS:
        return True
    if seg[0] in LABS:
        rest = [t for t in seg[1:] if t not in LINKS]
        return any(t in DISCIPLINES for t in rest)
    return False


def parse(s: str | None) -> tuple[str, str, str, str]:
    """(proper, kind, tokens, address) of a spelling; empty strings where there is none, bars between the parts of an address."""
    segs = _segments(s or "")
    while len(segs) > 1 and _is_part(segs[0]):
        segs = segs[1:]
    if not segs:
        return "", "", "", ""
    toks = segs[0]
    proper, kind = [], []
    i = 0
    while i < len(toks):
        t = toks[i]
        if t == "bio" and i + 1 < len(toks) and toks[i + 1].startswith("sci"):
            kind.append("biosciences")
            i += 2
            continue
        i += 1
        if t in LINKS or t in N.LEGAL or t.isdigit():
            continue
        c = N.WORD_OF.get(t)
        if c is None and len(t) >= 6:
            near = {N.WORD_OF[w] for w in _KIND_WORDS.near(t)}
            c = near.pop() if len(near) == 1 else None
        if c in KINDS:
            kind.append(c)
        elif c not in ("company", "group"):
            proper.append(t)
    address = [" ".join(t for t in seg if not t.isdigit()) for seg in segs[1:] if not all(t in N.LEGAL for t in seg)]
    return "".join(proper), " ".join(sorted(set(kind))), " ".join(proper), "|".join(filter(None, address))


def token_cost(a: str, b: str) -> float:
    """0 for equal tokens, a little for an abbreviation, an initial or one slip, 1 for different ones."""
    if a == b:
        return 0.0
    x, y = sorted((a, b), key=len)
    if N.WORD_OF.get(x) and N.WORD_OF.get(x) == N.WORD_OF.get(y):
        return 0.05
    if len(x) == 1 and y.startswith(x):
        return 0.2
    if len(x) >= LEAST_CHARS and len(y) - len(x) <= SHORTENED[-1] and y.startswith(x):
        return 0.2
    if len(x) >= 3 and N.distance(x, y, 1) <= 1:
        return 0.2
    if len(x) >= LEAST_CHARS and any(N.distance(x, y[:-k], 1) <= 1 for k in SHORTENED if len(y) - k >= LEAST_CHARS):
        return 0.3
    return 1.0


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in the assignment of least cost (rows <= columns), by shortest augmenting paths."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, row = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)  # row[j]: the row of column j, from 1
    for i in range(1, n + 1):
        row[0], j = i, 0
        least, via, done = [9e9] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row[j]:
            done[j] = True
            r, step, to = row[j], 9e9, 0
            for k in range(1, m + 1):
                if not done[k]:
                    c = cost[r - 1][k - 1] - u[r] - v[k]
                    if c < least[k]:
                        least[k], via[k] = c, j
                    if least[k] < step:
                        step, to = least[k], k
            for k in range(m + 1):
                if done[k]:
                    u[row[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = to
        while j:
            row[j] = row[via[j]]
            j = via[j]
    out = [0] * n
    for j in range(1, m + 1):
        if row[j]:
            out[row[j] - 1] = j - 1
    return out


def joined(x: tuple[str, ...]) -> list[tuple[str, ...]]:
    """A token list, and those with two neighbours written in one word."""
    return [x, *((*x[:i], x[i] + x[i + 1], *x[i + 2 :]) for i in range(len(x) - 1))]


@N.Memo
def align(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Mean cost of the best assignment of the shorter token list to the longer; tokens left over cost 1.

    Neighbouring tokens may be joined first, as names are written in one word or two.
    """

    def best(x: tuple[str, ...], y: tuple[str, ...]) -> float:
        if len(x) > len(y):
            x, y = y, x
        cost = [[token_cost(t, u) for u in y] for t in x]
        return (sum(c[j] for c, j in zip(cost, assign(cost))) + len(y) - len(x)) / max(1, len(y))

    return min(best(x, y) for x in joined(a) for y in joined(b))


#: Stands for words that don't mean the same; above what any number of slips comes to.
UNLIKE = 9


def word_slips(t: str, u: str, short: bool, most: int) -> int:
    """Slips between two words; with ``short``, ``t`` may also be the initial or the shortened form of ``u``."""
    if t == u or (N.WORD_OF.get(t) and N.WORD_OF.get(t) == N.WORD_OF.get(u)):
        return 0
    e = UNLIKE
    if min(len(t), len(u)) >= 3:
        e = min(e, N.distance(t, u, 1) if N.distance(t, u, 1) <= 1 else UNLIKE)
        if most > 1 and e == UNLIKE and min(len(t), len(u)) >= LEAST_CHARS and two_slips(t, u):
            e = 2
    if short and len(t) == 1 and u.startswith(t):
        return 0
    if short and len(t) >= LEAST_CHARS:
        e = min([e, *(N.distance(t, u[:-k], 1) for k in SHORTENED if len(u) - k >= LEAST_CHARS and N.distance(t, u[:-k], 1) <= 1)])
    return e if e <= most else UNLIKE


@N.Memo
def slips(a: tuple[str, ...], b: tuple[str, ...], short: bool = False, most: int = 1) -> int:
    """Least slips between names of several words in any order, every word of one standing for a word of the other.

    ``UNLIKE`` where a word is left over or stands for none, or more than ``most`` slips are needed.
    """
    out = UNLIKE
    for x in joined(a):
        for y in joined(b):
            if len(x) == len(y) > 1:
                cost = [[word_slips(t, u, short, most) for u in y] for t in x]
                cost = [[c if c < UNLIKE else UNLIKE * len(x) for c in r] for r in cost]
                out = min(out, sum(r[j] for r, j in zip(cost, assign(cost))))
    return out if out <= most else UNLIKE


def initialled(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether names of as many words both have an initial, so that another letter is another word, not a slip."""
    return len(a) == len(b) > 1 and min(map(len, a)) == 1 == min(map(len, b))


def parsed(spellings: DataFrame) -> DataFrame:
    """(name, proper, kind, tokens, address) of the distinct names of ``spellings``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(parse, b.column(0).to_pylist()))) if b.num_rows else [()] * 4
            arrays = [b.column(0), *(pa.array(c, pa.string()) for c in cols)]
            yield pa.RecordBatch.from_arrays(arrays, ["name", "proper", "kind", "tokens", "address"])

    return spellings.mapInArrow(run, "name string, proper string, kind string, tokens string, address string")


def two_slips(a: str, b: str) -> bool:
    """Whether two names are two edits apart as two slips would leave them.

    Where all that differs is one or two letters next to one another that stand
    for as many others, the names are different ones (a changed syllable).
    """
    if N.distance(a, b, 2) > 2:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return not (len(x) == len(y) <= 3 and sum(c != d for c, d in zip(x, y)) <= 2)


#: The ``cut`` of a key that pairs initials with the words they begin.
INITIAL = -1


def word_keys(split: str, most: int, full: bool, short: bool) -> set[tuple[str, int]]:
    """(key, cut) of a name of several words, its words in alphabetical order: the keys of one name hold all its words.

    Up to ``most`` letters of it are deleted.  With ``full``, keys of its shortened
    forms too: one word that lacks letters at its end, or every word by its first
    letters.  A name with initials and the written-out one (``full``) share
    a word and the first letters of all.
    """
    out: set[tuple[str, int]] = set()
    for words in joined(tuple(split.split())):
        ws = [N.WORD_OF.get(w, w) for w in words]
        if len(ws) < 2:
            continue

        def put(i: int, w: str, cut: int, ws: list[str] = ws) -> None:
            out.add((" ".join(sorted([*ws[:i], w, *ws[i + 1 :]])), cut))

        first = " ".join(sorted(w[0] for w in ws))
        for i, w in enumerate(ws):
            once = N.deletes(w, 1) if len(w) >= 3 else {w}
            for d in once if most else {w}:
                put(i, d, 0)
            if most > 1:
                if len(w) >= LEAST_CHARS:
                    for d in N.deletes(w, 2):
                        put(i, d, 0)
                for j in range(i):
                    two = N.deletes(ws[j], 1) if len(ws[j]) >= 3 else {ws[j]}
                    for d in once:
                        for e in two:
                            put(i, d, 0, [*ws[:j], e, *ws[j + 1 :]])
            if full:
                for cut in SHORTENED:
                    if len(w) - cut >= LEAST_CHARS:
                        for d in N.deletes(w[:-cut], 1 if cut == 3 else 0):
                            put(i, d, cut)
            if len(w) > 1 and (full or (short and min(map(len, ws)) == 1)):
                out |= {(f"{first} . {d}", INITIAL) for d in {*once, w[:LEAST_CHARS]}}
        if full or short:
            out.add((" ".join(sorted(w[:LEAST_CHARS] for w in ws)) + " .", INITIAL))
    return out


def _keys(forms: DataFrame, truncated: bool, most: int = 1, short: bool = False) -> DataFrame:
    """(key, proper, n, splits, cut): the symmetric deletes of each proper name and of its shortened forms.

    Names of several words have keys of their words in any order besides, which hold blanks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, n, splits in zip(*(b.column(i).to_pylist() for i in range(3))):
                for cut in (0, *SHORTENED) if truncated else (0,):
                    part = p[: len(p) - cut]
                    if len(part) >= LEAST_CHARS:
                        rows += [(d, p, n, splits, cut) for d in N.deletes(part, most if cut in (0, 3) else 0)]
                for split in splits:
                    rows += [(d, p, n, splits, cut) for d, cut in word_keys(split, most, truncated, short)]
            cols = list(zip(*rows)) if rows else [()] * 5
            types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["key", "proper", "n", "splits", "cut"])

    return forms.select("proper", "n", "splits").mapInArrow(run, "key string, proper string, n bigint, splits array<string>, cut int")


def _edits(p: str, q: str, cut: int, ps: list[str], qs: list[str], two: bool) -> int:
    """Edits between names joined to one word, or word by word; ``UNLIKE`` where neither fits."""
    a = [tuple(x.split()) for x in ps] or [(p,)]
    b = [tuple(x.split()) for x in qs] or [(q,)]
    e = UNLIKE
    if cut >= 0 and min(len(p), len(q)) >= LEAST_CHARS and not any(initialled(x, y) for x in a for y in b):
        if two:
            e = 1 if two_slips(p, q) else UNLIKE
        elif align((p,), (q,)) < 0.5:
            e = N.distance(p, q[: len(q) - cut], 1)
    for x in a:
        for y in b:
            if e and (two or align(x, y) < 0.5):
                k = slips(x, y, cut != 0, 2 if two else 1)
                e = min(e, 1 if two and k <= 2 else k)
    return e


def _verified(pairs: DataFrame, two: bool = False) -> DataFrame:
    """Candidate pairs (p, q, cut, ps, qs, ...) whose tokens align; adds ``edits`` between p and q cut by ``cut`` letters.

    With ``two``, pairs two slips apart are let through instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = [_edits(*r, two) for r in zip(*(b.column(i).to_pylist() for i in range(5)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(e, pa.int32())], [*b.schema.names, "edits"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{schema}, edits int").where("edits <= 1")


def _splits(own: Column) -> Column:
    """The distinct token lists of several words; few, as all are one proper name parted by blanks."""
    return F.sort_array(F.collect_set(F.when(own & F.contains("tokens", F.lit(" ")), F.col("tokens")))).alias("splits")


def _heads(rows: DataFrame, link: DataFrame) -> DataFrame:
    """(r, kinds, n, splits): the kinds, the number of spellings and the ways to part the words of each root."""
    named = rows.join(link.withColumnRenamed("p", "proper"), "proper")
    kinds = F.collect_set(F.nullif("kind", F.lit("")))  # of a fixed list, so bounded
    return materialize(named.groupBy("r").agg(kinds.alias("kinds"), F.count("*").alias("n"), _splits(F.col("proper") == F.col("r"))), "heads")


def _fitting(cand: DataFrame, heads: DataFrame) -> DataFrame:
    """Candidates whose kinds have one in common, or one of which has none."""
    hk = heads.select("r", "kinds")
    both = cand.join(hk.toDF("p", "kp"), "p").join(hk.toDF("q", "kq"), "q")
    return both.where(F.arrays_overlap("kp", "kq") | (F.size("kp") == 0) | (F.size("kq") == 0))


def _neighbours(keys: DataFrame) -> DataFrame:
    """(p, q, cut, ps, qs, np, nq) of the names that share a key."""
    a = keys.select("key", F.col("proper").alias("p"), F.col("n").alias("np"), F.col("splits").alias("ps"))
    b = keys.select("key", F.col("proper").alias("q"), F.col("n").alias("nq"), F.col("splits").alias("qs"))
    return a.join(b, "key").where("p <> q").select("p", "q", F.lit(0).alias("cut"), "ps", "qs", "np", "nq").distinct()


def roots(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proper, root): the written-out proper name that each proper name stands for; and (proper, root): all that it could stand for."""
    forms = rows.groupBy("proper").agg(F.count("*").alias("n"), _splits(F.lit(True)))
    forms = materialize(forms.where((F.length("proper") >= LEAST_CHARS) | (F.size("splits") > 0)), "forms")
    # slips: to the neighbour within one edit that most spellings have
    near = _neighbours(_keys(forms, False)).where("nq > np or (nq = np and q < p)")
    once = materialize(_verified(near).select("p", "q", "nq"), "near")
    best = once.groupBy("p").agg(F.max(F.struct("nq", F.col("q").alias("q"))).alias("m")).select("p", F.col("m.q").alias("q"))
    link = materialize(forms.select(F.col("proper").alias("p")).join(best, "p", "left").select("p", F.coalesce("q", "p").alias("r")), "slips")
    slipped = link = _settle(link)
    # two slips, however often they were made: to the neighbour that most spellings have, as with one slip
    heads = _heads(rows, link)
    near = _neighbours(_keys(heads.withColumnRenamed("r", "proper"), False, 2)).where("nq > np or (nq = np and q < p)")
    twice = materialize(_fitting(_verified(near, True), heads).select("p", "q", "nq"), "near")
    best = twice.groupBy("p").agg(F.max(F.struct("nq", F.col("q").alias("q"))).alias("m")).select(F.col("p").alias("r"), F.col("m.q").alias("up"))
    link = _settle(materialize(link.join(best, "r", "left").select("p", F.coalesce("up", "r").alias("r")), "twice"))
    # shortened names: to the only full name of a fitting kind
    heads = _heads(rows, link)
    full = _keys(heads.withColumnRenamed("r", "proper"), True).where("cut <> 0").select("key", F.col("proper").alias("q"), F.col("splits").alias("qs"), "cut")
    short = _keys(forms, False, short=True).select("key", F.col("proper").alias("p"), F.col("splits").alias("ps"))
    cand = short.join(full, "key").where("p <> q and length(q) > length(p)").select("p", "q", "cut", "ps", "qs").distinct()
    cut = materialize(_verified(cand).groupBy("p", "q").agg(F.min("edits").alias("edits")), "cut")
    exact = _fitting(cut, heads).select("p", "q", "edits")
    w = Window.partitionBy("p")
    exact = exact.withColumn("least", F.min("edits").over(w)).where("edits = least").withColumn("k", F.count("*").over(w))
    up = exact.where("k = 1").select(F.col("p").alias("r"), F.col("q").alias("up"))
    last = _settle(materialize(link.join(up, "r", "left").select("p", F.coalesce("up", "r").alias("r")), "short"))
    # what a name could stand for: what it, or what it is a slip of, is next to or shortened from
    alts = once.select("p", "q").unionAll(twice.select("p", "q")).unionAll(cut.select("p", "q"))
    for by in (slipped, link):
        alts = alts.unionAll(by.where("p <> r").join((twice if by is slipped else cut).selectExpr("p as r", "q"), "r").select("p", "q"))
    alts = alts.join(last.selectExpr("p as q", "r"), "q").select("p", "r").unionAll(last).distinct()
    return last.toDF("proper", "root"), materialize(alts.toDF("proper", "root"), "alts")


def _settle(link: DataFrame) -> DataFrame:
    """Follows p -> r until nothing changes; each round doubles the reach, and links only lead to better names, so none goes in a circle."""
    while True:
        onward = link.select(F.col("p").alias("r"), F.col("r").alias("next"))
        link = materialize(link.join(onward, "r", "left").select("p", F.coalesce("next", "r").alias("r")), "settle")
        far = link.join(link.select(F.col("p").alias("r"), F.col("r").alias("next")), "r").where("next <> r")
        if far.isEmpty():
            return link


def organisations(spellings: DataFrame, together: DataFrame | None = None, countries: DataFrame | None = None) -> DataFrame:
    """(name, root, kind) of every readable name: spellings with equal root and kind mean one organisation.

    ``together`` has pairs (a, b) of names that stand for one thing if they are alike, as ``written_together`` gives,
    ``countries`` the codes (name, code) recorded beside names.
    """
    distinct = spellings.select(F.col("name").cast("string").alias("name")).where("name is not null").distinct()
    rows = materialize(parsed(distinct).where(F.length("proper") >= 1), "spellings")
    link, alts = roots(rows)
    rooted = rows.join(link, "proper", "left").withColumn("root", F.coalesce("root", "proper"))
    rooted = materialize(rooted.select("name", "root", "kind"), "rooted")
    known = rooted.where("kind <> ''").groupBy("root").agg(F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    only = known.where("lo = hi").select("root", F.col("lo").alias("only"))
    filled = F.when(F.col("kind") == "", F.coalesce("only", F.lit(""))).otherwise(F.col("kind"))
    first = materialize(rooted.join(only, "root", "left").select("name", "root", filled.alias("kind")), "first")
    part = rows.where("address <> ''").select("name", F.explode(F.split("address", r"\|")).alias("part"))
    if countries is not None:
        part = part.unionAll(countries.select("name", F.lower(F.trim("code"))).where("code is not null")).distinct()
    return _by_surroundings(rows, first, alts, together, materialize(part, "parts"))


def _by_surroundings(rows: DataFrame, first: DataFrame, alts: DataFrame, together: DataFrame | None, part: DataFrame) -> DataFrame:
    """``first`` with each name that could be of several organisations in the one that its surroundings speak for.

    That is the one that most names written beside it could be of too, then the one
    with most parts (name, part) of its address or of theirs.  A name stays where it
    is unless one other has more of these.
    """
    named = rows.select("name", "proper", F.col("kind").alias("own"))
    groups = first.select("root", "kind").distinct()
    could = named.join(alts, "proper").join(groups, "root").where("own = '' or own = kind")
    could = could.select("name", "root", "kind", F.lit(0).alias("now")).unionAll(first.withColumn("now", F.lit(1)))
    could = materialize(could.groupBy("name", "root", "kind").agg(F.max("now").alias("now")), "could")
    doubt = could.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name")
    if together is None:
        together = doubt.select(F.col("name").alias("a"), F.col("name").alias("b")).limit(0)
    both = together.where("a <> b").unionAll(together.where("a <> b").select("b", "a")).distinct()
    both = materialize(both.toDF("name", "other").join(doubt, "name", "left_semi"), "together")
    open_ = materialize(could.join(doubt, "name"), "doubt")
    # names beside it that could be of the same organisation
    beside = open_.join(both, "name").join(could.selectExpr("name as other", "root", "kind"), ["other", "root", "kind"])
    votes = beside.groupBy("name", "root", "kind").agg(F.countDistinct("other").alias("votes"))
    # parts of the address, of names that have no other choice
    sure = first.join(doubt, "name", "left_anti")
    places = sure.join(part, "name").select("root", "kind", "part").distinct()
    said = beside.select("name", "other").distinct().join(part.withColumnRenamed("name", "other"), "other").select("name", "part")
    said = said.unionAll(part).distinct()
    parts = open_.select("name", "root", "kind").join(said, "name").join(places, ["root", "kind", "part"])
    parts = parts.groupBy("name", "root", "kind").agg(F.count("*").alias("parts"))
    on = ["name", "root", "kind"]
    score = open_.join(votes, on, "left").join(parts, on, "left").fillna(0, ["votes", "parts"])
    w = Window.partitionBy("name")
    score = score.withColumn("s", F.struct("votes", "parts", "now")).withColumn("most", F.max("s").over(w)).where("s = most")
    best = score.withColumn("k", F.count("*").over(w)).where("k = 1").selectExpr("name", "root as r", "kind as k")
    out = first.join(best, "name", "left")
    return materialize(out.select("name", F.coalesce("r", "root").alias("root"), F.coalesce("k", "kind").alias("kind")), "organisations")


def countries_of(authorship: DataFrame) -> DataFrame:
    """(name, code): the country codes recorded with names without a registry id, as written."""
    a = authorship.where("institution_id is null and institution_name is not null and country_code is not null")
    return a.select(F.col("institution_name").alias("name"), F.col("country_code").alias("code")).distinct()


def written_together(authorship: DataFrame, affiliations: DataFrame) -> DataFrame:
    """(a, b): the only name without a registry id in either table at one place of the list of authors of one work."""
    at = ["work_id", "author_order"]
    a = authorship.where("institution_id is null").groupBy(*at).agg(F.min("institution_name").alias("a"), F.max("institution_name").alias("a2"))
    b = affiliations.where("n_resolved_institutions = 1 and resolved_institution_id is null")
    b = b.groupBy(*at).agg(F.min("raw_affiliation").alias("b"), F.max("raw_affiliation").alias("b2"))
    return a.where("a = a2").join(b.where("b = b2"), at).select("a", "b").distinct()


def spellings_of(authorship: DataFrame, affiliations: DataFrame) -> DataFrame:
    """The names without a registry id: (name) of both tables, each once."""
    a = authorship.where("institution_id is null and institution_name is not null").select(F.col("institution_name").alias("name"))
    b = affiliations.where("n_resolved_institutions = 1 and resolved_institution_id is null and raw_affiliation is not null")
    return a.unionAll(b.select(F.col("raw_affiliation").alias("name"))).distinct()


def pairs(orgs: DataFrame) -> DataFrame:
    """(name_a, name_b) of the names of each organisation."""
    a = orgs.withColumnRenamed("name", "name_a")
    b = orgs.withColumnRenamed("name", "name_b")
    return a.join(b, ["root", "kind"]).where("name_a < name_b").select("name_a", "name_b")
