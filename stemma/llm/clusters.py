"""Problem 6: groups of like records, their size and typical members, and labels put right.

A record's words and word pairs (title counted ``TITLE_WEIGHT`` times; accents
are dropped, as some texts have lost them) are weighted by how unevenly a term
spreads over the recorded clusters (its divergence from their base rates,
squared; inverse document frequency where nothing is recorded), and hashed to
``DIM`` signs each, which gives a unit vector.  The vectors are dealt by a hash of
their id to one cluster-feature tree for about ``TREE_ROWS`` of them: inner nodes
of at most ``BRANCH`` entries over leaves of as many, each entry with count,
linear sum, squared sum and vote counts.  A vector descends to the nearest entry
at every level and joins a leaf entry within reach, if the joint radius stays
within it too, or founds one; full nodes are split by their farthest pair.  A tree of more than ``LEAVES`` leaf
entries is built anew from them with a wider reach.  The trees are merged by the same insertion in
rounds until few entries remain, which are agglomerated by Ward's criterion.
Each group is named by the votes of its members' recorded clusters; then one pass
assigns every record to the nearest centroid, and the members nearest to each
centroid describe it.  Dealing and order are by hash and id, so the result is the
same on any number of executors.

Statistics cover all records.  What is broadcast are the terms that at least
``MIN_SHARE`` of all records hold (at most mean terms per record / MIN_SHARE)
and one centroid per cluster.  Records none of whose terms is weighted are
assigned by their rarer terms, by a join (``by_rare_terms``).

Defined results: records without title and abstract are assigned to no cluster
and give no rows; repeated rows count once; a record of which no term says
anything keeps its recorded cluster, or belongs to the largest (where nothing is
recorded at all, it has no row).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.session import materialize
from stemma.tables import latest_works

DIM = 128
TITLE_WEIGHT = 3
MIN_SHARE, MIN_WORKS = 0.001, 5
LEAST_DIVERGENCE = 0.3
#: Leaves of one tree, and leaves that Ward's agglomeration starts from.
LEAVES, WARD_LEAVES = 256, 1024
#: Entries of a node, entries of a level below which a descent goes on, and vectors dealt to one tree.
BRANCH, PATHS, TREE_ROWS = 24, 6, 10_000
#: Squared distance within which a vector joins a leaf entry, and what it grows by whenever a tree is full.
REACH, WIDER = 0.4, 1.2
#: By how much another centroid must be nearer before a recorded cluster is overruled.
MARGIN = 0.05
#: Terms beyond this many are refused rather than broadcast.
MAX_TERMS = 1_000_000


# Letters with accents, and what they are without.
_ACCENTED, _PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"


def terms_of(text: str) -> str:
    """SQL: words (letters of any script, Han letters by themselves, three or more) and pairs of neighbours of a text column."""
    plain = f"translate(lower(regexp_replace(coalesce({text}, ''), '<[^>]*>', ' . ')), '{_ACCENTED}', '{_PLAIN}')"
    words = f"regexp_extract_all({plain}, r'([\\p{{L}}\\p{{M}}&&[^\\p{{IsHan}}]]{{3,}}|\\p{{IsHan}}{{3,}})', 1)"
    return f"transform(array({words}), w -> concat(w, transform(slice(w, 2, greatest(size(w) - 1, 0)), (x, i) -> concat(get(w, i), ' ', x))))[0]"


def texts(works: DataFrame, topics: DataFrame) -> DataFrame:
    """(work_id, recorded, title terms, abstract terms); recorded is null where none or several are recorded."""
    w = latest_works(works.select("work_id", "title", "abstract", "loaded_at"))
    t = topics.where("work_id is not null").groupBy("work_id").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"))
    t = t.select("work_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("recorded"), F.lit(True).alias("listed"))
    d = w.join(t, "work_id", "left").where("coalesce(trim(title), '') <> '' or coalesce(trim(abstract), '') <> ''")
    return d.select(
        "work_id", "recorded", F.coalesce("listed", F.lit(False)).alias("listed"),
        F.expr(terms_of("title")).alias("tt"), F.expr(terms_of("abstract")).alias("ta"),
    )


def _terms() -> Column:
    return F.explode(F.array_distinct(F.concat("tt", "ta"))).alias("term")


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, recorded, k): how many records of each recorded cluster hold each term; written once."""
    each = docs.where("recorded is not null").select("recorded", _terms())
    return materialize(each.groupBy("term", "recorded").agg(F.count("*").alias("k")), "counts")


def term_weights(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, weight) over all records."""
    base = docs.where("recorded is not null").groupBy("recorded").agg(F.count("*").alias("n"))
    labelled = base.agg(F.sum("n")).first()[0] or 0
    total = docs.count()
    least = max(MIN_WORKS, int(total * MIN_SHARE))
    if not labelled:
        df = docs.select(_terms()).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        return df.select("term", F.round(F.log(F.lit(float(max(total, 2))) / F.col("n")), 9).alias("weight")).where("weight > 0")
    n = counts.groupBy("term").agg(F.sum("k").alias("n")).where(F.col("n") >= least)
    b = base.select("recorded", (F.col("n") / labelled).alias("b"))
    c = counts.join(n, "term").join(F.broadcast(b), "recorded")  # one row per cluster
    p = (F.col("k") + 3 * F.col("b")) / (F.col("n") + 3)
    rest = 3 / (F.col("n") + 3)
    kl = c.groupBy("term", "n").agg(F.sum(p * F.log(p / F.col("b"))).alias("s"), F.sum("b").alias("b"))
    kl = kl.withColumn("kl", F.col("s") + F.greatest(F.lit(0.0), 1 - F.col("b")) * rest * F.log(rest))
    return kl.where(F.col("kl") > LEAST_DIVERGENCE).select("term", F.round(F.col("kl") * F.col("kl"), 9).alias("weight"))


def signs(terms: list[str]) -> np.ndarray:
    """A row of DIM signs for each term, from its hash."""
    raw = b"".join(hashlib.blake2b(t.encode(), digest_size=DIM // 8).digest() for t in terms)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(len(terms), DIM)
    return (bits.astype(np.int8) * 2 - 1) if terms else np.zeros((0, DIM), np.int8)


def vectors(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(work_id, recorded, listed, v): unit vectors of all records; v is null where a record holds no weighted term."""
    rows = weights.limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    shared = docs.sparkSession.sparkContext.broadcast(sorted((r.term, float(r.weight)) for r in rows))

    def bare(b: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        cols = [b.column(c).take(pa.array(rows, pa.int64())) for c in ("work_id", "recorded", "listed")]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(rows), pa.list_(pa.float32()))], ["work_id", "recorded", "listed", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([t for t, _ in shared.value], pa.string())
        weight, sign = np.array([w for _, w in shared.value], np.float32), signs([t for t, _ in shared.value]).astype(np.float32)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                keys, counts = [], []
                for name, by in (("tt", TITLE_WEIGHT), ("ta", 1)):
                    lists = b.column(name)
                    term = pc.index_in(lists.flatten(), value_set=known)
                    hit = np.flatnonzero(pc.is_valid(term).to_numpy(zero_copy_only=False))
                    owner = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))[hit]
                    keys.append(owner * max(1, len(known)) + term.take(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64))
                    counts.append(np.full(len(hit), by, np.float32))
                key, back = np.unique(np.concatenate(keys), return_inverse=True)
                if not len(key):
                    yield bare(b, np.arange(b.num_rows))
                    continue
                n = np.bincount(back, np.concatenate(counts)).astype(np.float32)
                owner, term = np.divmod(key, len(known))
                rows, first = np.unique(owner, return_index=True)
                v = np.add.reduceat((np.log1p(n) * weight[term])[:, None] * sign[term], first, axis=0)
                size = np.sqrt((v * v).sum(1))
                rows, v = rows[size > 0], v[size > 0] / size[size > 0][:, None]
                sel = pa.array(rows)
                flat = pa.array(v.astype(np.float32).ravel(), pa.float32())
                vs = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * DIM, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(sel) for c in ("work_id", "recorded", "listed")), vs], ["work_id", "recorded", "listed", "v"])
                if len(rows) < b.num_rows:
                    yield bare(b, np.setdiff1d(np.arange(b.num_rows), rows))

    return docs.mapInArrow(run, "work_id string, recorded int, listed boolean, v array<float>")


def _distances(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (m * m).sum(1)[:, None] - 2 * m @ c.T + (c * c).sum(1)[None]


class Node:
    """Entries with count, linear sum and squared sum; below each a node, or, in a leaf, its votes per recorded cluster."""

    def __init__(self, below: list, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, leaf: bool) -> None:
        self.below, self.n, self.ls, self.ss, self.leaf = below, n, ls, ss, leaf

    @classmethod
    def over(cls, nodes: list[Node]) -> Node:
        """The inner node over ``nodes``."""
        sums = [(x.n.sum(), x.ls.sum(0), x.ss.sum()) for x in nodes]
        return cls(nodes, np.array([s[0] for s in sums]), np.array([s[1] for s in sums]), np.array([s[2] for s in sums]), False)

    def mean(self) -> np.ndarray:
        return self.ls / self.n[:, None]

    def part(self, at: np.ndarray) -> Node:
        return Node([self.below[i] for i in at], self.n[at], self.ls[at], self.ss[at], self.leaf)

    def parts(self) -> list[Node]:
        """The node itself, or, with more than BRANCH entries, what it is split into, each time by the farthest pair."""
        if len(self.n) <= BRANCH:
            return [self]
        m = self.mean()
        d = _distances(m, m)
        i, j = divmod(int(d.argmax()), len(d))
        second = d[j] < d[i]
        if second.all() or not second.any():  # entries all alike
            second = np.arange(len(d)) >= len(d) // 2
        return [p for half in (~second, second) for p in self.part(np.flatnonzero(half)).parts()]


class Tree:
    """A cluster-feature tree of at most ``leaves`` leaf entries."""

    def __init__(self, reach: float = REACH, leaves: int = LEAVES) -> None:
        self.reach, self.most = reach, leaves
        self.root = Node([], np.zeros(0), np.zeros((0, DIM)), np.zeros(0), True)

    def insert(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, votes: list[dict[int, float]]) -> None:
        """Adds features: records (count 1, their vector, its square), or leaf entries of another tree."""
        for start in range(0, len(n), 256):
            part = slice(start, start + 256)
            self._add(n[part], ls[part], ss[part], votes[part])
            while (leaf := self.leaves())[0].size > self.most:
                self.reach *= WIDER
                self.root = Node([], np.zeros(0), np.zeros((0, DIM)), np.zeros(0), True)
                order = np.argsort(-leaf[0], kind="stable")  # greatest entries first
                for at in np.array_split(order, -(-len(order) // 64)):
                    self._add(leaf[0][at], leaf[1][at], leaf[2][at], [leaf[3][i] for i in at])

    def _add(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, votes: list[dict[int, float]]) -> None:
        mean = ls / n[:, None]
        leaves, where, entry, least = self._nearest(mean)
        founded: list[tuple[Node, int]] = []  # by rows of this batch
        centres = np.zeros((0, DIM))
        for i, far in enumerate((least > self.reach).tolist()):
            leaf, k = leaves[where[i]], int(entry[i])
            if far and founded:
                d = ((centres - mean[i]) ** 2).sum(1)
                if d.min() <= self.reach:
                    (leaf, k), far = founded[int(d.argmin())], False
            if far:
                founded.append((leaf, len(leaf.n)))
                centres = np.vstack([centres, mean[i]])
                leaf.n, leaf.ls, leaf.ss = np.append(leaf.n, n[i]), np.vstack([leaf.ls, ls[i]]), np.append(leaf.ss, ss[i])
                leaf.below.append(dict(votes[i]))
                continue
            leaf.n[k] += n[i]
            leaf.ls[k] += ls[i]
            leaf.ss[k] += ss[i]
            for c, v in votes[i].items():
                leaf.below[k][c] = leaf.below[k].get(c, 0) + v
        nodes = self._summed(self.root)
        while len(nodes) > 1:
            nodes = Node.over(nodes).parts()
        self.root = nodes[0]

    def _nearest(self, mean: np.ndarray) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray]:
        """The leaves, and for each row its leaf, the nearest entry there and the squared distance.

        All rows descend together; at each level a row goes on below its ``PATHS`` nearest entries, as
        the nearest one alone often misleads where distances differ little.
        """
        level = [self.root]
        on = np.zeros((len(mean), 1), int)  # the nodes of the level that each row is at
        while True:
            sizes = [len(x.n) for x in level]
            first = np.concatenate([[0], np.cumsum(sizes)])
            d = np.full((len(mean), max(1, first[-1])), np.inf)
            for k, x in enumerate(level):
                rows = np.flatnonzero((on == k).any(1))
                if len(rows) and sizes[k]:
                    d[rows, first[k] : first[k + 1]] = _distances(mean[rows], x.mean())
            if level[0].leaf:
                best = d.argmin(1)
                where = np.clip(np.searchsorted(first, best, "right") - 1, 0, len(level) - 1)
                return level, where, best - first[where], d[np.arange(len(mean)), best]
            level = [c for x in level for c in x.below]
            on = np.argsort(d, 1, kind="stable")[:, :PATHS]

    def _summed(self, node: Node) -> list[Node]:
        """The node with the sums of what is below it now, or what it is split into."""
        if node.leaf:
            return node.parts()
        return Node.over([p for c in node.below for p in self._summed(c)]).parts()

    def leaves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict[int, float]]]:
        """Count, linear sum, squared sum and votes of all leaf entries."""
        level = [self.root]
        while not level[0].leaf:
            level = [c for x in level for c in x.below]
        cat = lambda name: np.concatenate([getattr(x, name) for x in level])
        return cat("n"), cat("ls"), cat("ss"), [v for x in level for v in x.below]

    def batch(self, number: int) -> pa.RecordBatch:
        return _entries(*self.leaves(), number)


def joined(group: np.ndarray, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, votes: list[dict[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict[int, float]]]:
    """The features of each group's entries added up."""
    names, at = np.unique(group, return_inverse=True)
    total = np.zeros((len(names), ls.shape[1]))
    np.add.at(total, at, ls)
    tally: list[dict[int, float]] = [{} for _ in names]
    for k, v in zip(at.tolist(), votes):
        for c, x in v.items():
            tally[k][c] = tally[k].get(c, 0) + x
    return np.bincount(at, n), total, np.bincount(at, ss), tally


def _entries(n: np.ndarray, ls: np.ndarray, ss: np.ndarray, votes: list[dict[int, float]], number: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(n), number), pa.int32()), pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.float64()),
         pa.array(list(ls), pa.list_(pa.float64())), pa.array(ss, pa.float64()),
         pa.array([sorted(v.items()) for v in votes], pa.map_(pa.int32(), pa.float64()))],
        ["tree", "leaf", "n", "ls", "ss", "votes"],
    )


_LEAF = "tree int, leaf int, n double, ls array<double>, ss double, votes map<int,double>"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM)


def leaves(vecs: DataFrame) -> DataFrame:
    """The leaf entries of the trees, merged in rounds until at most WARD_LEAVES remain."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree()
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                votes = [{} if c is None else {c: 1.0} for c in b.column("recorded").to_pylist()]
                tree.insert(np.ones(len(x)), x, (x * x).sum(1), votes)
        yield tree.batch(TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # at most a few trees
        if held:
            n, ss = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("n", "ss"))
            ls = np.concatenate([_matrix(b.column("ls")) for b in held])
            votes = [dict(v) for b in held for v in b.column("votes").to_pylist()]
            yield _entries(*joined(ward(n, ls / n[:, None], LEAVES), n, ls, ss, votes), TaskContext.get().partitionId())

    dealt = vecs.repartition(max(1, -(-vecs.count() // TREE_ROWS)), "work_id").sortWithinPartitions("work_id")
    out = materialize(dealt.select("recorded", "v").mapInArrow(grow, _LEAF), "leaves")
    while (k := out.count()) > WARD_LEAVES:
        few = max(1, k // (4 * LEAVES))
        out = materialize(out.repartition(few, F.col("tree") % few).sortWithinPartitions("tree", "leaf").mapInArrow(merge, _LEAF), "leaves")
    return out


def ward(n: np.ndarray, mean: np.ndarray, k: int) -> np.ndarray:
    """Group numbers of weighted points, agglomerated by least increase of the squared error down to k groups.

    Each point's cheapest partner is kept and looked for again only when it has changed.
    """
    size, m = n.astype(float).copy(), mean.copy()
    group, alive = np.arange(len(n)), np.ones(len(n), bool)
    d = np.maximum(_distances(m, m), 0) * (size[:, None] * size[None] / (size[:, None] + size[None]))
    np.fill_diagonal(d, np.inf)
    partner = d.argmin(1) if len(n) else np.zeros(0, int)
    least = d[np.arange(len(n)), partner]
    for _ in range(max(0, len(n) - k)):
        i = int(least.argmin())
        j = int(partner[i])
        m[i] = (size[i] * m[i] + size[j] * m[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        group[group == j] = i
        d[j, :] = d[:, j] = np.inf
        e = ((m - m[i]) ** 2).sum(1) * size * size[i] / (size + size[i])
        e[~alive] = np.inf
        e[i] = np.inf
        d[i, :] = d[:, i] = e
        least[j] = np.inf
        stale = np.flatnonzero(alive & ((partner == i) | (partner == j)))
        stale = np.append(stale[stale != i], i)
        partner[stale] = d[stale].argmin(1)
        least[stale] = d[stale, partner[stale]]
        closer = np.flatnonzero(alive & (e < least))
        partner[closer], least[closer] = i, e[closer]
    return group


def centroids(vecs: DataFrame, k: int | None = None) -> list[tuple[int, np.ndarray]]:
    """(cluster, unit centroid): Ward groups of the leaves, named by their votes.

    Twice as many groups are cut as clusters are recorded, and groups of one name
    are one cluster.  Where nothing is recorded the k groups are numbered from 0.
    """
    rows = leaves(vecs).collect()  # at most WARD_LEAVES
    rows = sorted(rows, key=lambda r: (-r.n, tuple(r.ls)))
    if not rows:
        return []
    n, ls = np.array([r.n for r in rows]), np.array([r.ls for r in rows])
    votes = [dict(r.votes) for r in rows]
    known = {c for v in votes for c in v}
    group = ward(n, ls / n[:, None], 2 * len(known) if known else (k or 30))
    sums: dict[int, np.ndarray] = {}
    for number, g in enumerate(np.unique(group)):
        at = np.flatnonzero(group == g)
        tally: dict[int, float] = {}
        for i in at:
            for c, x in votes[i].items():
                tally[c] = tally.get(c, 0) + x
        name = min(tally, key=lambda c: (-tally[c], c)) if tally else number if not known else None
        if name is not None:
            sums[name] = sums.get(name, 0) + ls[at].sum(0)
    for c in known - set(sums):  # no group has its name: the mean of the entries by their votes for it
        share = np.array([v.get(c, 0.0) for v in votes]) / n
        sums[c] = (ls * share[:, None]).sum(0)
    return sorted((c, s / max(1e-12, float(np.sqrt(s @ s)))) for c, s in sums.items())


def assigned(vecs: DataFrame, centres: list[tuple[int, np.ndarray]]) -> DataFrame:
    """(work_id, recorded, listed, cluster, similarity, kept): the nearest centroid, and that of the recorded cluster."""
    shared = vecs.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([c for c, _ in shared.value], np.int32)
        at = {int(c): i for i, c in enumerate(names)}
        m = np.array([v for _, v in shared.value]).reshape(-1, DIM)
        for b in batches:
            if not b.num_rows or not len(names):
                continue
            s = _matrix(b.column("v")) @ m.T
            best = s.argmax(1)
            own = [at.get(c) for c in b.column("recorded").to_pylist()]
            kept = [None if o is None else float(s[i, o]) for i, o in enumerate(own)]
            yield pa.RecordBatch.from_arrays(
                [b.column("work_id"), b.column("recorded"), b.column("listed"), pa.array(names[best]),
                 pa.array(s[np.arange(len(s)), best]), pa.array(kept, pa.float64())],
                ["work_id", "recorded", "listed", "cluster", "similarity", "kept"],
            )

    return vecs.mapInArrow(run, "work_id string, recorded int, listed boolean, cluster int, similarity double, kept double")


def by_rare_terms(left: DataFrame, docs: DataFrame, counts: DataFrame) -> DataFrame:
    """The assignment of records without weighted terms, by the recorded clusters that hold their terms, however few.

    A cluster's score is the sum over the record's terms of log(1 + k / b), with k its records that
    have the term and b its share of all; ties go to the least number.  The terms asked for are
    written first, so that the planner knows their size (they are few, as a rule).
    """
    base = docs.where("recorded is not null").groupBy("recorded").agg(F.count("*").alias("n"))
    base = base.withColumn("b", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per cluster
    asked = materialize(left.select("work_id", _terms()), "rare")
    held = asked.join(counts, "term").join(base, "recorded")
    scores = held.groupBy("work_id", "recorded").agg(F.sum(F.log(1 + F.col("k") / F.col("b"))).alias("s"))
    best = scores.groupBy("work_id").agg(F.max_by("recorded", F.struct(F.round("s", 9), -F.col("recorded"))).alias("best"))
    largest = base.agg(F.max_by("recorded", F.struct("n", -F.col("recorded"))).alias("largest"))
    rows = left.select("work_id", "recorded", "listed").join(best, "work_id", "left").join(largest)  # one row
    cluster = F.coalesce("recorded", "best", "largest").alias("cluster")
    zero = F.lit(0.0)
    return rows.select("work_id", "recorded", "listed", cluster, zero.alias("similarity"), zero.alias("kept")).where("cluster is not null")


def clustered(works: DataFrame, topics: DataFrame) -> DataFrame:
    """The assignment of every record that has a text."""
    docs = materialize(texts(works, topics), "terms")
    counts = term_counts(docs)
    every = materialize(vectors(docs, term_weights(docs, counts)), "vectors")
    vecs = every.where("v is not null")
    rows = assigned(vecs, centroids(vecs))
    bare = materialize(every.where("v is null").select("work_id"), "bare")  # written, so that the planner knows their size
    if bare.isEmpty():
        return rows
    left = materialize(docs.join(bare, "work_id", "left_semi"), "left")
    return rows.unionByName(by_rare_terms(left, docs, counts))


def corrected(rows: DataFrame) -> DataFrame:
    """(work_id, cluster) of the listed records whose recorded cluster is missing or does not fit."""
    wrong = F.col("recorded").isNull() | (
        (F.col("recorded") != F.col("cluster")) & (F.coalesce("kept", F.lit(-1.0)) < F.col("similarity") - MARGIN)
    )
    return rows.where(F.col("listed") & wrong).select("work_id", "cluster")


def described(rows: DataFrame, members: int = 3) -> DataFrame:
    """(cluster, n_works, rank, work_id, similarity): the size of each cluster and its most typical members."""
    w = Window.partitionBy("cluster").orderBy(F.desc("similarity"), "work_id")
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= members)
    n = rows.groupBy("cluster").agg(F.count("*").alias("n_works"))
    return top.join(n, "cluster").select("cluster", "n_works", "rank", "work_id", F.round("similarity", 4).alias("similarity"))
