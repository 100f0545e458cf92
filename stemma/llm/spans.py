"""Problem 10: long spans shared verbatim between records.

Seed and extend.  Every text is fingerprinted by winnowing: of the hashes of its
``K``-grams the least of every ``W`` consecutive ones is an anchor, where
``K + W - 1`` is the least length asked for, so two texts that share such a span
share an anchor inside it.  Texts are joined on anchors and matches are extended
both ways to maximal repeats; those of the least length are kept.

Exact copies are one class, represented by the least doc_id, and only
representatives are joined; the pairs of a class and between classes are written
out at the end, as the result is defined on documents.  Anchors that more than
``HOT`` rows hold (notices, near copies) are never paired: their surroundings are
refined to the hashes of all full-length windows around them, so that only texts
that do share a whole window meet.  Both ways are exact; none drops a link.

Lengths are code points of the text as stored.  Defined results: null and
shorter texts give no rows; equal rows are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.session import materialize

LEAST = 320
K = 192
#: Rows of one anchor beyond which it is refined instead of paired.
HOT = 48
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, m in enumerate((_MULT, _INV)):
            _POWERS[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 14), m, np.uint64)]))
    return _POWERS[0], _POWERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(text: str, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams of the code points of ``text``."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(code)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(n + 1)
    # code points are mixed first: equal sums of neighbouring letters then don't give equal hashes
    pre = np.concatenate([[np.uint64(0)], np.cumsum(_mix(code + np.uint64(1)) * up[:n])])
    return _mix((pre[k:] - pre[:-k]) * down[: n - k + 1])


def _sliding(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over every w consecutive values, by block prefixes and suffixes."""
    n = len(a)
    if w == 1:
        return a
    fill = a[-1]
    pad = np.concatenate([a, np.full(-n % w, fill, a.dtype)]).reshape(-1, w)
    head = op.accumulate(pad, axis=1).ravel()
    tail = op.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


def anchors(text: str, least: int = LEAST, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of ``text``: every k-gram that is least of some window."""
    h = gram_hashes(text, k)
    w = least - k + 1
    if len(h) < w:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = _sliding(h, w, np.minimum)
    # the greatest of the minima of the windows over a position: the position is chosen if its hash equals it
    edge = np.zeros(w - 1, np.uint64)
    high = _sliding(np.concatenate([edge, low, edge]), w, np.maximum)
    at = np.flatnonzero(h == high)
    return at, h[at].view(np.int64)


def windows(text: str, at: list[int], least: int = LEAST, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the full-length windows that hold any anchor of ``at``."""
    h = gram_hashes(text, least)
    keep = np.zeros(len(h) + 1, np.int64)
    for p in at:
        keep[max(0, p + k - least)] += 1
        keep[min(len(h), p + 1)] -= 1
    pos = np.flatnonzero(np.cumsum(keep)[:-1] > 0)
    return pos, h[pos].view(np.int64)


def repeats(a: str, b: str, seeds: list[tuple[int, int]], least: int = LEAST, k: int = K) -> list[tuple[int, int, int]]:
    """Maximal repeats (start in a, start in b, length) through the seeds, of at least ``least``."""
    x = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    y = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    out: set[tuple[int, int, int]] = set()
    reach: dict[int, int] = {}  # diagonal -> end of its last repeat
    for p, q in sorted(seeds):
        if p < reach.get(p - q, -1):
            continue
        n = min(p, q)
        miss = np.flatnonzero(x[p - n : p][::-1] != y[q - n : q][::-1])
        left = int(miss[0]) if len(miss) else n
        m = min(len(x) - p, len(y) - q)
        miss = np.flatnonzero(x[p : p + m] != y[q : q + m])
        right = int(miss[0]) if len(miss) else m
        reach[p - q] = p + right
        if right >= k and left + right >= least:
            out.add((p - left, q - left, left + right))
    return sorted(out)


class Shared:
    """The stages over one documents table; each is a DataFrame."""

    def __init__(self, docs: DataFrame, least: int = LEAST, k: int = K, hot: int = HOT) -> None:
        self.least, self.k = least, k
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.docs = rows.where(F.col("doc_id").isNotNull() & (F.length("text") >= least))
        keyed = self.docs.select("doc_id", F.sha2("text", 256).alias("key"), F.length("text").alias("n_chars")).distinct()
        reps = keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
        #: doc_id, n_chars, rep, n_copies of every long enough document
        self.members = materialize(keyed.join(reps, "key").select("doc_id", "n_chars", "rep", "n_copies"), "members")
        heads = self.members.where("doc_id = rep").select("doc_id")

        def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols: list[list[np.ndarray]] = [[], [], []]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    at, h = anchors(text, least, k)
                    for c, v in zip(cols, (np.full(len(at), doc, np.int64), at, h)):
                        c.append(v)
                flat = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in cols]
                yield pa.RecordBatch.from_arrays(flat, ["doc_id", "pos", "h"])

        every = self.docs.mapInArrow(seed, "doc_id bigint, pos bigint, h bigint")
        seeds = materialize(every.join(heads, "doc_id", "left_semi").distinct(), "anchors")
        met = (
            seeds.groupBy("h")
            .agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
            .where("lo < hi")
            .select("h", (F.col("n") > hot).alias("hot"))
        )
        #: anchors that at least two different texts hold
        self.seeds = materialize(seeds.join(met, "h"), "seeds")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(doc_id, text) of the documents asked for, each once."""
        return self.docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def cold_repeats(self) -> DataFrame:
        """(doc_a, doc_b, start_a, start_b, length) of representatives that share an anchor few hold."""
        s = self.seeds.where("not hot")
        a = s.select("h", F.col("doc_id").alias("doc_a"), F.col("pos").alias("pa"))
        b = s.select("h", F.col("doc_id").alias("doc_b"), F.col("pos").alias("pb"))
        met = a.join(b, "h").where("doc_a < doc_b").groupBy("doc_a", "doc_b")
        pairs = materialize(met.agg(F.collect_set(F.struct("pa", "pb")).alias("seeds")), "candidates")
        texts = self.texts(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")))
        with_a = pairs.join(texts.selectExpr("doc_id as doc_a", "text as ta"), "doc_a")
        with_b = with_a.join(texts.selectExpr("doc_id as doc_b", "text as tb"), "doc_b")
        least, k = self.least, self.k

        def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["doc_a", "doc_b", "start_a", "start_b", "length"]
            for b in batches:
                got = []
                for r in b.to_pylist():
                    at = [(s["pa"], s["pb"]) for s in r["seeds"]]
                    got += [(r["doc_a"], r["doc_b"], *m) for m in repeats(r["ta"], r["tb"], at, least, k)]
                cols = list(zip(*got)) if got else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        return with_b.select("doc_a", "doc_b", "seeds", "ta", "tb").mapInArrow(
            extend, "doc_a bigint, doc_b bigint, start_a bigint, start_b bigint, length bigint"
        )

    def shared_windows(self, hot_only: bool) -> DataFrame:
        """(g, doc_id, pos): full-length windows around shared anchors that stand in two texts at least."""
        s = self.seeds.where("hot") if hot_only else self.seeds
        at = s.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))  # of one text, so bounded by its length
        least, k = self.least, self.k

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols: list[list[np.ndarray]] = [[], [], []]
                for r in b.to_pylist():
                    pos, g = windows(r["text"], r["at"], least, k)
                    for c, v in zip(cols, (g, np.full(len(pos), r["doc_id"], np.int64), pos)):
                        c.append(v)
                flat = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in cols]
                yield pa.RecordBatch.from_arrays(flat, ["g", "doc_id", "pos"])

        rows = self.texts(at).join(at, "doc_id").select("doc_id", "text", "at")
        g = materialize(rows.mapInArrow(cut, "g bigint, doc_id bigint, pos bigint"), "windows")
        met = g.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        return materialize(g.join(met.select("g"), "g", "left_semi"), "shared")

    def hot_pairs(self) -> DataFrame:
        """(doc_a, doc_b) of representatives that share a whole window around a hot anchor.

        Windows that the same texts hold (a notice has one at each of its positions) are paired
        once: of all windows with equal owners, by number and two hashes of 64 bits, one is kept.
        """
        every = self.shared_windows(True).select("g", "doc_id").distinct()
        owners = every.groupBy("g").agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"),
            F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
        )
        kept = owners.groupBy("n", "x", "y", "lo", "hi").agg(F.min("g").alias("g")).select("g")
        g = every.join(kept, "g", "left_semi")
        a, b = g.withColumnRenamed("doc_id", "doc_a"), g.withColumnRenamed("doc_id", "doc_b")
        return a.join(b, "g").where("doc_a < doc_b").select("doc_a", "doc_b").distinct()

    def class_pairs(self) -> DataFrame:
        """(doc_a, doc_b): representatives of different texts that share a long span."""
        return self.cold_repeats().select("doc_a", "doc_b").unionAll(self.hot_pairs()).distinct()

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b) of documents: the class pairs written out, and the copies of each class."""
        m = self.members.select("doc_id", "rep")
        a = m.select(F.col("doc_id").alias("a"), F.col("rep").alias("doc_a"))
        b = m.select(F.col("doc_id").alias("b"), F.col("rep").alias("doc_b"))
        wide = self.class_pairs().join(a, "doc_a").join(b, "doc_b")
        across = wide.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
        c = self.members.where("n_copies > 1").select("doc_id", "rep")
        left, right = c.withColumnRenamed("doc_id", "doc_a"), c.withColumnRenamed("doc_id", "doc_b")
        within = left.join(right, "rep").where("doc_a < doc_b").select("doc_a", "doc_b")
        return across.unionAll(within)

    def coverage(self) -> DataFrame:
        """(doc_id, n_chars, shared_chars, n_copies): how much of each document stands in another one.

        Linear in the shared windows; no pairs are formed.  A text with copies is shared as a whole.
        """
        pos = self.shared_windows(False).select("doc_id", "pos").distinct()
        w = Window.partitionBy("doc_id").orderBy("pos")
        step = F.least(F.lit(self.least), F.coalesce(F.col("pos") - F.lag("pos").over(w), F.lit(self.least)))
        own = pos.withColumn("step", step).groupBy("doc_id").agg(F.sum("step").alias("covered"))
        rows = self.members.join(own.withColumnRenamed("doc_id", "rep"), "rep", "left")
        part = F.when(F.col("n_copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
        rows = rows.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), part.cast("bigint").alias("shared_chars"), "n_copies")
        return rows.where("shared_chars > 0")
