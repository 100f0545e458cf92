"""The measured cascade that resolves organisation strings: exact alias, then fuzzy name.

Every distinct string is resolved once.  The alias table is a join, as it grows
with the corpus.  Fuzzy matching scores comma segments against institution
names by the token-sort ratio, 200 LCS / (lengths), with two lossless bounds
before the exact score: the lengths, and the letters in common.  Both sides stay
distributed: the distinct segments are dealt into groups of about ``SEGMENTS``,
the names into blocks of about ``NAME_BLOCK``, and each group meets each block in
one task (a co-group), where the bounds are array operations and only what
passes them is scored.  So the memory of a task is bounded whatever the number
of strings or names, nothing reaches the driver, and only hits are given out.
(A join on q-grams or pieces of names was considered: at a score of 90 two names
of 40 letters may differ in 8 edits, so any exact key is a run of two or three
letters, and most names share several of those.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import normalize_org, org_segments
from stemma.operators.sampling import seeded_order
from stemma.session import materialize

#: Institution names, and segments of strings, that one task holds at a time.
NAME_BLOCK = 200_000
SEGMENTS = 20_000
LEAST_SEGMENT = 6


def institution_dimension(authorship: DataFrame) -> DataFrame:
    """One row per institution id: most frequent name, country and type (ties: the least), and its works."""
    cols = ("institution_name", "country_code", "institution_type")
    base = authorship.where("institution_id is not null")
    modes = base.groupBy("institution_id").agg(
        *[F.expr(f"mode() within group (order by {c})").alias(c) for c in cols], F.countDistinct("work_id").alias("n_works")
    )
    return modes


def alias_table(known: DataFrame) -> DataFrame:
    """(norm, institution_id): the institution most often meant by each normalised string; ties go to the least id."""
    votes = known.groupBy("norm", F.col("resolved_institution_id").alias("institution_id")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("norm").orderBy(F.desc("n"), "institution_id")
    return votes.withColumn("k", F.row_number().over(w)).where("k = 1").select("norm", "institution_id")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the words of Python integers."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def token_sort(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    a, b = token_sort(a), token_sort(b)
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


_LETTERS = {c: i for i, c in enumerate(" abcdefghijklmnopqrstuvwxyz0123456789")}


def _bag(s: str) -> np.ndarray:
    out = np.zeros(len(_LETTERS) + 1, np.int16)
    for c in s:
        out[_LETTERS.get(c, -1)] += 1
    return out


class NameIndex:
    """Names ordered by length, with their letter counts, for the best match at or above a threshold."""

    def __init__(self, names: list[tuple[str, str]], threshold: float) -> None:
        self.t = threshold
        rows = sorted((len(s := token_sort(n)), rank, s, i) for rank, (i, n) in enumerate(names))
        self.rows = rows
        self.size = np.array([r[0] for r in rows], np.int64)
        self.bags = np.array([_bag(r[2]) for r in rows]).reshape(-1, len(_LETTERS) + 1)

    def best(self, segment: str) -> tuple[float, int, str] | None:
        """(score, rank, id): highest score, ties to the first name."""
        s = token_sort(segment)
        n, bag = len(s), _bag(s)
        lo = np.searchsorted(self.size, int(n * self.t / (200 - self.t)), "left")
        hi = np.searchsorted(self.size, int(n * (200 - self.t) / max(self.t, 1e-9)) + 1, "right")
        # no common subsequence is longer than the letters in common
        most = 200.0 * np.minimum(self.bags[lo:hi], bag).sum(1) / np.maximum(1, n + self.size[lo:hi])
        top: tuple[float, int, str] | None = None
        for j in np.argsort(-most, kind="stable"):
            if most[j] < self.t - 1e-9 or (top and most[j] < top[0] - 1e-9):
                break
            m, rank, name, i = self.rows[lo + j]
            score = 200.0 * lcs(s, name) / (n + m) if n + m else 100.0
            if score >= self.t and (top is None or (score, -rank) > (top[0], -top[1])):
                top = (score, rank, i)
        return top


def fuzzy_hits(norms: DataFrame, institutions: DataFrame, threshold: float = 90.0) -> DataFrame:
    """(norm, institution_id, score) of the distinct ``norm`` strings with a name at or above the threshold.

    ``institutions`` has institution_id, norm_name, n_works; ties between names
    go to more works, then the lesser id; ties between segments to the first.
    """
    tasks = int(norms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = institutions.where("institution_id is not null and norm_name <> ''").select("institution_id", "norm_name", F.coalesce("n_works", F.lit(0)).alias("n_works"))
    names = materialize(names, "names")
    segs = norms.select("norm", F.posexplode(org_segments(F.col("norm"))).alias("pos", "seg")).where(F.length("seg") >= LEAST_SEGMENT)
    segs = materialize(segs, "segments")
    blocks = max(1, -(-names.count() // NAME_BLOCK))
    deals = max(tasks, -(-segs.count() // SEGMENTS))
    asked = segs.select("seg").distinct().select("seg", F.pmod(F.xxhash64("seg"), F.lit(deals)).alias("deal"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = names.withColumn("block", F.pmod(F.xxhash64("institution_id"), F.lit(blocks)).cast("int")).withColumn("deal", F.expr(f"explode(sequence(0L, {deals - 1}L))"))

    def score(segments: pa.Table, block: pa.Table) -> pa.Table:
        rows = sorted(zip(*(block.column(c).to_pylist() for c in ("n_works", "institution_id", "norm_name"))), key=lambda r: (-r[0], r[1]))
        index = NameIndex([(i, name) for _, i, name in rows], threshold)
        got = [(seg, hit[2], hit[0], rows[hit[1]][0]) for seg in segments.column("seg").to_pylist() if (hit := index.best(seg))]
        cols = list(zip(*got)) if got else [()] * 4
        types = (pa.string(), pa.string(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["seg", "institution_id", "score", "n_works"])

    # a partitioning by number is not undone by adaptive execution, which would see few bytes and miss the work
    meet = [x.repartition(deals * blocks, "deal", "block").groupBy("deal", "block") for x in (asked, dealt)]
    hits = meet[0].cogroup(meet[1]).applyInArrow(score, "seg string, institution_id string, score double, n_works bigint")
    order = F.struct((-F.col("score")).alias("s"), "pos", (-F.col("n_works")).alias("w"), "institution_id")
    best = segs.join(hits, "seg").groupBy("norm").agg(F.min(order).alias("b"))
    return best.select("norm", F.col("b.institution_id").alias("institution_id"), (-F.col("b.s")).alias("score"))


def resolve_strings(strings: DataFrame, known: DataFrame, institutions: DataFrame, threshold: float = 90.0, match_empty: bool = False) -> DataFrame:
    """Adds institution_id, method and score to rows with a ``norm`` column.

    Strings that normalise to nothing (other scripts) are not matched with one
    another unless ``match_empty`` is set.
    """
    alias = alias_table(known if match_empty else known.where("norm <> ''"))
    distinct = strings.select("norm").distinct()
    a = distinct.join(alias.withColumnRenamed("institution_id", "a_id"), "norm", "left")
    f = fuzzy_hits(a.where("a_id is null").select("norm"), institutions, threshold)
    hits = a.join(f.withColumnsRenamed({"institution_id": "f_id", "score": "f_score"}), "norm", "left").select(
        "norm",
        F.coalesce("a_id", "f_id").alias("institution_id"),
        F.when(F.col("a_id").isNotNull(), "exact_alias").when(F.col("f_id").isNotNull(), "fuzzy_name").otherwise("unresolved").alias("method"),
        F.when(F.col("a_id").isNotNull(), 100.0).otherwise(F.coalesce("f_score", F.lit(0.0))).alias("score"),
    )
    return strings.join(hits, "norm")


def split_affiliations(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, unresolved) with ``norm``; strings with two or more institutions are neither."""
    norm = normalize_org(F.coalesce("raw_affiliation", F.lit("")))  # after the filters: each row is normalised once
    known, open_ = raw.where("resolved_institution_id is not null"), raw.where("n_resolved_institutions = 0")
    return known.withColumn("norm", norm), open_.withColumn("norm", norm)


def holdout_split(known: DataFrame, size: int = 2000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(holdout, train): whole works in seeded hash order while their strings number at most ``size``.

    Train keeps no string that the holdout has.  The order is a hash, so it is
    the same for any partitioning.  The running sum is taken over one row per
    work, and only over the first ``size`` works, as every work has a string.
    """
    known = materialize(known, "known")  # read four times below
    per = known.groupBy("work_id").agg(F.count("*").alias("n")).withColumn("h", seeded_order("work_id", seed))
    first = per.orderBy("h", "work_id").limit(size)
    w = Window.orderBy("h", "work_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = first.withColumn("c", F.sum("n").over(w)).where(F.col("c") <= size).select("work_id")
    holdout = known.join(chosen, "work_id", "left_semi")
    train = known.join(chosen, "work_id", "left_anti").join(holdout.select("norm").distinct(), "norm", "left_anti")
    return holdout, train


def evaluation(resolved: DataFrame) -> DataFrame:
    """Precision and recall of rows with institution_id, method and the true resolved_institution_id.

    Recall divides by the whole holdout in every row; methods without hits have a row too.
    """
    spark = resolved.sparkSession
    hit = F.col("institution_id").isNotNull()
    right = hit & (F.col("institution_id") == F.col("resolved_institution_id"))
    sums = resolved.groupBy("method").agg(
        F.sum(F.when(hit, 1).otherwise(0)).alias("n_predicted"), F.sum(F.when(right, 1).otherwise(0)).alias("n_correct"), F.count("*").alias("n")
    )
    # a row for both methods and for whatever else occurs; the holdout's size is a window over these few rows
    spine = spark.createDataFrame([("exact_alias",), ("fuzzy_name",)], "method string")
    every = spine.join(sums, "method", "full").na.fill(0).withColumn("n_all", F.sum("n").over(Window.partitionBy())).drop("n")
    by = every.where(F.col("method").isin("exact_alias", "fuzzy_name"))
    total = every.agg(F.sum("n_predicted").alias("n_predicted"), F.sum("n_correct").alias("n_correct"), F.max("n_all").alias("n_all"))
    rows = total.select(F.lit("overall").alias("method"), "n_predicted", "n_correct", "n_all").unionByName(by)
    return rows.select(
        "method",
        F.when(F.col("method") == "overall", F.coalesce("n_all", F.lit(0))).alias("n_holdout"),
        F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"), F.coalesce("n_correct", F.lit(0)).alias("n_correct"),
        (F.col("n_correct") / F.nullif("n_predicted", F.lit(0))).alias("precision"),
        (F.col("n_correct") / F.nullif("n_all", F.lit(0))).alias("recall"),
    )


def coverage(resolved: DataFrame) -> DataFrame:
    """(method, n, share_of_unresolved) of the production pass."""
    n = resolved.groupBy("method").agg(F.count("*").alias("n"))
    return n.select("method", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share_of_unresolved"))


def resolved_affiliations(affiliations: DataFrame, authorship: DataFrame, threshold: float = 90.0) -> DataFrame:
    """The production pass: every unresolved string occurrence with institution_id, method and score."""
    inst = institution_dimension(authorship)
    inst = materialize(inst.withColumn("norm_name", normalize_org(F.coalesce("institution_name", F.lit("")))), "institutions")
    raw = affiliations.dropDuplicates(["affil_id"]) if "affil_id" in affiliations.columns else affiliations
    known, open_ = split_affiliations(raw)
    rows = resolve_strings(open_, known, inst, threshold)
    return rows.select("work_id", "author_order", "raw_affiliation", "institution_id", "method", "score")
