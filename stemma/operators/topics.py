"""Topics: text features, latent factors, clusters, their terms, and which of them emerge.

The term statistics are DataFrame aggregates over (cluster, term) counts; no
cluster's text is ever concatenated, so word pairs stay within one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import unwrap_udt

from stemma.session import materialize

# Words that nearly every abstract of the field has and that say nothing about its topic.
DOMAIN_STOP = (
    "learning machine deep model models data using based method methods approach results study analysis used use new "
    "proposed performance network networks neural artificial intelligence algorithm algorithms high different paper "
    "present show shows however also large important provide novel significant accuracy"
).split()
# Spark's English stop words (held here, so that no session and no jar is needed to name them).
ENGLISH_STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a "
    "an the and but if or because as until while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor "
    "not only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd "
    "i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't "
    "won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's "
    "why's would"
).split()
#: Letters and digits of any script, two or more; the one pattern of all text features.
WORD = r"[\p{L}\p{N}_]{2,}"


def stop_words() -> list[str]:
    """The English stop words and those of the field."""
    return sorted({*ENGLISH_STOP, *DOMAIN_STOP})


def document_text(works: DataFrame, limit: int | None = None) -> DataFrame:
    """(work_id, ..., text): title, '. ' and abstract, cut at ``limit`` characters if given; works without a title are left out."""
    text = F.concat("title", F.lit(". "), F.coalesce("abstract", F.lit("")))
    text = text if limit is None else F.substring(text, 1, limit)
    return works.where("title is not null").withColumn("text", text)


def grams(text: Column, stop: list[str]) -> Column:
    """Words of two characters or more without stop words, and pairs of neighbours among what remains."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)), lambda w: ~w.isin(stop))

    def with_pairs(ws: Column) -> Column:
        tail = F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0)))
        return F.concat(ws, F.transform(tail, lambda x, i: F.concat_ws(" ", F.get(ws, i), x)))

    # bound to a variable, so that the words are found once
    return F.transform(F.array(words), with_pairs)[0]


def tfidf_pipeline(vocabulary: int = 50_000, min_df: int = 3, text_col: str = "text") -> Pipeline:
    """Words and pairs, counts, inverse document frequency, unit length."""
    stop = stop_words()
    words = RegexTokenizer(inputCol=text_col, outputCol="_t", pattern=WORD, gaps=False)
    kept = StopWordsRemover(inputCol="_t", outputCol="_w", stopWords=stop)
    pairs = NGram(n=2, inputCol="_w", outputCol="_p")
    both = SQLTransformer(statement="SELECT *, concat(_w, _p) AS _g FROM __THIS__")
    counts = CountVectorizer(inputCol="_g", outputCol="_c", vocabSize=vocabulary, minDF=float(min_df))
    return Pipeline(stages=[words, kept, pairs, both, counts, IDF(inputCol="_c", outputCol="_i")])


def tfidf(docs: DataFrame, vocabulary: int = 50_000, min_df: int = 3) -> DataFrame:
    """Adds ``features``: counts times (idf + 1), to unit length."""
    model = tfidf_pipeline(vocabulary, min_df).fit(docs)
    rows = model.transform(docs)
    # the library's idf lacks the "+ 1" that keeps terms of every document, so the weights are applied here
    idf = model.stages[-1].idf.toArray()
    rows = ElementwiseProduct(scalingVec=Vectors.dense(idf + 1.0), inputCol="_c", outputCol="_x").transform(rows)
    rows = Normalizer(inputCol="_x", outputCol="features", p=2.0).transform(rows)
    return rows.drop("_t", "_w", "_p", "_g", "_c", "_i", "_x")


#: Terms of a block of partial sums, and blocks of equal terms that one task adds up.
TERM_BLOCK, ADDED = 2048, 32
_BLOCK = "block int, task int, part binary"


def _sparse(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each row of an unwrapped vector column."""
    index, value = (pc.struct_field(vectors, f) for f in ("indices", "values"))
    known = index.is_valid().to_numpy(zero_copy_only=False)
    i_at, v_at = index.offsets.to_numpy(), value.offsets.to_numpy()
    i_all, v_all = index.values.to_numpy(zero_copy_only=False), value.values.to_numpy(zero_copy_only=False)
    for r in range(len(vectors)):
        v = v_all[v_at[r] : v_at[r + 1]]
        yield (i_all[i_at[r] : i_at[r + 1]] if known[r] else np.arange(len(v))), v


def _add_blocks(key: tuple, parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p.as_buffer()) for p in parts.column("part"))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})


def singular_vectors(rows: DataFrame, k: int, col: str = "features", rounds: int = 4, seed: int = 42) -> np.ndarray:
    """The leading right singular vectors (terms x k) by randomised subspace iteration.

    Each round is one pass over the rows in Arrow batches, which gives the sums of each
    task by blocks of ``TERM_BLOCK`` terms; equal blocks are added in two steps, at most
    ``ADDED`` at once in the first.  What a task or the driver holds is bounded by the
    vocabulary and ``k``, whatever the number of documents.
    """
    size = rows.select(col).first()[0].size
    wide = min(size, k + 10)
    z = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, wide)))[0]
    sc = rows.sparkSession.sparkContext
    # one partial sum for each core, not for each file split
    data = rows.select(unwrap_udt(col).alias("x")).coalesce(max(1, sc.defaultParallelism))
    for _ in range(rounds):
        shared = sc.broadcast(z)

        def products(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            z = shared.value
            out = np.zeros_like(z)
            for b in batches:
                for i, v in _sparse(b.column(0)):
                    out[i] += v[:, None] * (v @ z[i])[None]  # a row's part of A'(A z)
            task = pa.array([TaskContext.get().partitionId()], pa.int32())
            for k in range(0, len(out), TERM_BLOCK):
                if (part := out[k : k + TERM_BLOCK]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), task, pa.array([part.tobytes()], pa.binary())], ["block", "task", "part"])

        sums = data.mapInArrow(products, _BLOCK).withColumn("task", F.floor(F.col("task") / ADDED).cast("int"))
        sums = sums.groupBy("block", "task").applyInArrow(_add_blocks, _BLOCK).withColumn("task", F.lit(0))
        y = np.zeros_like(z)
        for r in sums.groupBy("block", "task").applyInArrow(_add_blocks, _BLOCK).toLocalIterator():
            y[r.block : r.block + TERM_BLOCK] = np.frombuffer(r.part).reshape(-1, wide)
        shared.destroy()
        z = np.linalg.svd(y, full_matrices=False)[0]
    return z[:, : min(k, size)]


def latent(rows: DataFrame, id_col: str, components: int = 256, col: str = "features") -> DataFrame:
    """(id, features): projections on the leading right singular vectors (uncentred), to unit length."""
    rows = materialize(rows.select(id_col, col), "tfidf")
    first = rows.first()
    if first is None:
        return rows.withColumnRenamed(col, "features")
    v = singular_vectors(rows, max(1, min(components, first[1].size - 1)), col)
    shared = rows.sparkSession.sparkContext.broadcast(v)  # vocabulary x components, both bounded

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = [v @ shared.value[i] for i, v in _sparse(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y, pa.list_(pa.float64()))], ["id", "y"])

    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.select(id_col, unwrap_udt(col)).mapInArrow(project, f"id {kind}, y array<double>").select(F.col("id").alias(id_col), array_to_vector("y").alias("_y"))
    return materialize(Normalizer(inputCol="_y", outputCol="features", p=2.0).transform(out).drop("_y"), "latent")


def as_vectors(df: DataFrame, array_col: str = "embedding") -> DataFrame:
    """Precomputed embeddings (arrays) as ``features``; null ones are left out."""
    return df.where(F.col(array_col).isNotNull()).withColumn("features", array_to_vector(F.col(array_col).cast("array<double>")))


def n_clusters(documents: int, most: int = 30) -> int:
    return min(most, max(2, documents // 20))


def kmeans(rows: DataFrame, k: int, seed: int = 42, starts: int = 5) -> DataFrame:
    """Adds ``cluster`` and ``distance`` (to its own centre) by the best of several seeded starts."""
    best = None  # the library keeps the rows of each fit in memory, and lets them go
    for s in range(starts):
        m = KMeans(k=k, seed=seed + s, featuresCol="features", predictionCol="cluster").fit(rows)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    centres = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(best.clusterCenters())], "cluster int, centre array<double>")
    out = best.transform(rows).join(F.broadcast(centres), "cluster")  # k rows
    diff = F.zip_with(vector_to_array("features"), "centre", lambda a, b: (a - b) * (a - b))
    return out.withColumn("distance", F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x))).drop("centre")


def layout(rows: DataFrame) -> DataFrame:
    """Adds x and y, the first two principal components."""
    m = PCA(k=2, inputCol="features", outputCol="_xy").fit(rows)
    xy = vector_to_array("_xy")
    return m.transform(rows).withColumns({"x": xy[0], "y": xy[1]}).drop("_xy")


def examples(rows: DataFrame, distance: str = "distance", n: int = 3) -> DataFrame:
    """The n rows of each cluster nearest to its centre, with their rank."""
    w = Window.partitionBy("cluster").orderBy(distance, "work_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cluster_terms(docs: DataFrame, min_clusters: int = 2, vocabulary: int = 60_000) -> DataFrame:
    """(cluster, term, score): share of the term in its cluster times ln(1 + K / (df + 1))."""
    words = docs.select("cluster", F.explode(grams(F.col("text"), stop_words())).alias("term"))
    tf = words.groupBy("cluster", "term").agg(F.count("*").alias("n"))
    per = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("all"))
    kept = per.where(F.col("df") >= min_clusters).orderBy(F.desc("all"), "term").limit(vocabulary)
    tf = tf.join(kept, "term")
    k = docs.agg(F.countDistinct("cluster").alias("k")).first()[0]
    share = F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))
    return tf.select("cluster", "term", (share * F.log(1 + F.lit(k) / (F.col("df") + 1))).alias("score"))


def top_terms(scores: DataFrame, n: int = 6) -> DataFrame:
    """(cluster, terms): greedily the n best terms of each cluster that don't repeat one another.

    A term is passed over when it is a word of a chosen term, a chosen term is a
    word of it, or both are equal without their final s's.  A cluster's list is
    bounded by the vocabulary of ``cluster_terms``.  Ties go to the later term.
    """
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("score", "term"))))
    lists = scores.groupBy("cluster").agg(F.transform(ranked, lambda s: s["term"]).alias("all"))
    stem = lambda t: F.regexp_replace(t, "s+$", "")

    def fold(chosen: Column, t: Column) -> Column:
        clash = F.exists(chosen, lambda c: F.array_contains(F.split(c, " "), t) | F.array_contains(F.split(t, " "), c) | (stem(c) == stem(t)))
        return F.when((F.size(chosen) >= n) | clash, chosen).otherwise(F.array_append(chosen, t))

    return lists.select("cluster", F.aggregate("all", F.array().cast("array<string>"), fold).alias("terms"))


def cluster_year(works: DataFrame) -> DataFrame:
    """(cluster, year, n_weighted, share): weighted works and their share of the year."""
    n = works.groupBy("cluster", "year").agg(F.sum("sampling_weight").alias("n_weighted"))
    return n.withColumn("share", F.col("n_weighted") / F.nullif(F.sum("n_weighted").over(Window.partitionBy("year")), F.lit(0.0)))


def cluster_summary(works: DataFrame, by_year: DataFrame, k: int, early: tuple[int, int], recent: tuple[int, int], least_works: int = 100) -> DataFrame:
    """One row for each of 0..k-1: size, early and recent share, growth, median year, mean percentile, emerging.

    Sizes and shares of empty clusters are 0; their median and mean stay null.
    The growth bar is the exact upper quartile over all clusters, small ones too.
    """

    def share(lo: int, hi: int, name: str) -> DataFrame:
        part = by_year.where(F.col("year").between(lo, hi)).groupBy("cluster").agg(F.sum("n_weighted").alias("s"))
        return part.select("cluster", (F.col("s") / F.nullif(F.sum("s").over(Window.partitionBy()), F.lit(0.0))).alias(name))

    size = works.groupBy("cluster").agg(
        F.count("*").alias("n_works"), F.median("year").alias("median_year"), F.avg("citation_percentile").alias("mean_citation_pct")
    )
    spine = works.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    c = spine.join(size, "cluster", "left").join(share(*early, "early_share"), "cluster", "left").join(share(*recent, "recent_share"), "cluster", "left")
    c = c.na.fill({"n_works": 0, "early_share": 0.0, "recent_share": 0.0})
    c = c.withColumn("growth_ratio", (F.col("recent_share") + 0.005) / (F.col("early_share") + 0.005))
    bar = F.percentile("growth_ratio", F.lit(0.75)).over(Window.partitionBy())
    return c.withColumn("emerging", (F.col("n_works") >= least_works) & (F.col("growth_ratio") >= bar))
