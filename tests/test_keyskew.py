import random
from collections import defaultdict

from stemma.operators.keyskew import key_totals

SCHEMA = "k string, s string, w double, value string"


def brute(rows):
    out = defaultdict(lambda: [0, None, set()])
    for k, s, w, _ in rows:
        out[k][0] += 1
        if w is not None:
            out[k][1] = (out[k][1] or 0.0) + w
        if s is not None:
            out[k][2].add(s)
    return {k: (n, None if w is None else round(w, 6), len(d)) for k, (n, w, d) in out.items()}


def got(df, **kw):
    return {r.value: (r.n_rows, None if r.weight_sum is None else round(r.weight_sum, 6), r.n_distinct) for r in key_totals(df, "k", "s", "w", **kw).collect()}


def test_hot_key_nulls_ties(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None, ""]), r.choice([None, *map(str, range(40))]), r.choice([None, 0.5, 1.25]), "x") for _ in range(5000)]
    rows += [("one", "same", 1.0, "x")] * 3000 + [("nowt", "s", None, "x")] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(df, partitions=12) == brute(rows)
    assert got(df, partitions=1) == brute(rows)


def test_hot_key_is_spread_over_partitions(spark):
    from pyspark.sql import functions as F

    df = spark.range(20000).select(F.lit("hot").alias("k"), F.lit("same").alias("s"), F.monotonically_increasing_id().alias("spread"))
    sizes = [r["count"] for r in df.repartitionByRange(8, "k", "s", "spread").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5000


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == {}
    assert key_totals(spark.createDataFrame([("a", "b", 1.0, "c")], SCHEMA), "k", "s").collect()[0].weight_sum is None
