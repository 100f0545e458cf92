"""Per-key totals when a few keys hold most rows (problem 2).

The rows are range-partitioned on the composite (key, secondary, spread) whose
boundaries Spark takes from sampled quantiles, so a key that holds a third of
all rows fills a third of the partitions, each of the usual size.  ``spread``
is a row number per input split: even rows equal in both other columns can be
cut apart.  Inside a partition the sorted rows are reduced in one pass to one
partial state per key; keys cut by a boundary have several, which are stitched:
sums add up, and a secondary value that ends one piece and begins the next is
counted once.  What is stitched is one row per key and partition it touches.

Defined results: a null key is a value like any other and gets its own row;
null secondary values are not counted as distinct; null weights add nothing
(a key with only null weights has the sum null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_STATE = "k string, pid int, n bigint, w double, nw bigint, d bigint, first_s string, last_s string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of one partition sorted by (k, s); a key cut by a batch border is carried on."""
    held: list | None = None  # k, pid, n, w, nw, d, first_s, last_s
    fields = None
    for b in batches:
        if not b.num_rows:
            continue
        fields = fields or pa.schema(
            [("k", pa.string()), ("pid", pa.int32()), ("n", pa.int64()), ("w", pa.float64()), ("nw", pa.int64()),
             ("d", pa.int64()), ("first_s", pa.string()), ("last_s", pa.string())]
        )
        k, s, w = b.column("k").cast(pa.string()), b.column("s").cast(pa.string()), b.column("w")
        pid = b.column("pid")[0].as_py()

        def change(a: pa.Array) -> np.ndarray:
            if len(a) < 2:
                return np.zeros(0, bool)
            x, y = a[1:], a[:-1]
            ne = pc.fill_null(pc.not_equal(x, y), True)
            both = pc.and_(pc.is_null(x), pc.is_null(y))
            return pc.and_(ne, pc.invert(both)).to_numpy(zero_copy_only=False)

        kc = change(k)
        new_k = np.concatenate([[True], kc])
        new_s = np.concatenate([[True], kc | change(s)]) & pc.is_valid(s).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new_k)
        valid = pc.is_valid(w).to_numpy(zero_copy_only=False)
        ws = np.add.reduceat(pc.fill_null(w, 0.0).to_numpy(zero_copy_only=False), at)
        n = np.diff(np.append(at, len(k)))
        nw, d = np.add.reduceat(valid.astype(np.int64), at), np.add.reduceat(new_s.astype(np.int64), at)
        ks = k.take(pa.array(at)).to_pylist()
        fs, ls = s.take(pa.array(at)).to_pylist(), s.take(pa.array(at + n - 1)).to_pylist()
        rows = [[ks[i], pid, int(n[i]), float(ws[i]), int(nw[i]), int(d[i]), fs[i], ls[i]] for i in range(len(at))]
        if held is not None and held[0] == rows[0][0]:
            r = rows[0]
            cut = r[6] is not None and r[6] == held[7]
            rows[0] = [r[0], pid, r[2] + held[2], r[3] + held[3], r[4] + held[4], r[5] + held[5] - cut, held[6], r[7]]
        elif held is not None:
            rows.insert(0, held)
        held = rows.pop()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(held, fields)], schema=fields)


def key_totals(df: DataFrame, key: str, secondary: str, weight: str | None = None, partitions: int | None = None) -> DataFrame:
    """(value, n_rows, weight_sum, n_distinct) of every value of ``key``.

    ``n_distinct`` counts the distinct non-null values of ``secondary``;
    ``weight_sum`` is null without ``weight``.  ``partitions`` defaults to the
    session's shuffle partitions.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(
        F.col(key).cast("string").alias("k"),
        F.col(secondary).cast("string").alias("s"),
        (F.col(weight).cast("double") if weight else F.lit(None).cast("double")).alias("w"),
        F.monotonically_increasing_id().alias("spread"),
    )
    ranged = rows.repartitionByRange(n, "k", "s", "spread").sortWithinPartitions("k", "s")
    states = ranged.select("k", "s", "w", F.spark_partition_id().alias("pid")).mapInArrow(_runs, _STATE)
    # the pieces of a key meet here: at most one row per partition that holds the key
    w = Window.partitionBy("k").orderBy("pid")
    prev = F.lag("last_s").over(w)
    cut = F.when(prev == F.col("first_s"), 1).otherwise(0)
    return (
        states.withColumn("cut", cut)
        .groupBy("k")
        .agg(
            F.sum("n").alias("n_rows"),
            F.when(F.sum("nw") > 0, F.sum("w")).alias("weight_sum"),
            (F.sum("d") - F.sum("cut")).alias("n_distinct"),
        )
        .withColumnRenamed("k", "value")
    )
