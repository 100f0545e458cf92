"""Data-quality gates: each check is one row; a failing one stops publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class QualityError(RuntimeError):
    """Some gates failed; the message names them."""


def gates(works: DataFrame, credit: DataFrame, topics: DataFrame, least_abstracts: float = 0.8, most_credit: float = 1.0001) -> DataFrame:
    """(gate, value, passed) of the five checks."""
    w = works.agg(
        F.count("*").alias("n"), F.countDistinct("work_id").alias("d"), F.avg(F.when(F.col("abstract").isNotNull(), 1.0).otherwise(0.0)).alias("a")
    )
    per = credit.groupBy("work_id").agg(F.sum("credit").alias("c")).agg(F.max("c").alias("c"))
    loose = works.select("work_id").join(topics.select("work_id"), "work_id", "left_anti").agg(F.count("*").alias("k"))
    one = [
        w.select(F.lit("works_not_empty").alias("gate"), F.col("n").cast("double").alias("value"), (F.col("n") > 0).alias("passed")),
        w.select(F.lit("work_ids_unique"), (F.col("n") - F.col("d")).cast("double"), F.col("n") == F.col("d")),
        w.select(F.lit("abstracts_present"), F.col("a"), F.coalesce(F.col("a") >= least_abstracts, F.lit(False))),
        per.select(F.lit("credit_at_most_one"), F.col("c"), F.coalesce(F.col("c") <= most_credit, F.lit(True))),
        loose.select(F.lit("works_clustered"), F.col("k").cast("double"), F.col("k") == 0),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.unionAll(x)
    return out


def require(checks: DataFrame) -> None:
    """Raises QualityError with the names of the gates that failed."""
    bad = [r.gate for r in checks.where(~F.col("passed")).collect()]  # one row per gate
    if bad:
        raise QualityError("failed gates: " + ", ".join(sorted(bad)))
