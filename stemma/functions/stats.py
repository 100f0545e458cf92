"""Statistics as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval for k of n; NaN where n is 0."""
    p, zz = k / F.nullif(n, F.lit(0)), z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z / (1 + zz / n) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    nan = F.lit(float("nan"))
    return F.when(n > 0, mid - half).otherwise(nan), F.when(n > 0, mid + half).otherwise(nan)


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (kappa, n): agreement of two raters beyond chance over the union of their categories; NaN when chance is 1."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("k"))
    each = cells.select(F.explode(F.array(F.struct(F.col(a).alias("c"), F.col("k").alias("ra"), F.lit(0).cast("bigint").alias("rb")),
                                          F.struct(F.col(b).alias("c"), F.lit(0).cast("bigint").alias("ra"), F.col("k").alias("rb")))).alias("x"),
                        F.when(F.col(a) == F.col(b), F.col("k")).otherwise(0).alias("same"))
    m = each.groupBy("x.c").agg(F.sum("x.ra").alias("ra"), F.sum("x.rb").alias("rb"), (F.sum("same") / 2).alias("same"))
    t = m.agg(F.sum("ra").alias("n"), F.sum("same").alias("same"), F.sum(F.col("ra") * F.col("rb")).alias("chance"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return t.select(F.when(pe >= 1, F.lit(float("nan"))).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"), F.coalesce("n", F.lit(0)).alias("n"))


def cagr(first: Column, last: Column, years: Column) -> Column:
    """Compound growth per year; null when the first value or the span is 0."""
    return F.pow(last / F.nullif(first, F.lit(0.0)), 1.0 / F.nullif(years, F.lit(0))) - 1


def smoothed_ratio(recent: Column, early: Column, eps: float = 0.005) -> Column:
    """Growth of a share, with a floor that keeps shares near zero from giving huge ratios."""
    return (recent + eps) / (early + eps)
