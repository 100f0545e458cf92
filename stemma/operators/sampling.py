"""Quotas, weights and reproducible samples.

Order is by a seeded hash with the id as tie-break: unlike a generator it gives
the same sample for any partitioning, and ``limit`` keeps it a distributed top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(id_col: str, seed: int) -> Column:
    """The sort key of a seeded order: a hash of id and seed that any SQL engine has."""
    return F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed))))


def quotas(counts: DataFrame, cap: int | None, limit: int = 10_000) -> DataFrame:
    """(year, available, quota) of (year, available): shares of ``cap`` in proportion, at least 1, at most ``limit``.

    Without a cap, or with one that nothing exceeds, everything is taken.
    """
    total = F.sum("available").over(Window.partitionBy())
    share = F.greatest(F.lit(1), F.least(F.col("available"), F.bround(F.lit(cap) * F.col("available") / total), F.lit(limit)))
    all_of_it = F.col("available")
    q = all_of_it if cap is None else F.when(F.lit(cap) >= total, all_of_it).otherwise(share)
    return counts.select("year", "available", q.cast("bigint").alias("quota"))


def sampling_weights(available: DataFrame, downloaded: DataFrame) -> DataFrame:
    """(year, weight): available / downloaded, of the years of which anything was downloaded."""
    return available.join(downloaded, "year").where("downloaded > 0").select("year", (F.col("available") / F.col("downloaded")).alias("weight"))


def with_weights(works: DataFrame, weights: DataFrame) -> DataFrame:
    """``works`` with the weight of their year; 1 where the year has none."""
    rows = works.drop("sampling_weight").join(weights.select("year", F.col("weight").alias("sampling_weight")), "year", "left")
    return rows.withColumn("sampling_weight", F.coalesce("sampling_weight", F.lit(1.0)))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of the id."""
    return df.orderBy(seeded_order(id_col, seed), id_col).limit(n)


def seeded_sample_per(df: DataFrame, group: str, id_col: str, quota: DataFrame, seed: int = 42) -> DataFrame:
    """The first ``quota`` rows of each group in seeded order."""
    w = Window.partitionBy(group).orderBy(seeded_order(id_col, seed), id_col)
    return df.withColumn("_k", F.row_number().over(w)).join(quota.select(group, "quota"), group).where("_k <= quota").drop("_k", "quota")


def first_of_sample(df: DataFrame, id_col: str, n: int, first: int, seed: int = 42) -> DataFrame:
    """The sample with ``gold``: whether a row is among the first ``first`` in seeded order, which people label."""
    rows = seeded_sample(df, id_col, n, seed)  # n rows, so one window over all of them is small
    w = Window.orderBy(seeded_order(id_col, seed), id_col)
    return rows.withColumn("gold", F.row_number().over(w) <= first)
