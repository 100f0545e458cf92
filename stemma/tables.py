"""Reading the base tables, and the cleaned forms the queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name``, of which only ``columns`` are read if any are given.

    Extra columns of the file never reach an operator that names its columns.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest_works(works: DataFrame) -> DataFrame:
    """One row per work_id: the delivery with the last loaded_at.

    Ties are broken by the higher cited_by_count, then the greatest of the other
    columns, so the result does not depend on input order.  Rows without a
    work_id are left out.  The maximum combines map-side (by a sort of each task's
    own rows, as a struct is no fixed-width state), so a work_id that holds a third of
    all rows costs one row per map task, and of each work one row moves, with only the
    columns that the caller has selected.
    """
    rest = [c for c in works.columns if c != "work_id"]
    lead = [c for c in ("loaded_at", "cited_by_count") if c in rest]
    order = F.struct(*lead, *[c for c in rest if c not in lead])
    return (
        works.where(F.col("work_id").isNotNull())
        .groupBy("work_id")
        .agg(F.max(order).alias("_r"))
        .select("work_id", *[F.col("_r")[c].alias(c) for c in rest])
    )


def clean_links(author_countries: DataFrame) -> DataFrame:
    """Author-country links without exact duplicates and without a null code."""
    return (
        author_countries.select("work_id", "author_order", "country_code", "weight")
        .where(F.col("country_code").isNotNull())
        .dropDuplicates()
    )
