"""Fractional credit of countries and collaboration flags of works.

The grain is one link of an author to a country; links are aggregated to the
work before they meet anything else, and the region table, which is fixed and
small, is left to the planner's size check rather than forced to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blocs in the order in which they are tested; EU27 comes between China and the single countries.
BLOCS_FIRST = {"US": "United States", "CN": "China"}
BLOCS_LAST = {"GB": "United Kingdom", "IN": "India", "JP": "Japan", "KR": "South Korea"}


def bloc(code: Column, eu27: Column) -> Column:
    """The bloc of a country; 'Rest of world' for any other and for unknown codes."""
    c = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in BLOCS_FIRST.items():
        c = c.when(code == k, v)
    c = c.when(eu27 == "EU27", "EU27")
    for k, v in BLOCS_LAST.items():
        c = c.when(code == k, v)
    return c.otherwise("Rest of world")


def country_credit(links: DataFrame, works: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per work and country: summed weight, and the same times the work's sampling weight.

    Works without links and links without a work have no row; countries that the
    region table lacks have a null region.
    """
    per = links.groupBy("work_id", "country_code").agg(F.sum("weight").alias("credit"))
    w = works.select("work_id", "year", "sampling_weight", "top10pct", "top1pct", "citation_percentile")
    j = per.join(w, "work_id").join(regions.select("country_code", "region", "eu27"), "country_code", "left")
    return j.select(
        "work_id", "year", "country_code", bloc(F.col("country_code"), F.col("eu27")).alias("bloc"), "region", "credit",
        (F.col("credit") * F.col("sampling_weight")).alias("credit_weighted"), "top10pct", "top1pct", "citation_percentile",
    )


def work_collab(links: DataFrame, works: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per work with links: number of countries, and who takes part.

    An unknown country is outside Africa; ``has_africa`` is null where every region is unknown.
    """
    per = links.select("work_id", "country_code").distinct()
    r = per.join(regions.select("country_code", "region"), "country_code", "left")
    code, region = F.col("country_code"), F.col("region")
    flags = r.groupBy("work_id").agg(
        F.count("country_code").alias("n_countries"),
        F.bool_or(code == "US").alias("has_us"),
        F.bool_or(code == "CN").alias("has_cn"),
        F.bool_or(region == "Africa").alias("has_africa"),
        F.bool_or(~region.eqNullSafe("Africa")).alias("has_non_africa"),
    )
    return flags.join(works.select("work_id", "year", "sampling_weight"), "work_id")


def enriched_links(links: DataFrame, resolved: DataFrame, institutions: DataFrame, works: DataFrame, source: str = "provider") -> DataFrame:
    """The provider's links and those recovered for authors without any.

    A recovered author's weight is 1 / authors / links of the author, counted
    after authors with provider links and institutions without a country are
    left out; two institutions of one country are two links.
    """
    own = links.select("work_id", "author_order", "country_code", "weight", F.lit(source).alias("source"))
    r = resolved.where("institution_id is not null").select("work_id", "author_order", "institution_id").distinct()
    r = r.join(links.select("work_id", "author_order"), ["work_id", "author_order"], "left_anti")
    r = r.join(institutions.where("country_code is not null").select("institution_id", "country_code"), "institution_id")
    n = r.groupBy("work_id", "author_order").agg(F.count("*").alias("k"))
    r = r.join(n, ["work_id", "author_order"]).join(works.select("work_id", "n_authors"), "work_id")
    weight = F.lit(1.0) / F.nullif(F.col("n_authors"), F.lit(0)) / F.col("k")
    return own.unionByName(r.select("work_id", "author_order", "country_code", weight.alias("weight"), F.lit("recovered").alias("source")))
