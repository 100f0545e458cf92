"""One small query per single operator of the survey: the DataFrame form, and its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import text
from stemma.operators import evaluate, flatten
from stemma.plans.reference import segments_sql
from stemma.plans.registry import Registry
from stemma.tables import clean_links, load

REG = Registry()

_D = "(select distinct work_id, year, language, type, top10pct, sampling_weight, citation_percentile from works where work_id is not null)"
_L = "(select distinct work_id, author_order, country_code, weight from author_countries where country_code is not null)"


class Tables:
    """Tables of one data set; only the named columns are read."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.of = lambda name, *columns: load(spark, sf, name, *columns)

    def works(self) -> DataFrame:
        w = self.of("works", "work_id", "year", "language", "type", "top10pct", "sampling_weight", "citation_percentile")
        return w.where("work_id is not null").distinct()

    def links(self) -> DataFrame:
        return clean_links(self.of("author_countries"))

    def regions(self) -> DataFrame:
        return self.of("country_regions")


def _single(name: str, sql: str, fn: Callable[[Tables], DataFrame]) -> None:
    REG.add(f"ref_{name}", lambda spark, sf: fn(Tables(spark, sf)), sql)


def _n(name: str = "n") -> Column:
    return F.count("*").alias(name)


def _share(part: Column, *by: str) -> Column:
    """A part of its window's total."""
    return part / F.nullif(F.sum(part).over(Window.partitionBy(*by)), F.lit(0))


# ---- sources and expressions

_single("s4_count_by_year", "select year, count(*) as n from works where year is not null group by year",
        lambda t: t.of("works", "year").where("year is not null").groupBy("year").agg(_n()))
_single("s9_code_na", "select country_code, country_name, region from country_regions where country_code = 'NA'",
        lambda t: t.regions().where(F.col("country_code") == "NA").select("country_code", "country_name", "region"))
_single("p1_projection", f"select work_id, author_order, country_code, weight, 'provider' as source from {_L} l",
        lambda t: t.links().withColumn("source", F.lit("provider")))
_single("p4_zero_filled_sum", f"select year, cast(sum(case when top10pct then 1 else 0 end) as bigint) as n_top from {_D} w group by year",
        lambda t: t.works().groupBy("year").agg(F.sum(F.when(F.col("top10pct"), 1).otherwise(0)).alias("n_top")))
_single("p5_null_sum", f"select year, cast(sum(case when type = 'dataset' then 1 end) as bigint) as n from {_D} w group by year",
        lambda t: t.works().groupBy("year").agg(F.sum(F.when(F.col("type") == "dataset", 1)).alias("n")))
_single("p6_coalesce", f"select coalesce(language, 'unknown') as language, count(*) as n from {_D} w group by coalesce(language, 'unknown')",
        lambda t: t.works().groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(_n()))
_single("p7_guarded_ratio", f"select year, round(count(top10pct) / nullif(count(case when type = 'review' then 1 end), 0), 6) as ratio from {_D} w group by year",
        lambda t: t.works().groupBy("year").agg(F.round(F.count("top10pct") / F.nullif(F.count(F.when(F.col("type") == "review", 1)), F.lit(0)), 6).alias("ratio")))
_single("p10_distinct_from", f"select count(*) as n from {_D} w where language is distinct from 'en'",
        lambda t: t.works().where(~F.col("language").eqNullSafe("en")).agg(_n()))
_single("p12_in_list", f"select type, count(*) as n from {_D} w where type in ('review', 'preprint') and year between 2012 and 2020 group by type",
        lambda t: t.works().where(F.col("type").isin("review", "preprint") & F.col("year").between(2012, 2020)).groupBy("type").agg(_n()))
_single("p13_three_valued", f"select count(*) as n from {_D} w where top10pct and not (citation_percentile < 0.95)",
        lambda t: t.works().where(F.col("top10pct") & ~(F.col("citation_percentile") < 0.95)).agg(_n()))
_single("p14_length", "select count(distinct work_id) as n from works where length(abstract) > 200",
        lambda t: t.of("works", "work_id", "abstract").where(F.length("abstract") > 200).agg(F.countDistinct("work_id").alias("n")))

# ---- joins

_single("j1_inner", f"select t.cluster, count(*) as n from (select distinct work_id, cluster from work_topics) t join {_L} l on l.work_id = t.work_id group by t.cluster",
        lambda t: t.of("work_topics", "work_id", "cluster").distinct().join(t.links(), "work_id").groupBy("cluster").agg(_n()))
_single("j2_left_dimension", f"select r.region, count(*) as n from {_L} l left join country_regions r on r.country_code = l.country_code group by r.region",
        lambda t: t.links().join(t.regions(), "country_code", "left").groupBy("region").agg(_n()))
_single("j3_inner_dimension", f"select r.country_name, round(sum(l.weight), 6) as credit from {_L} l join country_regions r on r.country_code = l.country_code group by r.country_name",
        lambda t: t.links().join(t.regions(), "country_code").groupBy("country_name").agg(F.round(F.sum("weight"), 6).alias("credit")))
_single("j6_anti_by_null", f"select count(*) as n from {_D} w left join work_topics t on t.work_id = w.work_id where t.work_id is null",
        lambda t: t.works().join(t.of("work_topics", "work_id").withColumn("there", F.lit(True)), "work_id", "left").where("there is null").agg(_n()))
_single("j11_scalar_subquery", f"select country_code, round(sum(weight) / (select sum(weight) from {_L} z), 6) as share from {_L} l group by country_code",
        lambda t: t.links().groupBy("country_code").agg(F.sum("weight").alias("s")).select("country_code", F.round(F.col("s") / t.links().agg(F.sum("weight")).scalar(), 6).alias("share")))
_single("p15_semi_join", f"select count(*) as n from {_D} w where exists (select 1 from keywords k where k.work_id = w.work_id)",
        lambda t: t.works().join(t.of("keywords", "work_id"), "work_id", "left_semi").agg(_n()))

# ---- aggregates

_single("a3_count_and_empty", "select count(*) as n, count(*) > 0 as filled, count(*) = 0 as is_empty from works",
        lambda t: t.of("works", "work_id").agg(_n(), (F.count("*") > 0).alias("filled"), (F.count("*") == 0).alias("is_empty")))
_single("a5_average_of_case", f"select year, round(avg(case when language = 'en' then 1e0 else 0e0 end), 6) as share_en from {_D} w group by year",
        lambda t: t.works().groupBy("year").agg(F.round(F.avg(F.when(F.col("language") == "en", 1.0).otherwise(0.0)), 6).alias("share_en")))
_single("a7_bool_or", f"select work_id, bool_or(country_code = 'US') as has_us from {_L} l group by work_id",
        lambda t: t.links().groupBy("work_id").agg(F.bool_or(F.col("country_code") == "US").alias("has_us")))
_single("a11_group_by_all", f"select year, case when type = 'review' then 'review' else 'other' end as kind, count(*) as n, max(citation_percentile) as best from {_D} w group by all",
        lambda t: t.works().groupBy("year", F.when(F.col("type") == "review", "review").otherwise("other").alias("kind")).agg(_n(), F.max("citation_percentile").alias("best")))
_single("a12_group_by_ordinal", f"select coalesce(language, 'unknown') as language, year, count(*) as n from {_D} w group by 1, 2",
        lambda t: t.works().select(F.coalesce("language", F.lit("unknown")).alias("language"), "year").groupBy(1, 2).agg(_n()))
_single("a13_nested", f"select max(c) as most from (select work_id, round(sum(weight), 6) as c from {_L} l group by work_id) s",
        lambda t: t.links().groupBy("work_id").agg(F.round(F.sum("weight"), 6).alias("c")).agg(F.max("c").alias("most")))
_single("a15_value_counts", "select keyword, count(*) as n from keywords where keyword is not null group by keyword",
        lambda t: t.of("keywords", "keyword").where("keyword is not null").groupBy("keyword").agg(_n()))

# ---- windows

_single("w2_share", f"select year, type, round(count(*) / sum(count(*)) over (partition by year), 6) as share from {_D} w group by year, type",
        lambda t: t.works().groupBy("year", "type").agg(_n()).select("year", "type", F.round(_share(F.col("n"), "year"), 6).alias("share")))
_single("w4_aggregate_in_window", f"select type, round(sum(sampling_weight) / sum(sum(sampling_weight)) over (), 6) as share from {_D} w group by type",
        lambda t: t.works().groupBy("type").agg(F.sum("sampling_weight").alias("s")).select("type", F.round(_share(F.col("s")), 6).alias("share")))
_single("w5_count_over", f"select work_id, author_order, country_code, count(*) over (partition by work_id, author_order) as k from {_L} l",
        lambda t: t.links().select("work_id", "author_order", "country_code", F.count("*").over(Window.partitionBy("work_id", "author_order")).alias("k")))
_single("w9_keep_first", "select file_name, line_no, delivered_at from (select file_name, line_no, delivered_at, row_number() over (partition by file_name order by line_no) as k from raw_works) s where k = 1",
        lambda t: t.of("raw_works", "file_name", "line_no", "delivered_at").groupBy("file_name").agg(F.min(F.struct("line_no", "delivered_at")).alias("f")).select("file_name", "f.*"))

# ---- sets and order

_single("u2_distinct", "select distinct country_code from author_countries", lambda t: t.of("author_countries", "country_code").distinct())
_single("u3_difference", "select distinct a.country_code from author_countries a left join country_regions r on r.country_code = a.country_code where r.country_code is null and a.country_code is not null",
        lambda t: t.of("author_countries", "country_code").where("country_code is not null").distinct().join(t.regions(), "country_code", "left_anti"))
_single("o2_top", "select keyword, n from (select lower(keyword) as keyword, count(*) as n from keywords where keyword is not null group by lower(keyword)) k order by n desc, keyword limit 20",
        lambda t: t.of("keywords", "keyword").where("keyword is not null").groupBy(F.lower("keyword").alias("keyword")).agg(_n()).orderBy(F.desc("n"), "keyword").limit(20))


@REG.query("""select country_code, country_name, case when country_code = 'US' then 'United States' when country_code = 'CN' then 'China' when eu27 = 'EU27' then 'EU27'
  when country_code = 'GB' then 'United Kingdom' when country_code = 'IN' then 'India' when country_code = 'JP' then 'Japan' when country_code = 'KR' then 'South Korea'
  else 'Rest of world' end as bloc from country_regions""")
def ref_p3_blocs(spark: SparkSession, sf: str) -> DataFrame:
    from stemma.operators.credit import bloc

    r = load(spark, sf, "country_regions")
    return r.select("country_code", "country_name", bloc(F.col("country_code"), F.col("eu27")).alias("bloc"))


@REG.query("select type, case when type in ('ai_method', 'ai_application', 'not_ai') then type else 'invalid' end as role, count(*) as n from works group by 1, 2")
def ref_p16_valid_role(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "works", "type").groupBy("type", evaluate.valid_role(F.col("type")).alias("role")).agg(F.count("*").alias("n"))


@REG.query("select work_id, case country_code when 'US' then 'America' when 'CN' then 'China' else country_code end as name from author_countries")
def ref_p17_names(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "author_countries", "work_id", "country_code")
    return c.select("work_id", text.map_or_self(F.col("country_code"), {"US": "America", "CN": "China"}).alias("name"))


@REG.query("select distinct ror, split_part(nullif(ror, ''), '/', -1) as short from authorship_inst")
def ref_f1_short_id(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "authorship_inst", "ror").distinct().select("ror", flatten.short_id(F.col("ror")).alias("short"))


@REG.query(f"""with s as (select distinct institution_name as name, lower(institution_name) as low from authorship_inst where institution_name is not null)
  select name, array_to_string({segments_sql("low")}, '|') as segments from s""")
def ref_f14_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The organisation's parts of every institution name, in any script."""
    a = load(spark, sf, "authorship_inst", "institution_name").where("institution_name is not null").distinct()
    return a.select(F.col("institution_name").alias("name"), F.array_join(text.org_segments(F.lower("institution_name")), "|").alias("segments"))


@REG.query("select distinct work_id, rtrim(left(title, 48)) as short from works where title is not null")
def ref_f16_clip(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "works", "work_id", "title").where("title is not null").distinct().select("work_id", text.clip(F.col("title"), 48).alias("short"))
