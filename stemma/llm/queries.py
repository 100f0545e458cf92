"""Queries of the text problems (3 to 10) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import canon, clusters, languages, leaks, spans, terms, tokens, variants
from stemma.plans.registry import Registry
from stemma.tables import load

REG = Registry()

_COUNTS = r"""
with a as (
  select work_id, arg_max(abstract, (loaded_at, abstract)) as text from works
  where work_id is not null and abstract is not null group by work_id
), t as (
  select work_id, text from a
  union all select distinct work_id, keyword from keywords where work_id is not null and keyword is not null
), x as (
  select work_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+'))) as term from t
), n as (
  select work_id, term, count(*) as n from x group by all
), c as (
  select term, sum(n) as c, count(*) as n_works from n group by term
)
"""


def _scores(spark: SparkSession, sf: str) -> terms.Scores:
    return terms.Scores(
        load(spark, sf, "works", "work_id", "abstract", "loaded_at"), load(spark, sf, "keywords", "work_id", "keyword")
    )


@REG.query(
    _COUNTS
    + """
select work_id, term from n join c using (term)
where regexp_full_match(term, '[a-z]{6,}') and n >= 3 and n_works <= 5
"""
)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).repeated_rare()


@REG.query(
    _COUNTS
    + """
, r as (select work_id, sum(n) as r from n group by work_id), z as (select sum(n) as z from n), s as (
  select work_id, term, n, n_works, r * c / z as e, r * c / z * (1 - r / z) * (1 - c / z) as v
  from n join c using (term) join r using (work_id), z
), q as (
  select work_id, term, n, n_works, round(case when v > 0 then (n - e) / sqrt(v) else 0 end, 6) as residual from s
)
select *, cast(row_number() over (partition by work_id order by residual desc, term) as integer) as rank from q qualify rank <= 5
"""
)
def p3_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The five most characteristic words of every work."""
    return terms.top_terms(_scores(spark, sf).rows, 5)


@REG.query()
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(load(spark, sf, "documents", "doc_id", "text"))


def _runs_sql(key: str, text: str, table: str) -> str:
    """All runs of twelve words of a table's texts, each once per key."""
    return f"""select distinct {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) as g from (
      select {key}, list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) as w from {table}
      where {key} is not null and {text} is not null) where len(w) >= 12"""


@REG.query(f"""with i as ({_runs_sql("item_id", "item_text", "eval_items")}), d as ({_runs_sql("doc_id", "text", "documents")})
select distinct item_id, doc_id from i join d using (g)""")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.found(load(spark, sf, "documents", "doc_id", "text"), load(spark, sf, "eval_items", "item_id", "item_text"))


@REG.query()
def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where the leaked passages stand, in code points of the stored text."""
    docs, items = load(spark, sf, "documents", "doc_id", "text"), load(spark, sf, "eval_items", "item_id", "item_text")
    return leaks.leaked_spans(docs, items).distinct()


_WINDOWS = """with d as (select distinct doc_id, text from documents where doc_id is not null and length(text) >= 320), h as (
  select doc_id, unnest(range(1, length(text) - 318)) as pos, unnest(list_transform(range(1, length(text) - 318), lambda i: md5(substr(text, i, 320)))) as g from d
)"""


@REG.query(f"""{_WINDOWS}, g as (select distinct doc_id, g from h)
select distinct a.doc_id as doc_a, b.doc_id as doc_b from g a join g b on a.g = b.g and a.doc_id < b.doc_id""")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.Shared(load(spark, sf, "documents", "doc_id", "text")).pairs()


@REG.query(f"""{_WINDOWS}, m as (select g from h group by g having count(distinct doc_id) > 1),
s as (select doc_id, least(320, coalesce(pos - lag(pos) over (partition by doc_id order by pos), 320)) as step from h semi join m using (g)),
c as (select doc_id, sum(step)::bigint as shared_chars from s group by doc_id), k as (select text, count(*) as n_copies from d group by text)
select doc_id, length(text)::bigint as n_chars, shared_chars, n_copies, round(shared_chars / length(text), 4) as shared_part from c join d using (doc_id) join k using (text)""")
def p10_shared(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each document stands in other documents too."""
    c = spans.Shared(load(spark, sf, "documents", "doc_id", "text")).coverage()
    return c.withColumn("shared_part", F.round(F.col("shared_chars") / F.col("n_chars"), 4))


@REG.query()
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "affiliations_raw", "affil_id", "raw_affiliation", "n_resolved_institutions")
    return canon.found(a, load(spark, sf, "institutions"), load(spark, sf, "country_regions"))


@REG.query()
def p4_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """How often each unresolved string that means no listed entry was typed."""
    a = load(spark, sf, "affiliations_raw", "affil_id", "raw_affiliation", "n_resolved_institutions")
    open_ = a.where("n_resolved_institutions = 0 and affil_id is not null").dropDuplicates(["affil_id"])
    m = canon.mapped(open_, load(spark, sf, "institutions"), load(spark, sf, "country_regions"))
    none = m.where(F.col("institution_id") == canon.NONE).select("affil_id")
    hit = open_.join(none, "affil_id", "left_semi")
    return hit.groupBy("raw_affiliation").agg(F.count("*").alias("n"))


def _organisations(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "authorship_inst", "work_id", "author_order", "institution_id", "institution_name", "country_code")
    b = load(spark, sf, "affiliations_raw", "work_id", "author_order", "raw_affiliation", "n_resolved_institutions", "resolved_institution_id")
    return variants.organisations(variants.spellings_of(a, b), variants.written_together(a, b), variants.countries_of(a))


@REG.query()
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return variants.pairs(_organisations(spark, sf))


@REG.query()
def p5_organisations(spark: SparkSession, sf: str) -> DataFrame:
    """Every spelling with its organisation; one row per spelling."""
    return _organisations(spark, sf)


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.clustered(
        load(spark, sf, "works", "work_id", "title", "abstract", "loaded_at"), load(spark, sf, "work_topics", "work_id", "cluster")
    )


@REG.query()
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.corrected(_clustered(spark, sf))


@REG.query()
def p6_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Size and three most typical members of every cluster."""
    return clusters.described(_clustered(spark, sf))


@REG.query()
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return languages.found(load(spark, sf, "works", "work_id", "language", "abstract", "loaded_at"))


@REG.query()
def p7_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of every abstract with its language and confidence."""
    s = languages.segmented(load(spark, sf, "works", "work_id", "language", "abstract", "loaded_at"))
    return s.select("work_id", "segment", "language", F.round("confidence", 4).alias("confidence"), F.length("text").alias("n_chars"))
