"""Queries of the general training-data problems (1 and 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators import flatten, keyskew
from stemma.plans.registry import Registry
from stemma.tables import load

REG = Registry()

_FIRST = """
with p as (
  select file_name, line_no, cast(record as json) r from raw_works
  where json_valid(record) and coalesce(record::json->>'$.id', '') <> ''
), w as (
  select split_part(r->>'$.id', '/', -1) as work_id, r from p
  qualify row_number() over (partition by r->>'$.id' order by file_name, line_no) = 1
), a as (
  select work_id, unnest(cast(r->'$.authorships' as json[])) as a,
         generate_subscripts(cast(r->'$.authorships' as json[]), 1) - 1 as ord from w
)
"""
_P1 = (
    _FIRST
    + """
, i as (
  select work_id, ord, unnest(cast(a->'$.institutions' as json[])) as i,
         generate_subscripts(cast(a->'$.institutions' as json[]), 1) - 1 as sub_ord from a
), c as (
  select distinct work_id, ord, unnest(cast(a->'$.countries' as varchar[])) as code from a
), cr as (
  select work_id, ord, row_number() over (partition by work_id, ord order by code) - 1 as sub_ord, code
  from c where coalesce(code, '') <> ''
), k as (
  select work_id, unnest(map_entries(cast(r->'$.abstract_inverted_index' as map(varchar, integer[])))) as e from w
), t as (
  select work_id, r->>'$.primary_topic.display_name' as t0, r->>'$.primary_topic.subfield.display_name' as t1,
         r->>'$.primary_topic.field.display_name' as t2, r->>'$.primary_topic.domain.display_name' as t3 from w
), u as (
  select work_id, 'author' as child, ord, 0 as sub_ord, split_part(nullif(a->>'$.author.id', ''), '/', -1) as item from a
  union all select work_id, 'institution', ord, sub_ord, split_part(nullif(i->>'$.id', ''), '/', -1) from i
  union all select work_id, 'country', ord, sub_ord, code from cr
  union all select work_id, 'topic', 0, 0, t0 from t
  union all select work_id, 'topic', 1, 0, t1 from t
  union all select work_id, 'topic', 2, 0, t2 from t
  union all select work_id, 'topic', 3, 0, t3 from t
  union all select work_id, 'word', unnest(e.value), 0, e.key from k
)
select distinct work_id, child, cast(ord as integer) as ord, cast(sub_ord as integer) as sub_ord, item
from u where coalesce(item, '') <> '' and ord is not null
"""
)


@REG.query(_P1)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.found(load(spark, sf, "raw_works", "file_name", "line_no", "record"))


@REG.query(
    _FIRST
    + """
, i as (
  select work_id, ord, unnest(cast(a->'$.institutions' as json[])) as i from a
), n as (
  select i->>'$.id' as id, i->>'$.display_name' as name, work_id, ord from i
), f as (
  select distinct work_id, ord, true as has from n where coalesce(id, '') <> '' or coalesce(name, '') <> ''
), u as (
  select work_id, ord, a->>'$.author.id' as id, a->>'$.author.display_name' as name from a
), s as (
  select case when coalesce(id, '') <> '' then 'identified' when coalesce(name, '') <> '' then 'named' else 'blank' end as own, coalesce(has, false) as has,
    work_id from u left join f using (work_id, ord)
), o as (
  select distinct work_id from (select work_id, unnest(map_entries(cast(r->'$.abstract_inverted_index' as map(varchar, integer[])))) as e from w)
  where e.key <> '' and len(list_filter(e.value, lambda x: x is not null)) > 0
), t as (
  select work_id, coalesce(r->>'$.primary_topic.display_name', '') <> '' or coalesce(r->>'$.primary_topic.subfield.display_name', '') <> ''
    or coalesce(r->>'$.primary_topic.field.display_name', '') <> '' or coalesce(r->>'$.primary_topic.domain.display_name', '') <> '' as stated from w
), h as (select distinct work_id from s where own <> 'blank')
select 'author' as child, case when own <> 'blank' and has then own || '_affiliated' else own end as subtype, count(*) as n from s group by all
union all select 'institution', case when coalesce(id, '') <> '' then 'registered' when coalesce(name, '') <> '' then 'unregistered' else 'blank' end, count(*) from n group by all
union all select 'record', case when h.work_id is not null and o.work_id is not null then 'attributed_text' when h.work_id is not null then 'attributed'
  when o.work_id is not null then 'text' when t.stated then 'classified' else 'bare' end, count(*)
  from t left join h on h.work_id = t.work_id left join o on o.work_id = t.work_id group by all
"""
)
def p1_subtypes(spark: SparkSession, sf: str) -> DataFrame:
    """How many authors, institutions and whole records fall into each structural subtype."""
    raw = load(spark, sf, "raw_works", "file_name", "line_no", "record")
    rows = flatten.nodes(flatten.typed_records(flatten.first_deliveries(raw)))
    rows = rows.where(F.col("child").isin("author", "institution", "record"))
    return rows.groupBy("child", "subtype").agg(F.count("*").alias("n"))


@REG.query("""
select 'country_code' as field, country_code as value, count(*) as n_rows, round(sum(weight), 6) as weight_sum,
       count(distinct work_id) as n_works from author_countries group by country_code
union all
select 'institution_id', institution_id, count(*), cast(null as double), count(distinct work_id)
from authorship_inst group by institution_id
""")
def p2_key_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, summed weight and distinct works of every country code and every institution id."""
    a = keyskew.key_totals(load(spark, sf, "author_countries"), "country_code", "work_id", "weight")
    b = keyskew.key_totals(load(spark, sf, "authorship_inst"), "institution_id", "work_id")
    return a.select(F.lit("country_code").alias("field"), "value", "n_rows", F.round("weight_sum", 6).alias("weight_sum"),
                    F.col("n_distinct").alias("n_works")).unionAll(
        b.select(F.lit("institution_id"), "value", "n_rows", "weight_sum", "n_distinct"))
