"""Queries that go through the file sources and sinks: tables are written to the shared folder and read back by the readers under test."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma import schemas
from stemma.operators import flatten
from stemma.plans import reference
from stemma.plans.registry import Registry
from stemma.session import shared_dir
from stemma.sources import files
from stemma.tables import load

REG = Registry()


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, sf: str) -> str:
    """The raw records as gzipped JSON lines, a folder for each of their files; gives the glob."""
    root = _folder(spark, "lines")
    load(spark, sf, "raw_works", "file_name", "record").write.partitionBy("file_name").option("compression", "gzip").text(root)
    return f"{root}/*/*.gz"


_IDS = """p as (select split_part(cast(record as json)->>'$.id', '/', -1) as work_id, cast(record as json) as r from raw_works
  where json_valid(record) and coalesce(record::json->>'$.id', '') <> '')"""


@REG.query(f"with {_IDS} select work_id, count(*) as n_lines from p group by work_id")
def s6_jsonl_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of each record, from gzipped JSON lines read as lines."""
    lines = files.read_work_lines(spark, _lines(spark, sf))
    ids = flatten.parse_lines(lines).where("id is not null").select(flatten.short_id(F.col("id")).alias("work_id"))
    return ids.groupBy("work_id").agg(F.count("*").alias("n_lines"))


@REG.query(f"""with {_IDS} select work_id, r->>'$.title' as title, cast(r->>'$.publication_year' as integer) as year,
  cast(coalesce(json_array_length(r->'$.authorships'), 0) as integer) as n_authors, count(*) as n from p group by all""")
def s6_jsonl_records(spark: SparkSession, sf: str) -> DataFrame:
    """Typed records of gzipped JSON lines under the explicit schema."""
    r = files.read_records(spark, _lines(spark, sf)).where("coalesce(id, '') <> ''")
    n = F.greatest(F.coalesce(F.size("authorships"), F.lit(0)), F.lit(0))
    rows = r.select(flatten.short_id(F.col("id")).alias("work_id"), "title", F.col("publication_year").alias("year"), n.alias("n_authors"))
    return rows.groupBy("work_id", "title", "year", "n_authors").agg(F.count("*").alias("n"))


@REG.query(reference.REG.oracles["s8_yearly_counts"])
def s7_json_document(spark: SparkSession, sf: str) -> DataFrame:
    """The yearly counts as one JSON document in a file, read and joined over the union of its maps' years."""
    y = reference.Base(spark, sf).yearly
    as_map = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c) > 0, F.struct(F.col("year").cast("string"), F.col(c)))))
    path = _folder(spark, "counts")
    y.agg(as_map("ai_bio").alias("ai_bio"), as_map("bio_baseline").alias("bio_baseline")).write.json(path)  # one row
    return files.yearly_counts(files.read_json_document(spark, path, schemas.COUNTS_BY_YEAR))


@REG.query("select country_code, country_name, region, coalesce(eu27, '') as eu27 from country_regions")
def s9_csv_countries(spark: SparkSession, sf: str) -> DataFrame:
    """The country table through CSV: the code NA stays a country, names with commas stay whole."""
    path = _folder(spark, "countries")
    files.write_human_csv(load(spark, sf, "country_regions", *schemas.COUNTRY_REGIONS.names), path)
    return files.read_country_regions(spark, path)


@REG.query(f"with {reference._W} select work_id, year, title, abstract, cast(null as varchar) as human_ai_role, cast(null as varchar) as human_notes from w")
def s10_csv_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All works as a labelling sheet and back: line ends, quotes, commas and blanks of the texts are kept."""
    w = reference.Base(spark, sf).works("year", "title", "abstract").select("work_id", "year", "title", "abstract")
    path = _folder(spark, "sheet")
    empty = F.lit(None).cast("string")
    files.write_human_csv(w.withColumns({"human_ai_role": empty, "human_notes": empty}), path)
    return files.read_labelled_csv(spark, path)


_ROLE = "case when contains(lower(coalesce(abstract, '')), '{t}') then 'ai_method' else 'not_ai' end"


@REG.query(f"""with {reference._W}, a as (select work_id, {_ROLE.format(t="learning")} as ai_role, 'first' as model from w),
  b as (select work_id, {_ROLE.format(t="neural")} as ai_role, 'second' as model from w where year % 2 = 0)
  select work_id, coalesce(b.ai_role, a.ai_role) as ai_role, coalesce(b.model, a.model) as model from a left join b using (work_id)""")
def s11_label_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to a label cache, the later, smaller one for a part of the works; the last record of each counts."""
    w = reference.Base(spark, sf).works("year", "abstract")
    role = lambda t: F.when(F.contains(F.lower(F.coalesce("abstract", F.lit(""))), F.lit(t)), "ai_method").otherwise("not_ai").alias("ai_role")
    path = _folder(spark, "cache")
    files.append_cache(w.select("work_id", role("learning"), F.lit("first").alias("model")).coalesce(1), path)
    files.append_cache(w.where("year % 2 = 0").select("work_id", role("neural"), F.lit("second").alias("model")), path)
    return files.read_label_cache(spark, path).select("work_id", "ai_role", "model")


@REG.query("select work_id, keyword, score from keywords where score >= 0.5")
def k1_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Gzipped JSON lines written and read under a schema."""
    k = load(spark, sf, "keywords", "work_id", "keyword", "score").where("score >= 0.5")
    path = _folder(spark, "keywords")
    files.write_json_lines(k, path)
    return spark.read.schema(k.schema).json(path)


@REG.query("select year, type, count(*) as n from works where year is not null group by all")
def k3_replaced_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table created, then replaced, partitioned by year."""
    path = _folder(spark, "table")
    files.replace_table(spark.range(3).select(F.lit("x").alias("type"), F.lit(1).alias("n"), F.lit(0).alias("year")), path)
    counts = load(spark, sf, "works", "year", "type").where("year is not null").groupBy("year", "type").agg(F.count("*").alias("n"))
    return files.replace_table(counts.select("type", "n", "year"), path, ["year"]).select("year", "type", "n")


@REG.query("""select country_code, count(*) as n, 'a;b -- c' as note from author_countries where country_code >= 'M' and weight > 0.1 group by country_code""")
def k5_script(spark: SparkSession, sf: str) -> DataFrame:
    """A script of several statements with bound parameters: views, comments, and strings that hold what parts statements."""
    view = f"links_{uuid.uuid4().hex}"
    files.replace_view(load(spark, sf, "author_countries", "country_code", "weight"), view)
    script = f"""
      -- heavy links; those above the bound
      create or replace temp view {view}_heavy as select country_code from {view} where weight > 0.1 /* a ';' and a :name */;
      select country_code, count(*) as n, :note as note from {view}_heavy where country_code >= :least group by country_code;
    """
    return files.run_script(spark, script, note="a;b -- c", least="M", unused=1)


@REG.query("select work_id, keyword, score from keywords")
def k8_keyed_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A cache whose key is its rows' content: filled by the first call, read by the second."""
    k = load(spark, sf, "keywords", "work_id", "keyword", "score")
    root = _folder(spark, "cached")
    files.cached(k, root, "keywords", ["work_id", "keyword", "score"])
    return files.cached(k, root, "keywords", ["work_id", "keyword", "score"])
