"""Named queries for the reference's operators, with oracle SQL over the same tables.

Base tables are cleaned first (one row per work, links without copies).  Sums of
doubles are rounded to 6 digits on both sides, as their order differs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import stats, text
from stemma.operators import credit, evaluate, flatten, quality, resolve, sampling, topics
from stemma.plans.registry import Registry
from stemma.session import reused
from stemma.tables import clean_links, latest_works, load

REG = Registry()

# The search terms of the corpus (one of each group must be mentioned) and of its baseline (one of them), and the work types.
AI_TERMS = [
    "machine learning", "deep learning", "neural network", "artificial intelligence", "large language model", "transformer model",
    "random forest", "support vector machine", "convolutional neural network", "graph neural network", "foundation model", "generative model",
]
BIO_TERMS = [
    "genomics", "genome", "gene expression", "transcriptomics", "single-cell", "protein structure", "protein design", "CRISPR",
    "gene editing", "synthetic biology", "variant calling", "epigenomics", "metagenomics", "drug discovery",
]
BASELINE_TERMS = ["genomics", "genome", "transcriptomics", "CRISPR", "synthetic biology", "protein design"]
WORK_TYPES = ["article", "preprint", "review"]
EARLY, RECENT = (2013, 2016), (2018, 2020)


# what compatibility decomposition makes of some characters
_COMPAT = "replace(replace(replace(replace(translate(coalesce({c}, ''), chr(160) || 'ªº¹²³', ' ao123'), '¼', '14'), '½', '12'), '¾', '34'), '…', '...')"


def _norm_sql(c: str) -> str:
    """The oracle's form of text.normalize_org."""
    s = f"lower(regexp_replace(strip_accents({_COMPAT.format(c=c)}), '[^\\x00-\\x7F]', '', 'g'))"
    s = f"regexp_replace({s}, '[^a-z0-9, ]+', ' ', 'g')"
    for a, b in text.ABBREVIATIONS:
        s = f"regexp_replace({s}, '\\b{a}\\b', '{b}', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'), ' ,')"


_W = """w as (
  select * exclude (rn) from (
    select *, row_number() over (partition by work_id order by loaded_at desc nulls last, cited_by_count desc nulls last) as rn
    from works where work_id is not null) where rn = 1)"""
_LK = "lk as (select distinct work_id, author_order, country_code, weight from author_countries where country_code is not null)"
_TP = """tp as (select work_id, min(cluster) as cluster from work_topics where cluster is not null and work_id is not null
  group by work_id having min(cluster) = max(cluster))"""
_INST = """inst as (
  select institution_id, n_works, iname as institution_name, ctry as country_code, itype as institution_type
  from (select institution_id, count(distinct work_id) as n_works from authorship_inst where institution_id is not null group by 1)
  left join (select institution_id, institution_name as iname from authorship_inst where institution_name is not null
    group by 1, 2 qualify row_number() over (partition by institution_id order by count(*) desc, institution_name) = 1) using (institution_id)
  left join (select institution_id, country_code as ctry from authorship_inst where country_code is not null
    group by 1, 2 qualify row_number() over (partition by institution_id order by count(*) desc, country_code) = 1) using (institution_id)
  left join (select institution_id, institution_type as itype from authorship_inst where institution_type is not null
    group by 1, 2 qualify row_number() over (partition by institution_id order by count(*) desc, institution_type) = 1) using (institution_id))"""
_AF = f"""af as materialized (
  select *, {_norm_sql("raw_affiliation")} as norm from (
    select distinct affil_id, work_id, author_order, raw_affiliation, n_resolved_institutions, resolved_institution_id from affiliations_raw))"""
_ALIAS = """alias as (
  select norm, resolved_institution_id as institution_id from af where resolved_institution_id is not null and norm <> ''
  group by 1, 2 qualify row_number() over (partition by norm order by count(*) desc, resolved_institution_id) = 1)"""
_EXACT = "res as (select work_id, author_order, raw_affiliation, institution_id from af left join alias using (norm) where n_resolved_institutions = 0)"


def segments_sql(norm: str) -> str:
    """The oracle's form of text.org_segments."""
    words = ", ".join(f"'{w}'" for w in text.ORG_WORDS)
    segs = f"list_filter(list_transform(string_split({norm}, ','), lambda x: trim(x)), lambda x: x <> '')"
    kept = f"""list_filter({segs}, lambda x: len(list_intersect(string_split(x, ' '), [{words}])) > 0
      and not regexp_matches(x, '^({"|".join(text.PART_PREFIXES)})'))"""
    return f"case when len({kept}) > 0 then {kept} else ({segs})[:2] end"


def _sorted_sql(c: str) -> str:
    """The oracle's form of resolve.token_sort for normalised text."""
    return f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"


# LCS by rows of its table: each letter of one text turns the row of the letters before it into its own.
_LCS = """list_max(list_reduce(list_prepend(list_transform(string_split(b, ''), lambda d: 0),
      list_transform(string_split(a, ''), lambda c: list_transform(string_split(b, ''), lambda d: case when c = d then 1 else 0 end))),
      lambda r, m: list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1),
        lambda k: greatest(r[k], (case when k > 1 then r[k - 1] else 0 end) + m[k]))))))"""


def _cascade_sql(known: str, asked: str, p: str = "") -> str:
    """The oracle's cascade: ``{p}hit`` (norm, institution_id, method, score) of the distinct strings of ``asked``, aliases from ``known``.

    Names whose score can reach 90 differ by at most a tenth of their joint length, insertions and deletions counted, and
    no fewer of these can be than edits in all; so the engine's edit distance is a lossless bound before the exact score.
    """
    return f"""{p}alias as (
    select norm, resolved_institution_id as institution_id from {known} where norm <> ''
    group by 1, 2 qualify row_number() over (partition by norm order by count(*) desc, resolved_institution_id) = 1
  ), {p}open as materialized (select distinct norm from {asked}), {p}names as materialized (
    select institution_id, n_works, {_sorted_sql("name")} as b from (select institution_id, n_works, {_norm_sql("institution_name")} as name from inst) where name <> ''
  ), {p}segs as materialized (
    select norm, unnest(g) as seg, generate_subscripts(g, 1) as pos from (
      select norm, {segments_sql("norm")} as g from {p}open where norm not in (select norm from {p}alias))
  ), {p}near as materialized (
    select s.a, n.b from (select distinct {_sorted_sql("seg")} as a from {p}segs where length(seg) >= 6) s
    join (select distinct b from {p}names) n on abs(length(a) - length(b)) * 10 <= length(a) + length(b) and levenshtein(a, b) * 10 <= length(a) + length(b)
  ), {p}score as materialized (select a, b, 200.0::double * {_LCS} / (length(a) + length(b)) as score from {p}near),
  {p}fuzzy as (
    select norm, institution_id, score from {p}segs s join {p}score c on c.a = {_sorted_sql("s.seg")} join {p}names n using (b)
    where length(seg) >= 6 and score >= 90
    qualify row_number() over (partition by norm order by score desc, pos, n_works desc, institution_id) = 1
  ), {p}hit as (
    select o.norm, coalesce(l.institution_id, f.institution_id) as institution_id,
      case when l.institution_id is not null then 'exact_alias' when f.institution_id is not null then 'fuzzy_name' else 'unresolved' end as method,
      case when l.institution_id is not null then 100.0::double else coalesce(f.score, 0) end as score
    from {p}open o left join {p}alias l using (norm) left join {p}fuzzy f using (norm))"""


_CASCADE = f"""{_cascade_sql("(select * from af where resolved_institution_id is not null)", "(select * from af where n_resolved_institutions = 0)")}"""
_RES = f"""{_CASCADE},
  res as (select work_id, author_order, raw_affiliation, institution_id, method, score from af join hit using (norm) where n_resolved_institutions = 0)"""
_EN = f"""{_W}, {_LK}, {_INST}, {_AF}, {_RES}, rec as (
  select r.work_id, r.author_order, i.country_code, count(*) over (partition by r.work_id, r.author_order) as k
  from (select distinct work_id, author_order, institution_id from res where institution_id is not null) r
  join inst i using (institution_id)
  where i.country_code is not null
    and not exists (select 1 from lk where lk.work_id = r.work_id and lk.author_order = r.author_order)
), en as (
  select work_id, author_order, country_code, weight, 'provider' as source from lk
  union all
  select rec.work_id, author_order, country_code, 1.0::double / nullif(w.n_authors, 0) / k, 'recovered' from rec join w using (work_id)
), vc as (
  select e.work_id, w.year, e.country_code,
    case when e.country_code = 'US' then 'United States' when e.country_code = 'CN' then 'China' when r.eu27 = 'EU27' then 'EU27'
      when e.country_code = 'GB' then 'United Kingdom' when e.country_code = 'IN' then 'India' when e.country_code = 'JP' then 'Japan'
      when e.country_code = 'KR' then 'South Korea' else 'Rest of world' end as bloc,
    r.region, sum(e.weight) as credit, sum(e.weight * w.sampling_weight) as cw, w.top10pct, w.top1pct, w.citation_percentile
  from en e join w using (work_id) left join country_regions r on r.country_code = e.country_code group by all
), cl as (
  select e.work_id, w.year, max(w.sampling_weight) as sw, count(distinct e.country_code) as n_countries,
    bool_or(e.country_code = 'US') as has_us, bool_or(e.country_code = 'CN') as has_cn, bool_or(r.region = 'Africa') as has_africa,
    bool_or(r.region is distinct from 'Africa') as has_non_africa
  from en e join w using (work_id) left join country_regions r on r.country_code = e.country_code group by e.work_id, w.year
), b as (select min(year) as y0, max(year) as y1 from w)"""
_TEXT = "lower(coalesce(title, '') || '. ' || coalesce(abstract, ''))"


def _any(terms: list[str]) -> str:
    return "(" + " or ".join(f"contains({_TEXT}, '{t.lower()}')" for t in terms) + ")"


_YC = f"""{_W}, yc as (
  select year, count(*) filter (where {_any(AI_TERMS)} and {_any(BIO_TERMS)}) as ai_bio, count(*) filter (where {_any(BASELINE_TERMS)}) as bio_baseline
  from w where year is not null group by year)"""


class Base:
    """The cleaned tables of one data set, made when asked for; only the named columns are read."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    def works(self, *columns: str) -> DataFrame:
        return latest_works(load(self.spark, self.sf, "works", "work_id", "loaded_at", "cited_by_count", *columns))

    @cached_property
    def links(self) -> DataFrame:
        return clean_links(load(self.spark, self.sf, "author_countries"))

    @cached_property
    def regions(self) -> DataFrame:
        return load(self.spark, self.sf, "country_regions")

    @cached_property
    def institutions(self) -> DataFrame:
        cols = ("work_id", "institution_id", "institution_name", "country_code", "institution_type")
        return resolve.institution_dimension(load(self.spark, self.sf, "authorship_inst", *cols))

    @cached_property
    def affiliations(self) -> tuple[DataFrame, DataFrame]:
        return resolve.split_affiliations(load(self.spark, self.sf, "affiliations_raw").dropDuplicates(["affil_id"]))

    @cached_property
    def exact(self) -> DataFrame:
        """Unresolved strings resolved by alias only."""
        known, open_ = self.affiliations
        rows = open_.join(resolve.alias_table(known.where("norm <> ''")), "norm", "left")
        return rows.select("work_id", "author_order", "raw_affiliation", "institution_id")

    @cached_property
    def resolved(self) -> DataFrame:
        """Every unresolved string by the whole cascade, written once."""

        def build() -> DataFrame:
            cols = ("work_id", "institution_id", "institution_name", "country_code", "institution_type")
            return resolve.resolved_affiliations(load(self.spark, self.sf, "affiliations_raw"), load(self.spark, self.sf, "authorship_inst", *cols))

        return reused(self.spark, "resolved", self.paths("affiliations_raw", "authorship_inst"), build)

    def paths(self, *tables: str) -> list[str]:
        return [f"{self.sf}/{t}.parquet" for t in tables]

    @cached_property
    def enriched(self) -> DataFrame:
        """The links of all authors, recovered ones too: one table, written once and read by every query on countries."""
        build = lambda: credit.enriched_links(self.links, self.resolved, self.institutions, self.works("n_authors"))
        return reused(self.spark, "enriched", self.paths("affiliations_raw", "authorship_inst", "author_countries", "works"), build)

    @cached_property
    def credit(self) -> DataFrame:
        w = self.works("year", "sampling_weight", "top10pct", "top1pct", "citation_percentile")
        return credit.country_credit(self.enriched, w, self.regions)

    @cached_property
    def collab(self) -> DataFrame:
        return credit.work_collab(self.enriched, self.works("year", "sampling_weight"), self.regions)

    @cached_property
    def topics(self) -> DataFrame:
        t = load(self.spark, self.sf, "work_topics", "work_id", "cluster").where("cluster is not null and work_id is not null")
        t = t.groupBy("work_id").agg(F.min("cluster").alias("cluster"), F.max("cluster").alias("hi"))
        return t.where("cluster = hi").select("work_id", "cluster")

    def years(self) -> tuple[Column, Column]:
        """First and last year with works, the range the queries are bound to: scalar subqueries, so no job runs while a query is built."""
        y = load(self.spark, self.sf, "works", "year", "work_id").where("work_id is not null")
        return y.agg(F.min("year")).scalar(), y.agg(F.max("year")).scalar()

    @cached_property
    def yearly(self) -> DataFrame:
        w = self.works("year", "title", "abstract").where("year is not null")
        t = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit("")))
        ai, bio = text.search_filter(t, [AI_TERMS, BIO_TERMS]), text.mentions_any(t, BASELINE_TERMS)
        return w.groupBy("year").agg(F.count(F.when(ai, 1)).alias("ai_bio"), F.count(F.when(bio, 1)).alias("bio_baseline"))


def _r(c: object, name: str, digits: int = 6):
    """A column rounded and named."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name)


def _ratio(a, b):
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def _total(c):
    """The sum of a column over all rows (of an aggregate)."""
    return F.sum(c).over(Window.partitionBy())


# ---- Q1 to Q12: the named analytic queries -------------------------------------------------------------------------


@REG.query(f"""with {_YC} select year, ai_bio, bio_baseline, round(ai_bio / nullif(bio_baseline, 0), 6) as ai_share_of_bio,
  round(ai_bio / nullif(lag(ai_bio) over (order by year), 0) - 1, 6) as yoy_growth from yc where year between 2010 and 2025""")
def q1_growth_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """The window is over the selected years only, one row each."""
    y = Base(spark, sf).yearly.where(F.col("year").between(2010, 2025))
    growth = _ratio(F.col("ai_bio"), F.lag("ai_bio").over(Window.orderBy("year"))) - 1
    return y.select("year", "ai_bio", "bio_baseline", _r(_ratio(F.col("ai_bio"), F.col("bio_baseline")), "ai_share_of_bio"), _r(growth, "yoy_growth"))


@REG.query(f"""with {_EN}, s as (select year, bloc, sum(cw) as o from vc, b where year between y0 and y1 group by all)
  select year, bloc, round(o, 6) as output, round(o / nullif(sum(o) over (partition by year), 0), 6) as share from s""")
def q2_country_share_by_year(spark: SparkSession, sf: str) -> DataFrame:
    d = Base(spark, sf)
    y0, y1 = d.years()
    s = d.credit.where(F.col("year").between(y0, y1)).groupBy("year", "bloc").agg(F.sum("credit_weighted").alias("o"))
    return s.select("year", "bloc", _r("o", "output"), _r(_ratio(F.col("o"), F.sum("o").over(Window.partitionBy("year"))), "share"))


@REG.query(f"""with {_EN}, s as (
    select bloc, sum(cw) as o, sum(case when top10pct then cw else 0 end) as t10, sum(case when top1pct then cw else 0 end) as t1
    from vc, b where year between y0 and y1 - 1 group by all), z as (select sum(o) as o, sum(t10) as t10, sum(t1) as t1 from s)
  select bloc, round(s.o, 6) as output, round(s.o / nullif(z.o, 0), 6) as share_all, round(s.t10 / nullif(z.t10, 0), 6) as share_top10,
    round(s.t1 / nullif(z.t1, 0), 6) as share_top1, round((s.t10 / nullif(z.t10, 0)) / nullif(s.o / nullif(z.o, 0), 0), 6) as impact_ratio from s, z""")
def q3_country_impact(spark: SparkSession, sf: str) -> DataFrame:
    """The last year is left out; a null flag is credited as not highly cited."""
    d = Base(spark, sf)
    y0, y1 = d.years()
    cw = F.col("credit_weighted")
    s = d.credit.where(F.col("year").between(y0, y1 - 1)).groupBy("bloc").agg(
        F.sum(cw).alias("o"), F.sum(F.when(F.col("top10pct"), cw).otherwise(0)).alias("t10"), F.sum(F.when(F.col("top1pct"), cw).otherwise(0)).alias("t1")
    )
    share = {c: _ratio(F.col(c), _total(c)) for c in ("o", "t10", "t1")}
    return s.select("bloc", _r("o", "output"), _r(share["o"], "share_all"), _r(share["t10"], "share_top10"), _r(share["t1"], "share_top1"),
                    _r(_ratio(share["t10"], share["o"]), "impact_ratio"))


@REG.query(f"""with {_EN} select year, round(sum(sw), 6) as papers, round(sum(case when n_countries > 1 then sw end) / nullif(sum(sw), 0), 6) as intl_collab_rate,
  round(sum(case when has_us and has_cn then sw end) / nullif(sum(case when has_us or has_cn then sw end), 0), 6) as us_cn_share_of_us_or_cn,
  round(sum(case when has_us and has_cn then sw end) / nullif(sum(case when has_us then sw end), 0), 6) as us_papers_with_cn
  from cl, b where year between y0 and y1 group by year""")
def q4_collaboration(spark: SparkSession, sf: str) -> DataFrame:
    """A share is null, not 0, when no work qualifies."""
    d = Base(spark, sf)
    y0, y1 = d.years()
    sw, us, cn = F.col("sampling_weight"), F.col("has_us"), F.col("has_cn")
    part = lambda c: F.sum(F.when(c, sw))
    g = d.collab.where(F.col("year").between(y0, y1)).groupBy("year")
    return g.agg(_r(F.sum(sw), "papers"), _r(_ratio(part(F.col("n_countries") > 1), F.sum(sw)), "intl_collab_rate"),
                 _r(_ratio(part(us & cn), part(us | cn)), "us_cn_share_of_us_or_cn"), _r(_ratio(part(us & cn), part(us)), "us_papers_with_cn"))


@REG.query(f"""with {_EN}, s as (select country_code, sum(cw) as o, count(distinct work_id) as papers_sampled from vc, b
    where region = 'Africa' and year between y0 and y1 group by 1)
  select country_code, country_name, round(o, 6) as output, papers_sampled,
    round(o / nullif((select sum(cw) from vc, b where year between y0 and y1), 0), 6) as world_share
  from s join country_regions using (country_code)""")
def q5_africa(spark: SparkSession, sf: str) -> DataFrame:
    d = Base(spark, sf)
    y0, y1 = d.years()
    v = d.credit.where(F.col("year").between(y0, y1))
    # one pass: the world total is a window over the countries' sums
    s = v.groupBy("country_code", "region").agg(F.sum("credit_weighted").alias("o"), F.countDistinct("work_id").alias("papers_sampled"))
    s = s.withColumn("world", _total("o")).where("region = 'Africa'")
    s = s.join(d.regions.select("country_code", "country_name"), "country_code")
    return s.select("country_code", "country_name", _r("o", "output"), "papers_sampled", _r(_ratio(F.col("o"), F.col("world")), "world_share"))


@REG.query(f"""with {_EN}, c as (select year, sum(case when region = 'Africa' then cw else 0 end) as a, sum(cw) as o from vc, b where year between y0 and y1 group by 1),
  k as (select year, sum(case when has_africa and has_non_africa then sw end) / nullif(sum(case when has_africa then sw end), 0) as p from cl, b
    where year between y0 and y1 group by 1)
  select year, round(a / nullif(o, 0), 6) as africa_share, round(p, 6) as africa_with_external_partner from c left join k using (year)""")
def q6_africa_trend(spark: SparkSession, sf: str) -> DataFrame:
    d = Base(spark, sf)
    y0, y1 = d.years()
    cw, sw = F.col("credit_weighted"), F.col("sampling_weight")
    c = d.credit.where(F.col("year").between(y0, y1)).groupBy("year")
    c = c.agg(_r(_ratio(F.sum(F.when(F.col("region") == "Africa", cw).otherwise(0)), F.sum(cw)), "africa_share"))
    both = F.col("has_africa") & F.col("has_non_africa")
    k = d.collab.where(F.col("year").between(y0, y1)).groupBy("year")
    k = k.agg(_r(_ratio(F.sum(F.when(both, sw)), F.sum(F.when(F.col("has_africa"), sw))), "africa_with_external_partner"))
    return c.join(k, "year", "left")


_CS = f"""{_TP}, tw as (select w.*, tp.cluster from w join tp using (work_id)), cy as (
    select cluster, year, sum(sampling_weight) as n_weighted from tw group by all
  ), ea as (select cluster, sum(n_weighted) as s from cy where year between {EARLY[0]} and {EARLY[1]} group by 1),
  re as (select cluster, sum(n_weighted) as s from cy where year between {RECENT[0]} and {RECENT[1]} group by 1),
  sz as (select cluster, count(*) as n_works, median(year) as median_year, avg(citation_percentile) as mean_citation_pct from tw group by 1),
  cs0 as (select k.c::integer as cluster, coalesce(n_works, 0) as n_works, median_year, mean_citation_pct,
      coalesce(ea.s / nullif((select sum(s) from ea), 0), 0) as early_share, coalesce(re.s / nullif((select sum(s) from re), 0), 0) as recent_share
    from (select unnest(range(30)) as c) k left join sz on sz.cluster = k.c left join ea on ea.cluster = k.c left join re on re.cluster = k.c),
  cs1 as (select *, (recent_share + 0.005) / (early_share + 0.005) as growth_ratio from cs0),
  cs as (select *, n_works >= 100 and growth_ratio >= (select quantile_cont(growth_ratio, 0.75) from cs1) as emerging from cs1)"""


def _summary(d: Base) -> DataFrame:
    w = d.works("year", "sampling_weight", "citation_percentile").join(d.topics, "work_id")
    return topics.cluster_summary(w, topics.cluster_year(w), 30, EARLY, RECENT)


@REG.query(f"""with {_W} select coalesce(language, 'unknown') as language, round(sum(sampling_weight), 6) as papers,
  round(sum(sampling_weight) / nullif(sum(sum(sampling_weight)) over (), 0), 6) as share from w group by 1""")
def q8_language(spark: SparkSession, sf: str) -> DataFrame:
    w = Base(spark, sf).works("language", "sampling_weight")
    g = w.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.sum("sampling_weight").alias("s"))
    return g.select("language", _r("s", "papers"), _r(_ratio(F.col("s"), _total("s")), "share"))


@REG.query(f"with {_EN} select round(sum(case when source = 'recovered' then weight else 0 end) / nullif(sum(weight), 0), 6) as recovered_share from en")
def q9_recovered_share(spark: SparkSession, sf: str) -> DataFrame:
    e = Base(spark, sf).enriched
    return e.agg(_r(_ratio(F.sum(F.when(F.col("source") == "recovered", F.col("weight")).otherwise(0)), F.sum("weight")), "recovered_share"))


@REG.query(f"""with {_EN} select source, round(sum(case when r.region in ('North America', 'Europe') then weight else 0 end) / nullif(sum(weight), 0), 6) as na_eu
  from en left join country_regions r using (country_code) group by 1""")
def q10_regions_by_source(spark: SparkSession, sf: str) -> DataFrame:
    d = Base(spark, sf)
    j = d.enriched.join(d.regions.select("country_code", "region"), "country_code", "left")
    inside = F.sum(F.when(F.col("region").isin("North America", "Europe"), F.col("weight")).otherwise(0))
    return j.groupBy("source").agg(_r(_ratio(inside, F.sum("weight")), "na_eu"))


_EX0 = """xy as (select work_id, min(x) as x, min(y) as y from work_topics where x is not null and y is not null group by 1),
  pn as (select tp.cluster, w.work_id, w.title, w.year, x, y from tp join xy using (work_id) join w using (work_id)),
  ce as (select cluster, avg(x) as cx, avg(y) as cy from pn group by 1),
  ds as (select pn.*, round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 9) as distance from pn join ce using (cluster)),
  ex as (select *, row_number() over (partition by cluster order by distance, work_id) as rank from ds qualify rank <= 3)"""
_EX = f"{_W}, {_TP}, {_EX0}"


def _examples(d: Base) -> DataFrame:
    xy = load(d.spark, d.sf, "work_topics", "work_id", "x", "y").where("x is not null and y is not null")
    xy = xy.groupBy("work_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    pt = d.topics.join(xy, "work_id").join(d.works("title", "year"), "work_id")
    c = pt.groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return topics.examples(pt.join(c, "cluster").withColumn("distance", F.round(F.sqrt(dx * dx + dy * dy), 9)))


@REG.query(f"with {_EX} select cluster, title as example_title from ex where rank = 1")
def q11_example_titles(spark: SparkSession, sf: str) -> DataFrame:
    """The title of the first example, by an explicit rank."""
    return _examples(Base(spark, sf)).groupBy("cluster").agg(F.min_by("title", "rank").alias("example_title"))


@REG.query(f"with {_W} select min(year) as first_year, max(year) as last_year, count(*) as n from w")
def q12_bounds(spark: SparkSession, sf: str) -> DataFrame:
    w = Base(spark, sf).works("year")
    return w.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("n"))


# ---- views, entity resolution, topics ---------------------------------------------------------------------------------


@REG.query(f"""with {_EN} select work_id, year, country_code, bloc, region, round(credit, 6) as credit, round(cw, 6) as credit_weighted, top10pct, top1pct,
  citation_percentile from vc""")
def v1_country_credit(spark: SparkSession, sf: str) -> DataFrame:
    c = Base(spark, sf).credit
    return c.withColumns({"credit": F.round("credit", 6), "credit_weighted": F.round("credit_weighted", 6)})


@REG.query(f"with {_EN} select work_id, year, sw as sampling_weight, n_countries, has_us, has_cn, has_africa, has_non_africa from cl")
def v2_work_collab(spark: SparkSession, sf: str) -> DataFrame:
    return Base(spark, sf).collab.select("work_id", "year", "sampling_weight", "n_countries", "has_us", "has_cn", "has_africa", "has_non_africa")


@REG.query(f"with {_INST} select institution_id, institution_name, country_code, institution_type, n_works from inst")
def e1_institutions(spark: SparkSession, sf: str) -> DataFrame:
    return Base(spark, sf).institutions


@REG.query(f"with {_AF} select distinct raw_affiliation, norm from af where raw_affiliation is not null")
def e2_normalized(spark: SparkSession, sf: str) -> DataFrame:
    raw = load(spark, sf, "affiliations_raw", "raw_affiliation").where("raw_affiliation is not null").distinct()
    return raw.select("raw_affiliation", text.normalize_org(F.col("raw_affiliation")).alias("norm"))


@REG.query(f"""with {_AF} select case when resolved_institution_id is not null then 'known' when n_resolved_institutions = 0 then 'unresolved' else 'neither' end
  as state, count(*) as n from af group by 1""")
def e3_states(spark: SparkSession, sf: str) -> DataFrame:
    a = load(spark, sf, "affiliations_raw").dropDuplicates(["affil_id"])
    s = F.when(F.col("resolved_institution_id").isNotNull(), "known").when(F.col("n_resolved_institutions") == 0, "unresolved").otherwise("neither")
    return a.groupBy(s.alias("state")).agg(F.count("*").alias("n"))


@REG.query(f"with {_AF}, {_ALIAS} select * from alias")
def e4_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.alias_table(Base(spark, sf).affiliations[0].where("norm <> ''"))


@REG.query(f"with {_AF}, {_ALIAS}, {_EXACT} select distinct * from res")
def e5_exact_alias(spark: SparkSession, sf: str) -> DataFrame:
    return Base(spark, sf).exact.distinct()


@REG.query(f"""with {_INST}, {_AF}, {_cascade_sql("(select * from af where false)", "(select * from af where n_resolved_institutions = 0)")}
  select norm, institution_id, round(score, 9) as score from fuzzy""")
def e6_fuzzy_names(spark: SparkSession, sf: str) -> DataFrame:
    """Best name of every unresolved string at 90 or more."""
    d = Base(spark, sf)
    inst = d.institutions.withColumn("norm_name", text.normalize_org(F.coalesce("institution_name", F.lit(""))))
    return resolve.fuzzy_hits(d.affiliations[1].select("norm").distinct(), inst).withColumn("score", F.round("score", 9))


@REG.query(f"""with {_INST}, {_AF}, {_RES} select distinct * replace (round(score, 9) as score) from res""")
def e9_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """The production pass: what each unresolved string means, by which step and with what score."""
    return Base(spark, sf).resolved.withColumn("score", F.round("score", 9)).distinct()


_HOLD = f"""{_INST}, {_AF}, kn as (select * from af where resolved_institution_id is not null),
  pw as (select work_id, count(*) as n, md5(work_id || '-42') as h from kn group by work_id),
  cw as (select work_id from pw qualify sum(n) over (order by h, work_id rows unbounded preceding) <= 2000),
  ho as (select * from kn where work_id in (select work_id from cw)),
  tr as (select * from kn where work_id not in (select work_id from cw) and norm not in (select norm from ho)),
  {_cascade_sql("tr", "ho")}, rs as (select ho.*, hit.institution_id, hit.method from ho join hit using (norm)),
  ms as (select unnest(['exact_alias', 'fuzzy_name']) as method),
  sm as (select method, count(institution_id) as n_predicted, count(*) filter (where institution_id = resolved_institution_id) as n_correct
    from ms left join rs using (method) group by method),
  nn as (select count(*) as n from rs), ev as (select 'overall' as method, (select n from nn) as n_holdout, sum(n_predicted)::bigint as n_predicted,
    sum(n_correct)::bigint as n_correct from sm union all select method, null, n_predicted, n_correct from sm)"""


@REG.query(f"""with {_HOLD} select method, n_holdout, n_predicted, n_correct, round(n_correct / nullif(n_predicted, 0), 9) as precision,
  round(n_correct / nullif((select n from nn), 0), 9) as recall from ev""")
def e8_holdout_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    d = Base(spark, sf)
    inst = d.institutions.withColumn("norm_name", text.normalize_org(F.coalesce("institution_name", F.lit(""))))
    holdout, train = resolve.holdout_split(d.affiliations[0])
    e = resolve.evaluation(resolve.resolve_strings(holdout, train, inst))
    return e.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@REG.query(f"""with {_INST}, {_AF}, {_RES} select method, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share_of_unresolved from res group by method""")
def e9_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.coverage(Base(spark, sf).resolved).withColumn("share_of_unresolved", F.round("share_of_unresolved", 9))


@REG.query(f"with {_EN} select work_id, author_order, country_code, round(weight, 9) as weight, source from en")
def e10_enriched_links(spark: SparkSession, sf: str) -> DataFrame:
    return Base(spark, sf).enriched.withColumn("weight", F.round("weight", 9))


@REG.query(f"""with {_W}, {_CS} select cluster, year, round(n_weighted, 6) as n_weighted, round(n_weighted / nullif(sum(n_weighted) over (partition by year), 0), 6) as share
  from cy""")
def m11_cluster_year(spark: SparkSession, sf: str) -> DataFrame:
    d = Base(spark, sf)
    cy = topics.cluster_year(d.works("year", "sampling_weight").join(d.topics, "work_id"))
    return cy.select("cluster", "year", _r("n_weighted", "n_weighted"), _r("share", "share"))


@REG.query(f"""with {_W}, {_CS} select cluster, n_works, median_year, round(mean_citation_pct, 6) as mean_citation_pct, round(early_share, 6) as early_share,
  round(recent_share, 6) as recent_share, round(growth_ratio, 6) as growth_ratio, emerging from cs""")
def m12_cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = _summary(Base(spark, sf))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_citation_pct", "early_share", "recent_share", "growth_ratio")})


@REG.query(f"with {_EX} select cluster, work_id, cast(rank as integer) as rank from ex")
def m7_examples(spark: SparkSession, sf: str) -> DataFrame:
    return _examples(Base(spark, sf)).select("cluster", "work_id", "rank")


_STOP = ", ".join(f"'{s.replace(chr(39), chr(39) * 2)}'" for s in topics.stop_words())
_GR = f"""tx as (
    select cluster, list_filter(regexp_extract_all(lower(title || '. ' || coalesce(abstract, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x not in ({_STOP})) as ws
    from w join tp using (work_id) where title is not null
  ), gr as (select cluster, unnest(list_concat(ws, list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2]))) as term from tx),
  tf as (select cluster, term, count(*) as n from gr group by all),
  pt as (select term, count(*) as df, sum(n) as total from tf group by 1 having count(*) >= 2)"""
_SCORE = "n / sum(n) over (partition by cluster) * ln(1 + (select count(distinct cluster) from tx) / (df + 1))"
# the greedy choice: a list of one term each is folded into the list of the chosen ones
_LABEL = f"""{_GR}, p6 as (select * from pt order by total desc, term limit 60000),
  sc as (select cluster, term, round({_SCORE}, 12) as score from tf join p6 using (term)),
  li as (select cluster, list([term] order by score desc, term desc) as every from sc group by 1),
  ch as (select cluster, list_reduce(every, lambda c, x: case when len(c) >= 6 or len(list_filter(c, lambda t: list_contains(string_split(t, ' '), x[1])
    or list_contains(string_split(x[1], ' '), t) or regexp_replace(t, 's+$', '') = regexp_replace(x[1], 's+$', ''))) > 0 then c else list_concat(c, x) end) as terms from li),
  lb as (select cluster, array_to_string(terms, ', ') as top_terms, array_to_string(terms[:3], ' / ') as label from ch)"""


def _documents(d: Base) -> DataFrame:
    return topics.document_text(d.works("title", "abstract")).join(d.topics, "work_id")


def _labels_of(d: Base) -> DataFrame:
    """(cluster, top_terms, label); scores are rounded before they are ranked, so that ties are ties."""
    scores = topics.cluster_terms(_documents(d)).withColumn("score", F.round("score", 12))
    t = topics.top_terms(scores)
    return t.select("cluster", F.array_join("terms", ", ").alias("top_terms"), F.array_join(F.slice("terms", 1, 3), " / ").alias("label"))


@REG.query(f"with {_W}, {_TP}, {_GR} select cluster, term, round({_SCORE}, 9) as score from tf join pt using (term)")
def m9_cluster_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all terms that two clusters have, over whole texts."""
    d = Base(spark, sf)
    return topics.cluster_terms(_documents(d), vocabulary=10_000_000).withColumn("score", F.round("score", 9))


@REG.query(f"with {_W}, {_TP}, {_LABEL} select * from lb")
def m10_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Six terms per cluster that don't repeat one another, and the label of the first three."""
    return _labels_of(Base(spark, sf))


@REG.query(f"""with {_W}, {_CS}, {_EX0}, {_LABEL} select cs.cluster, array_to_string(string_split(top_terms, ', ')[:3], ', ') as terms, n_works,
    round(growth_ratio, 6) as growth_ratio, emerging, rtrim(left(title, 48)) || '...' as example
  from cs left join lb on lb.cluster = cs.cluster left join ex on ex.cluster = cs.cluster and ex.rank = 1""")
def j8_cluster_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Every cluster with its first three terms and, where it has one, the clipped title nearest to its centre."""
    d = Base(spark, sf)
    terms = F.array_join(F.slice(F.split("top_terms", ", "), 1, 3), ", ")
    rows = _summary(d).join(_labels_of(d), "cluster", "left").join(_examples(d).where("rank = 1").select("cluster", "title"), "cluster", "left")
    example = F.concat(text.clip(F.col("title"), 48), F.lit("..."))
    return rows.select("cluster", terms.alias("terms"), "n_works", _r("growth_ratio", "growth_ratio"), "emerging", example.alias("example"))


@REG.query(f"""with {_EN}, {_CS}, {_LABEL}, s as (select cluster, bloc, sum(cw) as o from vc join tp using (work_id) group by all)
  select s.cluster, label, n_works, round(growth_ratio, 6) as growth_ratio, emerging, bloc, round(o / nullif(sum(o) over (partition by s.cluster), 0), 6) as bloc_share
  from s join cs on cs.cluster = s.cluster left join lb on lb.cluster = s.cluster""")
def q7_cluster_country_mix(spark: SparkSession, sf: str) -> DataFrame:
    d = Base(spark, sf)
    s = d.credit.join(d.topics, "work_id").groupBy("cluster", "bloc").agg(F.sum("credit_weighted").alias("o"))
    share = _r(_ratio(F.col("o"), F.sum("o").over(Window.partitionBy("cluster"))), "bloc_share")
    c = _summary(d).join(_labels_of(d), "cluster", "left")
    c = c.select("cluster", "label", "n_works", _r("growth_ratio", "growth_ratio"), "emerging")
    return c.join(s.select("cluster", "bloc", share), "cluster")


@REG.query()
def m5_topic_model(spark: SparkSession, sf: str) -> DataFrame:
    """Words and pairs, tf-idf, latent factors, k-means and a 2-D layout of all titled works."""
    d = Base(spark, sf)
    docs = topics.document_text(d.works("title", "abstract")).select("work_id", "text")
    rows = topics.latent(topics.tfidf(docs), "work_id")
    k = topics.n_clusters(docs.count())
    out = topics.layout(topics.kmeans(rows, k))
    return out.select("work_id", "cluster", "x", "y")


@REG.query()
def m4_embedding_backend(spark: SparkSession, sf: str) -> DataFrame:
    """The same with precomputed embeddings as features."""
    rows = topics.as_vectors(load(spark, sf, "embeddings", "vec_id", "embedding"))
    out = topics.layout(topics.kmeans(rows.select("vec_id", "features"), 10))
    return out.select("vec_id", "cluster", F.round("distance", 6).alias("distance"), "x", "y")


# ---- flattening ---------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.typed_records(flatten.first_deliveries(load(spark, sf, "raw_works", "file_name", "line_no", "record")))


_FR = """p as (select file_name, line_no, cast(record as json) r from raw_works
    where json_valid(record) and coalesce(record::json->>'$.id', '') <> ''),
  fr as (select split_part(r->>'$.id', '/', -1) as work_id, r from p
    qualify row_number() over (partition by r->>'$.id' order by file_name, line_no) = 1),
  au as (select work_id, greatest(coalesce(json_array_length(r->'$.authorships'), 0), 1) as n, unnest(cast(r->'$.authorships' as json[])) as a,
      generate_subscripts(cast(r->'$.authorships' as json[]), 1) - 1 as author_order from fr)"""


@REG.query(f"""with {_FR}, k as (select work_id, unnest(map_entries(cast(r->'$.abstract_inverted_index' as map(varchar, integer[])))) as e from fr),
  o as (select work_id, unnest(e.value) as pos, e.key as word from k), ab as (select work_id, string_agg(word, ' ' order by pos, word) as abstract from o group by 1)
  select fr.work_id, r->>'$.title' as title, abstract, cast(r->>'$.publication_year' as integer) as year,
    coalesce(cast(r->>'$.cited_by_count' as bigint), 0) as cited_by_count, cast(r->>'$.fwci' as double) as fwci,
    cast(r->>'$.citation_normalized_percentile.value' as double) as citation_percentile,
    r->>'$.primary_location.source.display_name' as source_name, r->>'$.primary_topic.subfield.display_name' as subfield,
    cast(coalesce(json_array_length(r->'$.authorships'), 0) as integer) as n_authors
  from fr left join ab using (work_id)""")
def s6_works(spark: SparkSession, sf: str) -> DataFrame:
    """The flat works of the raw records, the abstract rebuilt from its index."""
    w = flatten.work_rows(_records(spark, sf))
    return w.select("work_id", "title", "abstract", "year", "cited_by_count", "fwci", "citation_percentile", "source_name", "subfield", "n_authors")


@REG.query(f"""with {_FR}, i as (select work_id, author_order, a->>'$.author.id' as aid, a->>'$.author.display_name' as author_name,
    unnest(cast(a->'$.institutions' as json[])) as i from au)
  select work_id, cast(author_order as integer) as author_order, split_part(nullif(aid, ''), '/', -1) as author_id, author_name,
    split_part(nullif(i->>'$.id', ''), '/', -1) as institution_id, i->>'$.display_name' as institution_name, i->>'$.ror' as ror,
    i->>'$.country_code' as country_code, i->>'$.type' as institution_type from i""")
def f6_authorship_inst(spark: SparkSession, sf: str) -> DataFrame:
    """Authors by institutions, joined by their shared keys (work, author position)."""
    n = flatten.nodes(_records(spark, sf))
    a = flatten.subtype_table(n, "author").select("work_id", F.col("ord").alias("author_order"), F.col("id").alias("author_id"), F.col("name").alias("author_name"))
    i = flatten.subtype_table(n, "institution").select(
        "work_id", F.col("ord").alias("author_order"), F.col("id").alias("institution_id"), F.col("name").alias("institution_name"), "ror", "country_code",
        F.col("type").alias("institution_type"),
    )
    rows = i.join(a, ["work_id", "author_order"])
    return rows.select("work_id", "author_order", "author_id", "author_name", "institution_id", "institution_name", "ror", "country_code", "institution_type")


@REG.query(f"""with {_FR} select work_id, cast(author_order as integer) as author_order, unnest(cast(a->'$.raw_affiliation_strings' as varchar[])) as raw_affiliation,
  cast(coalesce(json_array_length(a->'$.institutions'), 0) as integer) as n_resolved_institutions,
  case when json_array_length(a->'$.institutions') = 1 then split_part(nullif(a->>'$.institutions[0].id', ''), '/', -1) end as resolved_institution_id from au""")
def f7_affiliations_raw(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.raw_affiliations(_records(spark, sf))


@REG.query(f"""with {_FR}, c as (select distinct work_id, n, author_order, unnest(cast(a->'$.countries' as varchar[])) as country_code from au)
  select work_id, cast(author_order as integer) as author_order, country_code,
    round(1.0::double / n / count(*) over (partition by work_id, author_order), 9) as weight from c where country_code is not null""")
def f3_author_countries(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.country_shares(_records(spark, sf)).withColumn("weight", F.round("weight", 9))


@REG.query(f"""with {_FR}, k as (select work_id, unnest(cast(r->'$.keywords' as json[])) as k from fr)
  select work_id, k->>'$.display_name' as keyword, cast(k->>'$.score' as double) as score from k""")
def f6_keywords(spark: SparkSession, sf: str) -> DataFrame:
    k = flatten.subtype_table(flatten.nodes(_records(spark, sf)), "keyword")
    return k.select("work_id", F.col("name").alias("keyword"), "score")


@REG.query(f"""with {_YC}, a as (select * from yc where ai_bio > 0), z as (select * from yc where bio_baseline > 0)
  select coalesce(a.year, z.year) as year, coalesce(a.ai_bio, 0) as ai_bio, coalesce(z.bio_baseline, 0) as bio_baseline from a full join z on a.year = z.year""")
def s8_yearly_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Two maps of counts by year in one JSON document, parsed and joined over the union of their years."""
    from stemma.sources.files import yearly_counts

    y = Base(spark, sf).yearly
    as_map = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c) > 0, F.struct(F.col("year").cast("string"), F.col(c)))))
    doc = y.agg(F.to_json(F.struct(as_map("ai_bio").alias("ai_bio"), as_map("bio_baseline").alias("bio_baseline"))).alias("j"))
    return yearly_counts(doc.select(F.from_json("j", "ai_bio map<string,bigint>, bio_baseline map<string,bigint>").alias("d")).select("d.*"))


# ---- sampling, gates, evaluation ----------------------------------------------------------------------------------


@REG.query(f"""with {_W}, c as (select year, count(*) as available from w where year is not null group by 1)
  select year, available, cast(greatest(1, least(available, round_even(500 * available / (select sum(available) from c), 0), 10000)) as bigint) as quota from c""")
def c1_quotas(spark: SparkSession, sf: str) -> DataFrame:
    c = Base(spark, sf).works("year").where("year is not null").groupBy("year").agg(F.count("*").alias("available"))
    return sampling.quotas(c, 500)


@REG.query(f"""with {_W}, a as (select year, count(*) as available from w where year is not null group by 1),
  d as (select year, count(*) as downloaded from w where year is not null and abstract is not null and year % 4 <> 0 group by 1),
  g as (select year, available / downloaded as weight from a join d using (year) where downloaded > 0)
  select work_id, year, round(coalesce(weight, 1), 9) as sampling_weight from w left join g using (year)""")
def c2_sampling_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = Base(spark, sf).works("year", "abstract")
    a = w.where("year is not null").groupBy("year").agg(F.count("*").alias("available"))
    d = w.where("year is not null and abstract is not null and year % 4 <> 0").groupBy("year").agg(F.count("*").alias("downloaded"))
    rows = sampling.with_weights(w, sampling.sampling_weights(a, d))
    return rows.select("work_id", "year", F.round("sampling_weight", 9).alias("sampling_weight"))


_SAMPLE = f"""{_W}, sa as (select work_id, year, row_number() over (order by md5(work_id || '-42'), work_id) as k
  from w where title is not null and length(abstract) > 200 qualify k <= 300)"""


def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    return Base(spark, sf).works("title", "abstract", "year").where("title is not null and length(abstract) > 200")


@REG.query(f"with {_SAMPLE} select work_id, year from sa")
def c4_seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """300 works with an abstract over 200 characters; a sample is the feature."""
    return sampling.seeded_sample(_sampled(spark, sf), "work_id", 300).select("work_id", "year")


@REG.query(f"with {_SAMPLE} select work_id, year, k <= 150 as gold from sa")
def c6_gold_of_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sample, and which half of it people label."""
    return sampling.first_of_sample(_sampled(spark, sf), "work_id", 300, 150).select("work_id", "year", "gold")


@REG.query(f"""with {_EN}, u as (select count(*) as n, count(distinct work_id) as d, avg(case when abstract is not null then 1.0 else 0.0 end) as a from w),
  g as (select max(c) as c from (select sum(credit) as c from vc group by work_id)),
  l as (select count(*) as k from w left join work_topics t on t.work_id = w.work_id where t.work_id is null)
  select 'works_not_empty' as gate, n::double as value, n > 0 as passed from u union all select 'work_ids_unique', (n - d)::double, n = d from u
  union all select 'abstracts_present', round(a, 6), coalesce(a >= 0.8, false) from u
  union all select 'credit_at_most_one', round(c, 6), coalesce(c <= 1.0001, true) from g
  union all select 'works_clustered', k::double, k = 0 from l""")
def v10_quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    d = Base(spark, sf)
    q = quality.gates(d.works("abstract"), d.credit, load(spark, sf, "work_topics", "work_id"))
    return q.withColumn("value", F.round("value", 6))


def _labels(d: Base) -> tuple[DataFrame, DataFrame]:
    """Labels by rules on the works' data in place of a remote annotator and of people."""
    w = d.works("title", "abstract", "type", "year", "citation_percentile", "top10pct").where("abstract is not null")
    a = F.lower("abstract")
    role = F.when(a.contains("neural network"), "ai_method").when(a.contains("learning"), "ai_application").when(F.col("type") == "review", "other")
    human = F.when(a.contains("neural"), "ai_method").when(a.contains("machine learning") | a.contains("transformer"), "ai_application").otherwise("not_ai")
    labels = w.select("work_id", evaluate.valid_role(F.coalesce(role, F.lit("not_ai"))).alias("ai_role"), a.contains("pathogen").alias("biosecurity"),
                      (F.col("type") == "dataset").alias("off_topic"))
    return labels, w.where("year % 2 = 0").select("work_id", human.alias("human_ai_role"))


_LB = f"""{_W}, lb as (select work_id, case when contains(lower(abstract), 'neural network') then 'ai_method' when contains(lower(abstract), 'learning') then 'ai_application'
    when type = 'review' then 'invalid' else 'not_ai' end as ai_role, contains(lower(abstract), 'pathogen') as biosecurity, type = 'dataset' as off_topic
    from w where abstract is not null),
  gd as (select work_id, case when contains(lower(abstract), 'neural') then 'ai_method' when contains(lower(abstract), 'machine learning')
    or contains(lower(abstract), 'transformer') then 'ai_application' else 'not_ai' end as human_ai_role from w where abstract is not null and year % 2 = 0),
  m as (select * from gd join lb using (work_id)), rl as (select unnest(['ai_method', 'ai_application', 'not_ai']) as role),
  sh as (select 'query_precision_llm' as metric, count(*) filter (where ai_role <> 'not_ai') as k, count(*) as n from lb
    union all select 'query_precision_ai_and_bio', count(*) filter (where ai_role <> 'not_ai' and not coalesce(off_topic, false)), count(*) from lb
    union all select 'share_biosecurity_relevant', count(*) filter (where biosecurity), count(*) from lb
    union all select 'agreement_with_human', count(*) filter (where human_ai_role = ai_role), count(*) from m),
  pr as (select 'precision_' || role as metric, count(*) filter (where ai_role = role and human_ai_role = role) as k, count(*) filter (where ai_role = role) as n
    from rl, m group by role union all select 'recall_' || role, count(*) filter (where ai_role = role and human_ai_role = role),
    count(*) filter (where human_ai_role = role) from rl, m group by role),
  ka as (select sum(case when human_ai_role = ai_role then 1 else 0 end) / count(*) as po, count(*) as n from m),
  ra as (select human_ai_role as c, count(*) as k from m group by 1), rb as (select ai_role as c, count(*) as k from m group by 1),
  pe as (select sum(ra.k * rb.k) as s from ra join rb using (c))"""


@REG.query(f"""with {_LB} select metric, round(k / nullif(n, 0), 6) as value,
    round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 / (1 + 3.8416 / n) * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)), 6) as ci_low,
    round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 / (1 + 3.8416 / n) * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)), 6) as ci_high, n from sh
  union all select metric, round(k / nullif(n, 0), 6), null, null, n from pr
  union all select 'cohen_kappa', round((po - s / (n * n)) / (1 - s / (n * n)), 6), null, null, n from ka, pe""")
def v6_label_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Shares with Wilson intervals, agreement, kappa, and precision and recall per role."""
    e = evaluate.evaluation(*_labels(Base(spark, sf)))
    return e.withColumns({c: F.round(c, 6) for c in ("value", "ci_low", "ci_high")})


@REG.query(f"""with {_LB} select human_ai_role, count(*) filter (where ai_role = 'ai_method') as ai_method, count(*) filter (where ai_role = 'ai_application') as ai_application,
  count(*) filter (where ai_role = 'not_ai') as not_ai, count(*) filter (where ai_role = 'invalid') as invalid from m group by 1""")
def a21_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(*_labels(Base(spark, sf)))


# ---- single operators -----------------------------------------------------------------------------------------------


@REG.query("""select event_id, cast(cast('{' || regexp_extract('note ' || props || ' end', '(?s)\\{(.*)\\}', 1) || '}' as json)->>'$.k' as bigint) as k from events""")
def f19_json_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON object inside a longer text, parsed."""
    e = load(spark, sf, "events", "event_id", "props")
    return e.select("event_id", F.from_json(text.json_object(F.concat(F.lit("note "), "props", F.lit(" end"))), "k bigint")["k"].alias("k"))


@REG.query(f"""with {_YC}, e as (select arg_min(ai_bio, year) as a, arg_max(ai_bio, year) as z, arg_min(bio_baseline, year) as c, arg_max(bio_baseline, year) as d,
  max(year) - min(year) as n from yc) select round(pow(z / nullif(a, 0), 1.0 / n) - 1, 6) as cagr_ai, round(pow(d / nullif(c, 0), 1.0 / n) - 1, 6) as cagr_bio from e""")
def f22_cagr(spark: SparkSession, sf: str) -> DataFrame:
    y = Base(spark, sf).yearly
    e = y.agg(*[f(c, "year").alias(f"{n}_{c}") for c in ("ai_bio", "bio_baseline") for n, f in (("a", F.min_by), ("z", F.max_by))], (F.max("year") - F.min("year")).alias("n"))
    return e.select(*[_r(stats.cagr(F.col(f"a_{c}"), F.col(f"z_{c}"), F.col("n")), out) for c, out in (("ai_bio", "cagr_ai"), ("bio_baseline", "cagr_bio"))])


@REG.query(f"""with {_EN}, {_CS}, s as (select cluster, bloc, sum(cw) as o from vc join tp using (work_id) group by all),
  h as (select cluster, bloc, o / sum(o) over (partition by cluster) as share from s)
  select h.cluster, emerging, round(coalesce(avg(share) filter (where bloc = 'United States'), 0), 6) as us, round(coalesce(avg(share) filter (where bloc = 'China'), 0), 6) as cn
  from h join cs on cs.cluster = h.cluster group by all""")
def a22_us_cn_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of two blocs side by side for every cluster, and whether it emerges; 0 where a bloc has none."""
    d = Base(spark, sf)
    s = d.credit.join(d.topics, "work_id").groupBy("cluster", "bloc").agg(F.sum("credit_weighted").alias("o"))
    s = s.withColumn("share", F.col("o") / F.sum("o").over(Window.partitionBy("cluster"))).join(_summary(d).select("cluster", "emerging"), "cluster")
    p = s.groupBy("cluster", "emerging").pivot("bloc", ["United States", "China"]).agg(F.avg("share")).na.fill(0.0)
    return p.select("cluster", "emerging", _r("United States", "us"), _r("China", "cn"))


@REG.query("""select k.keyword, count(*) as n, count(distinct work_id) as n_works, round(avg(score), 9) as mean_score, round(median(score), 6) as median_score,
  round(quantile_cont(score, 0.75), 6) as upper_quartile from (select distinct work_id, lower(keyword) as keyword, score from keywords where keyword is not null) k group by 1""")
def a17_keyword_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, mean, exact median and quartile per keyword, whatever its case; null scores are skipped."""
    k = load(spark, sf, "keywords", "work_id", "keyword", "score").where("keyword is not null")
    k = k.select("work_id", F.lower("keyword").alias("keyword"), "score").distinct()
    return k.groupBy("keyword").agg(F.count("*").alias("n"), F.countDistinct("work_id").alias("n_works"), _r(F.avg("score"), "mean_score", 9),
                                    _r(F.median("score"), "median_score"), _r(F.percentile("score", F.lit(0.75)), "upper_quartile"))


@REG.query("""select w.work_id, w.title from (select distinct work_id, title from works where title is not null) w
  where not exists (select 1 from authorship_inst a where a.work_id = w.work_id and a.institution_id is not null)""")
def j5_not_exists(spark: SparkSession, sf: str) -> DataFrame:
    w = load(spark, sf, "works", "work_id", "title").where("title is not null").distinct()
    a = load(spark, sf, "authorship_inst", "work_id", "institution_id").where("institution_id is not null")
    return w.join(a, "work_id", "left_anti").where("work_id is not null").unionByName(w.where("work_id is null"))


@REG.query(f"with {_W} select year, type, count(*) as n, count(*) filter (where top10pct) as n_top, sum(cited_by_count)::bigint as citations, min(pub_date) as first_date from w group by all")
def a1_counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    w = Base(spark, sf).works("year", "type", "top10pct", "pub_date")
    return w.groupBy("year", "type").agg(F.count("*").alias("n"), F.count(F.when(F.col("top10pct"), 1)).alias("n_top"),
                                         F.sum("cited_by_count").alias("citations"), F.min("pub_date").alias("first_date"))


@REG.query("""select work_id, author_order, author_name, institution_id from (select distinct work_id, author_order, author_name, institution_id from authorship_inst
  where author_id is not null) order by work_id nulls last, author_order desc, author_name, institution_id limit 50""")
def o1_top_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sorting by several keys with nulls last, and a top-k."""
    a = load(spark, sf, "authorship_inst", "work_id", "author_order", "author_name", "institution_id", "author_id").where("author_id is not null")
    a = a.select("work_id", "author_order", "author_name", "institution_id").distinct()
    return a.orderBy(F.asc_nulls_last("work_id"), F.desc("author_order"), F.asc_nulls_last("author_name"), F.asc_nulls_last("institution_id")).limit(50)


@REG.query(f"""with {_YC} select 'pre' as period, round(avg(ai_bio), 6) as mean_ai from yc where year < 2018 union all
  select 'post', round(avg(ai_bio), 6) from yc where year >= 2018""")
def u1_union_all(spark: SparkSession, sf: str) -> DataFrame:
    y = Base(spark, sf).yearly
    part = lambda n, c: y.where(c).agg(F.lit(n).alias("period"), _r(F.avg("ai_bio"), "mean_ai"))
    return part("pre", "year < 2018").unionByName(part("post", "year >= 2018"))


@REG.query("select work_id, any_value(title) as title, any_value(language) as language, any_value(sampling_weight) as sampling_weight from works where work_id is not null group by work_id")
def a8_any_value(spark: SparkSession, sf: str) -> DataFrame:
    """Any non-null value of what all deliveries of a work have alike."""
    w = load(spark, sf, "works", "work_id", "title", "language", "sampling_weight").where("work_id is not null")
    return w.groupBy("work_id").agg(*[F.any_value(c, ignoreNulls=True).alias(c) for c in ("title", "language", "sampling_weight")])


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_QUOTED = "array_to_string(list_transform({t}, lambda x: '\"' || x || '\"'), ' OR ')"


@REG.query(f"""select 'title_and_abstract.search:(' || {_QUOTED.format(t=_list_sql(AI_TERMS))} || ') AND (' || {_QUOTED.format(t=_list_sql(BIO_TERMS))}
  || '),publication_year:2010-2025,type:' || array_to_string({_list_sql(WORK_TYPES)}, '|') as expression""")
def f21_search_expression(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus filter as a remote source's search string."""
    return spark.range(1).select(F.lit(text.source_filter([AI_TERMS, BIO_TERMS], WORK_TYPES, (2010, 2025))).alias("expression"))


@REG.query(f"""with {_W} select work_id, year, type from w where {_any(AI_TERMS)} and {_any(BIO_TERMS)} and type in ('article', 'preprint', 'review') and year between 2010 and 2025""")
def f21_corpus_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The same filter as a predicate on the local corpus."""
    w = Base(spark, sf).works("title", "abstract", "type", "year")
    t = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit("")))
    return w.where(text.corpus_filter(t, [AI_TERMS, BIO_TERMS], F.col("type"), WORK_TYPES, F.col("year"), (2010, 2025))).select("work_id", "year", "type")
