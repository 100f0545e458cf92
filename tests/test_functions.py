import math

import pytest
from pyspark.sql import functions as F

from stemma.functions import stats, text


def one(spark, col, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(col.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [
    ("Univ. of Tromsø, Dept. of Sci.", "university of troms, department of sciences"), ("Straße 1", "strae 1"), ("北京大学", ""),
    ("  Łódź  Natl. Acad. ,", "odz national academy"), ("Université de É", "universite de e"), ("Inst Tech", "institute technology"), ("", ""), (None, None),
])
def test_normalize(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(text.normalize_org(F.col("s")).alias("x")).first().x == want


@pytest.mark.parametrize("norm,want", [
    ("department of x, university of y, town", ["university of y"]), ("unit 4, some town, land, more", ["unit 4", "some town"]),
    ("united hospital", ["united hospital"]), ("institute a, college b", ["institute a", "college b"]), ("", []),
])
def test_segments(spark, norm, want):
    # 'united' begins with 'unit' and is passed over as a part; with nothing left the first two segments are taken
    assert one(spark, text.org_segments(F.col("s")), s=norm) == want


def test_json_search_and_names(spark):
    assert one(spark, text.json_object(F.col("s")), s='ok {"a": {"b": 1}} end') == '{"a": {"b": 1}}'
    assert one(spark, text.json_object(F.col("s")), s="none") is None
    assert one(spark, text.search_filter(F.col("s"), [["Deep learning"], ["genome", "cell"]]), s="DEEP Learning of cells")
    assert text.search_expression([["a", "b"], ["c"]]) == '("a" OR "b") AND ("c")'
    assert one(spark, text.map_or_self(F.col("s"), {"a": "A"}), s="b") == "b"
    assert one(spark, text.clip(F.col("s"), 4), s="abc def") == "abc"


def test_wilson(spark):
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    r = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int").select(lo.alias("lo"), hi.alias("hi")).collect()
    p, z, n = 0.8, 1.96, 10
    mid, half = (p + z * z / 2 / n) / (1 + z * z / n), z / (1 + z * z / n) * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)
    assert r[0].lo == pytest.approx(mid - half) and r[0].hi == pytest.approx(mid + half) and math.isnan(r[1].lo)


def test_kappa(spark):
    k = lambda rows: stats.cohen_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    r = k([("x", "x")] * 4 + [("x", "y"), ("y", "x")] + [("y", "y")] * 4 + [(None, "x")])
    assert r.kappa == pytest.approx((0.8 - 0.5) / 0.5) and r.n == 10
    assert math.isnan(k([("x", "x")]).kappa)
    assert k([]).n == 0


def test_cagr(spark):
    assert one(spark, stats.cagr(F.col("a"), F.col("b"), F.col("n")), a=100.0, b=121.0, n=2) == pytest.approx(0.1)
    assert one(spark, stats.cagr(F.col("a"), F.col("b"), F.col("n")), a=0.0, b=1.0, n=2) is None


def test_source_filter():
    assert text.source_filter([["a", "b"]], ["article", "review"], (2010, 2012)) == 'title_and_abstract.search:("a" OR "b"),publication_year:2010-2012,type:article|review'
    assert text.source_filter([["a"]], None, 2011) == 'title_and_abstract.search:("a"),publication_year:2011'
