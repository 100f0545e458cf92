import math
import random

import pytest
from pyspark.sql import functions as F

from stemma.functions.text import ORG_WORDS as text_words
from stemma.operators import credit, evaluate, quality, resolve, sampling, topics
from stemma.tables import latest_works

REGIONS = [("US", "United States", "North America", ""), ("DE", "Germany", "Europe", "EU27"), ("KE", "Kenya", "Africa", ""), ("NA", "Namibia", "Africa", "")]


@pytest.fixture(scope="module")
def base(spark):
    links = spark.createDataFrame([("W1", 0, "US", 0.5), ("W1", 1, "XX", 0.5), ("W2", 0, "KE", 1.0), ("W3", 0, "XX", 1.0), ("W9", 0, "US", 1.0)], "work_id string, author_order int, country_code string, weight double")
    works = spark.createDataFrame([("W1", 2020, 2.0, None, None, 0.5, 2), ("W2", 2020, 1.0, True, False, None, 1), ("W3", 2021, 1.0, False, False, 0.1, 2), ("W4", 2021, 3.0, True, True, 0.9, 4)],
                                  "work_id string, year int, sampling_weight double, top10pct boolean, top1pct boolean, citation_percentile double, n_authors int")
    return links, works, spark.createDataFrame(REGIONS, "country_code string, country_name string, region string, eu27 string")


def test_credit(base):
    rows = {(r.work_id, r.country_code): r for r in credit.country_credit(*base).collect()}
    assert set(rows) == {("W1", "US"), ("W1", "XX"), ("W2", "KE"), ("W3", "XX")}  # no link, no row; no work, no row
    assert rows["W1", "US"].credit_weighted == 1.0 and rows["W1", "XX"].bloc == "Rest of world" and rows["W1", "XX"].region is None


def test_collab_null_rules(base):
    r = {x.work_id: x for x in credit.work_collab(*base).collect()}
    assert (r["W1"].has_us, r["W1"].has_africa, r["W1"].has_non_africa, r["W1"].n_countries) == (True, False, True, 2)
    assert r["W3"].has_africa is None and r["W3"].has_non_africa and not r["W3"].has_us and r["W2"].has_africa


def test_bloc_order(spark):
    df = spark.createDataFrame([("US", "EU27"), ("GB", "EU27"), ("GB", ""), ("JP", None), (None, None)], "c string, e string")
    got = [r.b for r in df.select(credit.bloc(F.col("c"), F.col("e")).alias("b")).collect()]
    assert got == ["United States", "EU27", "United Kingdom", "Japan", "Rest of world"]


def test_enriched(spark, base):
    links, works, _ = base
    resolved = spark.createDataFrame([("W1", 0, "I1"), ("W3", 1, "I1"), ("W3", 1, "I2"), ("W3", 1, "I2"), ("W3", 1, "I3"), ("W4", 0, None)], "work_id string, author_order int, institution_id string")
    inst = spark.createDataFrame([("I1", "DE"), ("I2", "DE"), ("I3", None)], "institution_id string, country_code string")
    new = credit.enriched_links(links, resolved, inst, works).where("source = 'recovered'").collect()
    assert [(r.work_id, r.author_order, r.country_code, r.weight) for r in new] == [("W3", 1, "DE", 0.25)] * 2  # two institutions of one country: two links


def test_latest_works(spark):
    rows = [("W1", 1, 5, "a"), ("W1", 2, 3, None), ("W1", 2, 7, "z"), (None, 9, 9, "n"), ("W2", None, None, None)]
    df = spark.createDataFrame(rows, "work_id string, loaded_at int, cited_by_count int, title string")
    assert {tuple(r) for r in latest_works(df).collect()} == {("W1", 2, 7, "z"), ("W2", None, None, None)}


def lcs_slow(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_and_index_against_brute_force():
    r = random.Random(3)
    words = ["".join(r.choices("abcde", k=r.randint(0, 12))) for _ in range(300)]
    for a, b in zip(words, words[::-1]):
        assert resolve.lcs(a, b) == lcs_slow(a, b)
    names = [(f"I{i}", " ".join(r.choices(["university", "of", "north", "south", "lake", "institute", "lakes"], k=3))) for i in range(120)]
    index = resolve.NameIndex(names, 80)
    for _ in range(150):
        s = " ".join(r.choices(["universty", "of", "north", "south", "lake", "institute"], k=3))
        scores = [resolve.token_sort_ratio(s, n) for _, n in names]
        best = max(scores)
        hit = index.best(s)
        assert (hit is None) == (best < 80)
        if hit:
            assert hit[0] == pytest.approx(best) and hit[1] == scores.index(best)


def test_cascade(spark):
    inst = spark.createDataFrame([("I1", "university of oslo", 5), ("I2", "lake hospital", 2)], "institution_id string, norm_name string, n_works long")
    known = spark.createDataFrame([("uio oslo", "I1"), ("uio oslo", "I1"), ("uio oslo", "I2"), ("", "I2")], "norm string, resolved_institution_id string")
    ask = spark.createDataFrame([("uio oslo",), ("universty of oslo, norway",), ("nowhere at all, x",), ("",)], "norm string")
    got = {r.norm: (r.institution_id, r.method) for r in resolve.resolve_strings(ask, known, inst).collect()}
    assert got == {"uio oslo": ("I1", "exact_alias"), "universty of oslo, norway": ("I1", "fuzzy_name"), "nowhere at all, x": (None, "unresolved"), "": (None, "unresolved")}
    assert {r.norm: r.institution_id for r in resolve.resolve_strings(ask, known, inst, match_empty=True).collect()}[""] == "I2"


def test_holdout_and_evaluation(spark):
    known = spark.createDataFrame([(f"W{i // 3}", f"n{i % 40}", f"I{i % 5}") for i in range(120)], "work_id string, norm string, resolved_institution_id string")
    h, t = resolve.holdout_split(known, 30)
    assert 0 < h.count() <= 30
    assert h.join(t, "norm").count() == 0 and h.join(t, "work_id").count() == 0
    rows = spark.createDataFrame([("I1", "I1", "fuzzy_name"), ("I2", "I1", "fuzzy_name"), (None, "I1", "unresolved")], "institution_id string, resolved_institution_id string, method string")
    e = {r.method: r for r in resolve.evaluation(rows).collect()}
    assert (e["overall"].n_holdout, e["overall"].precision, e["fuzzy_name"].n_holdout) == (3, 0.5, None)
    assert e["overall"].recall == pytest.approx(1 / 3) and (e["exact_alias"].n_predicted, e["exact_alias"].precision, e["exact_alias"].recall) == (0, None, 0.0)
    assert {r.method: r.recall for r in resolve.evaluation(rows.limit(0)).collect()} == {"overall": None, "exact_alias": None, "fuzzy_name": None}


def test_mode_ties_take_the_least(spark):
    a = spark.createDataFrame([("W1", "I1", "b", "US", None), ("W2", "I1", "a", "US", None), ("W3", None, "z", "DE", "x")], "work_id string, institution_id string, institution_name string, country_code string, institution_type string")
    assert [tuple(r) for r in resolve.institution_dimension(a).collect()] == [("I1", "a", "US", None, 2)]


def test_quota_and_weights(spark):
    c = spark.createDataFrame([(2010, 5), (2011, 995), (2012, 0)], "year int, available long")
    assert {r.year: r.quota for r in sampling.quotas(c, 500).collect()} == {2010: 2, 2011: 498, 2012: 1}  # half to even: 2.5 -> 2, 497.5 -> 498
    assert {r.quota for r in sampling.quotas(c, None).collect()} == {5, 995, 0}
    w = sampling.sampling_weights(c, spark.createDataFrame([(2010, 2), (2011, 0)], "year int, downloaded long"))
    assert {r.year: r.weight for r in w.collect()} == {2010: 2.5}
    works = spark.createDataFrame([("W1", 2010), ("W2", 1999), ("W3", None)], "work_id string, year int")
    assert {r.work_id: r.sampling_weight for r in sampling.with_weights(works, w).collect()} == {"W1": 2.5, "W2": 1.0, "W3": 1.0}


def test_seeded_sample_is_independent_of_partitioning(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    a = {r.id for r in sampling.seeded_sample(df, "id", 50).collect()}
    assert len(a) == 50 and a == {r.id for r in sampling.seeded_sample(df.repartition(13), "id", 50).collect()}
    assert a != {r.id for r in sampling.seeded_sample(df, "id", 50, seed=7).collect()}
    q = spark.createDataFrame([(0, 5), (1, 2)], "g long, quota long")
    assert {r.g: r["count"] for r in sampling.seeded_sample_per(df, "g", "id", q).groupBy("g").count().collect()} == {0: 5, 1: 2}


def test_gates(spark):
    works = spark.createDataFrame([("W1", "a"), ("W1", None)], "work_id string, abstract string")
    cr = spark.createDataFrame([("W1", 0.7), ("W1", 0.7)], "work_id string, credit double")
    g = quality.gates(works, cr, works.limit(0))
    assert {r.gate: r.passed for r in g.collect()} == {"works_not_empty": True, "work_ids_unique": False, "abstracts_present": False, "credit_at_most_one": False, "works_clustered": False}
    with pytest.raises(quality.QualityError, match="abstracts_present.*works_clustered"):
        quality.require(g)


def test_labels(spark):
    answers = spark.createDataFrame([("W1", 'Sure: {"ai_role": "not_ai", "biosecurity": true}'), ("W2", '{"ai_role": "maybe"}'), ("W3", "no json"), ("W4", "{broken"), ("W5", None)], "work_id string, answer string")
    p = evaluate.parse_answers(answers)
    assert {r.work_id: r.ai_role for r in p.collect()} == {"W1": "not_ai", "W2": "invalid"}
    e = {r.metric: r for r in evaluate.evaluation(p.select("work_id", "ai_role")).collect()}
    assert set(e) == {"query_precision_llm"} and e["query_precision_llm"].value == 0.5  # 'invalid' counts as a hit
    gold = spark.createDataFrame([("W1", "not_ai"), ("W2", "ai_method"), ("W9", "not_ai"), ("W1", "nonsense")], "work_id string, human_ai_role string")
    e = {r.metric: r for r in evaluate.evaluation(p, gold).collect()}
    assert e["agreement_with_human"].value == 0.5 and e["precision_ai_method"].value is None and e["recall_ai_method"].value == 0.0
    assert e["share_biosecurity_relevant"].value == 0.5 and e["query_precision_ai_and_bio"].n == 2
    empty = {r.metric: r for r in evaluate.evaluation(p.limit(0)).collect()}
    assert empty["query_precision_llm"].value is None and math.isnan(empty["query_precision_llm"].ci_low)


def test_annotator_skips_failures(spark):
    works = spark.createDataFrame([("W1", "t", "a"), ("W2", None, None)], "work_id string, title string, abstract string")

    def answer(prompt):
        if "Title: t" not in prompt:
            raise RuntimeError("down")
        return '{"ai_role": "ai_method"}'

    assert [r.work_id for r in evaluate.annotate(evaluate.prompts(works), answer).collect()] == ["W1"]


def test_top_terms_skip_repeats(spark):
    rows = [(0, "single cell", 9.0), (0, "cell", 8.0), (0, "cells", 7.0), (0, "genes", 6.0), (0, "gene", 5.0), (0, "rna seq", 4.0), (1, "x", 1.0)]
    t = {r.cluster: r.terms for r in topics.top_terms(spark.createDataFrame(rows, "cluster int, term string, score double"), 3).collect()}
    assert t == {0: ["single cell", "cells", "genes"], 1: ["x"]}


def test_cluster_summary_spine(spark):
    w = spark.createDataFrame([(0, 2014, 1.0, 0.5), (0, 2019, 1.0, None), (2, 2019, 2.0, 0.9)], "cluster int, year int, sampling_weight double, citation_percentile double")
    s = {r.cluster: r for r in topics.cluster_summary(w, topics.cluster_year(w), 3, (2013, 2016), (2018, 2020), 1).collect()}
    assert (s[1].n_works, s[1].early_share, s[1].growth_ratio, s[1].median_year, s[1].emerging) == (0, 0.0, 1.0, None, False)
    assert s[2].growth_ratio == pytest.approx((2 / 3 + 0.005) / 0.005) and s[2].emerging and s[0].mean_citation_pct == 0.5


def test_latent_factors_match_svd(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    x = np.random.default_rng(0).random((30, 12)) * (np.arange(12) < 4) + np.random.default_rng(1).random((30, 12)) * 0.01
    rows = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)], ["id", "features"])
    got = np.array([r.features.toArray() for r in topics.latent(rows, "id", 3).orderBy("id").collect()])
    y = x @ np.linalg.svd(x)[2][:3].T
    want = y / np.linalg.norm(y, axis=1, keepdims=True)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-5)


def test_kmeans_and_layout(spark):
    rows = spark.createDataFrame([(i, [float(i % 2) * 10 + i * 0.01, 1.0, 0.0]) for i in range(20)] + [(99, None)], "id int, embedding array<double>")
    out = topics.layout(topics.kmeans(topics.as_vectors(rows), 2, starts=2)).collect()
    assert len(out) == 20 and len({(r.id % 2, r.cluster) for r in out}) == 2 and max(r.distance for r in out) < 0.2
    assert topics.n_clusters(10) == 2 and topics.n_clusters(100) == 5 and topics.n_clusters(10**6) == 30


def test_topic_model_finds_planted_themes(spark):
    """Texts of three vocabularies with a common one, in several languages: the clusters are the themes."""
    r = random.Random(5)
    themes = ["folding protein torsion docking residue".split(), "atlas droplet doublet embedding annotation".split(), "édition guide нуклеаза knockout 基因组".split()]
    common = "study compared earlier claims noise reported several results".split()
    docs = [(f"W{i:03d}", " ".join(r.choices(common, k=6) + r.choices(themes[i % 3], k=9))) for i in range(150)]
    rows = topics.tfidf(spark.createDataFrame(docs, "work_id string, text string"), min_df=2)
    out = topics.kmeans(topics.latent(rows, "work_id", 16), 3, starts=3).collect()
    groups = {}
    for x in out:
        groups.setdefault(x.cluster, set()).add(int(x.work_id[1:]) % 3)
    assert len(out) == 150 and sorted(map(sorted, groups.values())) == [[0], [1], [2]]


def test_factors_by_blocks_of_terms(spark, monkeypatch):
    """More terms than a block, sparse vectors, several tasks: the factors are those of the whole matrix."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(topics, "TERM_BLOCK", 7)
    g = np.random.default_rng(0)
    x = np.where(g.random((60, 40)) < 0.3, g.random((60, 40)), 0) @ np.diag(0.7 ** np.arange(40))
    rows = spark.createDataFrame([(i, Vectors.sparse(40, np.flatnonzero(v).tolist(), v[v != 0].tolist())) for i, v in enumerate(x)], ["id", "features"]).repartition(5)
    v = topics.singular_vectors(rows, 3)
    want = np.linalg.svd(x)[2][:3]
    assert np.allclose(np.abs(v.T @ want.T), np.eye(3), atol=1e-3)


def test_fuzzy_hits_in_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resolve, "NAME_BLOCK", 40)
    monkeypatch.setattr(resolve, "SEGMENTS", 30)
    r = random.Random(8)
    word = lambda: r.choice(["north", "south", "lake", "hill", "river", "stone"])
    names = [(f"I{i:03d}", f"university of {word()} {word()} {word()}", r.randint(0, 3)) for i in range(150)]
    asked = list({f"universty of {word()} {word()} {word()}, {r.choice(['oslo', 'institute of ' + word()])}" for _ in range(120)})
    got = {x.norm: (x.institution_id, x.score) for x in resolve.fuzzy_hits(spark.createDataFrame([(a,) for a in asked], "norm string"), spark.createDataFrame(names, "institution_id string, norm_name string, n_works long")).collect()}
    for a in asked:
        segs = [s.strip() for s in a.split(",")]
        segs = [s for s in segs if set(s.split()) & set(text_words)] or segs[:2]
        best = min(((-resolve.token_sort_ratio(s, n), p, -w, i) for p, s in enumerate(segs) if len(s) >= 6 for i, n, w in names), default=(0,))
        if -best[0] >= 90:
            assert got[a] == (best[3], pytest.approx(-best[0]))
        else:
            assert a not in got


def test_gold_is_the_first_part_of_the_sample(spark):
    df = spark.range(500).selectExpr("concat('W', id) as work_id")
    rows = sampling.first_of_sample(df, "work_id", 40, 15).collect()
    assert len(rows) == 40 and sum(x.gold for x in rows) == 15
    assert {x.work_id for x in rows if x.gold} == {x.work_id for x in sampling.seeded_sample(df.repartition(7), "work_id", 15).collect()}
