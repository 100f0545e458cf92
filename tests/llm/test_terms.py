import math
from collections import Counter

import pytest

from stemma.llm import terms

W, K = "work_id string, abstract string, loaded_at int, term string", "work_id string, keyword string, n int"


def run(spark, works, keywords):
    return terms.Scores(spark.createDataFrame([(*w, "clash") for w in works], W), spark.createDataFrame([(*k, 1) for k in keywords], K))


def test_residuals_against_brute_force(spark):
    works = [("W1", "Alpha alpha beta", 1), ("W1", "Alpha alpha beta", 2), ("W2", "beta Gamma-gamma 7", 1), ("W3", "", 1), ("W4", None, 1), (None, "alpha", 1)]
    kw = [("W1", "Alpha"), ("W1", "Alpha"), ("W1", "alpha"), ("W5", "new Ключ"), ("W2", None), (None, "x")]
    counts = {"W1": Counter(alpha=4, beta=1), "W2": Counter({"beta": 1, "gamma": 2, "7": 1}), "W5": Counter({"new": 1, "ключ": 1})}
    total = sum(sum(c.values()) for c in counts.values())
    col = Counter()
    for c in counts.values():
        col.update(c)
    got = {(r.work_id, r.term): r for r in run(spark, works, kw).rows.collect()}
    assert set(got) == {(w, t) for w, c in counts.items() for t in c}
    for (w, t), r in got.items():
        row = sum(counts[w].values())
        e = row * col[t] / total
        want = (counts[w][t] - e) / math.sqrt(e * (1 - row / total) * (1 - col[t] / total))
        assert r.n == counts[w][t] and r.residual == pytest.approx(want) and r.n_works == sum(t in c for c in counts.values())


def test_found_and_degenerate_tables(spark):
    s = run(spark, [("W1", "sequence sequence SEQUENCE short short short", 1)], [])
    assert [tuple(r) for r in s.repeated_rare().collect()] == [("W1", "sequence")]
    assert all(r.residual == 0 for r in s.rows.collect())
    assert run(spark, [], []).rows.count() == 0


def test_hot_and_long(spark):
    works = [(f"W{i}", "common word " * 3 + "zzzzzzrare " * (3 if i == 5 else 0), 1) for i in range(400)] + [("W999", "longtext " * 200_000, 1)]
    s = run(spark, works, [])
    assert {tuple(r) for r in s.repeated_rare().collect()} == {("W5", "zzzzzzrare"), ("W999", "longtext")}
    top = {r.work_id: r.term for r in terms.top_terms(s.rows, 1).collect()}
    assert top["W5"] == "zzzzzzrare" and len(top) == 401


def test_critical_residual_loses_no_case(spark):
    """The selection by residual is exact where terms are dense, works short and margins uneven."""
    import random

    r = random.Random(4)
    words = [f"{a}{b}wordy" for a in "abcdefgh" for b in "abcdef"]
    works = [(f"W{i}", " ".join(r.choices(words[: r.choice((3, 20, 48))], k=r.choice((3, 9, 40, 200)))), 1) for i in range(12)]
    s = run(spark, works, [])
    counts = {w: Counter(t.split()) for w, t, _ in works}
    n_works = Counter(t for c in counts.values() for t in c)
    want = {(w, t) for w, c in counts.items() for t, n in c.items() if n >= 3 and n_works[t] <= 5}
    assert want and {tuple(x) for x in s.repeated_rare().collect()} == want
    assert run(spark, [], []).repeated_rare().count() == 0


def test_residual_decides_in_the_plan(spark):
    s = run(spark, [("W1", "sequence sequence sequence other", 1), ("W2", "something else again", 1)], [])
    plan = s.repeated_rare()._jdf.queryExecution().optimizedPlan().toString()
    assert "SQRT" in plan
