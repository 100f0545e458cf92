import random

import numpy as np
import pytest

from stemma.llm import clusters as C

WORDS = {0: "folding protein torsion docking residue", 1: "atlas droplet doublet embedding annotation", 2: "editing guide nuclease protospacer knockout"}
COMMON = "the study compared earlier claims about noise and reported several results".split()


def rows(n=240, wrong=12, missing=12):
    r = random.Random(4)
    works, topics, truth = [], [], {}
    for i in range(n):
        c = i % 3
        own = WORDS[c].split()
        text = " ".join(" ".join(r.sample(COMMON, 5)) + " " + " ".join(r.choices(own, k=3)) + "." for _ in range(4))
        works.append((f"W{i:04d}", f"About {r.choice(own)} and {r.choice(own)}", text if i % 10 else None, 1))
        truth[f"W{i:04d}"] = c
        topics.append((f"W{i:04d}", None if i < missing else (c + 1) % 3 if i < missing + wrong else c))
    return works, topics, truth


W, T = "work_id string, title string, abstract string, loaded_at int", "work_id string, cluster int, v double"


def run(spark, works, topics):
    return C.clustered(spark.createDataFrame(works, W), spark.createDataFrame([(*t, 0.0) for t in topics], T))


def test_missing_and_wrong_labels_are_put_right(spark):
    works, topics, truth = rows()
    works += [works[0], ("W9990", None, None, 1), ("W9991", "", "", 1), ("W9992", "zzz", None, 1), (None, "folding", "folding", 1)]
    topics += [topics[30], ("W9990", 1), ("W9991", None), ("W7777", 2)]
    out = run(spark, works, topics)
    got = {r.work_id: r.cluster for r in C.corrected(out).collect()}
    assert got == {f"W{i:04d}": truth[f"W{i:04d}"] for i in range(24)}
    d = C.described(out).collect()
    assert {r.cluster for r in d} == {0, 1, 2} and all(r["rank"] <= 3 for r in d)
    assert sorted(r.n_works for r in d if r["rank"] == 1) == [80, 80, 81]  # the record without any known term is in the largest


def test_same_clusters_on_any_partitioning(spark):
    works, topics, _ = rows()
    a, b = ({tuple(r) for r in C.clustered(spark.createDataFrame(works, W).repartition(n), spark.createDataFrame([(*t, 0.0) for t in topics], T)).collect()} for n in (2, 7))
    assert a == b


def test_records_of_rare_terms_and_accents(spark):
    works, topics, truth = rows(120, 0, 0)
    works += [("X1", "quetzal réseau", None, 1), ("X2", "quetzal", None, 1), ("X3", "xylophone", None, 1), ("X4", "ok", None, 1)]
    topics += [("X1", 2), ("X2", None), ("X3", 1), ("X4", None)]
    got = {r.work_id: r.cluster for r in run(spark, works, topics).collect()}
    assert got["X2"] == 2 and got["X1"] == 2 and got["X3"] == 1 and got["X4"] is not None and len(got) == 124
    expr = spark.createDataFrame([("Réseau de neurones 使用方法 CRISPR使用方法",)], "t string").selectExpr(C.terms_of("t") + " as x").first().x
    assert {"reseau", "neurones", "crispr", "使用方法"} <= set(expr) and "seau" not in expr


def test_without_labels_and_empty(spark):
    works, topics, truth = rows(120, 0, 0)
    docs = C.texts(spark.createDataFrame(works, W), spark.createDataFrame([], T))
    vecs = C.vectors(docs, C.term_weights(docs, C.term_counts(docs))).where("v is not null")
    centres = C.centroids(vecs, 3)
    got = {r.work_id: r.cluster for r in C.assigned(vecs, centres).collect()}
    groups = {}
    for w, c in got.items():
        groups.setdefault(c, set()).add(truth[w])
    assert len(centres) == 3 and all(len(g) == 1 for g in groups.values())
    assert run(spark, [], []).count() == 0


def test_tree_keeps_its_sums_and_bounds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, C.DIM))
    x /= np.sqrt((x * x).sum(1))[:, None]
    t = C.Tree(reach=0.1, leaves=200)
    t.insert(np.ones(3000), x, (x * x).sum(1), [{i % 4: 1.0} for i in range(3000)])

    def checked(t):
        n, ls, ss, votes = t.leaves()
        assert len(n) <= 200 and n.sum() == pytest.approx(3000) and np.allclose(ls.sum(0), x.sum(0)) and ss.sum() == pytest.approx(3000)
        assert sum(sum(v.values()) for v in votes) == 3000
        assert (ss / n - (ls * ls).sum(1) / n**2 <= t.reach + 1e-9).all()  # no entry's radius is beyond the reach
        return n, ls, ss, votes

    other = C.Tree(t.reach, leaves=200)
    other.insert(*checked(t))
    checked(other)
    deep = C.Tree(reach=0.5, leaves=10_000)
    deep.insert(np.ones(3000), x, (x * x).sum(1), [{}] * 3000)
    levels, level = 1, [deep.root]
    while not level[0].leaf:
        assert all(len(c.n) <= C.BRANCH and np.allclose(c.ls[k], b.ls.sum(0)) and c.n[k] == b.n.sum() for c in level for k, b in enumerate(c.below))
        level, levels = [b for c in level for b in c.below], levels + 1
    assert levels >= 3 and all(x.leaf and len(x.n) <= C.BRANCH for x in level)


def test_ward_against_brute_force():
    rng = np.random.default_rng(1)
    m, n = rng.normal(size=(12, 3)), rng.integers(1, 5, 12).astype(float)
    groups = [[i] for i in range(12)]
    while len(groups) > 4:
        def cost(g):
            w = n[g] / n[g].sum()
            return float((n[g][:, None] * (m[g] - w @ m[g]) ** 2).sum())

        _, a, b = min((cost(groups[a] + groups[b]) - cost(groups[a]) - cost(groups[b]), a, b) for a in range(len(groups)) for b in range(a))
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
    got = C.ward(n, m, 4)
    assert {frozenset(np.flatnonzero(got == g).tolist()) for g in np.unique(got)} == {frozenset(g) for g in groups}


def test_terms_bound(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_TERMS", 1)
    works, topics, _ = rows(60, 0, 0)
    with pytest.raises(ValueError):
        run(spark, works, topics)
