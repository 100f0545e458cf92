"""Every core query against its oracle SQL on the smallest tables."""

import numpy as np
import pytest
from oracle import difference

from stemma.plans import connectors, problems, reference, single

ALL = {n: (f, r.oracles.get(n)) for r in (reference.REG, single.REG, connectors.REG, problems.REG) for n, f in r.queries.items()}


@pytest.mark.parametrize("name", [n for n, (_, o) in ALL.items() if o])
def test_against_oracle(spark, sf, name):
    fn, sql = ALL[name]
    assert difference(fn(spark, sf), sql, sf) == ""


def test_queries_without_oracle_have_tests_of_their_own():
    assert {n for n, (_, o) in ALL.items() if not o} == {"m4_embedding_backend", "m5_topic_model"}


def test_m4_is_a_fixed_point_of_kmeans(spark, sf):
    """Every vector is in the cluster of the nearest mean, and its distance is the one to its own mean."""
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    rows = ALL["m4_embedding_backend"][0](spark, sf).collect()
    assert {r.vec_id for r in rows} == set(e) and len(rows) == len(e)
    names = sorted({r.cluster for r in rows})
    means = np.array([np.mean([e[r.vec_id] for r in rows if r.cluster == c], axis=0) for c in names])
    near = 0
    for r in rows:
        d = np.sqrt(((means - e[r.vec_id]) ** 2).sum(1))
        assert r.distance == pytest.approx(d[names.index(r.cluster)], abs=1e-3)
        near += d.min() > d[names.index(r.cluster)] - 1e-3
    assert near / len(rows) > 0.97  # the library stops when means move by less than its tolerance
    assert np.std([r.x for r in rows]) >= np.std([r.y for r in rows]) > 0


def test_m5_gives_every_titled_work_a_cluster(spark, sf):
    from stemma.tables import latest_works, load

    titled = {r.work_id for r in latest_works(load(spark, sf, "works", "work_id", "title", "loaded_at", "cited_by_count")).where("title is not null").collect()}
    rows = ALL["m5_topic_model"][0](spark, sf).collect()
    assert {r.work_id for r in rows} == titled and len(rows) == len(titled)
    assert len({r.cluster for r in rows}) == min(30, max(2, len(titled) // 20)) and all(np.isfinite([r.x, r.y]).all() for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
