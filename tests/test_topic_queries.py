"""The topic queries run the whole job of their operators."""

import inspect

from stemma.operators import topics
from stemma.plans.reference import REG


class Stop(Exception):
    pass


def arguments(spark, sf, monkeypatch, name, operator):
    """The arguments with which a query calls an operator, defaults filled in."""
    real, got = inspect.signature(getattr(topics, operator)), {}

    def record(*args, **kw):
        b = real.bind(*args, **kw)
        b.apply_defaults()
        got.update(b.arguments)
        raise Stop

    monkeypatch.setattr(topics, operator, record)
    try:
        REG.queries[name](spark, sf)
    except Stop:
        pass
    return got


def test_all_factors_and_starts(spark, sf, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(topics, "tfidf", lambda docs: docs)
        assert arguments(spark, sf, m, "m5_topic_model", "latent")["components"] == 256
    with monkeypatch.context() as m:
        m.setattr(topics, "tfidf", lambda docs: docs)
        m.setattr(topics, "latent", lambda rows, *a, **k: rows)
        assert arguments(spark, sf, m, "m5_topic_model", "kmeans")["starts"] == 5
    assert arguments(spark, sf, monkeypatch, "m4_embedding_backend", "kmeans")["starts"] == 5


def test_text_is_whole(spark, sf, monkeypatch):
    works = spark.createDataFrame([("W1", "title", "word " * 2000 + "last"), ("W2", None, "x")], "work_id string, title string, abstract string")
    assert [r.text.endswith(" last") for r in topics.document_text(works).collect()] == [True]
    assert [len(r.text) for r in topics.document_text(works, 4000).collect()] == [4000]
    for name, after in (("m5_topic_model", "tfidf"), ("m10_top_terms", "cluster_terms")):
        with monkeypatch.context() as m:
            m.setattr(topics, after, lambda docs: docs)
            assert arguments(spark, sf, m, name, "document_text")["limit"] is None
