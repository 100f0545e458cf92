"""The text queries over the smallest tables: oracle SQL where there is one, else brute force or a round trip."""

from collections import defaultdict

import pytest
from oracle import difference

from stemma.llm import leaks, tokens
from stemma.llm.queries import REG


@pytest.mark.parametrize("name", list(REG.oracles))
def test_against_oracle(spark, sf, name):
    assert difference(REG.queries[name](spark, sf), REG.oracles[name], sf) == ""


COLUMNS = {
    "p4_found": ["affil_id", "institution_id"], "p5_found": ["name_a", "name_b"], "p6_found": ["work_id", "cluster"],
    "p7_found": ["work_id", "segment", "language"], "p8_ids": ["doc_id", "ids"], "p9_found": ["item_id", "doc_id"], "p10_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_no_row_twice(spark, sf, name):
    df = REG.queries[name](spark, sf)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows and len({str(r) for r in rows}) == len(rows)


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_p8_against_library(spark, sf):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(), special_tokens={})
    got = {r.doc_id: r.ids for r in REG.queries["p8_ids"](spark, sf).collect()}
    want = texts(spark, sf)
    assert got.keys() == want.keys()
    assert all(got[d] == (enc.encode_ordinary(t) if t else []) for d, t in want.items())


def test_p9_against_brute_force(spark, sf):
    items = spark.read.parquet(f"{sf}/eval_items.parquet").collect()
    grams = defaultdict(set)
    for r in items:
        w = leaks.words(r.item_text or "")
        for i in range(len(w) - 11):
            grams[tuple(w[i : i + 12])].add(r.item_id)
    want = {(i, d) for d, t in texts(spark, sf).items() for w in [leaks.words(t or "")] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    assert {tuple(r) for r in REG.queries["p9_found"](spark, sf).collect()} == want


def test_p10_against_brute_force(spark, sf):
    at = defaultdict(set)
    for d, t in texts(spark, sf).items():
        for k in range(len(t or "") - 319):
            at[t[k : k + 320]].add(d)
    want = {(a, b) for s in at.values() for a in s for b in s if a < b}
    assert {tuple(r) for r in REG.queries["p10_found"](spark, sf).collect()} == want
