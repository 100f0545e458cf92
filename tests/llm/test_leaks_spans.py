import random
from collections import defaultdict

import pytest

from stemma.llm import leaks, spans

DOCS = "doc_id long, text string, item_id long"


def test_leaks(spark):
    item = "Given a probe for VHT-850K that lights up Yad39, decide whether cutoff 9517 would rescue the outliers."
    w = leaks.words(item)
    docs = [
        (1, f"Before. {item} After."), (2, "x " + "  ".join(w[3:15]).upper() + " y"), (3, " ".join(w[3:14])), (4, None), (5, ""), (6, "<b>" + "-\n".join(w) + "</b>"),
        (7, "filler " * 300_000 + item), (1, f"Before. {item} After."),
    ]
    items = spark.createDataFrame([(10, item, 0), (11, item, 0), (12, "too short", 0), (13, None, 0), (14, "", 0), (10, item, 0)], "item_id long, item_text string, doc_id int")
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], DOCS)
    assert {tuple(r) for r in leaks.found(df, items).collect()} == {(i, d) for i in (10, 11) for d in (1, 2, 6, 7)}
    s = {(r.item_id, r.doc_id): docs[0][1][r.start : r.stop] for r in leaks.leaked_spans(df, items).where("doc_id = 1").collect()}
    assert s[10, 1] == item.rstrip(".")
    assert leaks.found(df.limit(0), items).count() == leaks.found(df, items.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 120)
    texts = [" ".join(f"w{i}x{j}" for j in range(14)) for i in range(12)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, item_text string")
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOCS)
    assert {tuple(r) for r in leaks.found(docs, items).collect()} == {(i, i) for i in range(12)}


def test_leaks_against_brute_force():
    """Runs of a small vocabulary, where words recur and runs overlap."""
    r = random.Random(5)
    for n in (1, 2, 5, 12):
        items = [(i, " ".join(r.choices("ab", k=r.randint(1, 40)))) for i in range(25)] + [(90, "a " * 30), (91, "a " * 30)]
        m = leaks.Matcher(items, n)
        for _ in range(40):
            text = " ".join(r.choices("abc", k=r.randint(0, 60)))
            w = leaks.words(text)
            want = {}
            for i, t in items:
                own = leaks.words(t)
                runs = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
                spans_ = []
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in runs:
                        if spans_ and k <= spans_[-1][1] + 1:
                            spans_[-1] = (spans_[-1][0], k + n - 1)
                        else:
                            spans_.append((k, k + n - 1))
                if spans_:
                    want[i] = spans_
            assert m.runs(text) == want


def corpus(seed=3):
    r = random.Random(seed)
    say = lambda n: "".join(r.choices("abcdefgh é漢\n", k=n))
    notice, core, exact = say(60), say(130), say(100)
    docs = {i: notice + say(r.randint(20, 300)) for i in range(30)}
    docs |= {100 + i: say(50) + core + say(40) + notice for i in range(4)}
    docs |= {200: say(30) + exact, 201: exact + say(30), 202: say(30) + exact[1:], 203: say(9) + exact[:-1] + say(9)}
    docs |= {300 + i: docs[100] for i in range(5)} | {400: "", 402: "ab" * 300, 403: "x" + "ab" * 260, 404: say(99), 405: docs[201] * 2}
    return docs


def brute(docs, least):
    at = defaultdict(set)
    for d, t in docs.items():
        for k in range(len(t) - least + 1):
            at[t[k : k + least]].add(d)
    pairs = {(a, b) for s in at.values() for a in s for b in s if a < b}
    cover = {}
    for d, t in docs.items():
        hit = [False] * len(t)
        for k in range(len(t) - least + 1):
            if len(at[t[k : k + least]]) > 1:
                hit[k : k + least] = [True] * least
        if any(hit):
            cover[d] = sum(hit)
    return pairs, cover


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_spans_against_brute_force(spark, hot):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 0) for d, t in docs.items()] + [(401, None, 0), (200, docs[200], 0)], DOCS).repartition(5)
    s = spans.Shared(df, least=100, k=64, hot=hot)
    pairs, cover = brute(docs, 100)
    got = [tuple(r) for r in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert {r.doc_id: r.shared_chars for r in s.coverage().collect()} == cover


def test_notice_pairs_once_per_owner_set(spark):
    """A notice longer than the least length gives one window, not one for each of its positions, to the pairing."""
    docs = corpus(7)
    r = random.Random(2)
    notice = "".join(r.choices("abcdefgh", k=180))
    docs |= {1000 + i: notice + "".join(r.choices("xyz", k=90)) for i in range(40)}
    df = spark.createDataFrame([(d, t, 0) for d, t in docs.items()], DOCS)
    s = spans.Shared(df, least=100, k=64, hot=4)
    assert {tuple(x) for x in s.pairs().collect()} == brute(docs, 100)[0]


def test_repeats_are_maximal(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, docs[d], 0) for d in (100, 101, 200, 201)], DOCS)
    for r in spans.Shared(df, least=100, k=64).cold_repeats().collect():
        a, b = docs[r.doc_a], docs[r.doc_b]
        x, y, n = r.start_a, r.start_b, r.length
        assert n >= 100 and a[x : x + n] == b[y : y + n]
        assert x == 0 or y == 0 or a[x - 1] != b[y - 1]
        assert x + n == len(a) or y + n == len(b) or a[x + n] != b[y + n]


def test_anchor_guarantee():
    r = random.Random(1)
    for _ in range(50):
        core = "".join(r.choices("ab c", k=320))
        x, y = ("".join(r.choices("abcd ", k=r.randint(0, 500))) + core + "".join(r.choices("abcd ", k=r.randint(0, 500))) for _ in "xy")
        assert set(spans.anchors(x)[1].tolist()) & set(spans.anchors(y)[1].tolist())
    assert len(spans.anchors("a" * 319)[0]) == 0 and len(spans.anchors("a" * 320)[0]) > 0


def test_empty(spark):
    s = spans.Shared(spark.createDataFrame([], DOCS))
    assert s.pairs().count() == s.coverage().count() == 0
