import random

import pytest

from stemma.llm.tokens import PATTERN, Encoder, encode_corpus, read_ranks


@pytest.fixture(scope="module")
def ranks():
    return read_ranks()


def plain_merge(ranks, word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if r == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(ranks[p] for p in parts)


def test_words_against_plain_merging(ranks):
    r, enc = random.Random(5), Encoder(ranks)
    pieces = [t for t in r.sample(sorted(ranks), 3000)]
    words = [b"".join(r.choices(pieces, k=r.randint(1, 4))) for _ in range(1500)] + [bytes(r.choices(range(256), k=r.randint(1, 20))) for _ in range(500)]
    assert all(enc.exact(w) == plain_merge(ranks, w) for w in words)
    strings = ["".join(r.choices("abcdeinorst é漢🙂", k=r.randint(1, 14))) for _ in range(3000)]
    enc.learn(strings)
    assert all(enc.words[s] == plain_merge(ranks, s.encode()) for s in strings)
    assert 0 < enc.merged < len(strings)  # some guesses fail and are merged, most are verified


def test_against_library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    ref = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", " ", "\r\n\t  x  ", "<|endoftext|>", "I'll can't 'S", "naïve café", "中文 и русский 🙂👩‍🔬", "a" * 5000, "ab" * 3000, "\x00\x01", "x" + " " * 400 + "y", "١٢٣ ½"]
    assert Encoder(ranks).encode(texts) == [ref.encode_ordinary(t) for t in texts]


def test_memo_restart_changes_nothing(ranks, monkeypatch):
    import stemma.llm.tokens as t

    monkeypatch.setattr(t, "MEMO_WORDS", 3)
    enc = Encoder(ranks)
    texts = ["one two three four", "five six", "one five"]
    assert [enc.encode([x])[0] for x in texts] == Encoder(ranks).encode(texts)


def test_null_empty_repeated_clashing(spark):
    df = spark.createDataFrame([(1, None, [9]), (2, "", [9]), (3, "hello world", None), (3, "hello world", None)], "doc_id long, text string, ids array<int>")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    assert got == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert encode_corpus(df.limit(0)).collect() == []


def test_vocabulary_size_is_checked(tmp_path, monkeypatch):
    import stemma.llm.tokens as t

    monkeypatch.setattr(t, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        read_ranks()
