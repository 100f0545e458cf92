"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary.

Speculate and verify.  A word's bytes are cut greedily into the longest tokens
of the vocabulary.  A token sequence is the one that merging would give if and
only if every two adjacent tokens, merged alone, stay those two tokens; so the
guesses of a whole batch are verified together by looking their adjacent pairs
up in a table of known pairs, and only pairs never met before are merged.  Words
that fail are merged exactly, by rank, with a heap (n log n for very long ones).

The file of ranks is read on the driver from a path that is a parameter, and
broadcast: its size is fixed by the vocabulary and checked.

Defined results: null and empty texts give an empty list; texts are encoded as
stored; special tokens' strings are ordinary text; one row per input row.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the vocabulary's public pattern that splits text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary beyond this is refused rather than broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Words kept in a worker's memory; beyond it the table starts anew (results don't depend on it).
MEMO_WORDS = 400_000


class Encoder:
    """Word and pair tables of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.longest = max(map(len, ranks))
        self.token = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.good: set[int] = set()
        self.bad: set[int] = set()
        self.merged = 0  # words that needed exact merging

    def exact(self, word: bytes) -> tuple[int, ...]:
        """Merging by rank: always the pair of lowest rank, leftmost first."""
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # end[i]: where the piece that begins at i ends; 0 when it was merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # a piece of this pair has changed
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def guess(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, i, n, ranks, longest = [], 0, len(word), self.ranks, self.longest
        while i < n:
            j = min(n, i + longest)
            while (r := ranks.get(word[i:j])) is None:
                j -= 1
            out.append(r)
            i = j
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not in the table yet: guess all, verify all pairs at once, merge the failures."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        guesses = [self.guess(b) for b in raw]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter(chain.from_iterable(guesses), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(guesses)), sizes)
        inside = owner[1:] == owner[:-1]
        codes, at = (flat[:-1] * self.size + flat[1:])[inside], owner[1:][inside]
        uniq, back = np.unique(codes, return_inverse=True)
        ok = np.fromiter(map(self.compatible, uniq.tolist()), bool, len(uniq))
        failed = set(np.unique(at[~ok[back]]).tolist()) if len(uniq) else set()
        self.merged += len(failed)
        for i, w in enumerate(words):
            self.words[w] = self.exact(raw[i]) if i in failed else tuple(guesses[i])

    def compatible(self, code: int) -> bool:
        if code in self.good:
            return True
        if code in self.bad:
            return False
        a, b = divmod(code, self.size)
        same = self.exact(self.token[a] + self.token[b]) == (a, b)
        (self.good if same else self.bad).add(code)
        return same

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.words)
        if len(self.words) + len(new) > MEMO_WORDS:
            self.words.clear()
            new = set(chain.from_iterable(cut))
        if new:
            self.learn(sorted(new))
        get = self.words.__getitem__
        return [list(chain.from_iterable(map(get, c))) for c in cut]


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    data = Path(path).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; at most {MAX_VOCABULARY_BYTES} are broadcast")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def encode_corpus(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row of ``docs``; a map over the scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            for i in range(0, max(1, b.num_rows), 512):
                part = b.slice(i, 512)
                ids = pa.array(enc.encode(part.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    rows = docs.selectExpr(f"cast({id_col} as bigint) as doc_id", f"cast({text_col} as string) as text")
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>")
