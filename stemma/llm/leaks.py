"""Problem 9: evaluation texts inside a training corpus.

One Aho-Corasick automaton holds runs of words of every evaluation item, as
sequences of word numbers; each document is scanned once.  A run of ``min_words``
words holds, wherever it begins, one of the item's runs of three quarters that
length taken at every few words, so only those are in the automaton (a fifth of
what all runs would take); each hit is extended both ways along the item's words,
and counts if ``min_words`` words agree.  A word is a maximal run of letters and
digits, lower-cased, so mark-up, odd spaces and punctuation between words don't
hide a passage.  Hits are mapped back to code-point offsets of the stored text.

The items are the stated query set: they are read in blocks of about
``BLOCK_CHARS`` characters, each block one automaton and one scan.  With several
blocks each scan is written to the shared folder before the next block is read,
so driver and workers hold one block at a time.  Documents never move.

Defined results: items and documents that are null, empty or shorter than
``min_words`` give no rows; equal items all match; repeated rows count once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.session import materialize

MIN_WORDS = 12
#: Characters of item text that one automaton holds; more items are scanned for in further blocks.
BLOCK_CHARS = 8 << 20
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def symbols(ids: array | list[int]) -> tuple[int, ...]:
    """Two symbols for each word number, of ranges of their own: the automaton's states look their few followers up in turn."""
    a = np.asarray(ids, np.int64)
    out = np.empty(2 * len(a), np.int64)
    out[::2], out[1::2] = (a >> 8) + 256, a & 255
    return tuple(out.tolist())


class Matcher:
    """The automaton of one block of items; items of equal words are one."""

    def __init__(self, items: list[tuple[int, str]], min_words: int) -> None:
        import ahocorasick

        self.n = min_words
        self.seed = max(1, 3 * min_words // 4)
        step = min_words - self.seed + 1
        self.number: dict[str, int] = {}
        classes: dict[bytes, int] = {}
        self.items: list[list[int]] = []  # the items of each class
        self.words: list[array] = []  # the word numbers of each class
        places: dict[tuple[int, ...], array] = {}  # run -> class, position, class, position ...
        for item, text in items:
            ids = array("i", [self.number.setdefault(w, len(self.number) + 1) for w in words(text)])
            if len(ids) < min_words:
                continue
            k = classes.setdefault(ids.tobytes(), len(classes))
            if k < len(self.items):
                self.items[k].append(item)
                continue
            self.items.append([item])
            self.words.append(ids)
            for i in range(0, len(ids) - self.seed + 1, step):
                places.setdefault(tuple(ids[i : i + self.seed]), array("i")).extend((k, i))
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.empty = not places
        while places:
            ids, where = places.popitem()
            self.auto.add_word(symbols(ids), where)
        if not self.empty:
            self.auto.make_automaton()

    def runs(self, text: str | None) -> dict[int, list[tuple[int, int]]]:
        """Per item the runs (first word, last word) of words of ``text`` that it holds."""
        if not text or self.empty:
            return {}
        get = self.number.get
        ids = [get(w.lower(), 0) for w in _WORD.findall(text)]
        found: dict[int, list[tuple[int, int]]] = {}
        reach: dict[tuple[int, int], int] = {}  # (class, shift) -> last word looked at
        for last, where in self.auto.iter(symbols(ids)) if len(ids) >= self.n else ():
            end = last // 2
            first = end - self.seed + 1
            for k, i in zip(where[::2], where[1::2]):
                if reach.get((k, first - i), -1) >= end:
                    continue
                own, lo, hi = self.words[k], first, end
                shift = i - first
                while lo and lo + shift and ids[lo - 1] == own[lo - 1 + shift]:
                    lo -= 1
                while hi + 1 < len(ids) and hi + 1 + shift < len(own) and ids[hi + 1] == own[hi + 1 + shift]:
                    hi += 1
                reach[k, -shift] = hi
                if hi - lo + 1 >= self.n:
                    found.setdefault(k, []).append((lo, hi))
        out: dict[int, list[tuple[int, int]]] = {}
        for k, spans in found.items():
            merged: list[tuple[int, int]] = []
            for lo, hi in sorted(spans):
                if merged and lo <= merged[-1][1] + 1:
                    merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
                else:
                    merged.append((lo, hi))
            out |= dict.fromkeys(self.items[k], merged)
        return out


def leaked_spans(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, doc_id, start, stop, n_words): leaked runs with offsets in code points, stop exclusive.

    Runs of one item that touch or overlap in the document are given as one.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("item_text").cast("string").alias("t"))
    asked = asked.where("item_id is not null and t is not null").distinct()
    chars = asked.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.length("text") >= 2 * min_words - 1)
    out = []
    for k in range(blocks):
        block = [(r.item_id, r.t) for r in asked.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == k).collect()]
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value, min_words)
            for b in batches:
                got: list[tuple] = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if hits := m.runs(text):
                        at = [(x.start(), x.end()) for x in _WORD.finditer(text)]
                        got += [(i, doc, at[p][0], at[q][1], q - p + 1) for i, rs in hits.items() for p, q in rs]
                cols = list(zip(*got)) if got else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "start", "stop", "n_words"])

        part = rows.mapInArrow(run, "item_id bigint, doc_id bigint, start bigint, stop bigint, n_words bigint")
        if blocks > 1:
            part = materialize(part, "leaks")
            shared.destroy()
        out.append(part)
    return reduce(DataFrame.unionAll, out)


def found(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, doc_id), each pair once."""
    return leaked_spans(docs, items, min_words).select("item_id", "doc_id").distinct()
