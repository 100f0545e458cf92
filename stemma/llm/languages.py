"""Problem 7: the language of texts and of the stretches of mixed texts.

A sentence is the mean of the embeddings of its hashed letter runs (two to four
letters, word edges included), followed by a linear softmax; both are trained by
stochastic gradient descent in numpy on a bounded sample of labelled records
(``SAMPLE`` per language), twice: sentences that the first model contradicts are
left out of the second, as labels are wrong at times and texts change language.
At most ``SENTENCES`` sentences are fitted on; a sixth of the sample is held out.
The softmax is calibrated on all held-out sentences: the temperature is the one
of least negative log-likelihood, and below the bar of rejection held-out
sentences are right at a rate of less than ``LEAST_ACCURACY`` (by isotonic
regression of right on confidence); where none are, the bar is chance.  ``Calibration`` reports both, the
calibration error, and the risk and coverage at the bar.  A sentence below the
bar has no language of its own and joins its neighbours'; a text that has none
above it is judged as a whole, and is ``und`` if that is below the bar too.
As everything after the embedding is linear, what is broadcast is one table of
``BUCKETS`` rows with a score per language.

A segment is a maximal run of sentences in one language.  Defined results: null,
blank and letterless texts have no segments; repeated deliveries count once (the
latest); with no labelled records at all nothing can be told apart and no rows
come out.  A rejected text has one segment, ``und``, with the confidence of the
likeliest language, and is no case of ``found``, as nothing is known against its label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.session import materialize
from stemma.tables import latest_works

# Names and codes of the languages.
FORMS = {
    "en": "en eng english", "es": "es spa spanish español espanol castellano", "pt": "pt por portuguese português portugues",
    "fr": "fr fra fre french français francais", "de": "de deu ger german deutsch", "it": "it ita italian italiano",
    "ru": "ru rus russian русский", "zh": "zh zho chi cmn chinese 中文",
}
# Labels that name no language.
MISSING = ("", "und", "unknown", "none", "null", "n/a", "mul", "zxx")
LANGUAGES = tuple(sorted(FORMS))
#: Labelled records per language that the model is fitted on.
SAMPLE = 300
#: Sentences that each of the two fits sees at most.
SENTENCES = 6000
BUCKETS, DIM = 1 << 15, 16
EPOCHS, RATE, BATCH = 4, 2.0, 32
#: Rate of right decisions among held-out sentences of like confidence below which a sentence is rejected.
LEAST_ACCURACY = 0.5
UNDECIDED = "und"
#: Letters, and different words, below which a stretch between stops is part of the sentence before it.
LEAST_LETTERS, LEAST_WORDS = 12, 4

_STOP = re.compile(r"(?<=[.!?…])(?=\s|<|$)|(?<=[。！？])|<\s*/?\s*(?:p|br|div|li|sec|title)\b[^>]*>")
_TAG = re.compile(r"<[^>]*>|&[a-zA-Z]+;|&#\d+;")
_QUOTED = re.compile("“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』|\"[^\"]*\"|[(（][^)）]*[)）]")
_GAP = re.compile(r"[\W\d_]+")
_WIDE = re.compile("[\u2e80-\u9fff]")


def normal_label(label: str | None) -> str | None:
    """The two-letter code of a label in any form; None for a missing one, '?' for one that names something else."""
    s = (label or "").strip().lower()
    if s in MISSING:
        return None
    head = re.split(r"[-_ ]", s)[0]
    for code, forms in FORMS.items():
        if s in forms.split() or head in forms.split():
            return code
    return "?"


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, marked-up parts removed; short stretches belong to the sentence before."""
    out: list[str] = []
    open_ = False  # whether the last sentence is still too short
    for part in _STOP.split(text or ""):
        part = _TAG.sub(" ", part).strip()
        if not any(map(str.isalpha, part)):
            continue
        if out and (open_ or _short(part)):
            out[-1] += " " + part
            open_ = open_ and _short(out[-1])
        else:
            out.append(part)
            open_ = _short(part) if len(out) == 1 else False
    return out


def _size(s: str) -> tuple[int, int, int]:
    """Letters (an ideograph counts as three), different words, ideographs."""
    words = _GAP.split(s.lower())
    wide = 0 if s.isascii() else len(_WIDE.findall(s))
    return sum(map(len, words)) + 2 * wide, len({*words} - {""}), wide


def _short(s: str) -> bool:
    """Whether a stretch is too little to be a sentence: few letters, or a few words and no ideographs."""
    plain = {w.lower() for w in s.split() if w.isalpha()}  # each is one word whatever surrounds it
    if len(plain) >= LEAST_WORDS and sum(map(len, plain)) >= LEAST_LETTERS:
        return False
    letters, words, wide = _size(s)
    return letters < LEAST_LETTERS or (wide < 4 and words < LEAST_WORDS)


def unquoted(sentence: str) -> str:
    """The sentence without quotations and brackets, which may be foreign; all of it where little else would remain."""
    rest = _QUOTED.sub(" ", sentence)
    return rest if rest == sentence or _size(rest)[0] >= LEAST_LETTERS else sentence


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per run length, the buckets of the letter runs of all texts, and where each text's begin."""
    plain = [" " + _GAP.sub(" ", t.lower()).strip() + " " for t in texts]
    size = np.fromiter(map(len, plain), np.int64, len(plain))
    code = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(plain)), size)
    space = code == 32
    out = []
    h = code * np.uint64(0x9E3779B97F4A7C15)
    inside = np.ones(len(code), bool)
    for n in (2, 3, 4):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ (h[:m] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + code[n - 1 :] * np.uint64(0x94D049BB133111EB)
        # runs stay in one text, and no run spans a word gap
        inside = inside[:m] & (owner[n - 1 :] == owner[:m])
        if n > 2:
            inside &= ~space[n - 2 : n - 2 + m]
        at = np.flatnonzero(inside)
        mixed = h[at]
        b = ((mixed ^ (mixed >> np.uint64(31))) & np.uint64(BUCKETS - 1)).astype(np.int32)
        out.append((b, np.searchsorted(owner[at], np.arange(len(plain) + 1))))
    return out


def _means(table: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]], texts: int) -> np.ndarray:
    """The mean row of ``table`` over the buckets of each text."""
    out, n = np.zeros((texts, table.shape[1])), np.zeros(texts, np.int64)
    for b, at in grams:
        k = np.diff(at)
        full = np.flatnonzero(k)
        if len(full):
            out[full] += np.add.reduceat(table[b], at[:-1][full], axis=0)
        n += k
    return out / np.maximum(n, 1)[:, None]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(texts: list[str], y: np.ndarray, classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    emb, w = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, classes))
    each = [np.unique(np.concatenate([b for b, _ in features([t])] or [np.zeros(0, np.int32)]), return_counts=True) for t in texts]
    weight = 1 / np.maximum(1, np.bincount(y, minlength=classes))
    weight *= len(y) / classes
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            ids = order[start : start + BATCH]
            idx = np.concatenate([each[i][0] for i in ids])
            cnt = np.concatenate([each[i][1] / max(1, each[i][1].sum()) for i in ids])
            seg = np.repeat(np.arange(len(ids)), [len(each[i][0]) for i in ids])
            x = np.zeros((len(ids), DIM))
            np.add.at(x, seg, emb[idx] * cnt[:, None])
            g = _softmax(x @ w)
            g[np.arange(len(ids)), y[ids]] -= 1
            g *= np.minimum(weight[y[ids]], 5)[:, None] / len(ids)
            gx = g @ w.T
            w -= rate * (x.T @ g)
            np.add.at(emb, idx, -rate * 20 * cnt[:, None] * gx[seg])
    return emb, w


class Calibration(NamedTuple):
    """Measured on all held-out sentences, wrongly labelled ones too."""

    temperature: float = 1.0
    bar: float = 0.5
    n_held: int = 0
    #: Mean distance of confidence and rate of right ones over ten bins of confidence.
    error: float = 0.0
    #: Share of wrong ones among those at the bar or above, and their share of all.
    risk: float = 0.0
    coverage: float = 1.0


def isotonic(y: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``y`` (pool adjacent violators)."""
    sums: list[list[float]] = []
    for v in y:
        sums.append([float(v), 1.0])
        while len(sums) > 1 and sums[-2][0] * sums[-1][1] >= sums[-1][0] * sums[-2][1]:
            s, n = sums.pop()
            sums[-1][0] += s
            sums[-1][1] += n
    return np.concatenate([np.full(int(n), s / n) for s, n in sums]) if sums else np.zeros(0)


def calibrate(z: np.ndarray, y: np.ndarray) -> Calibration:
    """Temperature and bar of held-out scores ``z`` with labels ``y``."""
    if not len(y):
        return Calibration()
    rows = np.arange(len(y))
    loss = lambda t: -np.log(np.maximum(1e-12, _softmax(z / t)[rows, y])).mean()
    t = float(min(np.geomspace(0.1, 4.0, 60), key=loss))
    p = _softmax(z / t)
    conf, right = p.max(1), p.argmax(1) == y
    order = np.argsort(conf, kind="stable")
    rate = isotonic(right[order].astype(float))
    bad = int((rate < LEAST_ACCURACY).sum())  # the least sure ones
    sure = np.concatenate([[1 / z.shape[1]], conf[order], [1.0]])
    bar = float((sure[bad] + sure[bad + 1]) / 2) if bad else float(sure[0])  # nothing measured asks for more than chance
    bins = np.minimum(9, (conf * 10).astype(int))
    gaps = [(bins == b).sum() * abs(conf[bins == b].mean() - right[bins == b].mean()) for b in range(10) if (bins == b).any()]
    over = conf >= bar
    return Calibration(t, bar, len(y), float(sum(gaps) / len(y)), float((~right[over]).mean()) if over.any() else 0.0, float(over.mean()))


class Model:
    """Scores per bucket and language, already divided by the temperature, and what was measured of them."""

    def __init__(self, table: np.ndarray, names: list[str], calibration: Calibration = Calibration()) -> None:
        self.table, self.names, self.calibration = np.ascontiguousarray(table, np.float32), names, calibration

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return _softmax(_means(self.table, features([unquoted(t) for t in texts]), len(texts)))


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """A model of (language, text) rows, one text per record; None without rows."""
    pairs = [(lang, s) for lang, text in rows for s in sentences(text)]
    # the same text without accents, and in capitals, is the same language
    rng = np.random.default_rng(seed)
    if not pairs:
        return None
    pick = rng.permutation(len(pairs))[: SENTENCES + SENTENCES // 5]
    held, pick = pick[: len(pick) // 6], pick[len(pick) // 6 :]
    names = sorted({lang for lang, _ in pairs})
    at = {n: i for i, n in enumerate(names)}
    if len(names) == 1:
        return Model(np.zeros((BUCKETS, 1)), names)
    import unicodedata

    def plain(s: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    def varied(ids: np.ndarray) -> tuple[list[str], np.ndarray]:
        texts = [pairs[i][1] if k % 4 else plain(pairs[i][1]) for k, i in enumerate(ids)]
        return texts, np.array([at[pairs[i][0]] for i in ids])

    texts, y = varied(pick)
    emb, w = _fit(texts, y, len(names), seed)
    p = Model(emb @ w, names).probabilities(texts)
    agree = p.argmax(1) == y
    if agree.sum() >= 2 * len(names):
        texts, y = [t for t, a in zip(texts, agree) if a], y[agree]
        emb, w = _fit(texts, y, len(names), seed + 1)
    table = emb @ w
    texts, y = varied(held)
    found = calibrate(_means(table, features([unquoted(t) for t in texts]), len(texts)), y)
    return Model(table / found.temperature, names, found)


def segments(model: Model, texts: list[str | None]) -> list[list[tuple[str, float, str]]]:
    """(language, confidence, text) of the segments of each text."""
    cut = [sentences(t) for t in texts]
    flat = [s for c in cut for s in c]
    out: list[list[tuple[str, float, str]]] = []
    p = model.probabilities(flat) if flat else np.zeros((0, 1))
    k = 0
    for c in cut:
        own = p[k : k + len(c)]
        k += len(c)
        out.append(_runs(model.names, c, own, model.calibration.bar) if c else [])
    return out


def _runs(names: list[str], parts: list[str], p: np.ndarray, bar: float) -> list[tuple[str, float, str]]:
    best, sure = p.argmax(1), p.max(1) >= bar
    if not sure.any():
        mean = p.mean(0)
        return [(names[int(mean.argmax())] if mean.max() >= bar else UNDECIDED, float(mean.max()), " ".join(parts))]
    label = [int(b) if s else -1 for b, s in zip(best, sure)]
    for i in range(len(label)):  # rejected sentences follow the one before, or the first sure one
        if label[i] < 0:
            label[i] = label[i - 1] if i else next(x for x in label if x >= 0)
    out: list[tuple[str, float, str]] = []
    start = 0
    for i in range(1, len(label) + 1):
        if i == len(label) or label[i] != label[start]:
            out.append((names[label[start]], float(p[start:i, label[start]].mean()), " ".join(parts[start:i])))
            start = i
    return out


def fitted(works: DataFrame) -> Model | None:
    """The model of a bounded sample of labelled records: SAMPLE per language, taken by hash of the id."""
    known = F.lower(F.trim(F.col("language")))
    code = F.element_at(F.create_map(*[F.lit(x) for c, fs in FORMS.items() for f in fs.split() for x in (f, c)]), F.split(known, "[-_ ]")[0])
    rows = works.where("abstract is not null and language is not null").select(code.alias("lang"), "work_id", F.col("abstract").alias("t"))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("work_id"), "work_id")
    rows = rows.where("lang is not null").withColumn("k", F.row_number().over(w)).where(F.col("k") <= SAMPLE)
    return train([(r.lang, r.t) for r in sorted(rows.collect(), key=lambda r: (r.lang, r.k))])


def segmented(works: DataFrame) -> DataFrame:
    """(work_id, label, n_segments, segment, language, confidence, text) of all abstracts."""
    w = materialize(latest_works(works.select("work_id", "language", "abstract", "loaded_at")).where("abstract is not null"), "abstracts")
    fit = fitted(w)
    # plain values: a class of this package could not be read back where the package isn't installed
    shared = works.sparkSession.sparkContext.broadcast(fit and (fit.table, fit.names, tuple(fit.calibration)))
    names = ["work_id", "label", "n_segments", "segment", "language", "confidence", "text"]
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value and Model(*shared.value[:2], Calibration(*shared.value[2]))
        for whole in batches:
            for i in range(0, whole.num_rows if model else 0, 256):
                b = whole.slice(i, 256)
                rows = []
                for wid, lab, segs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), segments(model, b.column(2).to_pylist())):
                    code = normal_label(lab)
                    rows += [(wid, code, len(segs), k, *s) for k, s in enumerate(segs)]
                cols = list(zip(*rows)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    schema = "work_id string, label string, n_segments int, segment int, language string, confidence double, text string"
    return w.select("work_id", "language", "abstract").mapInArrow(run, schema)


def found(works: DataFrame) -> DataFrame:
    """(work_id, segment, language) of the records that are mixed, unlabelled or labelled wrong."""
    s = segmented(works)
    case = (F.col("n_segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("language"))
    return s.where(case & (F.col("language") != UNDECIDED)).select("work_id", "segment", "language")
