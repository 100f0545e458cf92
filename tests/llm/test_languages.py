import random

import pytest

from stemma.llm import languages as L

SAY = {
    "en": ["The authors compared earlier claims about {}.", "This study measured the role of {} in the tissue.", "We improved estimates of {} over a period of 3.5 days."],
    "es": ["Los autores comparan por primera vez la calidad de {}.", "Este trabajo mide el papel de {} en los tejidos.", "El estudio mejora los límites de {} según cada centro."],
    "de": ["Die Autoren vergleichen erstmals die Güte von {}.", "Diese Arbeit untersucht die Rolle von {} im Gewebe.", "Das Modell verbessert die Grenzen von {} je Standort."],
    "ru": ["Авторы впервые сравнивают качество данных о {}.", "Эта работа измеряет роль {} в тканях.", "Модель уточняет пределы {} в разных центрах."],
    "zh": ["作者首次比较了关于{}的数据质量。", "本研究测量了组织中{}的作用。", "该模型改进了各中心{}的局限。"],
}
THINGS = ["gene expression", "cell atlas", "neural network", "long reads", "flux balance"]


def abstract(r, lang, n=4):
    return " ".join(r.choice(SAY[lang]).format(r.choice(THINGS)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    return [(lang, abstract(r, lang)) for lang in SAY for _ in range(40)]


@pytest.fixture(scope="module")
def model(rows):
    wrong = [("en", t) for lang, t in rows[40:44]]  # some labels are wrong
    return L.train(rows + wrong)


def test_held_out_accuracy(model):
    r = random.Random(8)
    held = [(lang, abstract(r, lang, 1)) for lang in SAY for _ in range(60)]
    p = model.probabilities([t for _, t in held])
    assert sum(model.names[i] == lang for i, (lang, _) in zip(p.argmax(1), held)) / len(held) > 0.98
    assert (p.max(1) >= model.calibration.bar).mean() > 0.95


def test_segments(model):
    r = random.Random(9)
    mixed = f"<p>Abstract: {abstract(r, 'en', 2)}</p> {abstract(r, 'ru', 2)} {abstract(r, 'en', 1)}"
    quoted = "本研究测量了组织中“die Grenzen von allen Standorten der Welt”的作用。"
    got = L.segments(model, [mixed, abstract(r, "de").upper(), quoted, "", None, "1234 5.6", abstract(r, "es", 1) + " zzqq."])
    assert [s[0] for s in got[0]] == ["en", "ru", "en"]
    assert [s[0] for s in got[1]] == ["de"] and [s[0] for s in got[2]] == ["zh"]
    assert got[3] == got[4] == got[5] == [] and [s[0] for s in got[6]] == ["es"]
    assert all(0 < s[1] <= 1 for g in got for s in g)
    assert len(L.segments(model, [abstract(r, "en", 3000)])[0]) == 1


@pytest.mark.parametrize("label,want", [("EN", "en"), ("eng", "en"), ("English", "en"), ("en-US", "en"), ("pt_BR", "pt"), ("zh-CN", "zh"), ("", None), (None, None), ("und", None), ("unknown", None), ("xx", "?")])
def test_labels(label, want):
    assert L.normal_label(label) == want


def test_table(spark, rows):
    r = random.Random(10)
    works = [(f"W{i}", lang, t, 1, 0) for i, (lang, t) in enumerate(rows)]
    works += [("X1", None, abstract(r, "es"), 1, 0), ("X2", "de", abstract(r, "en"), 1, 0), ("X3", "en-GB", abstract(r, "en"), 1, 0), ("X4", "en", None, 1, 0), ("X5", "en", " ", 1, 0),
              ("X6", "en", abstract(r, "en", 2) + " " + abstract(r, "de", 2), 1, 0), ("X1", None, abstract(r, "ru"), 0, 0), (None, None, abstract(r, "es"), 1, 0)]
    df = spark.createDataFrame(works, "work_id string, language string, abstract string, loaded_at int, segment int")
    assert {tuple(x) for x in L.found(df).collect()} == {("X1", 0, "es"), ("X2", 0, "en"), ("X6", 0, "en"), ("X6", 1, "de")}
    assert L.found(df.limit(0)).count() == 0
    assert L.train([]) is None and L.train([("en", "Only one language here.")]).names == ["en"]


def test_calibration():
    import numpy as np

    r = np.random.default_rng(3)
    y = r.integers(0, 4, 4000)
    z = r.normal(0, 1, (4000, 4))
    z[np.arange(4000), y] += 2.0  # the softmax of 2 z is what the labels were drawn from, nearly
    c = L.calibrate(z * 5, y)  # five times too sure
    assert c.n_held == 4000 and 1.5 < c.temperature < 4.0 and c.error < 0.05
    assert 0 < c.bar < 1 and c.risk < 0.3 and 0 < c.coverage < 1
    assert L.isotonic(np.array([1.0, 0, 1, 0, 1, 1])).tolist() == [0.5, 0.5, 0.5, 0.5, 1.0, 1.0]
    assert L.calibrate(np.zeros((0, 4)), np.zeros(0, int)) == L.Calibration()


def test_rejected_text(model):
    """A text below the bar has one segment without a language, and is no case."""
    sure = L.Model(model.table, model.names, L.Calibration(bar=1.1))
    assert [s[0] for s in L.segments(sure, ["The authors compared earlier claims about genes."])[0]] == [L.UNDECIDED]
