from itertools import combinations

import pytest

from stemma.llm import variants as V


@pytest.mark.parametrize("raw,want", [
    ("The Lömkendal Robotics Group, Inc", ("lomkendal", "robotics")), ("robot. lom-kendal s.a.", ("lomkendal", "robotics")), ("Lom Kendal Robotic GmbH", ("lomkendal", "robotics")),
    ("Dept. of Genetics, Hosp of Lomkendal, 12345 Town, United States", ("lomkendal", "hospital")), ("Laboratory of Cell Imaging, Lomkendal Clin. (Town, US)", ("lomkendal", "clinic")),
    ("Laboratories Lomkendal LLC", ("lomkendal", "laboratory")), ("Seed Co Lomkendal Ltd", ("lomkendal", "seed")), ("Lomkendal Bio-Sciences Co.", ("lomkendal", "biosciences")),
    ("Lomkendal", ("lomkendal", "")), ("", ("", "")), (None, ("", "")), ("???", ("", "")),
])
def test_parse(raw, want):
    assert V.parse(raw)[:2] == want


def test_align():
    assert V.align(("lomkendal", "robotics"), ("robot", "lomkendal")) < 0.1
    assert V.align(("lom", "kendal"), ("lomkendal",)) == 0
    assert V.align(("j", "smith"), ("smith", "john")) < 0.2
    assert V.align(("lomkendal",), ("tarkendos",)) == 1.0
    assert V.two_slips("lomkendal", "lmokednal") is True
    assert V.two_slips("lomkendal", "lomkenbol") is False  # the last syllable is another one


GROUPS = [
    ["Lomkendalfor Robotics, Inc", "LOMKENDALFOR ROBOT. S.A.", "Lomkendalfor Robotics Ltd", "Lom-Kendalfor Robotics", "Lomkndalfor Robotics GmbH", "Lomkendalfor LLC", "Lomkendal Robotics Co."],
    ["Tarbusnelgim Hospital", "Hosp. Tarbusnelgim Inc.", "Unit 4, Hosp of Tarbusnelgim, 11111 Town, Kenya", "Tarbunselgim Hospital LLC"],
    ["Tarbusnelgim Foundation", "Found. Tarbusnelgim Inc.", "Tarbusnelgim Fdn. Ltd"],
    ["Tarbusneldor Hospital", "The Tarbusneldor Hosp."],
    ["Vintosbelmar Clinic", "Klinik Vintosbelmar"],
]


def test_pairs(spark):
    names = [n for g in GROUPS for n in g]
    df = spark.createDataFrame([(n, "clash") for n in [*names, *names[:3], None, "", "?"]], "name string, kind string")
    got = {tuple(r) for r in V.pairs(V.organisations(df.select("name"))).collect()}
    want = {tuple(sorted(p)) for g in GROUPS for p in combinations(g, 2)}
    assert got == want


def test_empty(spark):
    assert V.pairs(V.organisations(spark.createDataFrame([], "name string"))).count() == 0


def test_shortened_name_of_two_is_not_linked(spark):
    names = ["Lomkendalfor Robotics", "Lomkendalfor Robotics Ltd", "Lomkendalbun Robotics", "Lomkendalbun Robotics Ltd", "Lomkendal Robotics"]
    got = {tuple(r) for r in V.pairs(V.organisations(spark.createDataFrame([(n,) for n in names], "name string"))).collect()}
    assert got == {(names[0], names[1]), (names[2], names[3])}


def test_long_name(spark):
    df = spark.createDataFrame([("Lomkendal Clinic",), ("Lomkendal Clinic " + "x" * 20000,)], "name string")
    assert V.organisations(df).count() == 2


def linked(spark, names):
    return {tuple(r) for r in V.pairs(V.organisations(spark.createDataFrame([(n,) for n in names], "name string"))).collect()}


WORDS = [
    ["Vale Snark Clinic", "Snark Vale Clinic Ltd", "Clinic Snark-Vale Inc", "Snrak Vale Clinic", "Vael Sanrk Clinic"],
    ["John Smithers Robotics", "J Smithers Robot. Inc", "Smithers J. Robotics"],
    ["Lomkendal Tarbusnelg Seed", "Lomken Tarbusnelg Seed Co", "Tarbusnelg Lomken Seed", "Tarbus Lomkend Seed LLC"],
    ["Bo Wu Hospital", "Wu Bo Hosp. Inc"],
    ["Ann Robert Velmar Clinic", "A R Velmar Clinic", "Velmar A Robert Clinic"],
    ["Natl Ekford Observatory", "National Ekford Observ."],
    ["K Vintos Software", "Vintos K Software Ltd"], ["R Vintos Software", "Vintos R Software Ltd"],
    ["Velgim Sotbal Seed"], ["Velgim Tarkendos Seed"],
]


def test_words_in_any_order_with_initials_and_shortened_words(spark):
    assert linked(spark, [n for g in WORDS for n in g]) == {tuple(sorted(p)) for g in WORDS for p in combinations(g, 2)}


def test_initial_of_two_is_not_linked(spark):
    assert linked(spark, ["John Smithers Seed", "Jane Smithers Seed", "J Smithers Seed"]) == set()


def test_align_takes_all_tokens_of_long_names():
    words = tuple(f"word{chr(97 + i) * 4}" for i in range(15))
    assert V.align(words, words[::-1]) == 0
    assert V.align(words, (*words[:12], "tarkendos", "lomkendal", "velmar")) > 0.1


def test_two_slips_are_linked_however_many_spellings_have_them(spark):
    legal = ("Inc", "Ltd", "LLC", "GmbH", "S.A.", "Corp")
    right = [f"{x}Lomkendalfor Robotics{y}" for x in ("", "The ", "Dept. of Biology, ") for y in ("", *(f" {z}" for z in legal))]
    wrong = [f"Lmokendaflor Robotics {x}" for x in legal]
    other = ["Lmokendaflor Clinic", *(f"Lmokendaflor Clinic {x}" for x in legal)]
    assert linked(spark, right + wrong) == {tuple(sorted(p)) for p in combinations(right + wrong, 2)}
    assert linked(spark, other[:5] + right) == {tuple(sorted(p)) for g in (other[:5], right) for p in combinations(g, 2)}


def test_other_scripts_and_short_names(spark):
    groups = [["Клиника Ломкендал", "КЛИНИКА ЛОМКЕНДАЛ"], ["北京大学", "北京大学。"], ["Bo Clinic", "Klinik Bo Ltd"], ["Вектор", "Вектoр-2"]]
    assert linked(spark, [n for g in groups[:3] for n in g]) == {tuple(sorted(p)) for g in groups[:3] for p in combinations(g, 2)}
    assert V.parse("北京大学")[0] == "北京大学" and V.parse("Вектор")[0] == "вектор"


def test_long_chains_settle(spark):
    """Links are followed to the end, however long their chain."""
    n = 41
    link = spark.createDataFrame([(f"n{i:02d}", f"n{max(0, i - 1):02d}") for i in range(n)], "p string, r string")
    assert {r.r for r in V._settle(link).collect()} == {"n00"}


def test_recall_and_precision_on_planted_variants(spark):
    """Random organisations, each under spellings with legal forms, departments, addresses, abbreviations, capitals, slips, other orders."""
    import random

    r = random.Random(11)
    syllables = "bar dol fen gim hart kel lom mun nor pas quil ros sel tav ulm ven wex yor zan".split()
    kinds = {"Clinic": ("Clin.", "Klinik"), "Robotics": ("Robot.", "Robotics"), "Hospital": ("Hosp.", "Hosp"), "Seed": ("Seeds", "Seed"), "Foundation": ("Found.", "Fdn")}
    seen, truth = set(), {}
    while len(seen) < 80:
        name = "".join(r.choices(syllables, k=r.choice((3, 4))))
        if all(V.N.distance(name, s, 3) > 3 for s in seen):
            seen.add(name)
    for i, name in enumerate(sorted(seen)):
        kind, p = r.choice(sorted(kinds)), name.capitalize()
        k = r.randrange(2, len(p) - 2)
        slip = p[:k] + p[k + 1] + p[k] + p[k + 2 :] if r.random() < 0.5 else p[:k] + p[k + 1 :]
        forms = [f"{p} {kind}", f"{p} {kind}, Inc", f"The {p} {kinds[kind][0]} Ltd", f"{kinds[kind][1]} {p}", f"{p.upper()} {kind.upper()} S.A.",
                 f"Department of Biology, {p} {kind}, 12345 Town, Kenya", f"{slip} {kind} LLC"]
        truth |= dict.fromkeys(forms, i)
    got = linked(spark, list(truth))
    want = {tuple(sorted(p)) for p in combinations(truth, 2) if truth[p[0]] == truth[p[1]]}
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.95


def found(spark, folder, rows):
    """p5_found over tables in which each (institution_name, country_code, raw_affiliation) is one author's; None: no row."""
    from stemma.llm import queries

    a = [(f"W{i}", 0, n, c) for i, (n, c, _) in enumerate(rows) if n]
    b = [(i, f"W{i}", 0, s, 1) for i, (_, _, s) in enumerate(rows) if s]
    t = spark.createDataFrame(a, "work_id string, author_order int, institution_name string, country_code string")
    t.selectExpr("*", "cast(null as string) as institution_id").write.parquet(f"{folder}/authorship_inst.parquet")
    t = spark.createDataFrame(b, "affil_id bigint, work_id string, author_order int, raw_affiliation string, n_resolved_institutions int")
    t.selectExpr("*", "cast(null as string) as resolved_institution_id").write.parquet(f"{folder}/affiliations_raw.parquet")
    return {tuple(r) for r in queries.REG.queries["p5_found"](spark, str(folder)).collect()}


def test_names_that_several_could_have_are_settled_by_what_stands_beside_them(spark, tmp_path):
    """Grows with the table: three organisations share the first letters and the kind, and one has a twin of another kind."""
    rows = [
        (["Lomkendalfor Clinic", "LOMKENDALFOR CLIN.", "Klinik Lomkendal", "Lomkendal Clinic Inc", "Lomkendalfor Clinic, Ostford, Kenya", "The Lomkendal Clinic, Ostford", "Lomkendal Clinic GmbH"], 0),
        (["Lomkendalbun Clinic", "Lomkendalbun Clinics", "Lomkendalbun Clinic, Nimbay, Japan", "Lomkendal Clinic, Nimbay", "Lomkendal Clinics"], 1),
        (["Lomkendaltis Clinic", "Lomkendaltis Clinics", "Lomkendaltis Clinic, Velholt, Chad"], 2),
        (["Lomkendaltis Software", "Lomkendaltis Softw.", "Lomkendaltis Ltd"], 3),
    ]
    (a, b, c, d) = (x for x, _ in rows)
    got = found(spark, tmp_path, [
        (a[0], "KE", a[4]), (a[1], None, None), (a[2], None, a[4]), (a[3], None, a[5]), (a[6], "ke", None),  # the author's other name, its address, the country
        (b[0], "JP", b[2]), (b[1], None, b[2]), (None, None, b[3]), (b[4], " JP ", None),
        (c[0], "TD", c[2]), (c[1], None, None), (d[0], None, None), (d[1], None, "Lomkendaltis Software, Skorperk"), (d[2], None, "Lomkendaltis Software, Skorperk"),
        ("Lomkendal Clinic Ltd", None, None),  # nothing says which
    ])
    d.append("Lomkendaltis Software, Skorperk")
    assert got == {tuple(sorted(p)) for g in (a, b, c, d) for p in combinations(g, 2)}


def test_unlike_names_of_one_author_are_not_linked(spark, tmp_path):
    rows = [("Lomkendalfor Clinic", "KE", "Tarbusnelgim Hospital, Ostford, Kenya"), ("Lomkendalfor Clin.", "KE", "Tarbusnelgim Hosp., Ostford, Kenya"), (None, None, "")]
    assert found(spark, tmp_path, rows) == {("Lomkendalfor Clin.", "Lomkendalfor Clinic"), ("Tarbusnelgim Hosp., Ostford, Kenya", "Tarbusnelgim Hospital, Ostford, Kenya")}


def test_written_together(spark):
    """Only where either table has one name; null keys, repeated rows and names with an id don't count."""
    a = [("W1", 0, None, "A"), ("W1", 0, None, "A"), ("W2", 0, None, "B"), ("W2", 0, None, "C"), ("W3", 0, "I1", "D"), (None, 0, None, "E"), ("W5", None, None, "F"), ("W6", 1, None, None)]
    b = [("W1", 0, "a", 1, None), ("W2", 0, "b", 1, None), ("W3", 0, "d", 1, None), (None, 0, "e", 1, None), ("W5", None, "f", 1, None), ("W6", 1, "g", 1, None)]
    got = V.written_together(
        spark.createDataFrame(a, "work_id string, author_order int, institution_id string, institution_name string"),
        spark.createDataFrame(b, "work_id string, author_order int, raw_affiliation string, n_resolved_institutions int, resolved_institution_id string"),
    )
    assert [tuple(r) for r in got.collect()] == [("A", "a")]
