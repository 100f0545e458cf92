import pytest

from stemma.llm import canon
from stemma.llm import names as N

ENTRIES = [
    ("I1", "University of Arford", "GB", 5), ("I2", "Arford State University", "GB", 4), ("I3", "Arford University Hospital", "GB", 3),
    ("I4", "Université de Belmont", "FR", 2), ("I5", "Institut für Molekularbiologie Cölnberg", "DE", 1), ("I6", "National Academy of Darville", "US", 9),
    ("I7", "National Academy of Darville", "GB", 1), ("I8", "Ekford Center for Genome Research", "CN", 1), ("I9", None, None, 0),
]
COUNTRIES = [("GB", "United Kingdom"), ("US", "United States"), ("FR", "France"), ("DE", "Germany"), ("CN", "China"), ("KR", "Korea, Republic of"), (None, None)][:-1]


@pytest.fixture(scope="module")
def index():
    return canon.Canon(ENTRIES, COUNTRIES)


@pytest.mark.parametrize("raw,want", [
    ("Dept. of Genetics, Univ. of Arford, Arford, United Kingdom", "I1"), ("Arford, University of", "I1"), ("ARFORD UNIV", "I1"), ("U. of Arfrod, Arford, UK", "I1"),
    ("a) Faculty of Medicine - State Univ Arford (deceased)", "I2"), ("Arford St. University", "I2"), ("Univ Hosp of Arford", "I3"), ("Arford Univeristy Hospital", "I3"),
    ("University of Belmont", "I4"), ("UniversitÃ© de Belmont, France", "I4"), ("IMB Cölnberg", "I5"), ("Institute of Molecular Biology, Colnberg", "I5"),
    ("National Academy of Darville, United Kingdom", "I7"), ("Nat. Acad. Darville (Darville, US)", "I6"), ("Genome Research Center, Ekford", "I8"), ("Ekford Genome Center", "I8"),
    ("Arford School of Music", "none"), ("Medical University of Arford, United States", "none"), ("University of Nowhere, Nowhere, France", "none"), ("n/a", "none"),
    ("无", "none"), ("", "none"), (None, "none"), ("Department of Biology", "none"), ("University of Arforb, Arforb, France", "none"),
])
def test_resolve(index, raw, want):
    assert index.resolve(raw)[0] == want


def test_longest_match_wins(index):
    assert index.resolve("Arford State University Hospital Building")[0] == "I2"
    assert index.resolve("x " * 200_000 + "University of Arford")[0] == "I1"


def test_distance_against_plain():
    def plain(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    import random

    r = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 7))) for _ in "ab")
        assert N.distance(a, b, 2) == min(3, plain(a, b))


def test_table(spark):
    vals = spark.createDataFrame([(1, "Univ Arford", 0, "x"), (1, "Univ Arford", 0, "x"), (2, None, 0, "x"), (3, "Univ Arford", 1, "x"), (None, "Univ Arford", 0, "x")],
                                 "affil_id long, raw_affiliation string, n_resolved_institutions int, institution_id string")
    inst = spark.createDataFrame(ENTRIES, "institution_id string, institution_name string, country_code string, n_works long")
    reg = spark.createDataFrame(COUNTRIES, "country_code string, country_name string")
    assert {tuple(r) for r in canon.found(vals, inst, reg).collect()} == {(1, "I1"), (2, "none")}
    assert {tuple(r) for r in canon.found(vals, inst.limit(0), reg).collect()} == {(1, "none"), (2, "none")}
    assert canon.found(vals.limit(0), inst, reg).count() == 0


def test_accuracy_on_resolved_strings(spark, sf):
    inst = [tuple(r) for r in spark.read.parquet(f"{sf}/institutions.parquet").select("institution_id", "institution_name", "country_code", "n_works").collect()]
    reg = [tuple(r) for r in spark.read.parquet(f"{sf}/country_regions.parquet").select("country_code", "country_name").collect()]
    c = canon.Canon(inst, reg)
    rows = spark.read.parquet(f"{sf}/affiliations_raw.parquet").where("resolved_institution_id is not null").collect()
    assert sum(c.resolve(r.raw_affiliation)[0] == r.resolved_institution_id for r in rows) / len(rows) > 0.99


def test_list_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(canon, "MAX_ENTRIES", 3)
    inst = spark.createDataFrame(ENTRIES, "institution_id string, institution_name string, country_code string, n_works long")
    with pytest.raises(ValueError):
        canon.read_list(inst, spark.createDataFrame(COUNTRIES, "country_code string, country_name string"))


@pytest.mark.parametrize("raw,want", [
    ("National Academy of Darville, GB (deceased)", "I7"), ("National Academy of Darville (Darville, GB) (on leave since 2019)", "I7"),
    ("National Academy of Darville, GB. Electronic address: mimek@gol.example", "I7"), ("Natl Acad Darville, Electronic address: mimek@gol.example, GB, 11111 Darville", "I7"),
    ("National Academy of Darville, GB, 11111 Darville, Long Street 12, Block 3", "I7"), ("National Academy of Darville, GB-11111 Darville, Long Street 12", "I7"),
    ("Department of GB, National Academy of Darville, Long Street 12", "I6"), ("NATIONAL ACADEMY DE DARVILLE", "I6"),
])
def test_country_code_anywhere_after_the_name(index, raw, want):
    assert index.resolve(raw)[0] == want


def test_particle_is_no_country():
    c = canon.Canon([("A", "Universidad de Ulmen", "DE", 1), ("B", "Universidad de Ulmen", "US", 9)], [("DE", "Germany"), ("US", "United States")])
    assert c.resolve("UNIVERSIDAD DE ULMEN")[0] == "B"
    assert c.resolve("UNIVERSIDAD DE ULMEN, DE (deceased)")[0] == "A"


def test_similarity_reaches_entries_of_several_proper_words_and_of_none():
    more = [("M1", "Vale Snark State University", "GB", 1), ("M2", "National Institute of Genetics", "GB", 1), ("M3", "Vale University", "GB", 1)]
    c = canon.Canon(more, COUNTRIES)
    assert c.resolve("State University, Snark, Vale")[:2] == ("M1", "similar")
    assert c.resolve("Natl. Inst. of Genet., London")[:2] == ("M2", "similar")
    assert c.resolve("University of Snark")[0] == "none" and c.resolve("Institute of Biology")[0] == "none"
    assert canon.Canon(more[1:2], COUNTRIES).resolve("Nat. Inst. of Genetics, London")[0] == "M2"
