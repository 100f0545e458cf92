import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from stemma import schemas
from stemma.config import Settings, load_settings
from stemma.operators import flatten
from stemma.sources import files, rest
from stemma.streaming import incremental


def test_gzip_lines_and_records(spark, tmp_path):
    for y, recs in ((2010, ['{"id": "W1", "title": "a"}', "", '{"id": "W2"']), (2011, ['{"id": "W1", "title": "b"}'])):
        with gzip.open(tmp_path / f"works_{y}.jsonl.gz", "wt") as f:
            f.write("\n".join(recs) + "\n")
    lines = files.read_work_lines(spark, f"{tmp_path}/works_*.jsonl.gz")
    assert [(r.file_name, r.line_no) for r in lines.orderBy("file_name", "line_no").collect()] == [("works_2010.jsonl.gz", 1), ("works_2010.jsonl.gz", 3), ("works_2011.jsonl.gz", 1)]
    assert [r.title for r in flatten.work_rows(flatten.typed_records(flatten.first_deliveries(lines))).collect()] == ["a"]
    assert {r.title for r in files.read_records(spark, f"{tmp_path}/works_2011.jsonl.gz").collect()} == {"b"}


def test_counts_document(spark, tmp_path):
    p = tmp_path / "counts.json"
    p.write_text(json.dumps({"ai_bio": {"2010": 3}, "bio_baseline": {"2010": 9, "2011": 4}}, indent=1))
    y = files.yearly_counts(files.read_json_document(spark, str(p), schemas.COUNTS_BY_YEAR))
    assert {tuple(r) for r in y.collect()} == {(2010, 3, 9), (2011, 0, 4)}


def test_country_csv_keeps_na(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('country_code,country_name,region,eu27\nNA,Namibia,Africa,\nCD,"Congo, Democratic Republic of the",Africa,\nDE,Germany,Europe,EU27\n')
    rows = {r.country_code: r for r in files.read_country_regions(spark, str(p)).collect()}
    assert rows["NA"].eu27 == "" and rows["CD"].country_name.startswith("Congo, D") and rows["DE"].eu27 == "EU27"


def test_human_csv_is_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("W1", 2010, 'a "quoted"\nline', None, "", "n")], schemas.GOLD_CSV)
    files.write_human_csv(df, f"{tmp_path}/gold")
    assert files.read_labelled_csv(spark, f"{tmp_path}/gold").first().title == 'a "quoted"\nline'
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_human_csv(df, f"{tmp_path}/gold")


def test_cache_last_record_wins(spark, tmp_path):
    p = tmp_path / "cache.jsonl"
    p.write_text('{"work_id": "W1", "ai_role": "a"}\n{"work_id": "W2", "ai_role": "b"}\nnot json\n{"work_id": "W1", "ai_role": "c"}\n')
    assert {r.work_id: r.ai_role for r in files.read_label_cache(spark, str(p)).collect()} == {"W1": "c", "W2": "b"}
    files.append_cache(spark.createDataFrame([("W3", "d")], "work_id string, ai_role string"), f"{tmp_path}/more")
    files.append_cache(spark.createDataFrame([("W4", "d")], "work_id string, ai_role string"), f"{tmp_path}/more")
    assert files.read_label_cache(spark, f"{tmp_path}/more").count() == 2


def test_tables_scripts_manifest(spark, tmp_path):
    t = files.replace_table(spark.range(3), f"{tmp_path}/t")
    t2 = files.replace_table(spark.range(5), f"{tmp_path}/t")
    assert t2.count() == 5 and t.columns == ["id"]
    files.replace_view(spark.range(4), "stemma_numbers")
    assert "stemma_numbers" in files.table_names(spark)
    r = files.run_script(spark, "-- note\ncreate or replace temp view stemma_v as select * from stemma_numbers; select count(*) as n from stemma_v where id between :lo and :hi", lo=1, hi=2)
    assert r.first().n == 2
    files.write_manifest(tmp_path / "m.json", n=3)
    assert files.read_manifest(tmp_path / "m.json") == {"n": 3} and not list(tmp_path.glob("*.part"))
    files.write_json_lines(spark.range(3), f"{tmp_path}/j")
    assert spark.read.schema("id long").json(f"{tmp_path}/j").count() == 3


def test_cache_key_is_content_not_size(spark, tmp_path):
    a = spark.createDataFrame([("W1", "x")], "id string, text string")
    b = spark.createDataFrame([("W1", "y")], "id string, text string")
    assert files.cached(a, str(tmp_path), "c", ["id", "text"]).first().text == "x"
    assert files.cached(b, str(tmp_path), "c", ["id", "text"]).first().text == "y"
    assert len(list(tmp_path.iterdir())) == 2
    files.cached(a, str(tmp_path), "c", ["id", "text"])
    assert len(list(tmp_path.iterdir())) == 2


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("n_clusters: 12\nearly_years: [2000, 2001]\n")
    s = load_settings(tmp_path / "s.yaml", seed=1)
    assert (s.n_clusters, s.early_years, s.seed, s.end_year) == (12, (2000, 2001), 1, Settings().end_year)
    with pytest.raises(ValueError, match="unknown"):
        load_settings(nonsense=1)


class Api(BaseHTTPRequestHandler):
    fails = 2

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if Api.fails:
            Api.fails -= 1
            self.send_response(429)
            self.end_headers()
            return
        year = q["filter"].split(":")[-1]
        if "group_by" in q:
            body = {"group_by": [{"key": "2010", "count": 7}]}
        elif "sample" in q:
            body = {"results": [{"id": f"S{year}-{q['seed']}-{q['page']}-{i}"} for i in range(2 if q["page"] == "1" else 1)]}
        else:
            page = {"*": ("c1", 2), "c1": ("c2", 1), "c2": (None, 0)}[q["cursor"]]
            body = {"results": [{"id": f"{year}-{q['cursor']}-{i}"} for i in range(page[1])], "meta": {"next_cursor": page[0]}}
        data = json.dumps(body).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def api():
    s = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/works"
    s.shutdown()


def test_paged_search(spark, api):
    Api.fails = 2
    spark.dataSource.register(rest.PagedSearch)
    read = lambda **o: spark.read.format("paged_search").options(url=api, backoff="0.01", **o).load()
    rows = read(years="2010-2011", filter="x:1").collect()
    assert sorted(json.loads(r.record)["id"] for r in rows) == sorted(f"{y}-{c}-{i}" for y in (2010, 2011) for c, i in (("*", 0), ("*", 1), ("c1", 0)))
    assert {r.line_no for r in rows} == {1, 2, 3}
    assert read(years="2010-2010", sample="3", per_page="2").count() == 3
    assert rest.count_by_year(api, "x:2010", backoff=0.01) == {2010: 7}


def test_paged_search_gives_up(api):
    Api.fails = 9
    with pytest.raises(Exception, match="429"):
        rest.fetch_json(api, {}, tries=2, backoff=0.01)
    Api.fails = 0


def test_incremental_ingest(spark, sf, tmp_path):
    raw = spark.read.parquet(f"{sf}/raw_works.parquet")
    src, out, ck = (f"{tmp_path}/{n}" for n in ("src", "out", "ck"))
    raw.limit(10).write.mode("append").parquet(src)
    lines = incremental.deduplicated(incremental.new_lines(spark, src))
    incremental.run_available(lines, out, ck)
    n = spark.read.parquet(out).count()
    incremental.run_available(incremental.deduplicated(incremental.new_lines(spark, src)), out, ck)
    assert spark.read.parquet(out).count() == n  # nothing new, nothing read
    raw.limit(10).write.mode("append").parquet(src)
    incremental.run_available(incremental.deduplicated(incremental.new_lines(spark, src)), out, ck)
    assert spark.read.parquet(out).count() == n  # the same records again are dropped
    ids = spark.read.parquet(out)
    assert ids.select("id").distinct().count() == ids.count() == n


def test_windowed_counts_batch_equals_stream(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    batch = incremental.windowed_counts(ev)
    assert batch.count() > 0 and batch.agg({"n": "sum"}).first()[0] == ev.count()


def test_later_append_wins_whatever_the_files(spark, tmp_path):
    """One old, small file, then a larger one: readers take large files first, the cache goes by append."""
    old = spark.createDataFrame([("w1", "not_ai")], "work_id string, ai_role string")
    new = spark.createDataFrame([(f"w{i}", "ai_method") for i in range(2000)], "work_id string, ai_role string").coalesce(1)
    for order, want in (((old, new), "ai_method"), ((new, old), "not_ai")):
        path = f"{tmp_path}/cache-{want}"
        for part in order:
            files.append_cache(part, path)
        assert files.read_label_cache(spark, path).where("work_id = 'w1'").first().ai_role == want
        assert files.read_label_cache(spark, path).count() == 2000


def test_within_an_append_the_later_row_wins(spark, tmp_path):
    files.append_cache(spark.createDataFrame([("w1", "a"), ("w1", "b")], "work_id string, ai_role string").coalesce(1), f"{tmp_path}/c")
    assert files.read_label_cache(spark, f"{tmp_path}/c").first().ai_role == "b"


def test_script_parts_and_parameters():
    got = files.statements("select ':no; -- x' as a, `b;c` from t where d = :yes; -- end; :none\n/* ; */ select \"it''s;\", x::int, :two, :yes_2 ; ;\n-- nothing\n")
    assert [sorted(n) for _, n in got] == [["yes"], ["two", "yes_2"]]
    assert got[0][0].startswith("select ':no; -- x'") and "x::int" in got[1][0]


def test_script_without_a_value(spark):
    with pytest.raises(ValueError, match="least"):
        files.run_script(spark, "select :least as x", other=1)


def test_sheet_keeps_blanks_quotes_and_line_ends(spark, tmp_path):
    rows = [("W1", 2010, "  a \"b\", c ", "x\ny", None, None), ("W2", None, "NA", "", None, None), ("W3", 1, None, "\\", None, None)]
    df = spark.createDataFrame(rows, schemas.GOLD_CSV)
    files.write_human_csv(df, f"{tmp_path}/s")
    got = {r.work_id: (r.title, r.abstract) for r in files.read_labelled_csv(spark, f"{tmp_path}/s").collect()}
    assert got["W1"] == ("  a \"b\", c ", "x\ny") and got["W2"][0] == "NA" and got["W3"] == (None, "\\")


def test_nested_settings(tmp_path):
    text = "paths: {raw_dir: x}\nproject: {title: T, contact_email: a@b.example}\ncorpus:\n  start_year: 2011\n  work_types: [article, review]\n  ai_terms: [machine learning]\n"
    text += "topics: {n_clusters: 7, random_state: 3, early_window: [2000, 2001], embedding_model: m}\nllm_classification: {enabled: true, provider: p, model: m, gold_size: 9}\n"
    (tmp_path / "n.yaml").write_text(text)
    s = load_settings(tmp_path / "n.yaml")
    assert (s.start_year, s.work_types, s.ai_terms, s.n_clusters, s.seed, s.early_years, s.gold_size) == (2011, ("article", "review"), ("machine learning",), 7, 3, (2000, 2001), 9)
    (tmp_path / "bad.yaml").write_text("corpus: {nonsense: 1}\n")
    with pytest.raises(ValueError, match="corpus.nonsense"):
        load_settings(tmp_path / "bad.yaml")


def test_years_already_fetched_are_skipped(spark, api, tmp_path):
    Api.fails = 0
    spark.dataSource.register(rest.PagedSearch)
    fetch = lambda years: incremental.fetch_missing(spark, str(tmp_path), years, url=api, backoff="0.01", filter="x:1")
    assert fetch((2010, 2011)) == [2010, 2011] and fetch((2010, 2012)) == [2012] and fetch((2010, 2012)) == []
    assert spark.read.text(f"{tmp_path}/works_*").count() == 9
