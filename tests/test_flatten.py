import json
import re

from stemma.operators import flatten as fl

RAW = "file_name string, line_no int, record string, id string"


def raw(spark, *records):
    rows = [("f", i, r if isinstance(r, str) or r is None else json.dumps(r), "clash") for i, r in enumerate(records)]
    return spark.createDataFrame(rows, RAW)


def found(df):
    return {tuple(r) for r in fl.found(df).collect()}


def test_full_record(spark):
    rec = {
        "id": "https://x/W1",
        "authorships": [
            {"author": {"id": "a/A1", "display_name": "N"}, "institutions": [{"id": None, "display_name": "I"}, {"id": "i/I2"}], "countries": ["US", "CN", "US", None]},
            {"author": None, "institutions": None, "countries": ["DE"]},
        ],
        "primary_topic": {"display_name": "T", "subfield": {"display_name": ""}, "field": {}, "domain": {"display_name": "D"}},
        "abstract_inverted_index": {"b": [1], "a": [0, 2], "c": []},
        "extra": {"deep": [1, {"x": 2}]},
    }
    assert found(raw(spark, rec)) == {
        ("W1", "author", 0, 0, "A1"), ("W1", "institution", 0, 1, "I2"), ("W1", "country", 0, 0, "CN"), ("W1", "country", 0, 1, "US"),
        ("W1", "country", 1, 0, "DE"), ("W1", "topic", 0, 0, "T"), ("W1", "topic", 3, 0, "D"), ("W1", "word", 0, 0, "a"), ("W1", "word", 1, 0, "b"), ("W1", "word", 2, 0, "a"),
    }


def test_states_are_composed_bottom_up(spark):
    inst = [{"display_name": "I"}, {}]
    full = {"id": "W1", "authorships": [{"author": {"id": "A"}}, {"author": {"display_name": "n"}}, {}, {"author": {"id": "B"}, "institutions": inst}, {"author": {"display_name": "m"}, "institutions": inst}],
            "keywords": [{"display_name": "k", "score": 0.5}, {"display_name": "k"}, {}], "abstract_inverted_index": {"w": [0]}}
    recs = [full, {"id": "W2", "authorships": [{"author": {"id": "A"}}]}, {"id": "W3", "authorships": [{}], "abstract_inverted_index": {"w": [0]}},
            {"id": "W4", "primary_topic": {"field": {"display_name": "F"}}}, {"id": "W5", "authorships": [], "abstract_inverted_index": {"w": []}}]
    n = fl.nodes(fl.typed_records(fl.first_deliveries(raw(spark, *recs))))
    w1 = fl.subtype_table(n, "author").where("work_id = 'W1'").orderBy("ord").collect()
    assert [(r.ord, r.subtype) for r in w1] == [(0, "identified"), (1, "named"), (2, "blank"), (3, "identified_affiliated"), (4, "named_affiliated")]
    assert {r.subtype for r in fl.subtype_table(n, "keyword").collect()} == {"scored", "unscored", "blank"}
    assert {r.work_id: r.subtype for r in fl.subtype_table(n, "record").collect()} == {"W1": "attributed_text", "W2": "attributed", "W3": "text", "W4": "classified", "W5": "bare"}


def test_nodes_are_routed_to_typed_tables(spark):
    rec = {"id": "W1", "authorships": [{"author": {"id": "A"}, "institutions": [{"id": "I"}, {"display_name": "x"}]}, {"author": {"display_name": "n"}}]}
    routed = fl.route(fl.nodes(fl.typed_records(fl.first_deliveries(raw(spark, rec)))))
    named = fl.subtype_table(routed, "author", "named")
    assert named.columns == ["work_id", "child", "ord", "sub_ord", "subtype", "name"] and [(r.ord, r.name) for r in named.collect()] == [(1, "n")]
    plan = fl.child_items(routed)._jdf.queryExecution()
    assert re.search(r"subtype#\d+ = registered", plan.optimizedPlan().toString()) and "PartitionFilters: [isnotnull(" in plan.executedPlan().toString()
    parents = fl.subtype_table(routed, "author").select("work_id", "ord")
    assert fl.subtype_table(routed, "institution").join(parents, ["work_id", "ord"]).count() == 2  # every child finds its parent


def test_first_delivery_counts_and_bad_lines_are_left_out(spark):
    one = {"id": "u/W1", "primary_topic": {"display_name": "first"}}
    two = {"id": "u/W1", "primary_topic": {"display_name": "later"}}
    bad = json.dumps(one)[:-3]
    df = raw(spark, bad, one, two, None, "", "[1]", "7", '{"id": ""}', '{"id": null}', "{}")
    assert found(df) == {("W1", "topic", 0, 0, "first")}
    assert found(df.unionAll(df)) == found(df)
    nowhere = df.selectExpr("cast(null as string) as file_name", "cast(null as int) as line_no", "record")
    assert len(found(nowhere)) == 1 and found(nowhere.repartition(5)) == found(nowhere)


def test_wrong_types_and_empty_table(spark):
    df = raw(spark, {"id": "W1", "authorships": "none", "primary_topic": 3, "abstract_inverted_index": [1], "keywords": {"a": 1}})
    assert found(df) == set()
    assert found(df.limit(0)) == set()


def test_abstract_text_and_work_rows(spark):
    recs = [{"id": "W1", "abstract_inverted_index": {"b": [1, 1], "a": [0]}}, {"id": "W2", "abstract_inverted_index": {}}, {"id": "W3", "abstract_inverted_index": {"x": []}}, {"id": "W4"}]
    rows = {r.work_id: r for r in fl.work_rows(fl.typed_records(fl.first_deliveries(raw(spark, *recs)))).collect()}
    assert [rows[f"W{i}"].abstract for i in (1, 2, 3, 4)] == ["a b b", None, "", None]
    assert rows["W1"].cited_by_count == 0 and rows["W1"].n_authors == 0


def test_long_abstract(spark):
    n = 50_000
    df = raw(spark, {"id": "W1", "abstract_inverted_index": {f"w{i}": [i] for i in range(n)}})
    assert fl.found(df).count() == n
