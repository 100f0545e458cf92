"""Nested records to related flat tables (problem 1 and the flattening step).

Each record is parsed once, to a variant, and walked once.  A bottom-up tree
automaton (``RULES``) gives every object of the record a state: a leaf is value
or missing, and the state of an object is decided by its own leaves and by the
states that its children were given before it.  So an author's state says whether
any institution below it is registered, a primary topic's whether all of its
levels are stated, and a record's which kinds of authors, topic and abstract it has.

Every object becomes one *node* row: its kind and state, the keys that all kinds
share (``work_id``, ``ord`` and ``sub_ord``, the positions that link it to its
parent), and the fields of its kind.  ``route`` writes the nodes once, each to the
directory of its typed subtype table, (kind, state); ``subtype_table`` reads one
table with the columns its subtype has, and never touches the others.

Defined results: a line that does not parse, is not an object, or has a null or
empty ``id`` gives no rows.  Missing, null and empty objects and arrays give no
child rows.  A leaf of the wrong type counts as missing.  Null and empty items
give no item row but keep their position.  Fields nobody declared are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.schemas import WORK_RECORD
from stemma.session import materialize

#: The automaton's transitions: kind -> (state, leaves that must have values, (child kind, states of which one must occur)...);
#: the first that applies gives the state.  Children's rules come before their parents'.
RULES: dict[str, tuple[tuple, ...]] = {
    "institution": (("registered", ("id",)), ("unregistered", ("name",)), ("blank", ())),
    "raw_affiliation": (("stated", ("name",)), ("blank", ())),
    "country": (("stated", ("name",)), ("blank", ())),
    "author": (
        ("identified_affiliated", ("id",), ("institution", ("registered", "unregistered"))), ("identified", ("id",)),
        ("named_affiliated", ("name",), ("institution", ("registered", "unregistered"))), ("named", ("name",)), ("blank", ()),
    ),
    "topic": (("stated", ("name",)), ("blank", ())),
    "keyword": (("scored", ("name", "score")), ("unscored", ("name",)), ("blank", ())),
    "word": (("stated", ("name",)), ("blank", ())),
    "record": (
        ("attributed_text", ("id",), ("author", ("identified_affiliated", "identified", "named_affiliated", "named")), ("word", ("stated",))),
        ("attributed", ("id",), ("author", ("identified_affiliated", "identified", "named_affiliated", "named"))),
        ("text", ("id",), ("word", ("stated",))), ("classified", ("id",), ("topic", ("stated",))), ("bare", ()),
    ),
}
#: Columns of the kinds beside the shared keys, and those a state is known to lack.
TYPED = {
    "record": ("id",),
    "author": ("id", "name"),
    "institution": ("id", "name", "ror", "country_code", "type"),
    "raw_affiliation": ("name",),
    "country": ("name",),
    "topic": ("name",),
    "keyword": ("name", "score"),
    "word": ("name",),
}
LACKS = {
    ("author", "named"): ("id",), ("author", "named_affiliated"): ("id",), ("author", "blank"): ("id", "name"),
    ("institution", "unregistered"): ("id",), ("institution", "blank"): ("id", "name"), ("keyword", "unscored"): ("score",), ("keyword", "blank"): ("name",),
    **{(kind, "blank"): ("name",) for kind in ("raw_affiliation", "country", "topic", "word")},
}
#: Problem 1's item of each kind, and the subtype tables that have one.
ITEMS = {
    "author": ("id", ("identified_affiliated", "identified")),
    "institution": ("id", ("registered",)),
    "country": ("name", ("stated",)),
    "topic": ("name", ("stated",)),
    "word": ("name", ("stated",)),
}
_KEYS = ("work_id", "child", "ord", "sub_ord", "subtype")


def short_id(c: Column) -> Column:
    """The last path segment of an id; null for null and empty."""
    return F.substring_index(F.nullif(c, F.lit("")), "/", -1)


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_lines(raw: DataFrame) -> DataFrame:
    """file_name, line_no and the ``id`` of every line; the id is null unless the line parses to an object that has one."""
    return raw.select(
        "file_name", "line_no", F.expr("nullif(try_variant_get(try_parse_json(record), '$.id', 'string'), '')").alias("id")
    )


def first_deliveries(raw: DataFrame) -> DataFrame:
    """(id, v): the records that count, as variants: of each ``id`` the first by file_name, line_no.

    Each line is parsed once, where it is read.  The first of an id is a map-side
    combined minimum, so an id that a third of all lines repeat gives one record a task.
    Equal lines at one place are one line; of different ones that of the lesser hash counts.
    """
    v = F.try_parse_json("record")
    rows = raw.select("file_name", "line_no", "record", v.alias("v"))
    rows = rows.withColumn("id", F.nullif(F.try_variant_get("v", "$.id", "string"), F.lit(""))).where(F.col("id").isNotNull())
    place = F.struct("file_name", "line_no", F.xxhash64("record").alias("h"))
    return rows.groupBy("id").agg(F.min_by("v", place).alias("v"))


def typed_records(first: DataFrame) -> DataFrame:
    """work_id and ``w``, the record as one typed struct."""
    w = F.try_variant_get("v", "$", WORK_RECORD.simpleString())
    return first.select(short_id(F.col("id")).alias("work_id"), w.alias("w"))


def _is_one_of(kind: str, states: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda n: (n["child"] == kind) & n["subtype"].isin(*states)


def _state(kind: str, leaves: dict[str, Column], **children: Column) -> Column:
    """The automaton's transition: the first rule whose leaves have values and whose children have states asked for.

    ``children`` are arrays of the nodes of each child kind.
    """
    c: Column | None = None
    for name, need, *below in RULES[kind]:
        test = F.lit(True)
        for leaf in need:
            test = test & leaves[leaf].isNotNull()
        for child, states in below:
            test = test & F.exists(children[child], _is_one_of(child, states))
        c = F.when(test, name) if c is None else c.when(test, name)
    return c


def _node(kind: str, ord_: Column, sub: Column, below: dict[str, Column] | None = None, **leaves: Column) -> Column:
    leaves = {k: v if k == "score" else _filled(v) for k, v in leaves.items()}
    null = F.lit(None)
    return F.struct(
        F.lit(kind).alias("child"),
        ord_.cast("int").alias("ord"),
        sub.cast("int").alias("sub_ord"),
        _state(kind, leaves, **(below or {})).alias("subtype"),
        *[leaves.get(k, null).cast("string").alias(k) for k in ("id", "name", "ror", "country_code", "type")],
        leaves.get("score", null).cast("double").alias("score"),
    )


def _arr(c: Column) -> Column:
    return F.coalesce(c, F.array())


def _bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, as the variable of a lambda."""
    return F.transform(F.array(c), use)[0]


def nodes(records: DataFrame) -> DataFrame:
    """One row per object of ``typed_records``: shared keys, state, typed fields.

    One generator over one array per record: no kind needs a second scan.
    """
    zero = F.lit(0)
    auth = _arr(F.col("w.authorships"))

    def of_author(a: Column, i: Column) -> Column:
        inst = F.transform(
            _arr(a["institutions"]),
            lambda x, j: _node(
                "institution", i, j, id=short_id(x["id"]), name=x["display_name"], ror=x["ror"],
                country_code=x["country_code"], type=x["type"],
            ),
        )

        def with_own(inst: Column) -> Column:
            own = _node("author", i, zero, {"institution": inst}, id=short_id(a["author"]["id"]), name=a["author"]["display_name"])
            raw = F.transform(_arr(a["raw_affiliation_strings"]), lambda x, j: _node("raw_affiliation", i, j, name=x))
            codes = F.array_sort(F.array_distinct(F.filter(_arr(a["countries"]), lambda x: x != "")))
            ctry = F.transform(codes, lambda x, j: _node("country", i, j, name=x))
            return F.concat(F.array(own), inst, raw, ctry)

        return _bound(inst, with_own)

    topic = F.col("w.primary_topic")
    names = F.array(topic["display_name"], *[topic[f]["display_name"] for f in ("subfield", "field", "domain")])
    words = F.flatten(
        F.transform(
            F.map_entries(F.col("w.abstract_inverted_index")),
            lambda e: F.transform(_arr(e["value"]), lambda p: _node("word", p, zero, name=e["key"])),
        )
    )
    parts = F.struct(
        F.flatten(F.transform(auth, of_author)).alias("authors"),
        F.transform(names, lambda x, i: _node("topic", i, zero, name=x)).alias("topics"),
        F.transform(_arr(F.col("w.keywords")), lambda x, i: _node("keyword", i, zero, name=x["display_name"], score=x["score"])).alias("keywords"),
        _arr(F.filter(words, lambda n: n["ord"].isNotNull())).alias("words"),
    )

    def with_record(p: Column) -> Column:
        below = {"author": p["authors"], "topic": p["topics"], "word": p["words"]}
        return F.concat(F.array(_node("record", zero, zero, below, id=F.col("w.id"))), p["authors"], p["topics"], p["keywords"], p["words"])

    return records.select("work_id", F.inline(_bound(parts, with_record)))


def route(node_rows: DataFrame) -> DataFrame:
    """The nodes, each written to the typed subtype table of its kind and state: a directory (child, subtype) in the shared folder."""
    return materialize(node_rows, "nodes", ["child", "subtype"])


def subtype_table(node_rows: DataFrame, kind: str, subtype: str | None = None) -> DataFrame:
    """The typed table of one kind, or of one subtype of it with the columns that it can have."""
    rows = node_rows.where(F.col("child") == kind)
    if subtype is None:
        return rows.select(*_KEYS, *TYPED[kind])
    lacks = LACKS.get((kind, subtype), ())
    return rows.where(F.col("subtype") == subtype).select(*_KEYS, *[c for c in TYPED[kind] if c not in lacks])


def child_items(routed: DataFrame) -> DataFrame:
    """(work_id, child, ord, sub_ord, item) of the objects that have an item, each read from the subtype tables that can hold one."""
    tables = [
        subtype_table(routed, kind, subtype).select("work_id", "child", "ord", "sub_ord", F.col(field).alias("item"))
        for kind, (field, subtypes) in ITEMS.items()
        for subtype in subtypes
    ]
    return reduce(DataFrame.unionAll, tables)


def work_rows(records: DataFrame) -> DataFrame:
    """The flat ``works`` table of the records."""
    w = F.col("w")
    cnp, topic, src = w["citation_normalized_percentile"], w["primary_topic"], w["primary_location"]["source"]
    return records.select(
        "work_id", w["doi"].alias("doi"), w["title"].alias("title"),
        abstract_text(w["abstract_inverted_index"]).alias("abstract"),
        w["publication_year"].alias("year"), w["publication_date"].alias("pub_date"), w["type"].alias("type"),
        w["language"].alias("language"), F.coalesce(w["cited_by_count"], F.lit(0)).cast("bigint").alias("cited_by_count"),
        w["fwci"].alias("fwci"), cnp["value"].alias("citation_percentile"),
        cnp["is_in_top_1_percent"].alias("top1pct"), cnp["is_in_top_10_percent"].alias("top10pct"),
        src["display_name"].alias("source_name"), src["type"].alias("source_type"),
        topic["display_name"].alias("topic"), topic["subfield"]["display_name"].alias("subfield"),
        topic["field"]["display_name"].alias("field"), topic["domain"]["display_name"].alias("domain"),
        F.coalesce(F.size(w["authorships"]), F.lit(0)).alias("n_authors"),
    )


def abstract_text(index: Column) -> Column:
    """The running text of an inverted index, ordered by (position, word).

    Null for a null or empty index; '' for an index that lists no position.
    """
    pairs = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e: F.transform(_arr(e["value"]), lambda p: F.struct(p.alias("p"), e["key"].alias("w"))),
        )
    )
    text = F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " ")
    return F.when(F.size(index) > 0, text)


def country_shares(records: DataFrame) -> DataFrame:
    """work_id, author_order, country_code, weight = 1 / authors / distinct countries of the author."""
    auth = _arr(F.col("w.authorships"))
    a = records.select("work_id", F.greatest(F.size(auth), F.lit(1)).alias("n"), F.posexplode(auth).alias("author_order", "a"))
    codes = F.array_sort(F.array_distinct(F.filter(_arr(F.col("a.countries")), lambda x: x.isNotNull())))
    c = a.select("work_id", "author_order", "n", codes.alias("codes"))
    return c.select(
        "work_id", "author_order", F.explode("codes").alias("country_code"),
        (F.lit(1.0) / F.col("n") / F.size("codes")).alias("weight"),
    )


def raw_affiliations(records: DataFrame) -> DataFrame:
    """work_id, author_order, raw_affiliation, n_resolved_institutions, resolved_institution_id (only when exactly one)."""
    a = records.select("work_id", F.posexplode(_arr(F.col("w.authorships"))).alias("author_order", "a"))
    inst = _arr(F.col("a.institutions"))
    return a.select(
        "work_id", "author_order", F.explode("a.raw_affiliation_strings").alias("raw_affiliation"),
        F.size(inst).alias("n_resolved_institutions"),
        F.when(F.size(inst) == 1, short_id(F.get(inst, F.lit(0))["id"])).alias("resolved_institution_id"),
    )


def found(raw: DataFrame) -> DataFrame:
    """Problem 1's result: every item of every counting record with its positions."""
    return child_items(route(nodes(typed_records(first_deliveries(raw)))))
