"""File sources and sinks; every reader has an explicit schema."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma import schemas


def read_work_lines(spark: SparkSession, glob: str) -> DataFrame:
    """(file_name, line_no, record) of JSON-lines files, gzipped or not; line numbers from 1.

    A gzipped file is one task, so deliveries should be many files of moderate
    size.  Numbering needs no shuffle: a file that is not cut has its lines in order.
    """
    lines = spark.read.option("wholetext", False).text(glob, lineSep="\n").select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("record")
    )
    w = Window.partitionBy("file_name").orderBy("_i")
    return lines.withColumn("line_no", F.row_number().over(w)).select("file_name", "line_no", "record").where("length(trim(record)) > 0")


def read_records(spark: SparkSession, glob: str) -> DataFrame:
    """Work records of JSON-lines files as typed columns."""
    return spark.read.schema(schemas.WORK_RECORD).json(glob)


def read_json_document(spark: SparkSession, path: str, schema) -> DataFrame:
    """One JSON document as one row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def yearly_counts(doc: DataFrame) -> DataFrame:
    """(year, ai_bio, bio_baseline) of a document of two maps; years of either, 0 where one lacks them."""
    a = doc.select(F.explode("ai_bio").alias("y", "ai_bio"))
    b = doc.select(F.explode("bio_baseline").alias("y", "bio_baseline"))
    j = a.join(b, "y", "full").select(F.col("y").cast("int").alias("year"), "ai_bio", "bio_baseline")
    return j.na.fill(0, ["ai_bio", "bio_baseline"])


def read_country_regions(spark: SparkSession, path: str) -> DataFrame:
    """The country table; the code NA is a country, an empty eu27 stays ''."""
    df = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").schema(schemas.COUNTRY_REGIONS).csv(path)
    return df.na.fill("", ["eu27"])


def read_labelled_csv(spark: SparkSession, path: str, schema=schemas.GOLD_CSV) -> DataFrame:
    """CSV of texts: quoted fields may hold line ends and doubled quotes; nothing but an empty cell is null."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


#: What ``append_cache`` adds to a record: the number of its append, and its place in it.
CACHE_ORDER = T.StructType([T.StructField("appended", T.LongType()), T.StructField("place", T.LongType())])


def read_label_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each work_id of a JSON-lines cache that is only appended to.

    What came last is told by the number of the append and the place in it, which ``append_cache``
    writes; files and their reading order say nothing.  Lines without them (of another writer) are
    older than any with them, and by their order in their own file among themselves.
    """
    schema = T.StructType([*schemas.LABEL_RECORD.fields, *CACHE_ORDER.fields])
    lines = spark.read.text(path).select(F.from_json("value", schema).alias("r"), F.monotonically_increasing_id().alias("_i")).where("r.work_id is not null")
    order = F.struct(F.coalesce("r.appended", F.lit(0)).alias("a"), F.coalesce("r.place", "_i").alias("p"))
    last = lines.groupBy("r.work_id").agg(F.max_by("r", order).alias("r"))
    return last.select(*[F.col("r")[f.name].alias(f.name) for f in schemas.LABEL_RECORD.fields])


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Gzipped JSON lines; the commit protocol makes the files appear only when whole."""
    df.write.mode(mode).option("compression", "gzip").json(path)


def append_cache(df: DataFrame, path: str) -> None:
    """Appends records, numbered so that the last of a key is known whatever order files are read in.

    One writer at a time, as with any cache that is read, filled and appended to.
    """
    spark, at = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    last = 0
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        last = spark.read.schema(CACHE_ORDER).json(path).agg(F.max("appended")).first()[0] or 0
    df.withColumns({"appended": F.lit(last + 1).cast("bigint"), "place": F.monotonically_increasing_id()}).write.mode("append").json(path)


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Create-or-replace of a Parquet table; gives the table back."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


# Parts of a script within which neither ';' nor ':name' means anything: comments, and quoted strings and names.
_OPAQUE = r"--[^\n]*|/\*(?s:.*?)\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`"
_PIECE = re.compile(rf"(?P<opaque>{_OPAQUE})|(?P<end>;)|(?<![:\w]):(?P<name>[A-Za-z_]\w*)")


def statements(script: str) -> list[tuple[str, set[str]]]:
    """The statements of a script, each with the names of its parameters (:name)."""
    out: list[tuple[str, set[str]]] = []
    start, names, bare = 0, set(), ""  # bare: the statement without what is opaque and commented
    last = 0
    for m in [*_PIECE.finditer(script), None]:
        bare += script[last : m.start() if m else len(script)]
        last = m.end() if m else len(script)
        if m and m["opaque"]:
            bare += "" if m[0].startswith(("--", "/*")) else "x"
        elif m and m["name"]:
            names.add(m["name"])
            bare += "x"
        else:  # the end of a statement
            if bare.strip():
                out.append((script[start : m.start() if m else len(script)].strip(), names))
            start, names, bare = last, set(), ""
    return out


def run_script(spark: SparkSession, script: str, **args: object) -> DataFrame | None:
    """Runs the statements of a script in turn with bound parameters (:name); gives the last result."""
    out = None
    for body, names in statements(script):
        if missing := names - set(args):
            raise ValueError(f"no value for the parameters {sorted(missing)}")
        out = spark.sql(body, args={n: args[n] for n in names}) if names else spark.sql(body)
    return out


def write_human_csv(df: DataFrame, path: str) -> None:
    """CSV for people to fill in; never overwrites what they may have filled in."""
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # texts are kept as they are
    df.write.mode("errorifexists").options(header=True, escape='"', **blanks).csv(path)


def write_manifest(path: str | Path, **values: object) -> None:
    """A small JSON document, written beside and moved into place."""
    p = Path(path)
    tmp = p.with_suffix(p.suffix + ".part")
    tmp.write_text(json.dumps(values, indent=1, sort_keys=True))
    tmp.replace(p)


def read_manifest(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def cached(df: DataFrame, root: str, name: str, key_cols: list[str]) -> DataFrame:
    """A Parquet cache that is valid for exactly these rows: its key is a hash over all key values, not their number."""
    h = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*key_cols)), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64(*key_cols).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    path = f"{root}/{name}-{h.n}-{h.x & 0xFFFFFFFFFFFFFFFF:016x}-{int(h.s) & 0xFFFFFFFFFFFFFFFF:016x}"
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
