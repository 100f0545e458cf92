"""Incremental ingest: new delivery files are read once, records dedup within the run of the stream.

An extension beside the batch pipeline: the checkpoint keeps which files were
read, as skipping files that are already there does in the batch form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RAW = "file_name string, line_no int, delivered_at timestamp_ntz, record string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def new_lines(spark: SparkSession, folder: str, schema: str = RAW) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def deduplicated(lines: DataFrame, delay: str = "30 days") -> DataFrame:
    """Records with an id, each id once within the watermark's delay; state is dropped behind it."""
    rid = F.expr("try_variant_get(try_parse_json(record), '$.id', 'string')")
    rows = lines.withColumn("at", F.col("delivered_at").cast("timestamp")).withColumn("id", rid).where("id is not null")
    return rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def run_available(df: DataFrame, out: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Reads what is there, appends the result as Parquet, and stops; a later call reads only what is new."""
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.partitionBy(*partition_by) if partition_by else w).start()
    q.awaitTermination()
    return q


def windowed_counts(events: DataFrame, length: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) per window of event time, emitted once the watermark has passed it."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    w = rows.groupBy(F.window("at", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def fetch_missing(spark: SparkSession, root: str, years: tuple[int, int], **options: object) -> list[int]:
    """Fetches the years that ``root`` lacks from the paged source, one folder of JSON lines each; gives those fetched.

    A folder counts as there once its commit marker is, so a fetch that was broken off is done again.
    """
    done = []
    for year in range(years[0], years[1] + 1):
        folder = f"{root}/works_{year}"
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            rows = spark.read.format("paged_search").options(**options, years=f"{year}-{year}").load()
            rows.select("record").write.mode("overwrite").option("compression", "gzip").text(folder)
            done.append(year)
    return done
