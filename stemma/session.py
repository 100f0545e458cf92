"""Session set-up and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use.

    On a cluster the caller's own session is used instead; no operator sets
    cluster-level configuration.
    """
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stemma")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without it; there a temporary folder is made and
    removed at exit.  On a cluster a missing setting is an error, as a
    machine-local folder would not be seen by the other executors.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="stemma-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return _OWN_DIR[0]


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet, in directories by ``partition_by`` if given, and read it back.

    Cuts the lineage; the result survives the loss of executors, which a
    ``localCheckpoint`` would not.  Used where one intermediate result feeds
    several consumers, so that it is computed once.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


_REUSED: dict[tuple, DataFrame] = {}


def source_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Bytes, files and time of change of each path: what a table derived from them depends on."""
    out = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size = fs.getContentSummary(path)
        out.append((p, size.getLength(), size.getFileCount(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def reused(spark: SparkSession, label: str, paths: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build`` gives, written once per application as long as the files at ``paths`` stay as they are."""
    key = (spark.sparkContext.applicationId, label, source_state(spark, paths))
    if key not in _REUSED:
        _REUSED[key] = materialize(build(), label)
    return _REUSED[key]
