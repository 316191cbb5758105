"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "driftline", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the library is tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own: on a cluster a
    machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has separate workers
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="driftline-")
    return _LOCAL_FOLDERS[app]


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else unmarked.

    Counts at most one row more than the bound, so a large table is not read through.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, free_shuffle: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a plan reads the same non-deterministic partitioning twice; the written
    table survives lost executors. With ``free_shuffle`` the shuffle files of the write go
    when it ends, not when the driver's garbage collector finds them unused.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true" if free_shuffle else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``.

    Only for tables whose last reader has been run and written or collected: a plan that still
    reads the table, or would have to be run again from it, fails afterwards.
    """
    spark = df.sparkSession
    root = shared_folder(spark).rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = hadoop.Path(spark._jvm.java.net.URI(folder))
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if path.getParent().toUri().getPath() != hadoop.Path(root).toUri().getPath():
            raise ValueError(f"{folder} isn't a table that materialize wrote")
        fs.delete(path, True)
