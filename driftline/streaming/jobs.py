"""Streaming jobs: deduplicated trace ingestion, running net changes, event counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.operators.netchange import fold_images, last_by_key, net_from_images
from driftline.sinks.store import session_bucket


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
                max_files: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def _stored_like(batch: DataFrame) -> Column:
    """Where the stored rows that can repeat a row of ``batch`` are: its buckets and its range of event ids.

    The buckets prune folders. Files are sorted by session and event, so the range skips those of other events.
    """
    seen = batch.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"),
                     F.collect_set("session_bucket").alias("buckets"), F.count_if(F.col("event_id").isNull()).alias("nulls")).first()
    within = F.lit(False) if seen["low"] is None else F.col("event_id").between(F.lit(seen["low"]), F.lit(seen["high"]))
    if seen["nulls"]:
        within = within | F.col("event_id").isNull()
    return F.col("session_bucket").isin(seen["buckets"]) & within


def stream_trace_ingest(events: DataFrame, out: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Store each event once, however often and however late an export brings it.

    A batch writes what is not stored yet under its batch id and the hash bucket of the session; a
    repeated batch overwrites itself. Of the stored keys it reads those in its own buckets and its own
    range of event ids. A session with many events is spread over files by event.
    """
    keys = ["session_id", "event_id"]
    schema = (f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in events.schema if f.name in keys)}, "
              "batch_id bigint, session_bucket int")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("session_bucket", session_bucket(F.col("session_id"), buckets))
        fresh = batch.dropDuplicates(keys)
        try:
            stored = batch.sparkSession.read.schema(schema).parquet(out)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            stored = stored.where(F.col("batch_id") != batch_id).where(_stored_like(batch)).alias("stored")
            same = [F.col(f"fresh.{k}").eqNullSafe(F.col(f"stored.{k}")) for k in keys]
            fresh = fresh.alias("fresh").join(stored, same, "left_anti")
        fresh.repartitionByRange("session_bucket", *keys).sortWithinPartitions("session_bucket", *keys).write.mode(
            "overwrite").partitionBy("session_bucket").parquet(f"{out}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_net_change(changes: DataFrame, keys: list[str], columns: list[str], out: str,
                      checkpoint: str) -> StreamingQuery:
    """Keep the net change of every key up to date.

    The state store holds the first and last image per key, so a batch touches only its
    own keys and late rows take their place by LSN. Each batch writes the keys it changed
    under its batch id; a repeated batch overwrites itself.
    """
    folded = fold_images(changes, keys, columns)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return folded.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """The whole folders ``name=number`` of ``path`` by number."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in fs.listStatus(root) if fs.exists(root) else ():
        kind, _, number = status.getPath().getName().partition("=")
        if kind == name and fs.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
            found[int(number)] = status.getPath().toString()
    return found


def _newest_images(spark: SparkSession, out: str, keys: list[str]) -> tuple[DataFrame, int]:
    """The newest images of each key, and the last batch they hold."""
    bases, batches = _written(spark, f"{out}-base", "upto"), _written(spark, out, "batch_id")
    base = max(bases, default=-1)
    later = {number: folder for number, folder in batches.items() if number > base}
    parts = [spark.read.parquet(bases[base]).withColumn("batch_id", F.lit(base).cast("long"))] if bases else []
    if later or not parts:
        folders = later.values() or [out]  # no batch at all: the reader's own error
        rows = spark.read.option("basePath", out).parquet(*folders)
        parts.append(rows.withColumn("batch_id", F.col("batch_id").cast("long")))
    images = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    images = images.select("table_name", *keys, "_first", "_last", "batch_id")
    return last_by_key(images, ["table_name", *keys], F.col("batch_id")), max([base, *later])


def read_net_change(spark: SparkSession, out: str, keys: list[str], columns: list[str]) -> DataFrame:
    """The current net changes: the newest images of each key, folded, from the last base and the batches after it."""
    return net_from_images(_newest_images(spark, out, keys)[0], keys, columns)


def compact_net_change(spark: SparkSession, out: str, keys: list[str]) -> int:
    """Fold the batches written so far into a base beside them; returns the last batch it holds.

    Readers use a base only when it is whole, so a compaction that fails changes nothing and may be
    repeated. What the base before this one covers is deleted now, not what this one covers: a reader
    that started before finds its files until the next compaction. So the files grow with the keys and
    the batches of two compactions, not with the history. One compaction runs at a time.
    """
    before = max(_written(spark, f"{out}-base", "upto"), default=-1)
    images, last = _newest_images(spark, out, keys)
    if last == before:
        return last
    images.drop("batch_id").write.mode("overwrite").parquet(f"{out}-base/upto={last}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    old = [folder for path, name, end in ((f"{out}-base", "upto", before), (out, "batch_id", before + 1))
           for number, folder in _written(spark, path, name).items() if number < end]
    for folder in old:
        path = hadoop.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return last


def stream_event_counts(events: DataFrame, out: str, checkpoint: str, window: str = "1 day") -> StreamingQuery:
    """Events per session and time window, of every window and however late an event comes.

    Each batch writes its own counts under its batch id, and ``read_event_counts`` adds them
    up; a repeated batch overwrites itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.where("event_time IS NOT NULL").groupBy(F.window("event_time", window), "session_id").agg(
            F.count(F.lit(1)).alias("events"))
        counts.select(F.col("window.start").alias("window_start"), "session_id", "events").write.mode(
            "overwrite").parquet(f"{out}/batch_id={batch_id}")

    return events.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_event_counts(spark: SparkSession, out: str) -> DataFrame:
    """The current counts of all windows, the newest too."""
    rows = spark.read.schema("window_start timestamp, session_id string, events bigint, batch_id bigint").parquet(out)
    return rows.groupBy("window_start", "session_id").agg(F.sum("events").alias("events"))
