"""Queries that run a streaming job over the supplied files to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.functions.values import micros
from driftline.plans import inputs as I
from driftline.plans.catalog import Catalog
from driftline.plans.changes import flat, net_sql
from driftline.session import shared_folder
from driftline.streaming import jobs

catalog = Catalog()


def _folder(spark, label):
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return jobs.read_stream(spark, sf, schema, f"{name}.parquet")


def _events(spark, sf):
    return _stream(spark, sf, "events").select(
        "event_id", F.concat(F.lit("s"), "user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("event_time"))


@catalog.add("stream_trace_ingest", "SELECT event_id, 's' || user_id AS session_id, epoch_us(ts) AS event_time FROM events")
def stream_trace_ingest(spark, sf):
    """Every event arrives three times and is stored once."""
    repeated = _events(spark, sf).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("_copy")
    out = _folder(spark, "stream-events")
    jobs.stream_trace_ingest(repeated, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.schema("event_id bigint, session_id string, event_time timestamp").parquet(f"{out}/data").drop("batch_id", "session_bucket")
    return rows.withColumn("event_time", micros(F.col("event_time")))


@catalog.add("stream_net_change", net_sql(I.change_log_sql()))
def stream_net_change(spark, sf):
    """The change log folded by a stream equals the batch fold."""
    changes = I.change_rows(_stream(spark, sf, "orders"))
    columns = ["o_custkey", "o_orderstatus", "o_totalprice"]
    out = _folder(spark, "stream-net")
    jobs.stream_net_change(changes, ["o_orderkey"], columns, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return flat(jobs.read_net_change(spark, f"{out}/data", ["o_orderkey"], columns))


@catalog.add("stream_net_change_compacted", net_sql(I.change_log_sql()))
def stream_net_change_compacted(spark, sf):
    """The same from a base that holds every batch."""
    changes = I.change_rows(_stream(spark, sf, "orders"))
    columns = ["o_custkey", "o_orderstatus", "o_totalprice"]
    out = _folder(spark, "stream-net")
    jobs.stream_net_change(changes, ["o_orderkey"], columns, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    jobs.compact_net_change(spark, f"{out}/data", ["o_orderkey"])
    return flat(jobs.read_net_change(spark, f"{out}/data", ["o_orderkey"], columns))


@catalog.add("stream_event_counts", """SELECT epoch_us(date_trunc('day', ts)) AS window_start, 's' || user_id AS session_id, count(*) AS events FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def stream_event_counts(spark, sf):
    """Daily counts per session of the days the watermark has passed."""
    out = _folder(spark, "stream-counts")
    jobs.stream_event_counts(_events(spark, sf), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    rows = jobs.read_event_counts(spark, f"{out}/data")
    # The job counts every window; this query's SQL asks for the days that ended an hour before the last event.
    passed = I.table(spark, sf, "events").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 1 HOUR")).alias("passed"))
    rows = rows.join(F.broadcast(passed), F.col("window_start") + F.expr("INTERVAL 1 DAY") <= F.col("passed")).drop("passed")
    return rows.withColumn("window_start", micros(F.col("window_start")))


@catalog.add("stream_event_counts_all", """SELECT epoch_us(date_trunc('day', ts)) AS window_start, 's' || user_id AS session_id,
  count(*) AS events FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def stream_event_counts_all(spark, sf):
    """Daily counts per session of every day, the newest too."""
    out = _folder(spark, "stream-counts")
    jobs.stream_event_counts(_events(spark, sf), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    rows = jobs.read_event_counts(spark, f"{out}/data")
    return rows.withColumn("window_start", micros(F.col("window_start")))
