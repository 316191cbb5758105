"""Sinks read back, commit order, and streaming jobs over several batches."""

from __future__ import annotations

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from driftline.operators import netchange as N
from driftline.operators.compare import compare_captures
from driftline.operators.stats import capture_fingerprint
from driftline.session import build_session, discard, materialize, shared_folder
from driftline.sinks import store
from driftline.sources import captures as sources
from driftline.sources.trace import read_trace_events
from driftline.streaming import jobs
from test_capture_compare import capture, random_capture, record
from test_net_change import SCHEMA, TRUTH, log, lsn


def save(spark, records, path, header="h1", name="c1"):
    store.save_capture(records, path, header, name, "s1", "Baseline", F.to_timestamp(F.lit("2024-01-01")), ["t1"], ["t9"])


def test_capture_round_trip(spark, tmp_path):
    path = str(tmp_path)
    records = capture(spark, random_capture(5))
    save(spark, records, path)
    assert compare_captures(records, sources.read_store(spark, path, "c1"), ignore_lsn=False).count() == 0
    header = spark.read.parquet(f"{path}/headers").first()
    assert header.total_records == records.count() and header.status == "Completed" and header.tables_skipped == ["t9"]


def test_capture_without_header_is_invisible(spark, tmp_path):
    path = str(tmp_path)
    save(spark, capture(spark, {"t": [record(1)]}), path)
    capture(spark, {"t": [record(2)]}).select(
        F.lit("h2").alias("capture_header_id"), F.lit("c2").alias("capture_name"), "table_name", "ordinal", "pk", "fields",
    ).write.mode("append").partitionBy("capture_name", "table_name").parquet(f"{path}/records")
    assert sources.read_store(spark, path, "c2").count() == 0
    assert sources.read_store(spark, path, "c1").count() == 1


def test_profile_round_trip_keeps_kinds(spark, tmp_path):
    document = {"t": [record(1, a="q\"uo\\te\n", b=1.5, c=None, d={"x": [1]}, e=True, f="é")]}
    records = capture(spark, document)
    store.write_profile(records, str(tmp_path / "lines"))
    assert compare_captures(records, sources.read_profile_lines(spark, str(tmp_path / "lines"))).count() == 0
    (tmp_path / "p.json").write_text(json.dumps(document))
    assert compare_captures(records, sources.read_profile(spark, str(tmp_path / "p.json"))).count() == 0
    row = records.select(store.record_json(F.col("fields"))).first()[0]
    assert json.loads(row) == document["t"][0]


def test_fingerprint_ignores_order_and_sees_changes(spark, listed):
    a = capture(spark, {"t": [record(1, v=1), record(2, v=2)]})
    b = capture(spark, {"t": [record(2, v=2), record(1, v=1)]})
    c = capture(spark, {"t": [record(1, v=1), record(2, v=3)]})
    assert listed(capture_fingerprint(a)) == listed(capture_fingerprint(b)) != listed(capture_fingerprint(c))
    told = [listed(capture_fingerprint(capture(spark, {"t": [record(1, v=v)]}))) for v in (1, "1", None, "NULL")]
    assert all(x != y for k, x in enumerate(told) for y in told[:k])


def test_trace_store_reads_one_session(spark, tmp_path, listed):
    events = spark.range(100).select(F.col("id").alias("event_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("session_id"))
    store.append_trace_events(events, str(tmp_path))
    assert listed(read_trace_events(spark, str(tmp_path), "s3"), "event_id") == listed(events.filter("session_id = 's3'"), "event_id")


class FakeSession:
    """A session with given settings, master and application id."""

    def __init__(self, settings, master, app="app-1"):
        self.conf = settings
        self.sparkContext = SimpleNamespace(master=master, applicationId=app)


def test_shared_folder():
    assert shared_folder(FakeSession({"spark.checkpoint.dir": "hdfs:/shared"}, "yarn")) == "hdfs:/shared"
    with pytest.raises(ValueError):
        shared_folder(FakeSession({}, "yarn"))
    local = FakeSession({}, "local[2]")
    assert shared_folder(local) == shared_folder(local)


def test_materialize_writes_once(spark):
    assert materialize(spark.range(5), "x").count() == 5
    assert materialize(spark.range(0), "x").count() == 0


def test_stream_net_change_over_batches(spark, tmp_path, listed):
    """Changes arrive in several files, late ones last; the result is the batch fold."""
    source, out = tmp_path / "in", tmp_path / "out"
    late_first = sorted(TRUTH, key=lambda c: (c[1] == 1, c))
    schema = log(spark, TRUTH).schema
    for part in (late_first[:7], late_first[7:14], late_first[14:]):
        log(spark, part).coalesce(1).write.mode("append").parquet(str(source))
        stream = jobs.read_stream(spark, str(source), schema, max_files=1)
        jobs.stream_net_change(stream, ["id"], ["v"], str(out / "d"), str(out / "c")).awaitTermination()
    got = jobs.read_net_change(spark, str(out / "d"), ["id"], ["v"])
    expected = N.net_change(log(spark, TRUTH), ["id"])
    assert listed(N.net_flat(got, ["id"])) == listed(N.net_flat(expected, ["id"]))


def test_stream_ingest_drops_repeats_across_batches(spark, tmp_path, listed):
    source, out = tmp_path / "in", tmp_path / "out"
    events = spark.range(20).select(
        F.col("id").alias("event_id"), F.lit("s").alias("session_id"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("id")).alias("event_time"))
    for _ in range(2):
        events.write.mode("append").parquet(str(source))
        stream = jobs.read_stream(spark, str(source), events.schema, max_files=1)
        jobs.stream_trace_ingest(stream, str(out / "d"), str(out / "c")).awaitTermination()
    assert listed(spark.read.parquet(str(out / "d")), "event_id") == listed(events, "event_id")


def timed(spark, ids, hours):
    return spark.createDataFrame([(i,) for i in ids], "event_id long").select(
        "event_id", F.lit("s").alias("session_id"),
        F.timestamp_micros(F.lit(1704067200000000 + hours * 3_600_000_000) + F.col("event_id")).alias("event_time"))


def test_streams_lose_no_late_or_newest_event(spark, tmp_path, listed):
    """Ten events, then ten more with others four hours behind them and repeats of the first ten."""
    source, out = tmp_path / "in", tmp_path / "out"
    batches = [timed(spark, range(10), 30), timed(spark, range(10, 20), 26), timed(spark, range(10), 30),
               timed(spark, range(20, 23), 2), timed(spark, range(10, 23), 2)]
    for batch in batches[:3], batches[3:]:
        for part in batch:
            part.coalesce(1).write.mode("append").parquet(str(source))
        for job, name in ((jobs.stream_trace_ingest, "i"), (jobs.stream_event_counts, "n")):
            stream = jobs.read_stream(spark, str(source), batches[0].schema, max_files=1)
            job(stream, str(out / name), str(out / f"{name}-c")).awaitTermination()
    stored = spark.read.parquet(str(out / "i"))
    assert [r[0] for r in listed(stored, "event_id")] == sorted(range(23), key=lambda i: repr((i,)))
    expected = {("2024-01-02 00:00:00", 30), ("2024-01-01 00:00:00", 16)}
    assert {(str(r["window_start"]), r["events"]) for r in jobs.read_event_counts(spark, str(out / "n")).collect()} == expected


@pytest.mark.parametrize("text", ["", "MiXeD", '{"a": 1}', "A" * 10000, "naïve ☃"])
def test_digests(spark, text):
    import base64
    import hashlib

    from driftline.functions.keys import sha256_base64, sha256_hex
    row = spark.createDataFrame([(text,)], "t string").select(sha256_hex(F.col("t")), sha256_base64(F.col("t"))).first()
    digest = hashlib.sha256(text.encode()).digest()
    assert tuple(row) == (digest.hex(), base64.b64encode(digest).decode())


def test_session_settings(spark):
    assert build_session().conf.get("spark.sql.session.timeZone") == "UTC"
    assert SCHEMA and lsn(1) == b"\0" * 9 + b"\1"


def test_discard_deletes_written_tables_only(spark, tmp_path):
    kept, gone = (materialize(spark.range(10).repartition(3), label) for label in ("kept", "gone"))
    discard(gone)
    assert kept.count() == 10
    with pytest.raises(Exception, match="(?i)not.*exist"):
        gone.collect()
    spark.range(3).write.parquet(str(tmp_path / "own"))
    with pytest.raises(ValueError):
        discard(spark.read.parquet(str(tmp_path / "own")))
    assert spark.read.parquet(str(tmp_path / "own")).count() == 3


def test_compaction_keeps_net_changes_and_bounds_the_files(spark, tmp_path, listed):
    """Read after every batch and every compaction; the folders of two compactions at most are left."""
    source, out = tmp_path / "in", tmp_path / "out"
    late_first = sorted(TRUTH, key=lambda c: (c[1] == 1, c))
    schema, data = log(spark, TRUTH).schema, str(out / "d")
    for turn, end in enumerate((5, 10, 15, len(late_first))):
        log(spark, late_first[5 * turn:end]).coalesce(1).write.mode("append").parquet(str(source))
        stream = jobs.read_stream(spark, str(source), schema, max_files=1)
        jobs.stream_net_change(stream, ["id"], ["v"], data, str(out / "c")).awaitTermination()
        expected = listed(N.net_flat(N.net_change(log(spark, late_first[:end]), ["id"]), ["id"]))
        assert listed(N.net_flat(jobs.read_net_change(spark, data, ["id"], ["v"]), ["id"])) == expected
        if turn:
            assert jobs.compact_net_change(spark, data, ["id"]) == turn
            assert jobs.compact_net_change(spark, data, ["id"]) == turn
            assert listed(N.net_flat(jobs.read_net_change(spark, data, ["id"], ["v"]), ["id"])) == expected
    assert sorted(p.name for p in (out / "d-base").iterdir()) == ["upto=2", "upto=3"]
    assert sorted(p.name for p in (out / "d").iterdir() if p.name.startswith("batch")) == ["batch_id=3"]


def test_ingest_reads_the_stored_rows_of_its_buckets_and_ids(spark, tmp_path, listed):
    """Null ids, the same id in other sessions, and repeats in later batches."""
    source, out = tmp_path / "in", tmp_path / "out"
    batches = [[("a", 1), ("b", 1), (None, 1), ("a", None)], [("a", 1), ("a", None), (None, 1), ("c", 7)], [("c", None), ("b", 2)]]
    for rows in [*batches, batches[0], [(None, None)], [(None, None)]]:
        spark.createDataFrame(rows, "session_id string, event_id long").coalesce(1).write.mode("append").parquet(str(source))
        stream = jobs.read_stream(spark, str(source), "session_id string, event_id long", max_files=1)
        jobs.stream_trace_ingest(stream, str(out / "d"), str(out / "c"), buckets=4).awaitTermination()
    stored = spark.read.schema("session_id string, event_id long").parquet(str(out / "d")).select("session_id", "event_id")
    assert sorted(map(repr, map(tuple, stored.collect()))) == sorted(
        {repr(r) for rows in batches for r in rows} | {repr((None, None))})
    batch = spark.createDataFrame([("c", 7)], "session_id string, event_id long").withColumn(
        "session_bucket", store.session_bucket(F.col("session_id"), 4))
    plan = spark.read.schema("session_id string, event_id long, batch_id bigint, session_bucket int").parquet(
        str(out / "d")).where(jobs._stored_like(batch))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(session_bucket" in plan and "GreaterThanOrEqual(event_id,7)" in plan


def test_shuffle_files_go_with_the_write(spark):
    rows = spark.range(1000).repartition(3, "id")
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    written = materialize(rows, "freed", free_shuffle=True)
    assert written.count() == rows.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
