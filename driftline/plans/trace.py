"""Queries over statement traces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.functions import statements as rules
from driftline.functions import text as X
from driftline.functions.values import micros
from driftline.operators import trace as T
from driftline.plans import inputs as I
from driftline.plans.catalog import Catalog
from driftline.session import shared_folder
from driftline.sinks import store
from driftline.sources import scripts
from driftline.sources import trace as sources

catalog = Catalog()

EVENTS = f"({I.TRACE_SQL}) e"
BLANKS = " ' ' || chr(9) || chr(10) || chr(13) "
UPPER = f"upper(trim(sql_text, {BLANKS}))"
SYSTEM = " OR ".join(f"contains(u, '{f}')" for f in rules.SYSTEM_FRAGMENTS)
MAINTENANCE = " OR ".join(f"contains(u, '{f}')" for f in rules.MAINTENANCE_FRAGMENTS)
STARTS = " OR ".join(f"starts_with(u, '{w}')" for w in rules.REPLAYABLE_STARTS)
REPLAYABLE = f"CASE WHEN u = '' OR starts_with(u, 'SELECT') OR {SYSTEM} OR {MAINTENANCE} THEN FALSE ELSE {STARTS} END"
CLASSIFIED = f"(SELECT *, {REPLAYABLE} AS is_replayable FROM (SELECT *, {UPPER} AS u FROM {EVENTS}) c) r"
NUMBERED = ("(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_time, event_id) AS execution_order "
            f"FROM {CLASSIFIED}) n")


def events(spark, sf):
    return I.trace_events(spark, sf)


def numbered(spark, sf):
    """Trace events with their stored execution order."""
    return I.stored(spark, sf, "numbered-events", lambda: T.execution_order(events(spark, sf)))


@catalog.add("execution_order", f"SELECT event_id, session_id, execution_order FROM {NUMBERED}")
def execution_order(spark, sf):
    return T.execution_order(events(spark, sf)).select("event_id", "session_id", "execution_order")


@catalog.add("is_replayable", f"SELECT event_id, is_replayable FROM {CLASSIFIED}")
def is_replayable(spark, sf):
    return events(spark, sf).select("event_id", rules.is_replayable(F.col("sql_text")).alias("is_replayable"))


SKIP_PATTERNS = ("%usp_x%", "drop table cargo", "create_able%")


@catalog.add("skip_statement", f"""
SELECT event_id, u = '' OR starts_with(u, 'SELECT') OR {SYSTEM} OR regexp_full_match(u, '.*USP_X.*') OR contains(u, 'DROP TABLE CARGO') AS skipped,
  u = '' OR {SYSTEM} AS skipped_system FROM {CLASSIFIED}""")
def skip_statement(spark, sf):
    sql = F.col("sql_text")
    return events(spark, sf).select(
        "event_id", rules.skip_statement(sql, exclude_patterns=SKIP_PATTERNS).alias("skipped"),
        rules.skip_statement(sql, skip_select=False).alias("skipped_system"))


CLEAN = f"""CASE WHEN trim(sql_text, {BLANKS}) = '' THEN '' ELSE
  c || CASE WHEN regexp_matches(c, '(?i)^(insert|update|delete|merge|create|alter|drop)') AND NOT ends_with(c, ';')
    AND NOT regexp_matches(c, '(?i)(^|[^0-9A-Za-z_])go$') THEN ';' ELSE '' END END"""
CLEANED = f"""(SELECT *, {CLEAN} AS clean FROM (SELECT *, regexp_replace(regexp_replace(trim(sql_text, {BLANKS}),
  '--\\s*exec sp_executesql[^\\n]*', '', 'gi'), '\\s+', ' ', 'g') AS c FROM {NUMBERED}) q) k"""


@catalog.add("clean_sql", f"SELECT event_id, clean AS cleaned FROM {CLEANED}")
def clean_sql(spark, sf):
    return events(spark, sf).select("event_id", X.clean_sql(F.col("sql_text")).alias("cleaned"))


@catalog.add("prepare_replay", f"""
SELECT session_id, event_id, clean AS sql_text, epoch_us(event_time) AS event_time, execution_order FROM {CLEANED}
WHERE is_replayable AND u <> '' AND NOT starts_with(u, 'SELECT') AND NOT ({SYSTEM})""")
def prepare_replay(spark, sf):
    statements = T.prepare_replay(numbered(spark, sf))
    return statements.select("session_id", "event_id", "sql_text",
                             micros(F.col("original_event_time")).alias("event_time"), "execution_order")


@catalog.add("events_by_type", f"SELECT event_id, duration FROM {EVENTS} WHERE event_name = 'sql_statement_completed'")
def events_by_type(spark, sf):
    return T.events_by_type(events(spark, sf), "sql_statement_completed").select("event_id", "duration")


@catalog.add("slow_events", f"SELECT event_id, statement, duration FROM {EVENTS} WHERE duration > 100")
def slow_events(spark, sf):
    return T.slow_events(events(spark, sf)).select("event_id", "statement", "duration")


@catalog.add("cpu_heavy", f"SELECT event_id, cpu_time FROM {EVENTS} WHERE cpu_time > 50")
def cpu_heavy(spark, sf):
    return T.cpu_heavy(events(spark, sf)).select("event_id", "cpu_time")


@catalog.add("io_heavy", f"SELECT event_id, reads FROM {EVENTS} WHERE reads > 0")
def io_heavy(spark, sf):
    return T.io_heavy(events(spark, sf)).select("event_id", "reads")


@catalog.add("trace_capture_filter", f"""SELECT event_id, event_name FROM {EVENTS}
WHERE event_name IN ('sql_batch_completed', 'rpc_completed') AND database_name = 'db2'""")
def trace_capture_filter(spark, sf):
    kept = T.trace_capture_filter(events(spark, sf), ["sql_batch_completed", "rpc_completed"], "db2")
    return kept.select("event_id", "event_name")


CRITERIA = {"DatabaseName": "db3", "ApplicationName": "click", "MinDuration": 200, "ExcludeSystemObjects": True,
            "ExcludeUsers": ["SA", "u1"]}


@catalog.add("criteria_filter", f"""SELECT event_id FROM {CLASSIFIED} WHERE database_name = 'db3' AND application_name = 'click'
AND duration >= 200 AND NOT ({SYSTEM}) AND NOT coalesce(lower(login_name) IN ('sa', 'u1'), FALSE)""")
def criteria_filter(spark, sf):
    return T.criteria_filter(events(spark, sf), CRITERIA).select("event_id")


@catalog.add("criteria_schemas", f"SELECT event_id FROM {CLASSIFIED} WHERE regexp_matches(sql_text, '(?i)\\b(sys|cdc)\\.')")
def criteria_schemas(spark, sf):
    return T.criteria_filter(events(spark, sf), {"IncludeSchemas": ["sys", "cdc"]}).select("event_id")


@catalog.add("trace_stats", f"""SELECT count(*) AS total_events, count(*) FILTER (is_replayable) AS replayable_events,
  epoch_us(max(event_time)) - epoch_us(min(event_time)) AS time_span_micros,
  count(DISTINCT nullif(database_name, '')) AS databases, count(DISTINCT nullif(application_name, '')) AS applications FROM {CLASSIFIED}""")
def trace_stats(spark, sf):
    return T.trace_stats(events(spark, sf))


@catalog.add("event_type_counts", f"SELECT event_name, count(*) AS events FROM {EVENTS} GROUP BY event_name")
def event_type_counts(spark, sf):
    return T.event_type_counts(events(spark, sf))


@catalog.add("names_involved", f"""SELECT 'database' AS kind, database_name AS name FROM {EVENTS} WHERE database_name <> ''
UNION SELECT 'application', application_name FROM {EVENTS} WHERE application_name <> ''""")
def names_involved(spark, sf):
    return T.names_involved(events(spark, sf))


@catalog.add("events_per_session", f"SELECT session_id, count(*) AS events FROM {EVENTS} GROUP BY session_id")
def events_per_session(spark, sf):
    return T.events_per_session(events(spark, sf))


@catalog.add("session_event_pair", f"""
WITH c AS (SELECT session_id, count(*) AS n FROM {EVENTS} GROUP BY session_id)
SELECT 'p' || c_custkey AS pair_id, coalesce(a.n, 0) AS baseline_events, coalesce(b.n, 0) AS optimized_events
FROM customer LEFT JOIN c a ON a.session_id = 's' || c_custkey LEFT JOIN c b ON b.session_id = 's' || (c_custkey + 1)""")
def session_event_pair(spark, sf):
    key = F.col("c_custkey")
    pair = I.table(spark, sf, "customer").select(
        F.concat(F.lit("p"), key).alias("pair_id"), F.concat(F.lit("s"), key).alias("baseline_session"),
        F.concat(F.lit("s"), key + 1).alias("optimized_session"))
    return T.session_event_pair(events(spark, sf), pair)


@catalog.add("frequent_statements", f"SELECT statement, count(*) AS executions FROM {EVENTS} GROUP BY statement ORDER BY executions DESC, statement LIMIT 10")
def frequent_statements(spark, sf):
    return T.frequent_statements(events(spark, sf))


@catalog.add("slowest_events", f"SELECT event_id, duration FROM {EVENTS} ORDER BY duration DESC, event_id LIMIT 10")
def slowest_events(spark, sf):
    return T.slowest_events(events(spark, sf)).select("event_id", "duration")


@catalog.add("newest_events", f"SELECT event_id, epoch_us(event_time) AS event_time FROM {EVENTS} ORDER BY event_time DESC, event_id DESC LIMIT 10")
def newest_events(spark, sf):
    return T.newest_events(events(spark, sf)).select("event_id", micros(F.col("event_time")).alias("event_time"))


@catalog.add("trace_event_count", f"SELECT count(*) AS events FROM {EVENTS}")
def trace_event_count(spark, sf):
    return T.trace_event_count(events(spark, sf))


@catalog.add("ordered_events", f"SELECT session_id, execution_order, event_id FROM {NUMBERED}")
def ordered_events(spark, sf):
    return T.ordered_events(numbered(spark, sf)).select("session_id", "execution_order", "event_id")


@catalog.add("page_events", f"""SELECT event_id, execution_order FROM {NUMBERED} WHERE session_id = 's8'
ORDER BY execution_order LIMIT 100 OFFSET 5""")
def page_events(spark, sf):
    return T.page_events(numbered(spark, sf), "s8", skip=5, take=100).select("event_id", "execution_order")


# Replay results derived from the numbered events: a statement fails by its event id.
RESULTS = f"(SELECT session_id, event_id, execution_order, event_id % 23 <> 0 AS success FROM {NUMBERED}) s"


def results(spark, sf):
    return numbered(spark, sf).select("session_id", "event_id", "execution_order",
                                      (F.col("event_id") % 23 != 0).alias("success"))


MARKED = f"""(SELECT s.*, CASE WHEN execution_order > f THEN 'skipped' WHEN success THEN 'success' ELSE 'failed' END AS outcome
FROM {RESULTS} LEFT JOIN (SELECT session_id, min(execution_order) AS f FROM {RESULTS} WHERE NOT success GROUP BY session_id) USING (session_id)) m"""


@catalog.add("mark_skipped", f"SELECT event_id, outcome FROM {MARKED}")
def mark_skipped(spark, sf):
    return T.mark_skipped(results(spark, sf)).select("event_id", "outcome")


@catalog.add("replay_rollup", f"""SELECT session_id, count(*) AS total_statements, count(*) FILTER (outcome = 'success') AS successful_statements,
  count(*) FILTER (outcome = 'failed') AS failed_statements, count(*) FILTER (outcome = 'skipped') AS skipped_statements
FROM {MARKED} GROUP BY session_id""")
def replay_rollup(spark, sf):
    return T.replay_rollup(results(spark, sf))


@catalog.add("replay_rollup_continue", f"""SELECT session_id, count(*) AS total_statements, count(*) FILTER (success) AS successful_statements,
  count(*) FILTER (NOT success) AS failed_statements, CAST(0 AS BIGINT) AS skipped_statements FROM {RESULTS} GROUP BY session_id""")
def replay_rollup_continue(spark, sf):
    return T.replay_rollup(results(spark, sf), continue_on_error=True)


@catalog.add("first_errors", f"""SELECT event_id, execution_order, greatest((SELECT count(*) FROM {RESULTS} WHERE NOT success) - 5, 0) AS more_errors
FROM {RESULTS} WHERE NOT success ORDER BY execution_order, event_id LIMIT 5""")
def first_errors(spark, sf):
    return T.first_errors(results(spark, sf)).select("event_id", "execution_order", "more_errors")


# --- documents ----------------------------------------------------------------------------

def _xml_items(element: str, values: dict[str, str]):
    """XML items of one event; an absent value has no item."""
    items = []
    for name, column in values.items():
        text = F.col(column).cast("string")
        for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(raw), F.lit(escaped))
        items.append(F.when(text.isNotNull(), F.concat(
            F.lit(f'<{element} name="{name}"><value>'), text, F.lit(f"</value></{element}>"))))
    return F.concat_ws("", *items)


DATA = {"database_name": "database_name", "duration": "duration", "cpu_time": "cpu_time", "logical_reads": "reads",
        "writes": "writes", "statement": "statement"}
ACTIONS = {"username": "login_name", "client_app_name": "application_name", "client_hostname": "host_name",
           "session_id": "spid", "transaction_id": "transaction_id"}


def ring_buffers(spark, sf):
    """One ring-buffer document per hundred events."""
    stamp = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    event = F.concat(F.lit('<event name="'), F.col("event_name"), F.lit('" timestamp="'), stamp, F.lit('">'),
                     _xml_items("data", DATA), _xml_items("action", ACTIONS), F.lit("</event>"))
    rows = events(spark, sf).select(F.floor(F.col("event_id") / 100).alias("buffer_id"), event.alias("x"))
    return rows.groupBy("buffer_id").agg(F.concat(
        F.lit("<RingBufferTarget>"), F.array_join(F.collect_list("x"), ""), F.lit("</RingBufferTarget>")).alias("target_data"))


@catalog.add("shred_trace_xml", f"""SELECT epoch_us(event_time) AS event_time, event_name, nullif(database_name, '') AS database_name, login_name,
  application_name, host_name, spid, duration, cpu_time, reads, writes, nullif(statement, '') AS statement, transaction_id FROM
  (SELECT *, replace(statement, '  ', ' ') AS _ FROM {EVENTS}) z""")
def shred_trace_xml(spark, sf):
    """Ring buffers built from the events, shredded back to typed columns."""
    rows = sources.shred_trace_xml(ring_buffers(spark, sf))
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return rows.select(
        micros(F.col("event_time")).alias("event_time"), "event_name", blank("database_name"), "login_name",
        "application_name", "host_name", "spid", "duration", "cpu_time", "reads", "writes",
        blank("statement"), "transaction_id")


@catalog.add("read_trace_defaults", f"""SELECT event_id, epoch_us(CASE WHEN event_id % 10 = 0 THEN TIMESTAMP '2024-06-01' ELSE event_time END) AS event_time,
  CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE event_name END AS event_name, database_name, is_replayable FROM {CLASSIFIED}""")
def read_trace_defaults(spark, sf):
    """Some times and names blanked, then defaulted."""
    holes = events(spark, sf).withColumns({
        "event_time": F.when(F.col("event_id") % 10 != 0, F.col("event_time")),
        "event_name": F.when(F.col("event_id") % 9 != 0, F.col("event_name"))})
    rows = sources.with_trace_defaults(holes, F.to_timestamp(F.lit("2024-06-01 00:00:00")))
    return rows.select("event_id", micros(F.col("event_time")).alias("event_time"), "event_name", "database_name",
                       "is_replayable")


PIECES = """SELECT doc_id, generate_subscripts(p, 1) AS execution_order, unnest(p) AS piece FROM (
  SELECT doc_id, string_split_regex(t, '(?im)^[ \\t]*go[ \\t]*\\r?$|;') AS p FROM (
    SELECT doc_id, replace(text, '. ', chr(10) || 'Go ' || chr(10)) AS t FROM documents))"""


@catalog.add("split_workload", f"""SELECT doc_id, execution_order, execution_order AS event_id,
  regexp_replace(piece, '^[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+|[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+$', '', 'g') AS sql_text FROM ({PIECES}) q
WHERE NOT regexp_full_match(piece, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]*')""")
def split_workload(spark, sf):
    """Whole document texts as workload files; every sentence end becomes a separator line."""
    files = I.table(spark, sf, "documents").select(
        "doc_id", F.replace("text", F.lit(". "), F.lit("\nGo \n")).alias("value"))
    return sources.split_workload(files)


@catalog.add("split_workload_parity", """SELECT doc_id, CAST(execution_order AS BIGINT) AS execution_order, trim(piece, ' ' || chr(10)) AS sql_text FROM (
  SELECT doc_id, generate_subscripts(p, 1) AS execution_order, unnest(p) AS piece FROM (
    SELECT doc_id, list_filter(string_split_regex(replace(text, 'en', 'GO'), 'GO|;'), lambda x: x <> '') AS p FROM documents)) q
WHERE trim(piece, ' ' || chr(10)) <> ''""")
def split_workload_parity(spark, sf):
    """The letters GO split anywhere; here over texts with many of them."""
    files = I.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("en"), F.lit("GO")).alias("value"))
    return sources.split_workload(files, parity=True).select("doc_id", "execution_order", "sql_text")


@catalog.add("read_statements", r"""
SELECT execution_order, execution_order AS event_id,
  regexp_replace('SELECT ''' || replace(text, '''', '''''') || ''' AS [a;b], "x;y" /* ; */ -- ;' || chr(10) || 'FROM t' || doc_id,
    '^[\s\x{0B}\x{85}\p{Z}]+|[\s\x{0B}\x{85}\p{Z}]+$', '', 'g') AS sql_text
FROM (SELECT doc_id, coalesce(text, '') AS text, 2 * row_number() OVER (ORDER BY doc_id) - 1 AS execution_order FROM documents)""")
def read_statements(spark, sf):
    """One script of a statement per document, its text in quotes over many lines; between them ``;`` and ``GO``.

    Many tasks write its parts, each the documents between two ids."""
    path = f"{shared_folder(spark).rstrip('/')}/script-{uuid.uuid4().hex}"
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("'"), F.lit("''"))
    order = ["doc_id", F.xxhash64("text")]
    I.table(spark, sf, "documents").repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat(
        F.lit("SELECT '"), text, F.lit("' AS [a;b], \"x;y\" /* ; */ -- ;\nFROM t"), F.col("doc_id").cast("string"),
        F.lit(";\n go\t")).alias("value")).write.text(path)
    return scripts.read_statements(spark, path, parts=True).select("event_id", "execution_order", "sql_text")


# --- sinks --------------------------------------------------------------------------------

@catalog.add("append_trace_events", f"SELECT event_id, session_id, duration FROM {EVENTS}")
def append_trace_events(spark, sf):
    """Events appended to the trace store and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    store.append_trace_events(events(spark, sf), path)
    return sources.read_trace_events(spark, path).select("event_id", "session_id", "duration")


@catalog.add("export_trace", f"""SELECT event_id, epoch_us(event_time) AS event_time, event_name, database_name, login_name, application_name, host_name,
  sql_text, execution_order FROM {NUMBERED}""")
def export_trace(spark, sf):
    """Nine columns exported as JSON lines and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    store.export_trace(numbered(spark, sf), path)
    rows = spark.read.schema(
        "event_id bigint, event_time timestamp, event_name string, database_name string, login_name string, "
        "application_name string, host_name string, sql_text string, execution_order bigint").json(path, timestampFormat=store.TIMESTAMP_FORMAT)
    return rows.withColumn("event_time", micros(F.col("event_time")))
