"""Queries over captures: comparison, totals, fingerprints, the stored form."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import keys
from driftline.functions.keys import lsn_base64, lsn_hex
from driftline.functions.values import json_equal, variant_value
from driftline.operators import compare as C
from driftline.operators import stats
from driftline.operators.normalized import is_excluded
from driftline.plans import inputs as I
from driftline.plans.catalog import Catalog
from driftline.session import shared_folder
from driftline.sinks import store
from driftline.sources import captures as sources

catalog = Catalog()


def both(spark, sf):
    return I.capture(spark, sf, "baseline"), I.capture(spark, sf, "test")


def failures_cte(ignore: tuple[str, ...] = ()) -> str:
    """All failures as CTE ``failures``, from field rows joined field by field."""
    kept = ""
    if ignore:
        names = ", ".join(f"'{i.lower()}'" for i in ignore)
        kept = (f"WHERE lower(field) NOT IN ({names}) "
                f"AND regexp_replace(lower(field), '^(old|new)_', '') NOT IN ({names})")
    return f"""{I.captures_cte()},
counts AS (SELECT table_name, CAST(sum(b) AS BIGINT) AS b, CAST(sum(t) AS BIGINT) AS t FROM (
  SELECT table_name, 1 AS b, 0 AS t FROM br UNION ALL SELECT table_name, 0, 1 FROM tr) GROUP BY table_name),
common AS (SELECT table_name FROM counts WHERE b > 0 AND t > 0),
matched AS (SELECT br.table_name, br.pk, br.op AS b_op, tr.op AS t_op FROM br JOIN tr USING (table_name, pk)),
field_pairs AS (
  SELECT coalesce(x.table_name, y.table_name) AS table_name, coalesce(x.pk, y.pk) AS pk,
         coalesce(x.field, y.field) AS field, x.val AS b_val, y.val AS t_val
  FROM (SELECT * FROM bf {kept}) x FULL OUTER JOIN (SELECT * FROM tf {kept}) y
    ON x.table_name = y.table_name AND x.pk = y.pk AND x.field = y.field),
failures AS (
  SELECT table_name, 'MissingTable' AS failure_type, NULL AS primary_key, NULL AS field_name, NULL AS baseline_value,
         NULL AS test_value, 'Table ''' || table_name || ''' exists in baseline but not in test capture' AS description
  FROM counts WHERE t = 0
  UNION ALL SELECT table_name, 'ExtraTable', NULL, NULL, NULL, NULL,
         'Table ''' || table_name || ''' exists in test capture but not in baseline' FROM counts WHERE b = 0
  UNION ALL SELECT table_name, 'RecordCountMismatch', NULL, NULL, CAST(b AS VARCHAR), CAST(t AS VARCHAR),
         'Record count mismatch in table ''' || table_name || ''': baseline has ' || b || ', test has ' || t
  FROM counts WHERE b > 0 AND t > 0 AND b <> t
  UNION ALL SELECT table_name, 'MissingRecord', pk, NULL, NULL, NULL,
         'Record with primary key ''' || pk || ''' exists in baseline but not in test capture for table ''' || table_name || ''''
  FROM br ANTI JOIN tr USING (table_name, pk) WHERE table_name IN (FROM common)
  UNION ALL SELECT table_name, 'ExtraRecord', pk, NULL, NULL, NULL,
         'Record with primary key ''' || pk || ''' exists in test capture but not in baseline for table ''' || table_name || ''''
  FROM tr ANTI JOIN br USING (table_name, pk) WHERE table_name IN (FROM common)
  UNION ALL SELECT table_name, 'OperationMismatch', pk, '__$operation', CAST(b_op AS VARCHAR), CAST(t_op AS VARCHAR),
         'Operation type mismatch for record ''' || pk || ''' in table ''' || table_name || ''''
  FROM matched WHERE b_op <> t_op
  UNION ALL SELECT table_name, 'FieldMismatch', pk, field, b_val, t_val,
         'Field ''' || field || ''' mismatch for record ''' || pk || ''' in table ''' || table_name || ''''
  FROM field_pairs SEMI JOIN matched USING (table_name, pk) WHERE b_val IS DISTINCT FROM t_val)"""


@catalog.add("compare_captures", f"WITH {failures_cte()} SELECT * FROM failures")
def compare_captures(spark, sf):
    return C.compare_captures(*both(spark, sf))


@catalog.add("compare_captures_digest_first", f"WITH {failures_cte()} SELECT * EXCLUDE (description) FROM failures")
def compare_captures_digest_first(spark, sf):
    """The same failures, moving full records only where digests differ."""
    return C.compare_captures(*both(spark, sf), digest_first=True).drop("description")


IGNORED = ("o_totalprice", "OLD_c_acctbal", "new_c_acctbal")


@catalog.add("ignore_fields", f"WITH {failures_cte(IGNORED)} SELECT * EXCLUDE (description) FROM failures")
def ignore_fields(spark, sf):
    return C.compare_captures(*both(spark, sf), ignore_fields=IGNORED).drop("description")


@catalog.add("compare_with_lsn", f"""WITH {failures_cte()}
SELECT table_name, failure_type, count(*) AS failures FROM (
  SELECT table_name, failure_type FROM failures
  UNION ALL SELECT table_name, 'FieldMismatch' FROM matched) GROUP BY ALL""")
def compare_with_lsn(spark, sf):
    """LSN differences counted too: every matched record then differs in its LSN."""
    failures = C.compare_captures(*both(spark, sf), ignore_lsn=False)
    return failures.groupBy("table_name", "failure_type").agg(F.count(F.lit(1)).alias("failures"))


SUMMARY_SQL = """SELECT
  (SELECT count(*) FROM common) AS tables_compared,
  (SELECT CAST(sum(greatest(b, t)) AS BIGINT) FROM counts WHERE b > 0 AND t > 0) AS records_compared,
  (SELECT CAST(sum(b * f) AS BIGINT) FROM counts JOIN (
     SELECT table_name, arg_min(n_fields, ordinal) + 4 AS f FROM br GROUP BY table_name) USING (table_name)
   WHERE b > 0 AND t > 0) AS fields_compared,
  (SELECT count(*) FROM failures) AS total_failures,
  (SELECT count(DISTINCT table_name) FROM failures) AS tables_with_failures,
  NOT EXISTS (FROM failures) AS is_match"""


@catalog.add("comparison_summary", f"WITH {failures_cte()} {SUMMARY_SQL}")
def comparison_summary(spark, sf):
    baseline, test = both(spark, sf)
    return C.comparison_summary(baseline, test, C.compare_captures(baseline, test))


@catalog.add("compare_many", f"""WITH {failures_cte()}
SELECT 'baseline-test' AS pair_id, * EXCLUDE (description) FROM failures""")
def compare_many(spark, sf):
    """Two pairs in one plan; a capture against itself has no failures."""
    baseline, test = both(spark, sf)
    pairs = [("baseline-test", baseline, test), ("test-test", test, test)]
    return C.compare_many(pairs).drop("description")


@catalog.add("missing_tables", f"WITH {I.captures_cte()} SELECT DISTINCT table_name FROM br WHERE table_name NOT IN (SELECT table_name FROM tr)")
def missing_tables(spark, sf):
    return C.missing_tables(*both(spark, sf))


@catalog.add("extra_tables", f"WITH {I.captures_cte()} SELECT DISTINCT table_name FROM tr WHERE table_name NOT IN (SELECT table_name FROM br)")
def extra_tables(spark, sf):
    return C.extra_tables(*both(spark, sf))


@catalog.add("common_tables", f"WITH {I.captures_cte()} SELECT table_name FROM br INTERSECT SELECT table_name FROM tr")
def common_tables(spark, sf):
    return C.common_tables(*both(spark, sf))


@catalog.add("except_tables", f"WITH {I.captures_cte()} SELECT table_name FROM br EXCEPT SELECT table_name FROM tr")
def except_tables(spark, sf):
    return stats.except_tables(*both(spark, sf))


@catalog.add("intersect_tables", f"WITH {I.captures_cte()} SELECT table_name FROM br INTERSECT SELECT table_name FROM tr")
def intersect_tables(spark, sf):
    return stats.intersect_tables(*both(spark, sf))


@catalog.add("union_keys", f"WITH {I.captures_cte()} SELECT table_name, pk FROM br UNION SELECT table_name, pk FROM tr")
def union_keys(spark, sf):
    return stats.union_keys(*both(spark, sf), ["table_name", "pk"])


@catalog.add("capture_totals", f"WITH {I.captures_cte()} SELECT count(DISTINCT table_name) AS tables_with_changes, count(*) AS total_records FROM br")
def capture_totals(spark, sf):
    return stats.capture_totals(I.capture(spark, sf, "baseline"))


@catalog.add("profile_stats", f"WITH {I.captures_cte()} SELECT table_name, CAST(op AS VARCHAR) AS operation, count(*) AS records FROM br GROUP BY ALL")
def profile_stats(spark, sf):
    return stats.profile_stats(I.capture(spark, sf, "baseline"))


@catalog.add("capture_fingerprint", f"""WITH {I.captures_cte()},
digests AS (SELECT table_name, sha256(length(pk) || ':' || pk || string_agg(length(field) || ':' || field
    || CASE WHEN val IS NULL THEN '~' ELSE length(kind) || ':' || kind || length(val) || ':' || val END, '' ORDER BY field)) AS h
  FROM bf GROUP BY table_name, pk),
parts AS (SELECT table_name, {", ".join(f"CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT) AS d{k}" for k in range(4))} FROM digests)
SELECT table_name, count(*) AS row_count, concat_ws(':', {", ".join(f"CAST(sum(CAST(d{k} AS HUGEINT)) AS VARCHAR)" for k in range(4))}) AS digest_sum,
  bit_xor(d0) AS digest_xor
FROM parts GROUP BY table_name""")
def capture_fingerprint(spark, sf):
    """Fingerprint of the data fields; record metadata is left out."""
    metadata = ("__$operation", "__$start_lsn", "__$table", "__$primary_key")
    return stats.capture_fingerprint(I.capture(spark, sf, "baseline"), metadata)


@catalog.add("tables_with_failures", f"""WITH {failures_cte()}
SELECT table_name, count(DISTINCT primary_key) AS differences FROM failures WHERE primary_key IS NOT NULL GROUP BY table_name""")
def tables_with_failures(spark, sf):
    failures = C.compare_captures(*both(spark, sf)).filter("primary_key IS NOT NULL")
    return stats.tables_with_diffs(failures, "primary_key")


# --- the stored form ----------------------------------------------------------------------

def documents(spark, sf):
    """JSON detail documents, one per table and thousand keys, with headers per capture."""
    union = None
    for side in ("baseline", "test"):
        records = I.capture(spark, sf, side).withColumn("part", F.floor(F.col("ordinal") / 1000))
        docs = records.groupBy("table_name", "part").agg(
            F.count(F.lit(1)).alias("record_count"),
            F.array_sort(F.collect_list(F.struct("ordinal", store.record_json(F.col("fields")).alias("json")))).alias("r"))
        docs = docs.select(
            F.lit(f"h-{side}").alias("capture_header_id"), "table_name", "part", "record_count",
            F.concat(F.lit("["), F.array_join(F.col("r")["json"], ","), F.lit("]")).alias("capture_data"))
        union = docs if union is None else union.unionByName(docs)
    headers = spark.range(0, 2, 1, 1).select(
        F.when(F.col("id") == 0, "h-baseline").otherwise("h-test").alias("capture_header_id"),
        F.when(F.col("id") == 0, "baseline").otherwise("test").alias("capture_name"))
    return headers, union


RECORD_ROWS = """SELECT table_name, pk, field, kind, val FROM {rows}
UNION ALL SELECT table_name, pk, '__$operation', 'bigint', CAST(op AS VARCHAR) FROM {records}"""


def field_rows(records):
    """Capture records in long form; an absent value has no kind."""
    rows = records.select("table_name", "pk", F.explode("fields").alias("field", "v"))
    return rows.select("table_name", "pk", "field", F.col("v.kind").alias("kind"), F.col("v.val").alias("val"))


# JSON has no timestamps or nulls with a type, and reads a whole decimal as an integer.
JSON_KINDS = """SELECT table_name, pk, field, CASE WHEN val IS NULL THEN NULL WHEN kind IN ('bigint', 'decimal') THEN 'number'
 ELSE 'string' END AS kind, CASE WHEN kind = 'decimal' THEN CAST(CAST(val AS DECIMAL(18,2)) AS VARCHAR) ELSE val END AS val
FROM ({rows}) x"""


def json_rows(records):
    rows = field_rows(records).filter("field NOT IN ('__$start_lsn', '__$table', '__$primary_key')")
    money = F.col("field").rlike("(price|bal)$")
    return rows.select(
        "table_name", "pk", "field",
        F.when(F.col("kind").isin("bigint", "decimal", "double"), "number").otherwise(F.col("kind")).alias("kind"),
        F.when(money, F.col("val").try_cast("decimal(18,2)").cast("string")).otherwise(F.col("val")).alias("val"))


@catalog.add("load_capture", f"WITH {I.captures_cte()} " + JSON_KINDS.format(rows=RECORD_ROWS.format(rows="bf", records="br")))
def load_capture(spark, sf):
    """Headers joined with documents by capture name, every record parsed back."""
    headers, details = documents(spark, sf)
    records, _ = sources.load_capture(headers, details, "baseline", part="part")
    return json_rows(records)


@catalog.add("parse_capture_json", f"WITH {I.captures_cte()} " + JSON_KINDS.format(rows=RECORD_ROWS.format(rows="tf", records="tr")))
def parse_capture_json(spark, sf):
    """Documents ``{table: [records]}`` parsed to records."""
    _, details = documents(spark, sf)
    whole = details.filter("capture_header_id = 'h-test'").select(F.concat(
        F.lit('{"'), "table_name", F.lit('":'), "capture_data", F.lit("}")).alias("doc"))
    return json_rows(sources.parse_capture_json(whole, "doc"))


@catalog.add("capture_details", f"""WITH {I.captures_cte()}
SELECT c.n AS capture_name, table_name, CAST(floor(ordinal / 1000) AS BIGINT) AS part, count(*) AS record_count
FROM (SELECT 'baseline' AS n, table_name, ordinal FROM br UNION ALL SELECT 'test', table_name, ordinal FROM tr) c GROUP BY ALL""")
def capture_details(spark, sf):
    headers, details = documents(spark, sf)
    return sources.capture_details(headers, details).select("capture_name", "table_name", "part", "record_count")


@catalog.add("save_capture", f"WITH {I.captures_cte()} " + RECORD_ROWS.format(rows="bf", records="br"))
def save_capture(spark, sf):
    """A capture written to the store and read back through its header."""
    path = f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    store.save_capture(I.capture(spark, sf, "baseline"), path, "h1", "baseline", "s1", "Baseline",
                       F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    rows = field_rows(sources.read_store(spark, path, "baseline"))
    return rows.filter("field NOT IN ('__$start_lsn', '__$table', '__$primary_key')")


@catalog.add("write_profile", f"WITH {I.captures_cte()} " + JSON_KINDS.format(rows=RECORD_ROWS.format(rows="bf", records="br")))
def write_profile(spark, sf):
    """A profile written as JSON lines and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/profile-{uuid.uuid4().hex}"
    store.write_profile(I.capture(spark, sf, "baseline"), path)
    return json_rows(sources.read_profile_lines(spark, path))


@catalog.add("exclude_stored_fields", f"WITH {I.captures_cte()}, shown AS (" + RECORD_ROWS.format(rows="bf", records="br") + """)
SELECT table_name, field, count(*) AS records, lower(field) IN ('new_o_custkey', '__$operation') OR lower(field) LIKE '%price%'
  OR lower(field) SIMILAR TO 'old_.*name' AS excluded FROM shown GROUP BY table_name, field""")
def exclude_stored_fields(spark, sf):
    """Field names of the stored records by list, substring and wildcard; each name is tested once."""
    rows = field_rows(I.capture(spark, sf, "baseline")).filter("field NOT IN ('__$start_lsn', '__$table', '__$primary_key')")
    names = rows.groupBy("table_name", "field").agg(F.count(F.lit(1)).alias("records"))
    hit = is_excluded(F.col("field"), ("NEW_O_CUSTKEY", "__$operation"), ("PRICE", "old_*name"))
    return names.withColumn("excluded", hit)


def _document(spark, sf):
    """The baseline capture as one document in one file: a line per record, behind the name of a table or a comma."""
    path = f"{shared_folder(spark).rstrip('/')}/document-{uuid.uuid4().hex}"
    records = I.capture(spark, sf, "baseline").select("table_name", "ordinal", "pk", store.record_json(F.col("fields")).alias("record"))
    last = records.agg(F.max("table_name")).first()[0]
    tables = Window.orderBy("table_name")
    heads = records.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).select("table_name", F.concat(
        F.when(F.row_number().over(tables) == 1, "{").otherwise("],"), F.to_json(F.array("table_name"))).alias("head"))
    heads = heads.withColumn("head", F.regexp_replace("head", r'\["(.*)"\]', '"$1": ['))
    first = F.row_number().over(Window.partitionBy("table_name").orderBy("ordinal", "pk")) == 1
    lines = records.withColumn("first", first).join(heads, "table_name").select(
        "table_name", "ordinal", "pk", F.concat(F.when(F.col("first"), F.col("head")).otherwise(","), "record").alias("value"))
    if last is not None:
        lines = lines.unionByName(spark.createDataFrame([(last, 2**62, "", "]}")], "table_name string, ordinal bigint, pk string, value string"))
    lines.coalesce(1).sortWithinPartitions("table_name", "ordinal", "pk").select("value").write.text(path)
    return path


@catalog.add("read_profile", f"WITH {I.captures_cte()} " + JSON_KINDS.format(rows=RECORD_ROWS.format(rows="bf", records="br")))
def read_profile(spark, sf):
    """One document in one file, read back in ranges."""
    return json_rows(sources.read_profile(spark, _document(spark, sf)))


@catalog.add("pk_value", f"WITH {I.captures_cte()} SELECT table_name, pk, count(*) AS records FROM br GROUP BY ALL")
def pk_value(spark, sf):
    """Key text read from the record's key field."""
    records = I.capture(spark, sf, "baseline")
    return records.select("table_name", keys.pk_value(F.col("fields")).alias("pk")).groupBy("table_name", "pk").agg(
        F.count(F.lit(1)).alias("records"))


@catalog.add("lsn_text", f"SELECT lsn AS lsn_hex, to_base64(unhex(lsn)) AS lsn_base64, count(*) AS n FROM ({I.change_log_sql()}) GROUP BY lsn")
def lsn_text(spark, sf):
    return I.change_log(spark, sf).groupBy("start_lsn").agg(F.count(F.lit(1)).alias("n")).select(
        lsn_hex(F.col("start_lsn")).alias("lsn_hex"), lsn_base64(F.col("start_lsn")).alias("lsn_base64"), "n")


@catalog.add("json_equal", """
SELECT event_id, k % 3 = 0 OR k % 3 = 1 AS number_forms, FALSE AS text_number, k % 2 = 0 AS text_forms, TRUE AS both_null
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def json_equal_query(spark, sf):
    """JSON equality over values built from the event properties."""
    k = F.get_json_object("props", "$.k")
    number = k.cast("bigint")
    value = lambda text: variant_value(F.try_parse_json(text))
    shown = F.when(number % 3 == 0, F.concat(k, F.lit(".0"))).when(
        number % 3 == 1, F.concat(k, F.lit(".00"))).otherwise(F.concat(k, F.lit(".5")))
    text = F.concat(F.lit('{"v":"'), k, F.lit('"}'))
    other = F.when(number % 2 == 0, text).otherwise(F.concat(F.lit('{"v":'), k, F.lit("}")))
    values = I.table(spark, sf, "events").select(
        "event_id", value(k).alias("number"), value(shown).alias("shown"),
        value(F.concat(F.lit('"'), k, F.lit('"'))).alias("quoted"), value(text).alias("text"),
        value(other).alias("other"), value(F.lit("null")).alias("nothing"))
    return values.select(
        "event_id", json_equal("number", "shown").alias("number_forms"), json_equal("number", "quoted").alias("text_number"),
        json_equal("text", "other").alias("text_forms"), json_equal("nothing", "nothing").alias("both_null"))
