"""Queries over table profiles: profile differences and normalized comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftline.functions import values as V
from driftline.functions.keys import row_key
from driftline.operators import normalized as M
from driftline.operators import profile_diff as P
from driftline.operators import stats
from driftline.operators.netchange import capture_records
from driftline.plans import inputs as I
from driftline.plans.catalog import Catalog
from driftline.session import shared_folder
from driftline.sinks import store

catalog = Catalog()

KEYED_TABLES = ("orders", "customer", "part", "supplier", "nation")


def manifest(spark, sf):
    """Descriptors of the compared tables, one row per table that has rows."""
    union = None
    for name in KEYED_TABLES:
        row = I.table(spark, sf, name).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
            F.lit("dbo").alias("schema"), F.lit(name).alias("name"), F.array(F.lit(I.KEYED[name].key)).alias("pk_columns"))
        union = row if union is None else union.union(row)
    return union


def profiles(spark, sf):
    stored = lambda side: I.stored(spark, sf, f"profile-{side}", lambda: I.profile(spark, sf, side))
    return stored("baseline"), stored("test")


def profile_cte() -> str:
    return f"""lf AS ({I.profile_fields_sql('baseline')}), rf AS ({I.profile_fields_sql('test')}),
lr AS (SELECT DISTINCT table_name, pk FROM lf), rr AS (SELECT DISTINCT table_name, pk FROM rf),
fields AS (
  SELECT lf.table_name, lf.pk, lf.field, lf.kind, lf.val AS l, rf.val AS r
  FROM lf JOIN rf ON lf.table_name = rf.table_name AND lf.pk = rf.pk AND lf.field = rf.field
  WHERE lf.val IS DISTINCT FROM rf.val),
diffs AS (
  SELECT table_name, pk AS key, 'Changed' AS action, field AS field_name, 'Changed' AS field_action, l AS left_value, r AS right_value FROM fields
  UNION ALL SELECT table_name, pk, 'Deleted', NULL, NULL, NULL, NULL FROM lr ANTI JOIN rr USING (table_name, pk)
  UNION ALL SELECT table_name, pk, 'New', NULL, NULL, NULL, NULL FROM rr ANTI JOIN lr USING (table_name, pk))"""


def _diffs(spark, sf):
    return P.diff_profiles(manifest(spark, sf), *profiles(spark, sf))


@catalog.add("diff_profiles", f"WITH {profile_cte()} SELECT * FROM diffs")
def diff_profiles(spark, sf):
    return _diffs(spark, sf)


@catalog.add("diff_profiles_parity", f"""WITH {profile_cte()}
SELECT * FROM diffs WHERE action = 'Changed'
  OR table_name NOT IN (SELECT table_name FROM lr INTERSECT SELECT table_name FROM rr)""")
def diff_profiles_parity(spark, sf):
    """Whole-table rule: rows missing inside a shared table are not reported."""
    return P.diff_profiles(manifest(spark, sf), *profiles(spark, sf), parity=True)


NOW = "1998-08-02 12:00:00"


@catalog.add("changed_unless_recent", f"""
SELECT o_orderkey, b.d IS DISTINCT FROM a.o_orderdate AND NOT (b.d BETWEEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND TIMESTAMP '{NOW}' + INTERVAL 1 DAY) AS changed,
  b.d IS DISTINCT FROM a.o_orderdate AS changed_plain
FROM orders a JOIN (SELECT o_orderkey, o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) AS d FROM orders) b USING (o_orderkey)""")
def changed_unless_recent(spark, sf):
    """Order dates moved by up to four days; dates near ``now`` do not count as changed."""
    orders = I.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.expr(
        "timestamp_micros(unix_micros(o_orderdate) + (o_orderkey % 5) * 86400000000)").alias("moved"))
    dtype = orders.schema["o_orderdate"].dataType
    values = orders.select("o_orderkey", V.typed_value("o_orderdate", dtype).alias("l"), V.typed_value("moved", dtype).alias("r"))
    return values.select(
        "o_orderkey", V.changed_unless_recent("l", "r", f"TIMESTAMP '{NOW}'").alias("changed"),
        V.changed_unless_recent("l", "r").alias("changed_plain"))


@catalog.add("write_diff", f"WITH {profile_cte()} SELECT * FROM diffs")
def write_diff(spark, sf):
    """Differences written as JSON lines and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/diff-{uuid.uuid4().hex}"
    diffs = _diffs(spark, sf)
    store.write_diff(diffs, path)
    return spark.read.schema(diffs.schema).json(path)


@catalog.add("diff_stats", f"""WITH {profile_cte()}
SELECT table_name, count(DISTINCT (key, action)) AS total_differences, count(DISTINCT key) FILTER (action = 'New') AS new_records,
  count(DISTINCT key) FILTER (action = 'Changed') AS changed_records, count(DISTINCT key) FILTER (action = 'Deleted') AS deleted_records,
  count(field_name) AS field_changes FROM diffs GROUP BY table_name""")
def diff_stats(spark, sf):
    return P.diff_stats(_diffs(spark, sf))


@catalog.add("field_change_counts", f"""WITH {profile_cte()}
SELECT table_name, field_name, count(*) AS changes FROM diffs WHERE field_name IS NOT NULL GROUP BY ALL""")
def field_change_counts(spark, sf):
    return P.field_change_counts(_diffs(spark, sf))


@catalog.add("diff_totals", f"""WITH {profile_cte()}, r AS (SELECT DISTINCT table_name, key, action FROM diffs)
SELECT count(DISTINCT table_name) AS tables_with_differences, count(*) AS total_differences,
  count(*) FILTER (action = 'New') AS new_records, count(*) FILTER (action = 'Changed') AS changed_records,
  count(*) FILTER (action = 'Deleted') AS deleted_records, count(*) = 0 AS is_identical FROM r""")
def diff_totals(spark, sf):
    return P.diff_totals(_diffs(spark, sf))


@catalog.add("tables_with_diffs", f"""WITH {profile_cte()}
SELECT table_name, count(DISTINCT key) AS differences FROM diffs GROUP BY table_name""")
def tables_with_diffs(spark, sf):
    return stats.tables_with_diffs(_diffs(spark, sf))


# --- normalized comparison ----------------------------------------------------------------

EXCLUDED = (*V.DEFAULT_EXCLUDED_COLUMNS, "o_orderpriority", "p_brand")
PATTERNS = ("*nation*", "mktseg")
MICRO = 1e-7


def _normal_state(spark, sf, name, side):
    """One table's after state as it is compared: key renamed ``id``, doubles for money.

    The test side shifts dates by hours and money by less than the tolerance, which the
    normalization must absorb.
    """
    t = I.KEYED[name]
    state = I.after_state(spark, sf, name, side)
    shift = 1 if side == "test" else 0
    if name == "orders":
        state = state.withColumn("o_orderdate", F.timestamp_micros(
            F.unix_micros("o_orderdate") + shift * (F.col("o_orderkey") % 7 + 1) * 3_600_000_000))
    if t.money:
        state = state.withColumn(t.money, F.col(t.money).cast("double") + F.lit(shift * MICRO))
    return state.withColumnRenamed(t.key, "id") if name != "part" else state.drop(t.key).distinct()


def _normal_capture(spark, sf, side):
    union = None
    for name in I.CAPTURED[side]:
        state = V.normalize_columns(_normal_state(spark, sf, name, side), excluded=EXCLUDED, patterns=PATTERNS)
        key = "id" if "id" in state.columns else state.columns[0]
        records = capture_records(state, f"dbo_{name}", [key], F.lit(0))
        union = records if union is None else union.unionByName(records)
    return union


def _normal_pair(spark, sf):
    stored = lambda side: I.stored(spark, sf, f"normal-{side}", lambda: _normal_capture(spark, sf, side))
    return stored("baseline"), stored("test")


def _normal_rows_sql(name: str, side: str) -> str:
    """Long form of one normalized table: ``table_name, row_key, field, val``."""
    t = I.KEYED[name]
    shift = 1 if side == "test" else 0
    exprs = {}
    for c in t.columns:
        if c == t.key:
            if name != "part":
                exprs["id"] = f"CAST({c} AS VARCHAR)"
        elif c in EXCLUDED or "nation" in c or "mktseg" in c:
            continue
        elif c == t.money:
            exprs[c] = f"CAST(round_even(CAST({c} AS DOUBLE) + {shift} * 1e-7, 6) AS VARCHAR)"
        elif c == "o_orderdate":
            moved = f"({c} + to_hours(CAST({shift} * (o_orderkey % 7 + 1) AS INTEGER)))"
            exprs[c] = f"strftime(date_trunc('day', {moved}), '%Y-%m-%d %H:%M:%S')"
        else:
            exprs[c] = f"CAST({c} AS VARCHAR)"
    columns = ", ".join(f"{e} AS {c}" for c, e in exprs.items())
    if "id" in exprs:
        key = "'id:' || id"
    else:
        text = " || ".join(f"'{c}:' || coalesce({c}, 'NULL') || ';'" for c in sorted(exprs))
        key = f"upper(substr(sha256({text}), 1, 16))"
    base = f"SELECT DISTINCT {columns} FROM ({I.after_sql(name, side)}) s"
    return " UNION ALL ".join(
        f"SELECT 'dbo_{name}' AS table_name, {key} AS row_key, '{c}' AS field, '{'n' if c == t.money else 's'}' AS kind, {c} AS val FROM ({base}) x"
        for c in exprs)


def normal_cte() -> str:
    left = " UNION ALL ".join(_normal_rows_sql(n, "baseline") for n in I.CAPTURED["baseline"])
    right = " UNION ALL ".join(_normal_rows_sql(n, "test") for n in I.CAPTURED["test"])
    return f"""lf AS ({left}), rf AS ({right}),
lr AS (SELECT DISTINCT table_name, row_key FROM lf), rr AS (SELECT DISTINCT table_name, row_key FROM rf),
diffs AS (
  SELECT lf.table_name, lf.row_key, 'Changed' AS action, lf.field AS field_name, lf.val AS left_value, rf.val AS right_value,
    CASE WHEN lf.val IS NULL THEN 'Added' WHEN rf.val IS NULL THEN 'Removed' ELSE 'ValueChanged' END AS difference_type
  FROM lf JOIN rf ON lf.table_name = rf.table_name AND lf.row_key = rf.row_key AND lf.field = rf.field
  WHERE lf.val IS DISTINCT FROM rf.val
    AND NOT coalesce(lf.kind = 'n' AND abs(TRY_CAST(lf.val AS DOUBLE) - TRY_CAST(rf.val AS DOUBLE)) < 1e-6, FALSE)
  UNION ALL SELECT table_name, row_key, 'Deleted', NULL, NULL, NULL, NULL FROM lr ANTI JOIN rr USING (table_name, row_key)
  UNION ALL SELECT table_name, row_key, 'Added', NULL, NULL, NULL, NULL FROM rr ANTI JOIN lr USING (table_name, row_key))"""


def _normal_diffs(spark, sf):
    return M.compare_normalized(*_normal_pair(spark, sf))


@catalog.add("compare_normalized", f"""WITH {normal_cte()} SELECT table_name, row_key, action, field_name, difference_type FROM diffs""")
def compare_normalized(spark, sf):
    return _normal_diffs(spark, sf).select("table_name", "row_key", "action", "field_name", "difference_type")


@catalog.add("row_field_diff", f"""WITH {normal_cte()}
SELECT table_name, row_key, field_name, left_value, right_value, difference_type FROM diffs WHERE action = 'Changed'""")
def row_field_diff(spark, sf):
    """The changed fields of matched rows, both values shown."""
    return _normal_diffs(spark, sf).filter("action = 'Changed'").select(
        "table_name", "row_key", "field_name", "left_value", "right_value", "difference_type")


@catalog.add("restrict_comparison", f"""WITH {normal_cte()}
SELECT table_name, count(DISTINCT row_key) AS differences FROM diffs WHERE table_name = 'dbo_orders' GROUP BY table_name""")
def restrict_comparison(spark, sf):
    """One table compared alone; the filter precedes the join."""
    diffs = M.compare_normalized(*_normal_pair(spark, sf), table="dbo_orders")
    return stats.tables_with_diffs(diffs, "row_key")


def _line_capture(spark, sf, side):
    """Lines of orders under the natural key of their order, so that a key has several rows, and parts without a key,
    many of them alike. The test side lists each order's lines backwards, raises the quantity of some, leaves out a line
    and holds some parts twice."""
    lines = I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"),
        F.expr("(l_linenumber * 10000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT)").alias("place"), "l_linenumber")
    parts = I.table(spark, sf, "part").select("p_partkey", F.col("p_size"), F.substring("p_brand", 1, 7).alias("p_brand"))
    if side == "test":
        lines = lines.where("NOT (id % 11 = 3 AND l_linenumber = 2)").withColumn("place", -F.col("place")).withColumn(
            "l_quantity", F.expr("IF(id % 5 = 0 AND l_linenumber <= 2, l_quantity + 1, l_quantity)"))
        parts = parts.unionByName(parts.where("p_partkey % 7 = 0"))
    line_records = capture_records(lines.drop("l_linenumber"), "dbo_lines", ["place"], F.col("place"), ["id", "l_partkey", "l_quantity"])
    part_records = capture_records(parts, "dbo_parts", ["p_partkey"], F.col("p_partkey"), ["p_size", "p_brand"])
    return line_records.unionByName(part_records)


@catalog.add("compare_normalized_repeats", """
WITH l AS (SELECT l_orderkey AS id, l_partkey, CAST(l_quantity AS DOUBLE) AS l_quantity, (l_linenumber * 10000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS place FROM lineitem),
r AS (SELECT l_orderkey AS id, l_partkey, CAST(l_quantity AS DOUBLE) + CASE WHEN l_orderkey % 5 = 0 AND l_linenumber <= 2 THEN 1 ELSE 0 END AS l_quantity,
        -((l_linenumber * 10000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT)) AS place
      FROM lineitem WHERE NOT (l_orderkey % 11 = 3 AND l_linenumber = 2)),
u AS (SELECT id, l_partkey, l_quantity, sum(one) AS more, max(place) FILTER (one = 1) AS lp, max(place) FILTER (one = -1) AS rp
      FROM (SELECT *, 1 AS one FROM l UNION ALL SELECT *, -1 FROM r) GROUP BY ALL HAVING sum(one) <> 0),
k AS (SELECT *, more > 0 AS left_side, row_number() OVER (PARTITION BY id, more > 0 ORDER BY CASE WHEN more > 0 THEN lp ELSE rp END DESC) AS occurrence FROM u),
p AS (SELECT id, occurrence, a.l_partkey AS lk, b.l_partkey AS rk, a.l_quantity AS lq, b.l_quantity AS rq, a.more AS l_n, -b.more AS r_n
      FROM (SELECT * FROM k WHERE left_side) a FULL JOIN (SELECT * FROM k WHERE NOT left_side) b USING (id, occurrence)),
lines AS (
  SELECT id, 'Changed' AS action, 'l_partkey' AS field_name, least(l_n, r_n) AS row_count, occurrence FROM p WHERE lk <> rk
  UNION ALL SELECT id, 'Changed', 'l_quantity', least(l_n, r_n), occurrence FROM p WHERE lq <> rq
  UNION ALL SELECT id, 'Deleted', NULL, l_n - coalesce(r_n, 0), occurrence FROM p WHERE l_n > coalesce(r_n, 0)
  UNION ALL SELECT id, 'Added', NULL, r_n - coalesce(l_n, 0), occurrence FROM p WHERE r_n > coalesce(l_n, 0)),
s AS (SELECT p_size, substr(p_brand, 1, 7) AS p_brand, count(*) AS row_count FROM part WHERE p_partkey % 7 = 0 GROUP BY ALL)
SELECT 'dbo_lines' AS table_name, 'id:' || id AS row_key, action, field_name, CAST(occurrence AS INTEGER) AS occurrence, CAST(row_count AS BIGINT) AS row_count FROM lines
UNION ALL SELECT 'dbo_parts', upper(substr(sha256('p_brand:' || coalesce(p_brand, 'NULL') || ';p_size:' || coalesce(CAST(p_size AS VARCHAR), 'NULL') || ';'), 1, 16)),
  'Added', NULL, 1, row_count FROM s""")
def compare_normalized_repeats(spark, sf):
    """Several rows under a natural key, listed in another order, and repeated rows without a key."""
    sides = [I.stored(spark, sf, f"repeats-{side}", lambda side=side: _line_capture(spark, sf, side)) for side in ("baseline", "test")]
    return M.compare_normalized(*sides).select("table_name", "row_key", "action", "field_name", "occurrence", "row_count")


REPORT_SQL = """report AS (SELECT t.table_name, count(DISTINCT row_key) AS total_rows,
  count(DISTINCT row_key) FILTER (action = 'Changed') AS changed_rows, count(DISTINCT row_key) FILTER (action = 'Added') AS new_rows,
  count(DISTINCT row_key) FILTER (action = 'Deleted') AS deleted_rows,
  coalesce(string_agg(DISTINCT field_name, ',' ORDER BY field_name), '') AS affected_columns
FROM (SELECT table_name FROM lr UNION SELECT table_name FROM rr) t LEFT JOIN diffs USING (table_name) GROUP BY t.table_name)"""


def _report(spark, sf):
    left, right = _normal_pair(spark, sf)
    tables = stats.union_keys(left, right, ["table_name"])
    return M.difference_report(M.compare_normalized(left, right), tables)


@catalog.add("difference_report", f"WITH {normal_cte()}, {REPORT_SQL} SELECT * FROM report")
def difference_report(spark, sf):
    return _report(spark, sf).withColumn("affected_columns", F.array_join("affected_columns", ","))


@catalog.add("report_text", f"""WITH {normal_cte()}, {REPORT_SQL}
SELECT table_name, 'Table: ' || table_name || chr(10) || '  Match: ' || CASE WHEN total_rows = 0 THEN 'True' ELSE 'False' END || chr(10)
  || '  Differences: ' || total_rows || chr(10) || '  Changed: ' || changed_rows || ', New: ' || new_rows || ', Deleted: ' || deleted_rows AS summary
FROM report""")
def report_text(spark, sf):
    return M.report_text(_report(spark, sf))


@catalog.add("comparison_totals", f"""WITH {normal_cte()}
SELECT (SELECT count(*) FROM (SELECT table_name FROM lr UNION SELECT table_name FROM rr)) AS tables_compared,
  count(*) = 0 AS overall_match, count(*) AS total_differences FROM (SELECT DISTINCT table_name, row_key FROM diffs)""")
def comparison_totals(spark, sf):
    left, right = _normal_pair(spark, sf)
    return M.comparison_totals(left, right, M.compare_normalized(left, right))


# --- normalization functions --------------------------------------------------------------

FIVE_MINUTES = 5 * 60 * 1_000_000


@catalog.add("normalize", """
SELECT event_id, epoch_us(ts) AS raw, epoch_us(time_bucket(INTERVAL 5 MINUTES, ts, TIMESTAMP '0001-01-01')) AS created_time,
  round_even(CAST(value AS DOUBLE) / 7, 6) AS value,
  to_base64(encode(event_type)) AS payload, CAST(units // 100 + CASE WHEN units % 100 > 50 OR (units % 100 = 50 AND (units // 100) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 1000000 AS amount
FROM (SELECT *, event_id * 125 AS units FROM events)""")
def normalize(spark, sf):
    """Time columns floored to five minutes, doubles and decimals to six places, bytes as text."""
    events = I.table(spark, sf, "events").select(
        "event_id", F.unix_micros("ts").alias("raw"), F.col("ts").alias("created_time"),
        (F.col("value") / 7).alias("value"), F.encode("event_type", "UTF-8").alias("payload"),
        (F.col("event_id").cast("decimal(18,0)") * F.lit("0.00000125").cast("decimal(10,8)")).alias("amount"))
    rows = V.normalize_columns(events, FIVE_MINUTES)
    return rows.select("event_id", "raw", F.unix_micros("created_time").alias("created_time"), "value", "payload",
                       F.col("amount").cast("double").alias("amount"))


@catalog.add("normalize_capture", """
SELECT CAST(event_id AS VARCHAR) AS pk, field, val FROM (
  SELECT event_id, 'event_time' AS field, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS val FROM events
  UNION ALL SELECT event_id, 'event_type', event_type FROM events
  UNION ALL SELECT event_id, 'user_id', CAST(user_id AS VARCHAR) FROM events)""")
def normalize_capture(spark, sf):
    """The same over schema-on-read records; excluded and pattern-matched fields go."""
    events = I.table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("event_time"), "event_type", "user_id", F.col("props").alias("raw_props"),
        F.col("value").alias("LastModified"))
    records = capture_records(events, "dbo_events", ["event_id"], F.col("event_id"),
                              ["event_time", "event_type", "user_id", "raw_props", "LastModified"])
    rows = M.normalize_capture(records, patterns=("raw_*",))
    return rows.select("pk", F.explode("fields").alias("field", "v")).select("pk", "field", F.col("v.val").alias("val"))


@catalog.add("exclude_columns", """
SELECT DISTINCT field, field IN ('o_custkey', 'o_orderdate') OR lower(field) LIKE '%price%' OR field = 'o_orderkey' AS excluded
FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderdate', 'o_orderpriority', 'o_orderstatus', 'o_totalprice']) AS field FROM orders)""")
def exclude_columns(spark, sf):
    """Names by list, wildcard and substring over the fields of every order record."""
    fields = I.table(spark, sf, "orders").select(F.explode(F.array(*[
        F.lit(c) for c in ("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
    ])).alias("field"))
    hit = M.is_excluded(F.col("field"), ("O_CUSTKEY", "o_orderdate"), ("PRICE", "o_order?ey"))
    return fields.select("field", hit.alias("excluded")).distinct()


@catalog.add("row_key", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Id:' || p_partkey WHEN p_partkey % 3 = 1 THEN 'key:' || p_name
  ELSE upper(substr(sha256('brand:' || p_brand || ';size:' || CASE WHEN p_size % 2 = 0 THEN 'NULL' ELSE CAST(p_size AS VARCHAR) END || ';'), 1, 16)) END AS row_key
FROM part""")
def row_key_query(spark, sf):
    """Natural keys where there is one, otherwise a digest of the fields."""
    value = lambda c, t: F.struct(F.lit(t).alias("kind"), c.cast("string").alias("val"))
    kind = F.col("p_partkey") % 3
    size = F.when(F.col("p_size") % 2 == 1, value(F.col("p_size"), "bigint"))
    natural = F.when(kind == 0, F.create_map(F.lit("Id"), value(F.col("p_partkey"), "bigint"))).when(
        kind == 1, F.create_map(F.lit("key"), value(F.col("p_name"), "string")))
    fields = F.coalesce(natural, F.create_map(F.lit("size"), size, F.lit("brand"), value(F.col("p_brand"), "string")))
    return I.table(spark, sf, "part").select("p_partkey", row_key(fields).alias("row_key"))


@catalog.add("value_equal_eps", """
SELECT l_orderkey, l_linenumber, count(*) FILTER (l_partkey % 2 = 0) AS near, count(*) FILTER (l_partkey % 2 = 1) AS far, count(*) AS nulls
FROM lineitem GROUP BY ALL""")
def value_equal_eps(spark, sf):
    """Prices moved by less or more than the tolerance; null equals null."""
    moved = F.col("l_extendedprice") + F.when(F.col("l_partkey") % 2 == 0, 5e-7).otherwise(1e-3)
    null = F.lit(None).cast("double")
    rows = I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", V.value_equal_eps(F.col("l_extendedprice"), moved).alias("same"),
        V.value_equal_eps(null, null).alias("null_same"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(
        F.count_if("same").alias("near"), F.count_if(~F.col("same")).alias("far"), F.count_if("null_same").alias("nulls"))


@catalog.add("difference_type", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Added' WHEN 1 THEN 'Removed' WHEN 2 THEN 'TypeChanged' ELSE 'ValueChanged' END AS difference_type
FROM orders""")
def difference_type(spark, sf):
    value = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("val"))
    k = F.col("o_orderkey") % 4
    left = F.when(k != 0, value("bigint", F.col("o_custkey").cast("string")))
    right = F.when(k == 2, value("string", F.col("o_custkey").cast("string"))).when(
        k != 1, value("bigint", F.lit("-1")))
    values = I.table(spark, sf, "orders").select("o_orderkey", left.alias("l"), right.alias("r"))
    return values.select("o_orderkey", V.difference_type("l", "r").alias("difference_type"))
