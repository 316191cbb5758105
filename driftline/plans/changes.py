"""Queries over change rows and table states."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.keys import lsn_hex
from driftline.operators import netchange as N
from driftline.operators import regression as R
from driftline.operators import state
from driftline.plans import inputs as I
from driftline.plans.captures import SUMMARY_SQL, failures_cte
from driftline.plans.catalog import Catalog
from driftline.sources import changes as sources

catalog = Catalog()

LOG = I.change_log_sql()
LOG_COLUMNS = "table_name, lsn, op, o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice"


def shown(changes):
    return changes.select("table_name", lsn_hex(F.col("start_lsn")).alias("lsn"), "op", "o_orderkey", "o_custkey",
                          "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


CHANGED = {name: name for name in I.CAPTURED["baseline"]}


def _diff_rows_sql(name: str, side: str) -> str:
    """Change rows between two states of a table, one row per image."""
    t = I.KEYED[name]
    joined = (f"SELECT coalesce(b.{t.key}, a.{t.key}) AS k, b.{t.key} IS NOT NULL AS hb, a.{t.key} IS NOT NULL AS ha, "
              + ", ".join(f"b.{c} AS b_{c}, a.{c} AS a_{c}" for c in t.data)
              + f" FROM ({I.before_sql(name)}) b FULL OUTER JOIN ({I.after_sql(name, side)}) a ON b.{t.key} = a.{t.key}")
    differs = " OR ".join(f"b_{c} IS DISTINCT FROM a_{c}" for c in t.data)
    image = lambda op, p, cond: (
        f"SELECT {op} AS op, k AS {t.key}, " + ", ".join(f"{p}_{c} AS {c}" for c in t.data) + f" FROM ({joined}) j WHERE {cond}")
    return " UNION ALL ".join([
        image(2, "a", "NOT hb"), image(1, "b", "NOT ha"),
        image(3, "b", f"hb AND ha AND ({differs})"), image(4, "a", f"hb AND ha AND ({differs})")])


@catalog.add("scan_changes", " UNION ALL ".join(
    f"SELECT 'dbo.{n}' AS table_name, op, CAST({I.KEYED[n].key} AS BIGINT) AS k, CAST({I.KEYED[n].money} AS DOUBLE) AS money "
    f"FROM ({_diff_rows_sql(n, 'baseline')}) c" for n in CHANGED))
def scan_changes(spark, sf):
    """Change rows of several tables as one."""
    tables = {
        f"dbo.{n}": I.table_changes(spark, sf, n, "baseline").select(
            "op", F.col(I.KEYED[n].key).alias("k"), F.col(I.KEYED[n].money).cast("double").alias("money"))
        for n in CHANGED}
    return sources.scan_changes(tables)


def _bounds(spark, sf):
    """LSNs a quarter and three quarters into the log, as the engine-independent key range."""
    orders = I.table(spark, sf, "orders")
    top = orders.agg(F.max("o_orderkey")).scalar()
    lsn = lambda key: F.unhex(F.lpad(F.hex(key * 10 + 1), 20, "0"))
    return lsn(F.floor(top / 4).cast("bigint")), lsn(F.floor(top * 3 / 4).cast("bigint"))


LO_SQL = "(SELECT lpad(hex(CAST(floor(max(o_orderkey) / 4) AS BIGINT) * 10 + 1), 20, '0') FROM orders)"
HI_SQL = "(SELECT lpad(hex(CAST(floor(max(o_orderkey) * 3 / 4) AS BIGINT) * 10 + 1), 20, '0') FROM orders)"


@catalog.add("scan_all_changes", f"SELECT {LOG_COLUMNS} FROM ({LOG}) c WHERE lsn BETWEEN {LO_SQL} AND {HI_SQL}")
def scan_all_changes(spark, sf):
    return shown(sources.scan_all_changes(I.change_log(spark, sf), *_bounds(spark, sf)))


@catalog.add("scan_changes_after", f"SELECT {LOG_COLUMNS} FROM ({LOG}) c WHERE lsn > {LO_SQL}")
def scan_changes_after(spark, sf):
    return shown(sources.scan_changes_after(I.change_log(spark, sf), _bounds(spark, sf)[0], ordered=True))


TIME_FROM, TIME_TO = "1996-01-01 00:00:00", "1996-06-30 00:00:00"
RANGE_SQL = (f"SELECT min(CASE WHEN change_time >= TIMESTAMP '{TIME_FROM}' THEN lsn END) AS from_lsn, "
             f"max(CASE WHEN change_time <= TIMESTAMP '{TIME_TO}' THEN lsn END) AS to_lsn FROM ({I.lsn_time_sql()}) t")


def _window():
    return F.to_timestamp(F.lit(TIME_FROM)), F.to_timestamp(F.lit(TIME_TO))


@catalog.add("lsn_range_for_time", RANGE_SQL)
def lsn_range_for_time(spark, sf):
    bounds = sources.lsn_range_for_time(I.lsn_time(spark, sf), *_window())
    return bounds.select(*[lsn_hex(F.col(c)).alias(c) for c in bounds.columns])


# The window must name the times of the log for its LSNs to be ordered by time; here they are
# ordered by key, so the range is wide and the net changes cover most orders.
def net_sql(log: str) -> str:
    """Net change per key from first and last image."""
    return f"""
WITH c AS (SELECT *, lsn || lpad(CAST(op AS VARCHAR), 2, '0') AS pos FROM ({log}) x),
f AS (SELECT table_name, o_orderkey, arg_min(op, pos) AS f_op, arg_max(op, pos) AS l_op, max(lsn) AS lsn,
  arg_min(o_custkey, pos) AS f_cust, arg_max(o_custkey, pos) AS l_cust,
  arg_min(o_orderstatus, pos) AS f_status, arg_max(o_orderstatus, pos) AS l_status,
  arg_min(o_totalprice, pos) AS f_price, arg_max(o_totalprice, pos) AS l_price FROM c GROUP BY table_name, o_orderkey),
n AS (SELECT *, CASE WHEN f_op IN (1, 3) AND l_op IN (2, 4) THEN 4 WHEN l_op IN (2, 4) THEN 2
       WHEN f_op IN (1, 3) THEN 1 END AS op,
  f_op IN (1, 3) AND l_op IN (2, 4) AS upd, f_op IN (1, 3) AS hb, l_op IN (2, 4) AS ha,
  f_cust IS DISTINCT FROM l_cust AS d_cust, f_status IS DISTINCT FROM l_status AS d_status,
  f_price IS DISTINCT FROM l_price AS d_price FROM f)
SELECT table_name, o_orderkey, op, lsn,
  CASE WHEN hb AND (NOT upd OR d_cust) THEN f_cust END AS old_o_custkey, CASE WHEN ha AND (NOT upd OR d_cust) THEN l_cust END AS new_o_custkey,
  CASE WHEN hb AND (NOT upd OR d_status) THEN f_status END AS old_o_orderstatus, CASE WHEN ha AND (NOT upd OR d_status) THEN l_status END AS new_o_orderstatus,
  CAST(CASE WHEN hb AND (NOT upd OR d_price) THEN f_price END AS DOUBLE) AS old_o_totalprice,
  CAST(CASE WHEN ha AND (NOT upd OR d_price) THEN l_price END AS DOUBLE) AS new_o_totalprice
FROM n WHERE op IS NOT NULL AND (op <> 4 OR d_cust OR d_status OR d_price)"""


def flat(net):
    rows = N.net_flat(net, ["o_orderkey"])
    return rows.select(
        "table_name", "o_orderkey", "op", lsn_hex(F.col("start_lsn")).alias("lsn"),
        "old_o_custkey", "new_o_custkey", "old_o_orderstatus", "new_o_orderstatus",
        F.col("old_o_totalprice").cast("double").alias("old_o_totalprice"),
        F.col("new_o_totalprice").cast("double").alias("new_o_totalprice"))


@catalog.add("net_change", net_sql(LOG))
def net_change(spark, sf):
    return flat(N.net_change(I.change_log(spark, sf), ["o_orderkey"]))


@catalog.add("net_changes", net_sql(f"SELECT * FROM ({LOG}) y WHERE lsn BETWEEN {LO_SQL} AND {HI_SQL}"))
def net_changes(spark, sf):
    """Net changes over an LSN range."""
    ranged = sources.scan_all_changes(I.change_log(spark, sf), *_bounds(spark, sf))
    return flat(N.net_change(ranged, ["o_orderkey"]))


@catalog.add("changes_in_time", net_sql(
    f"SELECT * FROM ({LOG}) y WHERE lsn BETWEEN (SELECT from_lsn FROM ({RANGE_SQL}) a) AND (SELECT to_lsn FROM ({RANGE_SQL}) b)"))
def changes_in_time(spark, sf):
    """Net changes over the LSN range of a time window."""
    ranged = sources.changes_in_time(I.change_log(spark, sf), I.lsn_time(spark, sf), *_window())
    return flat(N.net_change(ranged, ["o_orderkey"]))


@catalog.add("net_change_parity", f"""
WITH c AS (SELECT *, lsn || lpad(CAST(op AS VARCHAR), 2, '0') AS pos FROM ({LOG}) x),
f AS (SELECT o_orderkey, arg_max(op, pos) AS op,
  arg_max(o_totalprice, pos) AS l_price, arg_max(o_orderstatus, pos) AS l_status, arg_max(o_custkey, pos) AS l_cust,
  arg_min(o_totalprice, pos) FILTER (op = 3) AS b_price, arg_min(o_totalprice, pos) FILTER (op = 4) AS a_price,
  arg_min(o_orderstatus, pos) FILTER (op = 3) AS b_status, arg_min(o_orderstatus, pos) FILTER (op = 4) AS a_status
  FROM c GROUP BY o_orderkey)
SELECT o_orderkey, op,
  CAST(CASE WHEN op = 2 THEN l_price WHEN op = 4 AND b_price <> a_price THEN b_price END AS DOUBLE) AS old_price,
  CAST(CASE WHEN op = 1 THEN l_price WHEN op = 4 AND b_price <> a_price THEN a_price END AS DOUBLE) AS new_price,
  CASE WHEN op = 2 THEN l_status WHEN op = 4 AND b_status <> a_status THEN b_status END AS old_status,
  CASE WHEN op = 1 THEN l_status WHEN op = 4 AND b_status <> a_status THEN a_status END AS new_status
FROM f WHERE op <> 4 OR b_price <> a_price OR b_status <> a_status""")
def net_change_parity(spark, sf):
    """The fold with swapped codes and first update images."""
    rows = N.net_flat(N.net_change(I.change_log(spark, sf), ["o_orderkey"], parity=True), ["o_orderkey"])
    return rows.select(
        "o_orderkey", "op", F.col("old_o_totalprice").cast("double").alias("old_price"),
        F.col("new_o_totalprice").cast("double").alias("new_price"),
        F.col("old_o_orderstatus").alias("old_status"), F.col("new_o_orderstatus").alias("new_status"))


@catalog.add("old_new_fields", f"""
WITH n AS ({net_sql(LOG)})
SELECT table_name, o_orderkey, field, val FROM (
  SELECT table_name, o_orderkey, 'old_o_custkey' AS field, CAST(old_o_custkey AS VARCHAR) AS val FROM n
  UNION ALL SELECT table_name, o_orderkey, 'new_o_custkey', CAST(new_o_custkey AS VARCHAR) FROM n
  UNION ALL SELECT table_name, o_orderkey, 'old_o_orderstatus', old_o_orderstatus FROM n
  UNION ALL SELECT table_name, o_orderkey, 'new_o_orderstatus', new_o_orderstatus FROM n
  UNION ALL SELECT table_name, o_orderkey, 'old_o_totalprice', CAST(CAST(old_o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM n
  UNION ALL SELECT table_name, o_orderkey, 'new_o_totalprice', CAST(CAST(new_o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM n
) x WHERE val IS NOT NULL""")
def old_new_fields(spark, sf):
    """The sparse record fields of the net changes, one row each."""
    net = N.net_change(I.change_log(spark, sf), ["o_orderkey"])
    records = N.net_records(net, ["o_orderkey"], F.col("o_orderkey"))
    rows = records.select("table_name", F.col("pk").cast("bigint").alias("o_orderkey"),
                          F.explode("fields").alias("field", "v"))
    return rows.filter(~F.col("field").startswith("__$")).select(
        "table_name", "o_orderkey", "field", F.col("v.val").alias("val"))


@catalog.add("last_by_key", """
SELECT l_orderkey, l_linenumber, arg_max(p, p) AS l_partkey, arg_max(q, p) AS l_quantity FROM (
  SELECT l_orderkey, l_linenumber, l_quantity AS q, l_partkey AS p FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_quantity DESC) AS rn FROM lineitem)
  WHERE rn = 1) GROUP BY l_orderkey, l_linenumber""")
def last_by_key(spark, sf):
    """The last line per order and line number, by part then quantity."""
    lines = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return N.last_by_key(lines, ["l_orderkey", "l_linenumber"], F.struct("l_partkey", "l_quantity"))


@catalog.add("lsn_watermarks", f"SELECT table_name, count(*) AS row_count, min(lsn) AS min_lsn, max(lsn) AS max_lsn FROM ({LOG}) c GROUP BY table_name")
def lsn_watermarks(spark, sf):
    marks = sources.lsn_watermarks(I.change_log(spark, sf))
    return marks.select("table_name", "row_count", lsn_hex(F.col("min_lsn")).alias("min_lsn"),
                        lsn_hex(F.col("max_lsn")).alias("max_lsn"))


@catalog.add("recent_changes", f"SELECT {LOG_COLUMNS} FROM ({LOG}) c ORDER BY lsn DESC, op DESC LIMIT 10")
def recent_changes(spark, sf):
    return shown(sources.recent_changes(I.change_log(spark, sf)))


@catalog.add("snapshot_diff", "SELECT op, o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, "
             f"o_orderpriority FROM ({_diff_rows_sql('orders', 'test')}) c")
def snapshot_diff(spark, sf):
    rows = I.table_changes(spark, sf, "orders", "test")
    return rows.select("op", "o_orderkey", "o_custkey", "o_orderstatus",
                       F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")


def _net(spark, sf, side):
    return N.net_change(I.table_changes(spark, sf, "orders", side), ["o_orderkey"])


@catalog.add("apply_changes", "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority, "
             f"o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM ({I.after_sql('orders', 'baseline')}) a")
def apply_changes(spark, sf):
    """The before state with the net changes applied is the after state."""
    after = state.apply_changes(I.before_state(spark, sf, "orders"), _net(spark, sf, "baseline"), ["o_orderkey"])
    return after.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
                        "o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


def _validate_sql(side: str) -> str:
    """Compares the baseline result with the state of ``side`` as SQL row sets."""
    a, b = I.after_sql("orders", "baseline"), I.after_sql("orders", side)
    return f"""
WITH a AS ({a}), b AS ({b}), j AS (
  SELECT a.o_orderkey IS NOT NULL AS ha, b.o_orderkey IS NOT NULL AS hb,
    a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND (a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
      OR a.o_totalprice IS DISTINCT FROM b.o_totalprice) AS differs
  FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT count(*) FILTER (ha) AS replayed_rows, count(*) FILTER (hb) AS target_rows, count(*) FILTER (NOT ha) AS missing_rows,
  count(*) FILTER (NOT hb) AS unexpected_rows, count(*) FILTER (differs) AS changed_rows,
  count(*) FILTER (NOT ha OR NOT hb OR differs) = 0 AS is_match FROM j"""


@catalog.add("validate_replay", _validate_sql("baseline"))
def validate_replay(spark, sf):
    """Replaying the baseline changes reaches the baseline state."""
    return state.validate_replay(I.before_state(spark, sf, "orders"), _net(spark, sf, "baseline"),
                                 I.after_state(spark, sf, "orders", "baseline"), ["o_orderkey"])


@catalog.add("validate_replay_mismatch", _validate_sql("test"))
def validate_replay_mismatch(spark, sf):
    """Replaying the baseline changes misses the test state by the counted rows."""
    return state.validate_replay(I.before_state(spark, sf, "orders"), _net(spark, sf, "baseline"),
                                 I.after_state(spark, sf, "orders", "test"), ["o_orderkey"])


@catalog.add("state_differences", f"""
WITH a AS ({I.after_sql('orders', 'baseline')}), b AS ({I.after_sql('orders', 'test')})
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN a.o_orderkey IS NULL THEN 'Added' WHEN b.o_orderkey IS NULL THEN 'Removed' ELSE 'Changed' END AS difference
FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
  OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""")
def state_differences(spark, sf):
    return state.state_differences(I.after_state(spark, sf, "orders", "baseline"),
                                   I.after_state(spark, sf, "orders", "test"), ["o_orderkey"])


def _changed_schema(spark, sf):
    """Orders before, and after with a column dropped, one added (null for some) and one of another type."""
    after = I.after_state(spark, sf, "orders", "baseline").drop("o_orderpriority").withColumn(
        "o_custkey", F.col("o_custkey").cast("string")).withColumn(
        "o_channel", F.when(F.col("o_orderkey") % 3 != 0, F.lit("web")))
    return I.before_state(spark, sf, "orders"), after


_SCHEMA_ROWS = f"""b AS ({I.before_sql('orders')}), a AS ({I.after_sql('orders', 'baseline')}),
j AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.o_orderkey IS NOT NULL AS hb, a.o_orderkey IS NOT NULL AS ha,
    CAST(b.o_custkey AS VARCHAR) AS bc, CAST(a.o_custkey AS VARCHAR) AS ac, b.o_orderpriority AS bp,
    CASE WHEN a.o_orderkey % 3 <> 0 THEN 'web' END AS channel
  FROM b FULL OUTER JOIN a ON a.o_orderkey = b.o_orderkey)"""


@catalog.add("snapshot_diff_schema", f"""WITH {_SCHEMA_ROWS}
SELECT CASE WHEN ha THEN 3 ELSE 1 END AS op, o_orderkey, bc AS o_custkey, bp AS o_orderpriority, NULL AS o_channel, '["o_channel"]' AS absent_columns FROM j WHERE hb
UNION ALL SELECT CASE WHEN hb THEN 4 ELSE 2 END, o_orderkey, ac, NULL, channel, '["o_orderpriority"]' FROM j WHERE ha""")
def snapshot_diff_schema(spark, sf):
    """Images of states with different columns tell a lacking column from a null."""
    before, after = _changed_schema(spark, sf)
    rows = state.snapshot_diff(before, after, ["o_orderkey"], "dbo.orders", F.lit(b"\1"))
    return rows.select("op", "o_orderkey", "o_custkey", "o_orderpriority", "o_channel", "absent_columns")


@catalog.add("state_differences_schema", f"""WITH {_SCHEMA_ROWS}
SELECT o_orderkey, CASE WHEN NOT hb THEN 'Added' WHEN NOT ha THEN 'Removed' ELSE 'Changed' END AS difference FROM j""")
def state_differences_schema(spark, sf):
    before, after = _changed_schema(spark, sf)
    return state.state_differences(before, after, ["o_orderkey"])


@catalog.add("validate_replay_schema", f"""WITH {_SCHEMA_ROWS}
SELECT count(*) FILTER (ha) AS replayed_rows, count(*) FILTER (ha) AS target_rows, 0 AS missing_rows, 0 AS unexpected_rows,
  0 AS changed_rows, TRUE AS is_match FROM j""")
def validate_replay_schema(spark, sf):
    """Folded changes between states of different columns lead from one to the other."""
    before, after = _changed_schema(spark, sf)
    net = N.net_change(state.snapshot_diff(before, after, ["o_orderkey"], "dbo.orders", F.lit(b"\1")), ["o_orderkey"])
    return state.validate_replay(before, net, after, ["o_orderkey"]).select(
        "replayed_rows", "target_rows", *[F.col(c).cast("int").alias(c) for c in ("missing_rows", "unexpected_rows", "changed_rows")], "is_match")


def _regression(spark, sf):
    tables = []
    for name in ("orders", "customer", "part"):
        t = I.KEYED[name]
        tables.append(R.TableStates(
            f"dbo_{name}", [t.key], I.before_state(spark, sf, name), I.after_state(spark, sf, name, "baseline"),
            I.after_state(spark, sf, name, "test"), F.col(t.key), I.side_lsn(t, "baseline")))
    return R.run_regression(tables)


# The captures of the comparison queries hold one more table on each side.
ONLY_COMMON = "SELECT table_name, failure_type, count(*) AS failures FROM failures WHERE table_name IN (FROM common) GROUP BY ALL"


@catalog.add("run_regression", f"WITH {failures_cte()} {ONLY_COMMON}")
def run_regression(spark, sf):
    """States to net changes to comparison, failures counted per table and kind."""
    failures, _ = _regression(spark, sf)
    return failures.groupBy("table_name", "failure_type").agg(F.count(F.lit(1)).alias("failures"))


@catalog.add("run_regression_summary", f"WITH {failures_cte()}, shown AS (SELECT * FROM failures WHERE table_name IN (FROM common)) "
             + SUMMARY_SQL.replace("FROM failures", "FROM shown"))
def run_regression_summary(spark, sf):
    return _regression(spark, sf)[1]
