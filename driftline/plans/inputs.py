"""Inputs derived from the supplied tables, once as DataFrames and once as SQL.

The supplied tables hold no change log, capture or trace. Each is derived here over whole
tables by expressions both engines read alike; operators are expressed separately.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftline.operators.netchange import capture_records, net_records
from driftline.operators.state import snapshot_diff, snapshot_net
from driftline.session import materialize


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A supplied table; its schema is read from the file once."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[path]).parquet(path)
    # Files written without a zone read as local timestamps; the operators work on instants.
    return df.withColumns({
        f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


@dataclass(frozen=True)
class Keyed:
    """A supplied table with a unique key, one money column and one text column to edit."""

    name: str
    key: str
    money: str | None
    text: str
    rest: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [self.key, *self.data]

    @property
    def data(self) -> list[str]:
        return [*self.rest, self.text, *([self.money] if self.money else [])]


KEYED = {
    "orders": Keyed("orders", "o_orderkey", "o_totalprice", "o_orderstatus",
                    ("o_custkey", "o_orderdate", "o_orderpriority")),
    "customer": Keyed("customer", "c_custkey", "c_acctbal", "c_mktsegment", ("c_name", "c_nationkey")),
    "part": Keyed("part", "p_partkey", "p_retailprice", "p_type", ("p_name", "p_brand", "p_size")),
    "supplier": Keyed("supplier", "s_suppkey", "s_acctbal", "s_name", ("s_nationkey",)),
    "nation": Keyed("nation", "n_nationkey", None, "n_name", ("n_regionkey",)),
}

# Tables changed by the workload in each capture; supplier and nation are on one side only.
CAPTURED = {
    "baseline": ("orders", "customer", "part", "supplier"),
    "test": ("orders", "customer", "part", "nation"),
}


def before_exprs(t: Keyed) -> list[str]:
    money = [f"CAST({t.money} AS DECIMAL(18,2)) AS {t.money}"] if t.money else []
    return [t.key, *t.rest, t.text, *money]


def _edits(t: Keyed, side: str) -> tuple[str, list[str], str]:
    """Condition of deleted rows, expressions of kept rows, condition of copied rows."""
    k = t.key
    deleted = f"{k} % 97 = 5"
    money = f"CASE WHEN {k} % 13 = 0 THEN {t.money} + 10 ELSE {t.money} END"
    text = f"CASE WHEN {k} % 17 = 0 THEN 'Invoiced' ELSE {t.text} END"
    copied = f"{k} % 101 = 3"
    if side == "test":
        deleted = f"({k} % 97 = 5 OR {k} % 53 = 7)"
        money = f"CASE WHEN {k} % 29 = 0 THEN {t.money} + 11 WHEN {k} % 13 = 0 THEN {t.money} + 10 ELSE {t.money} END"
        text = f"CASE WHEN {k} % 59 = 1 THEN NULL WHEN {k} % 51 = 0 THEN 'Cancelled' WHEN {k} % 17 = 0 THEN 'Invoiced' ELSE {t.text} END"
        copied = f"({k} % 101 = 3 OR {k} % 101 = 4)"
    kept = [k, *t.rest, f"{text} AS {t.text}"]
    if t.money:
        kept.append(f"CAST({money} AS DECIMAL(18,2)) AS {t.money}")
    return deleted, kept, copied


def before_state(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name).selectExpr(*before_exprs(KEYED[name]))


def after_state(spark: SparkSession, sf: str, name: str, side: str) -> DataFrame:
    """The state after a workload: rows edited, deleted, and copied to new (negative) keys."""
    t = KEYED[name]
    deleted, kept, copied = _edits(t, side)
    before = before_state(spark, sf, name)
    copies = [f"-({t.key} + 1) AS {t.key}", *[c for c in t.columns if c != t.key]]
    return before.filter(f"NOT ({deleted})").selectExpr(*kept).unionByName(
        before.filter(copied).selectExpr(*copies))


def before_sql(name: str) -> str:
    return f"SELECT {', '.join(before_exprs(KEYED[name]))} FROM {name}"


def after_sql(name: str, side: str) -> str:
    t = KEYED[name]
    deleted, kept, copied = _edits(t, side)
    columns = ", ".join([t.key, *t.rest, t.text, *([t.money] if t.money else [])])
    copies = ", ".join([f"-({t.key} + 1) AS {t.key}", *t.rest, t.text, *([t.money] if t.money else [])])
    before = before_sql(name)
    return (f"SELECT {columns} FROM (SELECT {', '.join(kept)} FROM ({before}) b1 WHERE NOT ({deleted})) k "
            f"UNION ALL SELECT {copies} FROM ({before}) b2 WHERE {copied}")


# --- captures -----------------------------------------------------------------------------

LSN_STEP = {"baseline": 1, "test": 2}


def lsn_expr(value: str) -> str:
    """A ten-byte log sequence number from a non-negative integer expression (Spark)."""
    return f"unhex(lpad(hex({value}), 20, '0'))"


def lsn_hex_sql(value: str) -> str:
    """The same number as hex text (DuckDB)."""
    return f"lpad(hex({value}), 20, '0')"


def table_changes(spark: SparkSession, sf: str, name: str, side: str) -> DataFrame:
    """Change rows of one table between its before and after state."""
    t = KEYED[name]
    return snapshot_diff(before_state(spark, sf, name), after_state(spark, sf, name, side),
                         [t.key], f"dbo.{name}", side_lsn(t, side))


def side_lsn(t: Keyed, side: str) -> Column:
    return F.expr(lsn_expr(f"abs({t.key}) * 10 + {LSN_STEP[side]}"))


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf: str, label: str, build) -> DataFrame:
    """An input written once per application to the shared folder, as captures are."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _STORED:
        _STORED[key] = materialize(build(), label)
    return _STORED[key]


def capture(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """The stored capture of one side."""
    return stored(spark, sf, f"capture-{side}", lambda: build_capture(spark, sf, side))


def build_capture(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Net changes of all captured tables as capture records."""
    union = None
    for name in CAPTURED[side]:
        t = KEYED[name]
        net = snapshot_net(before_state(spark, sf, name), after_state(spark, sf, name, side), [t.key],
                           f"dbo.{name}", side_lsn(t, side))
        records = net_records(net, [t.key], F.col(t.key)).withColumn("table_name", F.lit(f"dbo_{name}"))
        union = records if union is None else union.unionByName(records)
    return union


_SQL_KIND = {"o_custkey": "bigint", "c_nationkey": "bigint", "p_size": "bigint", "s_nationkey": "bigint",
             "n_regionkey": "bigint", "o_orderdate": "timestamp"}


def sql_kind(t: Keyed, column: str) -> str:
    if column == t.key:
        return "bigint"
    if column == t.money:
        return "decimal"
    return _SQL_KIND.get(column, "string")


def capture_fields_sql(side: str) -> str:
    """Capture records in long form: one row per record and field.

    ``table_name, pk, ordinal, op, field, kind, val``; metadata fields are not listed.
    """
    parts = []
    for name in CAPTURED[side]:
        t = KEYED[name]
        joined = (f"SELECT coalesce(b.{t.key}, a.{t.key}) AS k, b.{t.key} IS NOT NULL AS hb, a.{t.key} IS NOT NULL AS ha, "
                  + ", ".join(f"b.{c} AS b_{c}, a.{c} AS a_{c}" for c in t.data)
                  + f" FROM ({before_sql(name)}) b FULL OUTER JOIN ({after_sql(name, side)}) a ON b.{t.key} = a.{t.key}")
        for c in t.data:
            for prefix, col in (("old", f"b_{c}"), ("new", f"a_{c}")):
                own = "hb" if prefix == "old" else "ha"
                parts.append(
                    f"SELECT 'dbo_{name}' AS table_name, CAST(k AS VARCHAR) AS pk, k AS ordinal, "
                    f"CASE WHEN NOT hb THEN 2 WHEN NOT ha THEN 1 ELSE 4 END AS op, '{prefix}_{c}' AS field, "
                    f"'{sql_kind(t, c)}' AS kind, CAST({col} AS VARCHAR) AS val FROM ({joined}) j "
                    f"WHERE {own} AND b_{c} IS DISTINCT FROM a_{c} AND ((hb AND ha) OR {col} IS NOT NULL)")
    return " UNION ALL ".join(parts)


def captures_cte() -> str:
    """Both captures as CTEs: ``bf``/``tf`` in long form and ``br``/``tr`` one row per record."""
    return (
        f"bf AS ({capture_fields_sql('baseline')}), tf AS ({capture_fields_sql('test')}), "
        "br AS (SELECT table_name, pk, ordinal, op, count(*) AS n_fields FROM bf GROUP BY ALL), "
        "tr AS (SELECT table_name, pk, ordinal, op, count(*) AS n_fields FROM tf GROUP BY ALL)")


def profile(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Whole table states as capture records (``before`` is the untouched state)."""
    names = CAPTURED["baseline"] if side == "before" else CAPTURED[side]
    union = None
    for name in names:
        state = before_state(spark, sf, name) if side == "before" else after_state(spark, sf, name, side)
        records = capture_records(state, f"dbo_{name}", [KEYED[name].key], F.col(KEYED[name].key))
        union = records if union is None else union.unionByName(records)
    return union


def profile_fields_sql(side: str) -> str:
    names = CAPTURED["baseline"] if side == "before" else CAPTURED[side]
    parts = []
    for name in names:
        t = KEYED[name]
        state = before_sql(name) if side == "before" else after_sql(name, side)
        for c in t.columns:
            parts.append(f"SELECT 'dbo_{name}' AS table_name, CAST({t.key} AS VARCHAR) AS pk, {t.key} AS ordinal, "
                         f"'{c}' AS field, '{sql_kind(t, c)}' AS kind, CAST({c} AS VARCHAR) AS val FROM ({state}) s")
    return " UNION ALL ".join(parts)


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Table descriptors derived from the data: one schema per nation, one table per part brand."""
    return spark.sql(MANIFEST_SQL_SPARK.format(sf=sf))


_MANIFEST_BODY = """
SELECT 'main' AS catalog,
       CASE WHEN p_partkey % 31 = 0 THEN 'cdc' WHEN p_partkey % 3 = 0 THEN 'sales' ELSE 'dbo' END AS schema,
       CASE WHEN p_partkey % 37 = 0 THEN 'ddl_history'
            ELSE concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS {text})) END AS name,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('id_', CAST(p_size AS {text})) END AS pk,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('inst_', CAST(p_partkey AS {text})) END AS capture_instance,
       p_partkey % 4 AS index_count
FROM {source}"""

MANIFEST_SQL = _MANIFEST_BODY.format(text="VARCHAR", source="part")
MANIFEST_SQL_SPARK = (
    "SELECT catalog, schema, name, CASE WHEN pk IS NULL THEN array() "
    "ELSE array(pk) END AS pk_columns, capture_instance, index_count FROM ("
    + _MANIFEST_BODY.format(text="STRING", source="parquet.`{sf}/part.parquet`") + ")")


# --- change log ---------------------------------------------------------------------------

def _steps() -> list[tuple[int, int, int, str, str]]:
    """``(key % 8, step, op, price, status)``: every first/last operation pair of a net change."""
    a, b, c = "CAST(o_totalprice AS DECIMAL(18,2))", "CAST(o_totalprice + 1 AS DECIMAL(18,2))", "CAST(o_totalprice + 2 AS DECIMAL(18,2))"
    s, inv = "o_orderstatus", "'Invoiced'"
    return [
        (0, 1, 2, a, s),
        (1, 1, 2, a, s), (1, 2, 3, a, s), (1, 2, 4, b, s),
        (2, 1, 2, a, s), (2, 2, 1, a, s),
        (3, 1, 3, a, s), (3, 1, 4, b, s), (3, 2, 3, b, s), (3, 2, 4, c, inv),
        (4, 1, 3, a, s), (4, 1, 4, b, inv), (4, 2, 3, b, inv), (4, 2, 4, a, s),
        (5, 1, 3, a, s), (5, 1, 4, b, s), (5, 2, 1, b, s),
        (6, 1, 1, a, s),
        (7, 1, 1, a, s), (7, 2, 2, c, inv),
    ]


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """Several changes per order."""
    return change_rows(table(spark, sf, "orders"))


def change_rows(orders: DataFrame) -> DataFrame:
    """The changes of batch or streaming orders; one scan, one row per change image."""
    images = ", ".join(
        f"CASE WHEN o_orderkey % 8 = {m} THEN named_struct('step', {step}, 'op', {op}, "
        f"'o_totalprice', {price}, 'o_orderstatus', {status}) END"
        for m, step, op, price, status in _steps())
    rows = orders.selectExpr(
        "o_orderkey", "o_custkey", f"inline(array_compact(array({images})))")
    return rows.selectExpr(
        "'dbo.orders' AS table_name",
        f"{lsn_expr('o_orderkey * 10 + step')} AS start_lsn",
        f"{lsn_expr('step')} AS seqval", "op", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def change_log_sql() -> str:
    parts = [
        f"SELECT 'dbo.orders' AS table_name, {lsn_hex_sql(f'o_orderkey * 10 + {step}')} AS lsn, {step} AS step, {op} AS op, "
        f"o_orderkey, o_custkey, {status} AS o_orderstatus, {price} AS o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 8 = {m}"
        for m, step, op, price, status in _steps()]
    return " UNION ALL ".join(parts)


def lsn_time(spark: SparkSession, sf: str) -> DataFrame:
    """When each change of the log happened: the order date plus the step in hours."""
    steps = "CASE WHEN o_orderkey % 8 IN (0, 6) THEN array(1) ELSE array(1, 2) END"
    return table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderdate", f"explode({steps}) AS step").selectExpr(
        f"{lsn_expr('o_orderkey * 10 + step')} AS start_lsn",
        "timestamp_micros(unix_micros(o_orderdate) + step * 3600000000) AS change_time")


def lsn_time_sql() -> str:
    return (f"SELECT {lsn_hex_sql('o_orderkey * 10 + step')} AS lsn, o_orderdate + to_hours(step) AS change_time "
            "FROM orders, (VALUES (1), (2)) s(step) WHERE step = 1 OR o_orderkey % 8 NOT IN (0, 6)")


# --- trace --------------------------------------------------------------------------------

# Statement text by event: every classification rule fires (fixed values).
STATEMENTS = (
    "", "SELECT 1", " insert into t values (1)", "UPDATE sys.x SET a = 1", "DELETE FROM cdc.t",
    "BACKUP DATABASE d", "EXEC usp_x 1", "EXECUTE usp_x", "WITH c AS (SELECT 1) DELETE FROM c",
    "UPDATE t SET a = '__$'", "DROP TABLE t", "MERGE INTO t USING s ON 1 = 1;",
    "UPDATE t   SET a = 1 -- exec sp_executesql N'x'", "CREATE TABLE xe_a (b int)",
    "delete from t where a = 1 GO", "ALTER TABLE t ADD b int", "DROP TABLE cargo",
)


def _statement_expr() -> str:
    whens = " ".join(
        f"WHEN event_id % {len(STATEMENTS)} = {i} THEN '{s.replace(chr(39), chr(39) * 2)}'"
        for i, s in enumerate(STATEMENTS))
    return f"CASE {whens} END"


def trace_exprs(text: str) -> list[str]:
    """Trace event columns over ``events``; ``text`` names the engine's text type."""
    as_text = lambda e: f"CAST({e} AS {text})"
    sql = _statement_expr()
    return [
        "event_id", f"concat('s', {as_text('user_id')}) AS session_id", "ts AS event_time",
        "CASE WHEN event_id % 3 = 0 THEN 'rpc_completed' WHEN event_id % 3 = 1 THEN 'sql_batch_completed' "
        "ELSE 'sql_statement_completed' END AS event_name",
        "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN '' ELSE concat('db', "
        f"{as_text('event_id % 4')}) END AS database_name",
        f"CASE WHEN event_id % 19 = 0 THEN 'sa' ELSE concat('u', {as_text('user_id % 10')}) END AS login_name",
        "event_type AS application_name",
        f"concat('host', {as_text('user_id % 3')}) AS host_name",
        "CAST(user_id % 500 AS INT) AS spid",
        "CAST(round(value * 100) AS BIGINT) AS duration",
        "CAST(round(value * 40) AS BIGINT) AS cpu_time",
        "event_id % 50 AS reads", "event_id % 7 AS writes",
        f"{sql} AS sql_text", "props AS tsql_stack",
        "event_id % 1000 AS transaction_id", f"{sql} AS statement",
    ]


def trace_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*trace_exprs("STRING"))


TRACE_SQL = f"SELECT {', '.join(trace_exprs('VARCHAR'))} FROM events"
