"""Row and field differences between two profiles (captures keyed by manifest keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.keys import profile_key_sql
from driftline.functions.values import changed_unless_recent_sql, quote_text
from driftline.model import LSN_FIELD, OPERATION_FIELD
from driftline.operators.netchange import last_by_key
from driftline.operators.stats import intersect_tables
from driftline.session import broadcast_if_small

IGNORED = (LSN_FIELD, OPERATION_FIELD)


def _line(action: str, *values: str) -> str:
    names = ("field_name", "field_action", "left_value", "right_value")
    values = values or ("CAST(NULL AS STRING)",) * 4
    parts = ", ".join(f"'{n}', {v}" for n, v in zip(names, values))
    return f"named_struct('action', '{action}', {parts})"


def diff_profiles(manifest: DataFrame, left: DataFrame, right: DataFrame, now: str | None = None,
                  parity: bool = False, unique_keys: bool = False) -> DataFrame:
    """Differing rows and fields of every table that has a key in the manifest.

    Returns ``table_name, key, action, field_name, field_action, left_value, right_value``;
    new and deleted rows have no field. With ``parity`` rows are new or deleted only when
    their whole table is absent on the other side, and fields only the right side has are
    left out. Of records with equal keys the last counts; ``unique_keys`` promises there
    are none and saves that step.
    """
    keyed = broadcast_if_small(manifest.filter("size(pk_columns) > 0").selectExpr(
        "concat_ws('_', schema, name) AS table_name", "transform(pk_columns, c -> trim(c)) AS pk_columns"))
    keys = ["table_name", "pk"]

    def side(df: DataFrame, name: str) -> DataFrame:
        listed = df.select("table_name", "ordinal", "fields").join(keyed, "table_name")
        rows = listed.selectExpr("table_name", f"{profile_key_sql('fields', 'pk_columns', parity)} AS pk", "ordinal", "fields")
        if not unique_keys:
            rows = last_by_key(rows, keys, F.col("ordinal"))
        return rows.select(*keys, F.col("fields").alias(name))

    joined = side(left, "l").join(side(right, "r"), keys, "full_outer")
    ignored = ", ".join(map(quote_text, IGNORED))
    right_only = "CAST(NULL AS STRING)" if parity else "'New'"
    action = (f"CASE WHEN NOT map_contains_key(r, p.key) THEN 'Deleted' "
              f"WHEN NOT map_contains_key(l, p.key) THEN {right_only} "
              f"WHEN {changed_unless_recent_sql('p.value.a', 'p.value.b', now)} THEN 'Changed' END")
    pairs = "map_entries(map_zip_with(l, r, (k, a, b) -> named_struct('a', a, 'b', b)))"
    fields = (f"transform(filter({pairs}, p -> NOT (p.value.a <=> p.value.b AND map_contains_key(l, p.key) AND map_contains_key(r, p.key)) "
              f"AND p.key NOT IN ({ignored}) AND {action} IS NOT NULL), "
              f"p -> {_line('Changed', 'p.key', action, 'p.value.a.val', 'p.value.b.val')})")
    found = (f"CASE WHEN r IS NULL THEN array({_line('Deleted')}) WHEN l IS NULL THEN array({_line('New')}) "
             f"WHEN NOT (map_entries(l) = map_entries(r)) THEN {fields} END")
    rows = joined.selectExpr("table_name", "pk AS key", f"inline({found})")
    if not parity:
        return rows
    shared = intersect_tables(left, right).withColumn("_shared", F.lit(True))
    # Left join on unique names: an anti join would be pushed below the explosion.
    marked = rows.join(shared, "table_name", "left")
    return marked.filter("action = 'Changed' OR _shared IS NULL").drop("_shared")


def diff_stats(diffs: DataFrame) -> DataFrame:
    """New, changed and deleted rows per table."""
    # A row has one line per changed field: count rows after reducing to one line per key.
    rows = diffs.groupBy("table_name", "key", "action").agg(F.count("field_name").alias("fields"))
    return rows.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total_differences"),
        F.count_if(F.col("action") == "New").alias("new_records"),
        F.count_if(F.col("action") == "Changed").alias("changed_records"),
        F.count_if(F.col("action") == "Deleted").alias("deleted_records"),
        F.sum("fields").alias("field_changes"))


def field_change_counts(diffs: DataFrame) -> DataFrame:
    """How often each field changed, per table."""
    return diffs.filter("field_name IS NOT NULL").groupBy("table_name", "field_name").agg(
        F.count(F.lit(1)).alias("changes"))


def diff_totals(diffs: DataFrame) -> DataFrame:
    """One row over all tables: tables with differences, totals, and whether nothing differs."""
    per_table = diff_stats(diffs)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per_table.agg(
        F.count(F.lit(1)).alias("tables_with_differences"),
        zero("total_differences").alias("total_differences"),
        zero("new_records").alias("new_records"),
        zero("changed_records").alias("changed_records"),
        zero("deleted_records").alias("deleted_records"),
        (zero("total_differences") == 0).alias("is_identical"))
