"""Folding row changes to one net change per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.keys import key_columns_value, key_text_sql
from driftline.functions.values import field_map, quote_name, quote_text, value_sql
from driftline.model import (
    DELETE, INSERT, KEY_FIELD, LSN_FIELD, OPERATION_FIELD, TABLE_FIELD, UPDATE_AFTER,
    UPDATE_BEFORE)

CHANGE_COLUMNS = ("table_name", "start_lsn", "seqval", "op")


def last_by_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregate, so a key repeated in a third of the rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(
        *keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def data_columns(changes: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in changes.columns
            if c not in CHANGE_COLUMNS and c not in keys and not c.startswith("__$")]


def fold_images(changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """First and last image per key by ``(start_lsn, seqval, op)``."""
    position = F.struct("start_lsn", "seqval", "op")
    image = F.struct("op", "start_lsn", *columns)
    return changes.groupBy("table_name", *keys).agg(
        F.min_by(image, position).alias("_first"), F.max_by(image, position).alias("_last"))


def net_from_images(folded: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Net change of each key from its first and last image; keys that net to nothing go."""
    first, last = F.col("_first.op"), F.col("_last.op")
    has_before = first.isin(DELETE, UPDATE_BEFORE)
    # An after-image without its before-image: the row existed, its old values are unknown.
    existed = first.isin(DELETE, UPDATE_BEFORE, UPDATE_AFTER)
    has_after = last.isin(INSERT, UPDATE_AFTER)
    op = (
        F.when(has_after & existed, UPDATE_AFTER)
        .when(has_after, INSERT)
        .when((last == DELETE) & existed, DELETE)
    )
    return (
        folded.select(
            "table_name", *keys, op.cast("int").alias("op"), F.col("_last.start_lsn").alias("start_lsn"),
            F.when(has_before, image_of("_first", columns)).alias("before"),
            F.when(has_after, image_of("_last", columns)).alias("after"))
        .withColumn("changed", changed_columns(columns))
        .filter("op IS NOT NULL AND (op <> 4 OR size(changed) > 0)")
    )


def image_of(name: str, columns: list[str]) -> Column:
    """The data columns of an image struct."""
    parts = ", ".join(f"{quote_text(c)}, {name}.{quote_name(c)}" for c in columns)
    return F.expr(f"named_struct({parts})")


def changed_columns(columns: list[str]) -> Column:
    """Names of the columns that differ between the ``before`` and ``after`` structs."""
    differing = ", ".join(
        f"IF(before.{quote_name(c)} <=> after.{quote_name(c)}, NULL, {quote_text(c)})" for c in columns)
    return F.expr(f"array_compact(array({differing}))")


def net_change(changes: DataFrame, keys: list[str], columns: list[str] | None = None,
               parity: bool = False) -> DataFrame:
    """One net change per key.

    Returns ``table_name, <keys>, op, start_lsn, before, after, changed``. With ``parity``
    codes 1 and 2 read as insert and delete, the first key column alone is the key, and an
    update shows its first before-image and first after-image.
    """
    columns = columns or data_columns(changes, keys)
    if not parity:
        return net_from_images(fold_images(changes, keys, columns), keys, columns)

    position = F.struct("start_lsn", "seqval", "op")
    image = F.struct("op", "start_lsn", *columns)
    folded = changes.groupBy("table_name", keys[0]).agg(
        F.max_by(image, position).alias("_last"),
        F.min_by(image, F.when(F.col("op") == UPDATE_BEFORE, position)).alias("_b"),
        F.min_by(image, F.when(F.col("op") == UPDATE_AFTER, position)).alias("_a"))
    last = F.col("_last.op")
    paired = last.isin(UPDATE_BEFORE, UPDATE_AFTER) & F.col("_b").isNotNull() & F.col("_a").isNotNull()
    before = F.when(last == 2, image_of("_last", columns)).when(paired, image_of("_b", columns))
    after = F.when(last == 1, image_of("_last", columns)).when(paired, image_of("_a", columns))
    return (
        folded.select("table_name", keys[0], last.cast("int").alias("op"),
                      F.col("_last.start_lsn").alias("start_lsn"), before.alias("before"), after.alias("after"))
        .withColumn("changed", changed_columns(columns))
        .filter("size(changed) > 0")
    )


def net_flat(net: DataFrame, keys: list[str]) -> DataFrame:
    """Net changes with typed ``old_<col>`` and ``new_<col>`` columns, null where unchanged."""
    columns = net.schema["after"].dataType.fieldNames()
    shown = [
        f"IF(array_contains(changed, {quote_text(c)}), {side}.{quote_name(c)}, NULL) AS {quote_name(prefix + c)}"
        for c in columns for side, prefix in (("before", "old_"), ("after", "new_"))
    ]
    return net.selectExpr("table_name", *map(quote_name, keys), "op", "start_lsn", *shown)


def net_records(net: DataFrame, keys: list[str], ordinal: Column) -> DataFrame:
    """Net changes as capture records with sparse ``old_``/``new_`` fields.

    An insert lists its non-null values as ``new_``, a delete as ``old_``; an update lists
    both sides of the fields that changed.
    """
    def entry(name: str, expr: str, dtype) -> str:
        return f"named_struct('key', {quote_text(name)}, 'value', {value_sql(expr, dtype)})"

    schema = net.schema
    pk = key_text_sql([f"CAST({quote_name(k)} AS STRING)" for k in keys], "null")
    entries = [
        entry(OPERATION_FIELD, "op", schema["op"].dataType),
        entry(LSN_FIELD, "start_lsn", schema["start_lsn"].dataType),
        entry(TABLE_FIELD, "table_name", schema["table_name"].dataType),
        entry(KEY_FIELD, quote_name(keys[0]), schema[keys[0]].dataType) if len(keys) == 1
        else entry(KEY_FIELD, pk, schema["table_name"].dataType),
    ]
    for field in schema["after"].dataType.fields:
        listed = f"array_contains(changed, {quote_text(field.name)})"
        for side, prefix in (("before", "old_"), ("after", "new_")):
            value = f"{side}.{quote_name(field.name)}"
            shown = f"{side} IS NOT NULL AND {listed} AND (op IN (3, 4) OR {value} IS NOT NULL)"
            entries.append(f"IF({shown}, {entry(prefix + field.name, value, field.dataType)}, NULL)")
    return net.select(
        F.col("table_name"), ordinal.cast("bigint").alias("ordinal"), F.expr(pk).alias("pk"),
        F.expr(f"map_from_entries(array_compact(array({', '.join(entries)})))").alias("fields"))


def capture_records(df: DataFrame, table_name: str, keys: list[str], ordinal: Column,
                    columns: list[str] | None = None) -> DataFrame:
    """A typed table as capture records holding every column."""
    return df.select(
        F.lit(table_name).alias("table_name"), ordinal.cast("bigint").alias("ordinal"),
        key_columns_value(keys).alias("pk"), field_map(df, columns).alias("fields"))
