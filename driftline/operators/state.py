"""Table states: differences, applying net changes, replay validation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from driftline.functions.values import quote_name
from driftline.model import DELETE, INSERT, UPDATE_AFTER, UPDATE_BEFORE
from driftline.operators.netchange import changed_columns


#: Added where two states have different columns: the JSON text of the names that a row's own state lacks.
ABSENT = "absent_columns"


def _common_type(left: DataFrame, right: DataFrame, name: str) -> DataType:
    """The type that holds the values of a column of both sides; text where Spark knows none."""
    one, other = left.schema[name].dataType, right.schema[name].dataType
    if one == other:
        return one
    if StringType() in (one, other):  # a union would read the texts as the other type
        return StringType()
    try:
        return left.select(quote_name(name)).union(right.select(quote_name(name))).schema[0].dataType
    except AnalysisException:
        return StringType()


def resolve_states(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both states with the same columns: those of the left, then the others of the right.

    A column that a state lacks is null there and named in ``absent_columns``, so a lacking
    column isn't taken for a null; states with equal columns have no such column. A column of
    two types gets the one that holds both.
    """
    names = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c != ABSENT]
    types = {c: _common_type(left, right, c) for c in names if c in left.columns and c in right.columns}
    marked = any(c not in df.columns for df in (left, right) for c in names) or ABSENT in [*left.columns, *right.columns]

    def resolved(df: DataFrame, other: DataFrame) -> DataFrame:
        columns = [F.col(quote_name(c)).cast(types[c]).alias(c) if c in types
                   else F.col(quote_name(c)) if c in df.columns
                   else F.lit(None).cast(other.schema[c].dataType).alias(c) for c in names]
        if marked:
            lacking = F.array(*[F.lit(c) for c in names if c not in df.columns]).cast("array<string>")
            before = F.from_json(ABSENT, "array<string>") if ABSENT in df.columns else F.array().cast("array<string>")
            columns.append(F.to_json(F.array_sort(F.array_union(before, lacking))).alias(ABSENT))
        return df.select(*columns)

    return resolved(left, right), resolved(right, left)


def joined_states(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Both states, with their columns resolved, side by side as ``before`` and ``after`` structs, absent side null."""
    before, after = resolve_states(before, after)
    columns = [quote_name(c) for c in before.columns if c not in keys]
    return before.select(*keys, F.struct(*columns).alias("before")).join(
        after.select(*keys, F.struct(*columns).alias("after")), keys, "full_outer")


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], table_name: str,
                  start_lsn: Column, seqval: Column | None = None) -> DataFrame:
    """Change rows that turn ``before`` into ``after``: inserts, deletes, update image pairs.

    Where the states have different columns, every image has all of them and ``absent_columns``.
    """
    image = lambda op, row: F.struct(F.lit(op).alias("_op"), F.col(row).alias("_row"))
    images = (
        F.when(F.col("before").isNull(), F.array(image(INSERT, "after")))
        .when(F.col("after").isNull(), F.array(image(DELETE, "before")))
        .when(~F.col("before").eqNullSafe(F.col("after")),
              F.array(image(UPDATE_BEFORE, "before"), image(UPDATE_AFTER, "after")))
    )
    joined = joined_states(before, after, keys)
    columns = joined.schema["before"].dataType.names
    rows = joined.select(*keys, F.inline(images))
    return rows.select(
        F.lit(table_name).alias("table_name"), start_lsn.alias("start_lsn"),
        (start_lsn if seqval is None else seqval).alias("seqval"), F.col("_op").cast("int").alias("op"),
        *keys, *[F.col("_row")[c].alias(c) for c in columns])


def snapshot_net(before: DataFrame, after: DataFrame, keys: list[str], table_name: str,
                 start_lsn: Column) -> DataFrame:
    """Net changes between two states, straight from their join.

    Equals ``net_change(snapshot_diff(...))`` without its second shuffle.
    """
    op = (
        F.when(F.col("before").isNull(), INSERT)
        .when(F.col("after").isNull(), DELETE)
        .when(~F.col("before").eqNullSafe(F.col("after")), UPDATE_AFTER)
    )
    joined = joined_states(before, after, keys)
    columns = joined.schema["before"].dataType.names
    return joined.select(
        F.lit(table_name).alias("table_name"), *keys, op.alias("op"), start_lsn.alias("start_lsn"),
        "before", "after").filter("op IS NOT NULL").withColumn("changed", changed_columns(columns))


def apply_changes(base: DataFrame, net: DataFrame, keys: list[str]) -> DataFrame:
    """The state after net changes: untouched rows plus after-images.

    Images with other columns than ``base`` give a state with the columns of both, as
    ``resolve_states`` has them. ``net`` is usually far smaller than ``base``; the anti join
    then needs no shuffle of ``base``, and otherwise falls back to a shuffled join.
    """
    untouched = base.join(net.select(*keys), keys, "left_anti").select(*[quote_name(c) for c in base.columns])
    images = net.schema["after"].dataType.names
    changed = net.filter(F.col("op") != DELETE).select(*keys, *[F.col("after")[c].alias(c) for c in images])
    untouched, changed = resolve_states(untouched, changed)
    return untouched.unionByName(changed)


def state_differences(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ between two states, with the kind of difference."""
    kind = (
        F.when(F.col("before").isNull(), "Added")
        .when(F.col("after").isNull(), "Removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "Changed")
    )
    return joined_states(actual, expected, keys).select(*keys, kind.alias("difference")).filter(
        "difference IS NOT NULL")


def validate_replay(base: DataFrame, net: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """One row: whether applying ``net`` to ``base`` gives ``target``, with difference counts."""
    kind = (
        F.when(F.col("before").isNull(), "Added")
        .when(F.col("after").isNull(), "Removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "Changed")
        .otherwise("Same")
    )
    pairs = joined_states(apply_changes(base, net, keys), target, keys).select(kind.alias("kind"))
    return pairs.agg(
        F.count_if(F.col("kind") != "Added").alias("replayed_rows"),
        F.count_if(F.col("kind") != "Removed").alias("target_rows"),
        F.count_if(F.col("kind") == "Added").alias("missing_rows"),
        F.count_if(F.col("kind") == "Removed").alias("unexpected_rows"),
        F.count_if(F.col("kind") == "Changed").alias("changed_rows"),
        (F.count_if(F.col("kind") != "Same") == 0).alias("is_match"))
