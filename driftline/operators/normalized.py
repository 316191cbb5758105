"""Normalized comparison: row differences with tolerance windows and excluded columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.keys import natural_key, row_digest, row_key
from driftline.functions.text import column_pattern_regex
from driftline.functions.values import difference_type_sql, normalize_value, value_equal_sql
from driftline.model import DEFAULT_EXCLUDED_COLUMNS, DEFAULT_TOLERANCE_MICROS
from driftline.session import materialize


def is_excluded(field, excluded=DEFAULT_EXCLUDED_COLUMNS, patterns=()):
    """Whether a field name is excluded, as a column expression over long data."""
    hit = F.lower(field).isin(*[c.lower() for c in excluded])
    for pattern in patterns:
        if pattern.strip():
            hit = hit | field.rlike("(?i)" + column_pattern_regex(pattern))
    return hit


def normalize_capture(capture: DataFrame, window_micros: int = DEFAULT_TOLERANCE_MICROS,
                      excluded=DEFAULT_EXCLUDED_COLUMNS, patterns=()) -> DataFrame:
    """Capture records without excluded fields and with normalized values."""
    kept = F.map_filter("fields", lambda k, _: ~is_excluded(k, excluded, patterns))
    return capture.withColumn("fields", F.transform_values(
        kept, lambda k, v: normalize_value(k, v, window_micros)))


def compare_normalized(left: DataFrame, right: DataFrame, table: str | None = None) -> DataFrame:
    """Differing rows of two normalized captures, one line per differing field.

    Rows match on their natural key or, without one, on a digest of all fields; ``row_key``
    only names them. Equal rows of a key cancel each other by count; the different rows left
    on both sides are paired from the last backwards. Returns
    ``table_name, row_key, action, field_name, left_value, right_value, difference_type,
    occurrence, row_count``; added and deleted rows have no field. ``occurrence`` counts the
    different rows left of a natural key, ``row_count`` the equal rows that a line stands for: of
    a row that one side repeats more often, the surplus is deleted or added. ``table`` restricts
    both sides before anything moves.

    Only digests and counts of all rows are shuffled; fields are fetched for the pairs alone.
    """
    key = ["table_name", "_natural", "_row"]

    if table is not None:
        left, right = (df.filter(F.col("table_name") == table) for df in (left, right))

    def counted(df: DataFrame, l_n: int, r_n: int) -> DataFrame:
        natural = natural_key(F.col("fields"))
        rows = df.select("table_name", natural.alias("_key"), row_digest(F.col("fields")).alias("_digest"),
                         F.when(natural.isNull(), row_key(F.col("fields"))).alias("_label"), "ordinal")
        return rows.select("table_name", F.col("_key").isNotNull().alias("_natural"),
                           F.coalesce(F.encode("_key", "UTF-8"), F.col("_digest")).alias("_row"), "_digest", "_label",
                           F.lit(l_n).alias("l_n"), F.lit(r_n).alias("r_n"), "ordinal")

    # The label follows from the digest. As a key of the groups it leaves only numbers to be added up, so no row is sorted.
    rows = counted(left, 1, 0).unionByName(counted(right, 0, 1)).groupBy(*key, "_digest", "_label").agg(
        (F.sum("l_n") - F.sum("r_n")).alias("more"),
        F.max(F.when(F.col("l_n") == 1, F.col("ordinal"))).alias("l_ordinal"),
        F.max(F.when(F.col("r_n") == 1, F.col("ordinal"))).alias("r_ordinal")).where("more <> 0")
    on_left = F.col("more") > 0
    rows = rows.withColumn("_left", on_left).withColumn("ordinal", F.when(on_left, F.col("l_ordinal")).otherwise(F.col("r_ordinal")))
    place = Window.partitionBy(*key, "_left").orderBy(F.col("ordinal").desc_nulls_last(), "_digest")
    of = lambda mask, column: F.max(F.when(mask, column))
    pairs = rows.repartition(*key).withColumn("occurrence", F.row_number().over(place)).groupBy(*key, "occurrence").agg(
        F.coalesce(F.any_value("_label"), F.col("_row").cast("string")).alias("row_key"), of(F.col("_left"), F.col("_digest")).alias("l_digest"),
        of(~F.col("_left"), F.col("_digest")).alias("r_digest"), of(F.col("_left"), F.col("more")).alias("l_n"),
        of(~F.col("_left"), -F.col("more")).alias("r_n"))

    # Three readers follow; without the table each would take all digests of both sides again.
    pairs = materialize(pairs, "pairs", free_shuffle=True)

    def fetched(df: DataFrame, name: str) -> DataFrame:
        """The fields of one row for each digest that is paired; digests are taken of the rows of paired keys alone."""
        wanted = pairs.where("l_digest IS NOT NULL AND r_digest IS NOT NULL").select("table_name", "_row").distinct()
        rows = df.select("table_name", F.encode(natural_key(F.col("fields")), "UTF-8").alias("_row"), "fields").where(
            "_row IS NOT NULL").join(wanted, ["table_name", "_row"], "left_semi")
        return rows.groupBy("table_name", F.lit(True).alias("_natural"), "_row", row_digest(F.col("fields")).alias(f"{name}_digest")).agg(
            F.any_value("fields").alias(name))

    joined = pairs.join(fetched(left, "l"), [*key, "l_digest"], "left").join(fetched(right, "r"), [*key, "r_digest"], "left")
    entries = "map_entries(map_zip_with(l, r, (k, a, b) -> named_struct('a', a, 'b', b)))"
    changed = _line("Changed", "p.key", "p.value.a.val", "p.value.b.val",
                    difference_type_sql("p.value.a", "p.value.b"))
    fields = (f"transform(filter({entries}, p -> NOT (p.value.a <=> p.value.b) AND NOT {value_equal_sql('p.value.a', 'p.value.b')}), p -> {changed})")
    surplus = (f"IF(l_n > r_n, array({_line('Deleted', count='l_n - r_n')}), "
               f"IF(r_n > l_n, array({_line('Added', count='r_n - l_n')}), array()))")
    found = (f"CASE WHEN r_digest IS NULL THEN array({_line('Deleted', count='l_n')}) "
             f"WHEN l_digest IS NULL THEN array({_line('Added', count='r_n')}) ELSE concat({fields}, {surplus}) END")
    return joined.selectExpr("table_name", "row_key", "occurrence", f"inline({found})").select(
        "table_name", "row_key", "action", "field_name", "left_value", "right_value", "difference_type", "occurrence", "row_count")


def _line(action: str, *values: str, count: str = "least(l_n, r_n)") -> str:
    names = ("field_name", "left_value", "right_value", "difference_type")
    values = values or ("CAST(NULL AS STRING)",) * 4
    parts = ", ".join(f"'{n}', {v}" for n, v in zip(names, values))
    return f"named_struct('action', '{action}', {parts}, 'row_count', {count})"


def _differing_rows(differences: DataFrame) -> DataFrame:
    """``table_name, action, row_count, fields``; a row is changed in several lines, added or deleted in one."""
    changed = F.col("action") == "Changed"
    return differences.groupBy("table_name", "row_key", "action", "occurrence").agg(
        F.when(changed, F.max("row_count")).otherwise(F.sum("row_count")).alias("row_count"),
        F.collect_set("field_name").alias("fields"))


def difference_report(differences: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Per table: differing rows by action and the affected columns.

    ``tables`` lists the compared tables, so those without differences show zeros;
    ``affected_columns`` holds distinct field names, at most the width of the table.
    """
    # One line per row and field again, the first line of each row marked, so that rows and
    # columns are counted in the same pass over the differences.
    rows = _differing_rows(differences)
    lines = rows.select("table_name", "action", "row_count", F.posexplode_outer("fields").alias("pos", "field"))
    first = F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("row_count"))
    report = lines.groupBy("table_name").agg(
        F.sum(first).alias("total_rows"),
        F.sum(F.when(F.col("action") == "Changed", first)).alias("changed_rows"),
        F.sum(F.when(F.col("action") == "Added", first)).alias("new_rows"),
        F.sum(F.when(F.col("action") == "Deleted", first)).alias("deleted_rows"),
        F.array_sort(F.collect_set("field")).alias("affected_columns"))
    if tables is not None:
        report = tables.select("table_name").join(report, "table_name", "left")
    totals = ("total_rows", "changed_rows", "new_rows", "deleted_rows")
    return report.select(
        "table_name", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in totals],
        F.coalesce("affected_columns", F.array().cast("array<string>")).alias("affected_columns"))


def report_text(report: DataFrame) -> DataFrame:
    """The summary lines of each table in a difference report."""
    return report.select("table_name", F.format_string(
        "Table: %s\n  Match: %s\n  Differences: %s\n  Changed: %s, New: %s, Deleted: %s",
        "table_name", F.when(F.col("total_rows") == 0, "True").otherwise("False"), "total_rows",
        "changed_rows", "new_rows", "deleted_rows").alias("summary"))


def comparison_totals(left: DataFrame, right: DataFrame, differences: DataFrame) -> DataFrame:
    """One row: tables compared, whether all match, total differing rows."""
    tables = left.select("table_name").distinct().union(right.select("table_name").distinct()).distinct()
    rows = _differing_rows(differences).groupBy("table_name").agg(F.sum("row_count").alias("n"))
    per_table = tables.join(rows, "table_name", "left")
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
    return per_table.agg(
        F.count(F.lit(1)).alias("tables_compared"), (total == 0).alias("overall_match"),
        total.alias("total_differences"))
