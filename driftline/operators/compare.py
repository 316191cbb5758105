"""Comparing two captures: typed failures and a summary.

A capture is ``table_name, ordinal, pk, fields map<string, struct<kind, val>>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.values import json_equal_sql, quote_text
from driftline.model import (
    EXTRA_RECORD, EXTRA_TABLE, FIELD_MISMATCH, KEY_FIELD, LSN_FIELD, MISSING_RECORD, MISSING_TABLE,
    OPERATION_FIELD, OPERATION_MISMATCH, RECORD_COUNT_MISMATCH, TABLE_FIELD)
from driftline.operators.netchange import last_by_key

# One sentence per failure kind (fixed values); ``%s`` slots are filled from the failure.
DESCRIPTIONS = {
    MISSING_TABLE: ("Table '%s' exists in baseline but not in test capture", ("table_name",)),
    EXTRA_TABLE: ("Table '%s' exists in test capture but not in baseline", ("table_name",)),
    RECORD_COUNT_MISMATCH: ("Record count mismatch in table '%s': baseline has %s, test has %s",
                            ("table_name", "baseline_value", "test_value")),
    MISSING_RECORD: ("Record with primary key '%s' exists in baseline but not in test capture for table '%s'",
                     ("primary_key", "table_name")),
    EXTRA_RECORD: ("Record with primary key '%s' exists in test capture but not in baseline for table '%s'",
                   ("primary_key", "table_name")),
    OPERATION_MISMATCH: ("Operation type mismatch for record '%s' in table '%s'",
                         ("primary_key", "table_name")),
    FIELD_MISMATCH: ("Field '%s' mismatch for record '%s' in table '%s'",
                     ("field_name", "primary_key", "table_name")),
}

FAILURE_COLUMNS = ["table_name", "failure_type", "primary_key", "field_name",
                   "baseline_value", "test_value", "description"]


def failure_description_sql() -> str:
    def sentence(text: str, slots: tuple[str, ...]) -> str:
        pieces = text.split("%s")
        parts = [quote_text(pieces[0])]
        for slot, piece in zip(slots, pieces[1:]):
            parts += [slot, quote_text(piece)]
        return f"concat({', '.join(parts)})"

    cases = " ".join(f"WHEN '{kind}' THEN {sentence(*parts)}" for kind, parts in DESCRIPTIONS.items())
    return f"CASE failure_type {cases} END"


def ignored_field_sql(field: str, ignore_fields=(), ignore_lsn: bool = True) -> str:
    """Whether a field is left out: by name, by name behind ``old_``/``new_``, or as metadata."""
    names = [f.lower() for f in ignore_fields] + [OPERATION_FIELD, TABLE_FIELD, KEY_FIELD]
    if ignore_lsn:
        names.append(LSN_FIELD)
    listed = ", ".join(map(quote_text, names))
    name = f"lower({field})"
    bare = f"IF(left({name}, 4) IN ('old_', 'new_'), substr({name}, 5), {name})"
    return f"({name} IN ({listed}) OR {bare} IN ({listed}))"


def table_counts(baseline: DataFrame, test: DataFrame) -> DataFrame:
    """Raw rows per table and side, and the field count of the first baseline record."""
    side = lambda df, name: df.select(
        "table_name", F.lit(name).alias("side"), "ordinal", F.size("fields").alias("fields"))
    rows = side(baseline, "b").unionByName(side(test, "t"))
    in_baseline = F.col("side") == "b"
    return rows.groupBy("table_name").agg(
        F.count_if(in_baseline).alias("baseline_records"),
        F.count_if(~in_baseline).alias("test_records"),
        F.min_by(F.when(in_baseline, F.col("fields")), F.when(in_baseline, F.col("ordinal"))).alias("first_fields"))


def _raw_counts(baseline: DataFrame, test: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or ["table_name"]
    rows = baseline.select(*scope, F.lit(1).alias("b"), F.lit(0).alias("t")).union(
        test.select(*scope, F.lit(0), F.lit(1)))
    return rows.groupBy(*scope).agg(F.sum("b").alias("b"), F.sum("t").alias("t"))


def missing_tables(baseline: DataFrame, test: DataFrame) -> DataFrame:
    return _raw_counts(baseline, test).filter("t = 0").select("table_name")


def extra_tables(baseline: DataFrame, test: DataFrame) -> DataFrame:
    return _raw_counts(baseline, test).filter("b = 0").select("table_name")


def common_tables(baseline: DataFrame, test: DataFrame) -> DataFrame:
    return _raw_counts(baseline, test).filter("b > 0 AND t > 0").select("table_name")


def _failure(kind_sql: str, field: str = "CAST(NULL AS STRING)", left: str = "CAST(NULL AS STRING)",
             right: str = "CAST(NULL AS STRING)") -> str:
    return (f"named_struct('failure_type', {kind_sql}, 'field_name', {field}, "
            f"'baseline_value', {left}, 'test_value', {right})")


def _differing_keys(baseline: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, or whose last records have different digests."""
    # Entries in name order, so the digest does not depend on how a map was built.
    digest = F.expr("sha2(to_json(array_sort(map_entries(fields), (x, y) -> "
                    "CASE WHEN x.key < y.key THEN -1 WHEN x.key > y.key THEN 1 ELSE 0 END)), 256)")

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*keys, F.struct("ordinal", digest.alias("digest")).alias("last"))
        return rows.groupBy(*keys).agg(F.max("last").alias("last")).select(*keys, F.col("last.digest").alias(name))

    return side(baseline, "l").join(side(test, "r"), keys, "full_outer").filter(
        "NOT (l <=> r)").select(*keys)


def compare_captures(baseline: DataFrame, test: DataFrame, ignore_fields=(),
                     ignore_lsn: bool = True, scope: list[str] | None = None,
                     digest_first: bool = False, unique_keys: bool = False) -> DataFrame:
    """All failures between two captures.

    Each side is reduced to its last record per ``(table_name, pk)``; that aggregation
    leaves both sides partitioned for the full outer join, which adds no exchange. Only
    differing fields are exploded. ``scope`` names the columns that identify a table.

    With ``digest_first`` the first shuffle carries a SHA-256 per record instead of its
    fields, and only records whose digests differ are read again and compared: less data
    moves when the captures are large and nearly equal. ``unique_keys`` promises one
    record per key, as net changes have, and saves the reduction.
    """
    scope = scope or ["table_name"]
    keys = [*scope, "pk"]
    counted_baseline, counted_test = baseline, test
    if digest_first:
        differing = _differing_keys(baseline, test, keys)
        baseline = baseline.join(differing, keys, "left_semi")
        test = test.join(differing, keys, "left_semi")

    def side(df: DataFrame, name: str) -> DataFrame:
        if not unique_keys:
            df = last_by_key(df.select(*keys, "ordinal", "fields"), keys, F.col("ordinal"))
        return df.select(*keys, F.col("fields").alias(name))

    joined = side(baseline, "l").join(side(test, "r"), keys, "full_outer")

    op = quote_text(OPERATION_FIELD)
    pairs = "map_entries(map_zip_with(l, r, (k, a, b) -> named_struct('a', a, 'b', b)))"
    # Operations are compared where both records have one, other fields unless ignored.
    compared = (f"IF(p.key = {op}, map_contains_key(l, {op}) AND map_contains_key(r, {op}), "
                f"NOT {ignored_field_sql('p.key', ignore_fields, ignore_lsn)})")
    differing = (f"filter({pairs}, p -> NOT (p.value.a <=> p.value.b) AND {compared} "
                 f"AND NOT {json_equal_sql('p.value.a', 'p.value.b')})")
    kind = f"IF(p.key = {op}, '{OPERATION_MISMATCH}', '{FIELD_MISMATCH}')"
    fields = f"transform({differing}, p -> {_failure(kind, 'p.key', 'p.value.a.val', 'p.value.b.val')})"
    # Identical maps (the usual case) skip the field-by-field work.
    found = (f"CASE WHEN r IS NULL THEN array({_failure(quote_text(MISSING_RECORD))}) "
             f"WHEN l IS NULL THEN array({_failure(quote_text(EXTRA_RECORD))}) "
             f"WHEN NOT (map_entries(l) = map_entries(r)) THEN {fields} END")
    records = joined.selectExpr(*scope, "pk AS primary_key", f"inline({found})")

    counts = _raw_counts(counted_baseline, counted_test, scope)
    # Inner on unique names: a semi join would be pushed below the explosion and move every
    # joined record instead of the failures alone.
    records = records.join(counts.filter("b > 0 AND t > 0").select(*scope), scope)
    counted = "b > 0 AND t > 0 AND b <> t"
    tables = counts.filter("b = 0 OR t = 0 OR b <> t").selectExpr(
        *scope, "CAST(NULL AS STRING) AS primary_key",
        f"CASE WHEN t = 0 THEN '{MISSING_TABLE}' WHEN b = 0 THEN '{EXTRA_TABLE}' ELSE '{RECORD_COUNT_MISMATCH}' END AS failure_type",
        "CAST(NULL AS STRING) AS field_name", f"IF({counted}, CAST(b AS STRING), NULL) AS baseline_value",
        f"IF({counted}, CAST(t AS STRING), NULL) AS test_value")
    others = [c for c in scope if c != "table_name"]
    return records.unionByName(tables).selectExpr(
        *others, *FAILURE_COLUMNS[:-1], f"{failure_description_sql()} AS description")


def comparison_summary(baseline: DataFrame, test: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: tables, records and fields compared, failures, tables with failures, match."""
    counts = table_counts(baseline, test).select(
        "table_name", "baseline_records", "test_records", "first_fields", F.lit(0).alias("failures"))
    failed = failures.groupBy("table_name").agg(F.count(F.lit(1)).alias("failures")).select(
        "table_name", F.lit(0).alias("baseline_records"), F.lit(0).alias("test_records"),
        F.lit(None).cast("int").alias("first_fields"), "failures")
    both = (F.col("baseline_records") > 0) & (F.col("test_records") > 0)
    return counts.union(failed).agg(
        F.count_if(both).alias("tables_compared"),
        F.coalesce(F.sum(F.when(both, F.greatest("baseline_records", "test_records"))), F.lit(0))
        .cast("bigint").alias("records_compared"),
        F.coalesce(F.sum(F.when(both, F.col("baseline_records") * F.col("first_fields"))), F.lit(0))
        .cast("bigint").alias("fields_compared"),
        F.coalesce(F.sum("failures"), F.lit(0)).cast("bigint").alias("total_failures"),
        F.count_if(F.col("failures") > 0).alias("tables_with_failures"),
        (F.coalesce(F.sum("failures"), F.lit(0)) == 0).alias("is_match"))


def compare_many(pairs: list[tuple[str, DataFrame, DataFrame]], ignore_fields=(),
                 ignore_lsn: bool = True) -> DataFrame:
    """Failures of several capture pairs in one plan, keyed by ``pair_id``.

    The pair is part of the key, so all pairs share one shuffle per side.
    """
    def tagged(index: int) -> DataFrame:
        union = None
        for pair in pairs:
            side = pair[index].withColumn("pair_id", F.lit(pair[0]))
            union = side if union is None else union.unionByName(side)
        return union

    return compare_captures(tagged(1), tagged(2), ignore_fields, ignore_lsn, ["pair_id", "table_name"])
