"""Profile differences and normalized comparison on literal rows."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftline.functions import values as V
from driftline.functions.keys import row_key
from driftline.operators import normalized as M
from driftline.operators import profile_diff as P
from driftline.operators.netchange import capture_records


def records(df, table="dbo_t", keys=("id",)):
    return capture_records(df, table, list(keys), F.lit(0))


def manifest(spark, *names, pk=("id",)):
    return spark.createDataFrame([("dbo", n, list(pk)) for n in names], "schema string, name string, pk_columns array<string>")


def test_profile_rows_and_fields(spark, listed):
    left = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "id int, v string, w int")
    right = spark.createDataFrame([(1, "a", 1), (2, "x", 1), (4, "d", 1)], "id int, v string, w int")
    diffs = P.diff_profiles(manifest(spark, "t"), records(left), records(right))
    assert listed(diffs, "key", "action", "field_name", "field_action", "left_value", "right_value") == [
        ("2", "Changed", "v", "Changed", "b", "x"), ("3", "Deleted", None, None, None, None),
        ("4", "New", None, None, None, None)]
    assert listed(P.diff_stats(diffs)) == [("dbo_t", 3, 1, 1, 1, 1)]
    assert listed(P.diff_totals(diffs)) == [(1, 3, 1, 1, 1, False)]
    parity = P.diff_profiles(manifest(spark, "t"), records(left), records(right), parity=True)
    assert listed(parity, "key", "action") == [("2", "Changed")]


def test_fields_on_one_side(spark, listed):
    left = spark.createDataFrame([(1, "a", 1)], "id int, v string, gone int")
    right = spark.createDataFrame([(1, "a", 1)], "id int, v string, added int")
    diffs = P.diff_profiles(manifest(spark, "t"), records(left), records(right))
    assert listed(diffs, "field_name", "field_action") == [("added", "New"), ("gone", "Deleted")]
    parity = P.diff_profiles(manifest(spark, "t"), records(left), records(right), parity=True)
    assert listed(parity, "field_name", "field_action") == [("gone", "Deleted")]


def test_keyless_and_whole_tables(spark, listed):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    left, right = records(df, "dbo_a"), records(df, "dbo_b")
    assert listed(P.diff_profiles(manifest(spark, "a", "b"), left, right, parity=True), "table_name", "action") == [
        ("dbo_a", "Deleted"), ("dbo_b", "New")]
    assert P.diff_profiles(manifest(spark, "a", "b", pk=()), left, right).count() == 0


def test_recent_times_are_forgiven(spark, listed):
    rows = lambda *times: spark.createDataFrame(
        [(i, datetime(2024, 1, d)) for i, d in enumerate(times)], "id int, at timestamp")
    left, right = records(rows(1, 1, 1)), records(rows(10, 11, 20))
    now = "TIMESTAMP '2024-01-10 12:00:00'"
    assert listed(P.diff_profiles(manifest(spark, "t"), left, right, now), "key") == [("2",)]
    assert P.diff_profiles(manifest(spark, "t"), left, right).count() == 3


@pytest.mark.parametrize("value,expected", [(0.0000005, 0.0), (1.2345675, None), (2.5, 2.5), (-0.1234567, -0.123457)])
def test_doubles_round_to_six_places(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v double")
    got = V.normalize_columns(df).first().v
    assert abs(got - value) <= 5.1e-7 and (expected is None or got == expected)


def test_decimals_round_half_to_even(spark):
    df = spark.sql("SELECT CAST('0.0000005' AS DECIMAL(18,8)) AS a, CAST('0.0000015' AS DECIMAL(18,8)) AS b")
    row = V.normalize_columns(df).first()
    assert (float(row.a), float(row.b)) == (0.0, 0.000002)


def test_windows_count_from_year_one(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-05-05 13:37:21' AS event_time, TIMESTAMP '2024-05-05 13:37:21' AS at")
    five = V.normalize_columns(df, 5 * 60 * 10**6).first()
    assert five.event_time == datetime(2024, 5, 5, 13, 35) and five["at"] == datetime(2024, 5, 5, 13, 37, 21)
    assert V.normalize_columns(df).first().event_time == datetime(2024, 5, 5)
    # Seven-day windows differ between an origin in year 1 and one in 1970.
    week = V.normalize_columns(df, 7 * 24 * 3600 * 10**6).first().event_time
    assert (week - datetime(1, 1, 1)).days % 7 == 0
    assert V.normalize_columns(df, 0).first().event_time == datetime(2024, 5, 5, 13, 37, 21)


def test_normalizing_twice_changes_nothing(spark, listed):
    df = spark.sql("SELECT TIMESTAMP '2024-05-05 13:37:21.123456' AS created, 1.23456789D AS x, X'0102' AS b, "
                   "CAST('1.00000049' AS DECIMAL(18,8)) AS d, 'ModifiedDate' AS LastModified")
    once = V.normalize_columns(df)
    assert once.columns == ["created", "x", "b", "d"]
    assert listed(V.normalize_columns(once)) == listed(once)


def test_excluded_columns():
    columns = ["Id", "ModifiedDate", "lastmodified", "OrderDate", "RowVersion", "Notes", "a.b"]
    assert V.keep_columns(columns) == ["Id", "OrderDate", "RowVersion", "Notes", "a.b"]
    assert V.keep_columns(columns, (), ("row*", "NOTE", "a.?", "")) == ["Id", "ModifiedDate", "lastmodified", "OrderDate"]


def test_row_keys(spark, listed):
    df = spark.createDataFrame([(7, "a"), (8, "b")], "Id int, v string")
    assert listed(records(df, keys=("Id",)).select(row_key(F.col("fields")))) == [("Id:7",), ("Id:8",)]
    plain = spark.createDataFrame([("a", None), ("a", "x")], "v string, w string")
    import hashlib
    expected = [(hashlib.sha256(t.encode()).hexdigest().upper()[:16],) for t in ("v:a;w:NULL;", "v:a;w:x;")]
    assert listed(records(plain, keys=("v",)).select(row_key(F.col("fields")))) == sorted(expected)


def test_normalized_comparison(spark, listed):
    left = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, None)], "Id int, x double, v string")
    right = spark.createDataFrame([(1, 1.0 + 5e-7, "a"), (2, 2.1, "b"), (4, 3.0, "c")], "Id int, x double, v string")
    diffs = M.compare_normalized(records(left, keys=("Id",)), records(right, keys=("Id",)))
    assert listed(diffs, "row_key", "action", "field_name", "difference_type") == [
        ("Id:2", "Changed", "x", "ValueChanged"), ("Id:3", "Deleted", None, None), ("Id:4", "Added", None, None)]
    report = M.difference_report(diffs, spark.createDataFrame([("dbo_t",), ("dbo_same",)], "table_name string"))
    assert listed(report) == [("dbo_same", 0, 0, 0, 0, []), ("dbo_t", 3, 1, 1, 1, ["x"])]
    assert listed(M.report_text(report).filter("table_name = 'dbo_t'"), "summary") == [
        ("Table: dbo_t\n  Match: False\n  Differences: 3\n  Changed: 1, New: 1, Deleted: 1",)]


def test_difference_kinds(spark, listed):
    left = spark.sql("SELECT 1 AS Id, CAST(NULL AS STRING) AS a, 'x' AS b, 1 AS c, 1 AS d")
    right = spark.sql("SELECT 1 AS Id, 'x' AS a, CAST(NULL AS STRING) AS b, '1' AS c, 2 AS d")
    diffs = M.compare_normalized(records(left, keys=("Id",)), records(right, keys=("Id",)))
    assert listed(diffs, "field_name", "difference_type") == [
        ("a", "Added"), ("b", "Removed"), ("c", "TypeChanged"), ("d", "ValueChanged")]


def test_rows_without_a_key_show_as_deleted_and_added(spark, listed):
    left = spark.createDataFrame([("a", 1)], "name string, v int")
    right = spark.createDataFrame([("a", 2)], "name string, v int")
    diffs = M.compare_normalized(records(left, keys=("name",)), records(right, keys=("name",)))
    assert listed(diffs, "action") == [("Added",), ("Deleted",)]


def test_repeated_and_like_rows_are_all_compared(spark, listed):
    """Rows without a key count, texts that read alike differ, and no row of a repeated key is left out."""
    def side(rows, columns, keys):
        return records(spark.createDataFrame(rows, columns), keys=keys)

    def found(left, right, columns="v string, w string", keys=("v",)):
        diffs = M.compare_normalized(side(left, columns, keys), side(right, columns, keys))
        report = listed(M.difference_report(diffs), "total_rows", "changed_rows", "new_rows", "deleted_rows")
        return listed(diffs, "action", "row_count"), report

    assert found([("a", "b")] * 3, [("a", "b")]) == ([("Deleted", 2)], [(2, 0, 0, 2)])
    assert found([("a", "b")] * 2, [("a", "b")] * 2) == ([], [])
    for one, other in ((("a", None), ("a", "NULL")), (("a;w:b", None), ("a", "b;w:NULL"))):
        assert found([one], [other]) == ([("Added", 1), ("Deleted", 1)], [(2, 0, 1, 1)])
    versions = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "Id int, v string, w int")
    both, last = (capture_records(df, "dbo_t", ["Id"], F.col("w")) for df in (versions, versions.where("w = 2")))
    assert listed(M.compare_normalized(both, last), "action", "row_count") == [("Deleted", 1)]
    assert listed(M.compare_normalized(both, both)) == []


def test_digests_are_taken_once(spark, listed):
    left = records(spark.createDataFrame([(1, "a"), (2, "b")], "Id long, name string"), keys=("Id",))
    right = records(spark.createDataFrame([(1, "c"), (3, "d")], "Id long, name string"), keys=("Id",))
    diffs = M.compare_normalized(left, right)
    # The pairs were written: the digests of a side are only taken again of the rows that are paired.
    assert any("/pairs-" in name for name in diffs.inputFiles())
    assert sorted(listed(diffs, "row_key", "action", "field_name")) == [
        ("Id:1", "Changed", "name"), ("Id:2", "Deleted", None), ("Id:3", "Added", None)]


def test_unmapped_type_is_an_error(spark):
    df = spark.sql("SELECT INTERVAL 1 DAY AS i")
    with pytest.raises(TypeError):
        capture_records(df, "t", ["i"], F.lit(0))


def test_keys_come_from_the_manifest(spark, listed):
    """All key columns make the key; an absent one reads <null>, and of equal keys the last counts."""
    left = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (1, "y", 2)], "a int, b string, v int")
    right = spark.createDataFrame([(1, "x", 1), (1, "y", 3)], "a int, b string, v int")
    ordered = lambda df: capture_records(df, "dbo_t", ["a"], F.col("v"))
    keyed = manifest(spark, "t", pk=("a", " b"))
    diffs = P.diff_profiles(keyed, ordered(left), ordered(right))
    assert listed(diffs, "key", "left_value", "right_value") == [("1|y", "2", "3")]
    parity = P.diff_profiles(keyed, ordered(left), ordered(right), parity=True)
    assert listed(parity, "key") == [("1y",)]
    absent = P.diff_profiles(manifest(spark, "t", pk=("a", "zz")), ordered(left), ordered(right))
    assert listed(absent, "key", "field_name") == [("1|<null>", "v")]
