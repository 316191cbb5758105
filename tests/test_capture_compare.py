"""Capture comparison: the golden documents, every failure kind, ignore rules, properties."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from driftline.functions.keys import key_columns_value
from driftline.operators.compare import (
    common_tables, compare_captures, compare_many, comparison_summary, extra_tables, missing_tables)
from driftline.operators.netchange import capture_records
from driftline.operators.skew import salted_left_join
from driftline.sources.captures import load_capture, parse_capture_json, parse_captures, parse_table_documents

# Recorded documents (fixed values).
ORDERS = [
    {"__$table": "dbo.SalesOrder", "__$operation": 4, "__$start_lsn": "AAAIRQAABHgAAg==", "__$primary_key": 1,
     "new_OrderStatus": "Invoiced", "old_OrderStatus": "Open",
     "new_CustomerEmail": "expeditedorders@acme.com", "old_CustomerEmail": "orders@acme.com"},
    {"__$table": "dbo.SalesOrder", "__$operation": 4, "__$start_lsn": "AAAIRQAABKgABA==", "__$primary_key": 2,
     "new_OrderStatus": "Invoiced", "old_OrderStatus": "Open"},
]
DETAILS = [
    {"__$table": "dbo.SalesOrderDetail", "__$operation": 4, "__$start_lsn": "AAAIRQAABJAABw==", "__$primary_key": 2,
     "new_ProductDescription": "Widget Type B", "old_ProductDescription": "Standard Widget Type B"},
    {"__$table": "dbo.SalesOrderDetail", "__$operation": 4, "__$start_lsn": "AAAIRQAABLAABw==", "__$primary_key": 6,
     "new_ProductDescription": "Annual Support", "old_ProductDescription": "Annual Support Package"},
]


def without(record, *fields):
    return {k: v for k, v in record.items() if k not in fields}


def capture(spark, document):
    df = spark.createDataFrame([(json.dumps(document),)], "doc string")
    return parse_capture_json(df, "doc")


def golden(spark, lsn="x"):
    baseline = {"dbo_SalesOrder": ORDERS, "dbo_SalesOrderDetail": DETAILS}
    test = {
        "dbo_SalesOrder": [without(ORDERS[0], "new_CustomerEmail", "old_CustomerEmail"), ORDERS[1]],
        "dbo_SalesOrderDetail": [DETAILS[0], {**DETAILS[1], "new_ProductDescription": "Annual Support - Lump Sum"}],
    }
    test = {t: [{**r, "__$start_lsn": lsn} for r in records] for t, records in test.items()}
    return capture(spark, baseline), capture(spark, test)


KEY = ("table_name", "failure_type", "primary_key", "field_name", "baseline_value", "test_value")


@pytest.mark.parametrize("digest_first", [False, True])
def test_golden_documents(spark, listed, digest_first):
    baseline, test = golden(spark)
    failures = compare_captures(baseline, test, digest_first=digest_first)
    assert listed(failures, *KEY) == sorted([
        ("dbo_SalesOrder", "FieldMismatch", "1", "new_CustomerEmail", "expeditedorders@acme.com", None),
        ("dbo_SalesOrder", "FieldMismatch", "1", "old_CustomerEmail", "orders@acme.com", None),
        ("dbo_SalesOrderDetail", "FieldMismatch", "6", "new_ProductDescription", "Annual Support",
         "Annual Support - Lump Sum"),
    ], key=repr)
    assert listed(comparison_summary(baseline, test, failures)) == [(2, 4, 28, 3, 2, False)]


def test_lsn_counted_on_request(spark):
    assert compare_captures(*golden(spark), ignore_lsn=False).count() == 7


def record(key, op=4, **fields):
    return {"__$operation": op, "__$primary_key": key, **fields}


def test_every_failure_kind(spark, listed):
    baseline = capture(spark, {
        "only_left": [record(1)],
        "both": [record(1, v="a"), record(2, v="a"), record(3, v="a"), record(5, op=2, v="a")],
    })
    test = capture(spark, {
        "only_right": [record(1)],
        "both": [record(1, v="a"), record(2, v="b"), record(4, v="a"), record(5, op=1, v="a"), record(6)],
    })
    failures = compare_captures(baseline, test)
    assert listed(failures, *KEY) == sorted([
        ("only_left", "MissingTable", None, None, None, None),
        ("only_right", "ExtraTable", None, None, None, None),
        ("both", "RecordCountMismatch", None, None, "4", "5"),
        ("both", "MissingRecord", "3", None, None, None),
        ("both", "ExtraRecord", "4", None, None, None),
        ("both", "ExtraRecord", "6", None, None, None),
        ("both", "OperationMismatch", "5", "__$operation", "2", "1"),
        ("both", "FieldMismatch", "2", "v", "a", "b"),
    ], key=repr)
    texts = {r.failure_type: r.description for r in failures.collect()}
    assert texts["MissingTable"] == "Table 'only_left' exists in baseline but not in test capture"
    assert texts["RecordCountMismatch"] == "Record count mismatch in table 'both': baseline has 4, test has 5"
    assert texts["FieldMismatch"] == "Field 'v' mismatch for record '2' in table 'both'"
    assert listed(missing_tables(baseline, test)) == [("only_left",)]
    assert listed(extra_tables(baseline, test)) == [("only_right",)]
    assert listed(common_tables(baseline, test)) == [("both",)]


JSON_VALUES = [
    (1, 1, True), (1, "1", False), (1.0, 1.00, True), (1, 1.0, True), (1.5, 1.25, False), (True, True, True),
    (True, "true", False), (None, None, True), (None, 0, False), ("a", "A", False), ("", None, False),
    ({"a": 1}, {"a": 1}, True), ({"a": 1}, {"a": 2}, False), ([1, 2], [1, 2], True), ([1, 2], [2, 1], False),
    (10**40, 10**40, True), (10**40, 10**40 + 1, False), (1e-20, 2e-20, False), (1e20, 10**20, True),
    (1e20, 10**20 + 1, False), (1e5, 100000, True), (10, 1, False), (100, 100.0, True), (-1.50, -1.5, True),
]
NUMBER_TEXTS = [
    ("0.1234567890123456789012345", "0.1234567890123456789012346", False), ("1.0", "1.00", True), ("10.0", "10", True),
    ("123456789012345678901234567890123456789012.5", "123456789012345678901234567890123456789012.50", True),
    ("0.10", "0.1", True), ("0.0", "0", True), ("1000", "1", False),
]


def test_values_compare_as_json(spark, listed):
    """One table per pair of values; a table fails when they differ."""
    texts = [(json.dumps(x), json.dumps(y), equal) for x, y, equal in JSON_VALUES] + NUMBER_TEXTS
    side = lambda i: "{%s}" % ",".join(
        '"t%d":[{"__$primary_key":1,"v":%s}]' % (n, case[i]) for n, case in enumerate(texts))
    a, b = (parse_capture_json(spark.createDataFrame([(side(i),)], "doc string"), "doc") for i in (0, 1))
    failed = {r[0] for r in listed(compare_captures(a, b), "table_name")}
    wrong = [case for n, case in enumerate(texts) if (f"t{n}" not in failed) is not case[2]]
    assert not wrong


def test_null_equals_absent(spark):
    a = capture(spark, {"t": [record(1, v=None, w=1)]})
    b = capture(spark, {"t": [record(1, w=1)]})
    assert compare_captures(a, b).count() == 0


def test_keys_null_and_absent(spark, listed):
    parsed = capture(spark, {"t": [record(None), {"v": 1}, record("k")]})
    assert listed(parsed, "pk") == [("k",), ("null",), ("unknown",)]


def test_last_duplicate_wins_but_raw_count_stays(spark, listed):
    a = capture(spark, {"t": [record(1, v="old"), record(1, v="new")]})
    b = capture(spark, {"t": [record(1, v="new")]})
    assert listed(compare_captures(a, b), "failure_type") == [("RecordCountMismatch",)]


@pytest.mark.parametrize("ignore", ["LogDate", "logdate", "LOGDATE"])
def test_ignored_field_spellings(spark, listed, ignore):
    a = capture(spark, {"t": [record(1, LogDate=1, old_LogDate=1, new_LogDate=1, v=1)]})
    b = capture(spark, {"t": [record(1, LogDate=2, old_LogDate=2, new_LogDate=2, v=2)]})
    assert listed(compare_captures(a, b, [ignore]), "field_name") == [("v",)]


def test_ignoring_one_side_keeps_the_other(spark, listed):
    a = capture(spark, {"t": [record(1, old_v=1, new_v=1)]})
    b = capture(spark, {"t": [record(1, old_v=2, new_v=2)]})
    assert listed(compare_captures(a, b, ["old_v"]), "field_name") == [("new_v",)]


def random_capture(seed):
    rng = random.Random(seed)
    return {t: [record(rng.randrange(20), rng.choice([1, 2, 4]), **{
        f: rng.choice([None, 1, "1", 1.5, "x"]) for f in rng.sample("abcd", rng.randrange(5))})
        for _ in range(rng.randrange(1, 30))] for t in rng.sample(["t1", "t2", "t3"], 2)}


def brute(a, b):
    """Failures by dictionary lookups."""
    found = []
    for t in a.keys() - b.keys():
        found.append((t, "MissingTable", None, None))
    for t in b.keys() - a.keys():
        found.append((t, "ExtraTable", None, None))
    for t in a.keys() & b.keys():
        left = {str(r["__$primary_key"]): r for r in a[t]}
        right = {str(r["__$primary_key"]): r for r in b[t]}
        if len(a[t]) != len(b[t]):
            found.append((t, "RecordCountMismatch", None, None))
        found += [(t, "MissingRecord", k, None) for k in left.keys() - right.keys()]
        found += [(t, "ExtraRecord", k, None) for k in right.keys() - left.keys()]
        for k in left.keys() & right.keys():
            x, y = left[k], right[k]
            if x["__$operation"] != y["__$operation"]:
                found.append((t, "OperationMismatch", k, "__$operation"))
            for f in x.keys() | y.keys():
                u, v = x.get(f), y.get(f)
                if not f.startswith("__$") and (type(u), u) != (type(v), v):
                    found.append((t, "FieldMismatch", k, f))
    return sorted(found, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_random_captures_against_brute_force(spark, listed, seed):
    a, b = random_capture(seed), random_capture(seed + 100)
    left, right = capture(spark, a), capture(spark, b)
    columns = ("table_name", "failure_type", "primary_key", "field_name")
    assert listed(compare_captures(left, right), *columns) == brute(a, b)
    assert listed(compare_captures(left, right, digest_first=True), *columns) == brute(a, b)
    assert compare_captures(left, left).count() == 0
    mirrored = {"MissingRecord": "ExtraRecord", "ExtraRecord": "MissingRecord",
                "MissingTable": "ExtraTable", "ExtraTable": "MissingTable"}
    swapped = [(t, mirrored.get(k, k), p, f) for t, k, p, f in listed(compare_captures(right, left), *columns)]
    assert sorted(swapped, key=repr) == brute(a, b)


def test_many_pairs_equal_single_comparisons(spark, listed):
    a, b, c = (capture(spark, random_capture(s)) for s in (1, 2, 3))
    many = compare_many([("ab", a, b), ("bc", b, c)])
    columns = ("table_name", "failure_type", "primary_key", "field_name", "description")
    assert listed(many.filter("pair_id = 'ab'"), *columns) == listed(compare_captures(a, b), *columns)
    assert listed(many.filter("pair_id = 'bc'"), *columns) == listed(compare_captures(b, c), *columns)


def test_load_capture_rejects_bad_documents(spark, listed):
    headers = spark.createDataFrame(
        [("h1", "s1", "baseline-capture"), ("h2", "s1", "baseline.capture")],
        "capture_header_id string, session_id string, capture_name string")
    details = spark.createDataFrame([
        ("h1", "good", json.dumps([record(1, v=1), record(2)])), ("h1", "bad", "[{"), ("h1", "scalar", "[1]"),
        ("h2", "other", "[]")], "capture_header_id string, table_name string, capture_data string")
    records, rejects = load_capture(headers, details, "baseline-capture", "s1")
    assert listed(records, "table_name", "ordinal", "pk") == [("good", 0, "1"), ("good", 1, "2")]
    assert listed(rejects, "table_name") == [("bad",), ("scalar",)]


def test_capture_names_resolve_to_one_capture(spark):
    headers = spark.createDataFrame([("h1", "s1", "c"), ("h2", "s2", "c")],
                                    "capture_header_id string, session_id string, capture_name string")
    details = spark.createDataFrame([("h1", "t", "[]")], "capture_header_id string, table_name string, capture_data string")
    with pytest.raises(ValueError):
        load_capture(headers, details, "c")
    with pytest.raises(LookupError):
        load_capture(headers, details, "absent")
    load_capture(headers, details, "c", "s1")


def test_documents_in_parts_keep_their_order(spark, listed):
    details = spark.createDataFrame([
        ("t", 1, json.dumps([record(1, v="last")])), ("t", 0, json.dumps([record(1, v="first"), record(2)]))],
        "table_name string, part int, capture_data string")
    records, _ = parse_table_documents(details, part="part")
    whole = capture(spark, {"t": [record(1, v="last"), record(2), record(3)]})
    kinds = listed(compare_captures(records, whole), "failure_type", "primary_key")
    assert kinds == [("ExtraRecord", "3")]


def test_hot_key_is_reduced_before_the_join(spark):
    """A third of all rows share one key: the plan aggregates before its exchange."""
    from pyspark.sql import functions as F

    base = spark.range(30000).select(
        F.lit("t").alias("table_name"), F.col("id").alias("ordinal"),
        F.when(F.col("id") % 3 == 0, "unknown").otherwise(F.col("id").cast("string")).alias("pk"),
        F.create_map(F.lit("v"), F.struct(F.lit("bigint").alias("kind"), F.col("id").cast("string").alias("val"))).alias("fields"))
    failures = compare_captures(base, base)
    assert failures.count() == 0
    plan = failures._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
    assert plan.count("FullOuter") == 1


def test_documents_longer_than_a_variant(spark, listed):
    """150 records of 1 MB each: more than the 128 MiB that one variant holds."""
    records = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda k: F.concat(
        F.lit('{"__$primary_key":'), k.cast("string"), F.lit(',"a":"'), F.repeat(F.lit("x"), 1_000_000), F.lit('"}'))), ",")
    table = spark.range(1).select(F.lit("t").alias("table_name"), F.concat(F.lit("["), records, F.lit("]")).alias("capture_data"))
    rows, rejects = parse_table_documents(table)
    assert (rows.agg(F.count_distinct("pk")).first()[0], rejects.count()) == (150, 0)
    whole = table.select(F.concat(F.lit('{"t":'), "capture_data", F.lit("}")).alias("doc"))
    rows, rejects = parse_captures(whole, "doc")
    assert (rows.agg(F.count_distinct("pk")).first()[0], rejects.count()) == (150, 0)
    assert parse_capture_json(whole, "doc").count() == 150


def test_bad_documents_are_rejects_or_errors(spark, listed):
    good = ['{"t":[{"a":1}],"u":[]}', '{"t":null}', "{}"]
    bad = ['{"t":[{"a":1}', '{"t":5,"u":[{"a":1}]}', '{"t":[1]}', '{"t":[null]}', "[]", "nope", "", '{"t":[],"t":[]}',
           '{"t":[{"a":1,"a":2}]}', "{'t':[]}", None]
    rows, rejects = parse_captures(spark.createDataFrame([(d,) for d in good + bad], "doc string"), "doc")
    assert listed(rows, "table_name", "ordinal") == [("t", 0)]
    assert {r[0] for r in rejects.collect()} == set(bad)
    for document in bad[:-1]:
        with pytest.raises(Exception, match="not a capture document"):
            parse_capture_json(spark.createDataFrame([(document,)], "doc string"), "doc").collect()
    tables = spark.createDataFrame([("t", d) for d in ("[]", ' [{"a":1}]', '{"a":1}', "[1]", "[null]", '[{"a":1}', None)],
                                   "table_name string, capture_data string")
    rows, rejects = parse_table_documents(tables)
    assert rows.count() == 1 and rejects.count() == 5


def test_composite_keys_with_separators_and_nulls(spark, listed):
    """Parts that hold the separator, or read like the mark of a null, make keys of their own."""
    columns = "a string, b string, v int"
    left = spark.createDataFrame([("a|b", "c", 1), (None, "c", 2), ("x", "y", 3), ("\\", "z", 4)], columns)
    right = spark.createDataFrame([("a", "b|c", 1), ("<null>", "c", 2), ("x", "y", 3), ("\\", "z", 5)], columns)
    records = lambda df: capture_records(df, "dbo_t", ["a", "b"], F.lit(0))
    failures = compare_captures(records(left), records(right))
    assert sorted(r.failure_type for r in failures.select("failure_type").collect()) == [
        "ExtraRecord", "ExtraRecord", "FieldMismatch", "MissingRecord", "MissingRecord"]
    values = ["a", "a|b", "b", "", "|", "\\", "<null>", "\\<null>", None, "\\|", "a\\", "|b"]
    pairs = spark.createDataFrame([(x, y) for x in values for y in values], "a string, b string")
    assert pairs.select(key_columns_value(["a", "b"])).distinct().count() == len(values) ** 2


def test_frequent_keys_are_split_by_their_count(spark, listed):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), "id")
    lookup = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = salted_left_join(rows, lookup, "k", F.col("id"), parts=20, few=10)
    assert listed(joined, "k", "id", "v") == listed(rows.join(lookup, "k", "left"), "k", "id", "v")
