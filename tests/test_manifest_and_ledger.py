"""Table filters and ledger jobs on literal rows."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from driftline.operators import ledger as L
from driftline.sources import manifest as M

MANIFEST = "catalog string, schema string, name string, pk_columns array<string>, capture_instance string"


def manifest(spark, *names):
    return spark.createDataFrame([("db", "dbo", n, ["Id"], f"dbo_{n}") for n in names], MANIFEST)


@pytest.mark.parametrize("tables,include,exclude,expected", [
    (["Orders", "Customers", "AuditLog"], ["dbo.Orders", "dbo.Customers"], None, ["Customers", "Orders"]),
    (["Orders", "Customers", "AuditLog"], None, ["dbo.AuditLog"], ["Customers", "Orders"]),
    (["Orders", "Customers", "Products", "AuditLog"], ["dbo.Orders", "dbo.Customers", "dbo.AuditLog"], ["dbo.AuditLog"],
     ["Customers", "Orders"]),
    (["Orders", "Customers"], ["DBO.ORDERS", "dbo.customers"], None, ["Customers", "Orders"]),
    (["Orders", "Customers", "Products"], None, None, ["Customers", "Orders", "Products"]),
    (["Orders", "Customers"], [], [], ["Customers", "Orders"]),
    (["AaCompanyConfig", "Orders", "Customers"], ["AaCompanyConfig"], None, ["AaCompanyConfig"]),
    (["AaCompanyConfig", "Orders", "Customers"], ["aacompanyconfig"], None, ["AaCompanyConfig"]),
    (["Orders", "Customers"], ["dbo.NonExistent"], None, []),
])
def test_filter_cases(spark, listed, tables, include, exclude, expected):
    df = manifest(spark, *tables)
    assert [r[0] for r in listed(M.filter_tables(df, include, exclude), "name")] == expected
    entries = lambda names: None if not names else spark.createDataFrame([(n,) for n in names], "entry string")
    assert [r[0] for r in listed(M.filter_tables_by(df, entries(include), entries(exclude)), "name")] == expected


def test_listing_and_eligibility(spark, listed):
    df = spark.createDataFrame([
        ("db", "dbo", "a", ["id"], "dbo_a"), ("db", "dbo", "b", [], "dbo_b"), ("db", "dbo", "c", ["id"], None),
        ("db", "cdc", "x", ["id"], "x"), ("db", "dbo", "ddl_history", ["id"], "x"), ("db", "dbo", "columns", ["id"], "x")], MANIFEST)
    assert [r[0] for r in listed(M.list_tables(df), "name")] == ["a", "b", "c", "columns"]
    status = dict(listed(M.eligible_tables(df), "name", "capture_status"))
    assert (status["a"], status["b"], status["c"]) == ("enabled", "skipped", "skipped")
    with pytest.raises(ValueError):
        M.require_eligible(df, ["b"])
    assert M.require_eligible(df, ["a", "b"]).count() == 1


def test_names_only_right(spark, listed):
    left = spark.createDataFrame([("A",), ("b",)], "name string")
    right = spark.createDataFrame([("a",), ("C",), ("c",), ("B",), ("d",)], "name string")
    assert [r.name for r in M.tables_only_right(left, right).collect()] == ["C", "d"]
    with pytest.raises(ValueError):
        M.distinct_field(left, "absent")


ORDERS = ("sales_order_id int, order_number string, customer_name string, order_status string, sub_total decimal(18,2), "
          "tax_amount decimal(18,2), total_amount decimal(18,2), notes string")
LINES = "sales_order_id int, line_number bigint, product_code string, quantity decimal(18,4), unit_price decimal(18,4), line_total decimal(28,4)"
D = Decimal


@pytest.fixture(scope="module")
def books(spark):
    orders = spark.createDataFrame([
        (1, "SO-1", "Acme", "Open", D(100), D(8), D(108), None), (2, "SO-2", "Beta", "Invoiced", D(50), D(4), D(54), "n"),
        (3, "SO-3", "Core", "Open", D(10), D(1), D(11), "n"), (4, "SO-4", "Dyna", "Cancelled", D(1), D(0), D(1), None)], ORDERS)
    lines = spark.createDataFrame([(1, 1, "A", D(2), D(25), D(50)), (1, 2, "B", D(1), D(50), D(50)), (3, 1, "C", D(1), D(10), D(10))], LINES)
    accounts = spark.createDataFrame([(2, "1200", "Receivable", "Asset"), (9, "4000", "Sales", "Revenue"), (1, "1000", "Cash", "Asset")],
                                     "account_id int, account_number string, account_name string, account_type string")
    return orders, lines, accounts


def test_invoice_post_and_balance(spark, listed, books):
    orders, lines, accounts = books
    requests = spark.createDataFrame([(1,), (2,), (3,), (99,), (3,)], "sales_order_id int")
    date = F.to_timestamp(F.lit("2024-03-01"))
    done = L.invoice_orders(requests, orders, lines, accounts, date, last_ar=998, last_gl=7)
    assert listed(done["rejects"]) == [(2, "cannot be invoiced, status Invoiced"), (99, "not found")]
    assert listed(done["ar"], "sales_order_id", "ar_transaction_id", "transaction_number", "outstanding_amount") == [
        (1, 999, "AR-2024-999", D("108.00")), (3, 1000, "AR-2024-1000", D("11.00"))]
    assert [str(r[0]) for r in listed(done["ar"], "due_date")] == ["2024-03-31 00:00:00"] * 2
    assert listed(done["ar_lines"], "ar_transaction_id", "line_number", "product_code") == [(1000, 1, "C"), (999, 1, "A"), (999, 2, "B")]
    assert dict(listed(done["orders"], "sales_order_id", "order_status")) == {1: "Invoiced", 2: "Invoiced", 3: "Invoiced", 4: "Cancelled"}
    headers = done["gl"].withColumn("posting_date", F.lit(None).cast("timestamp"))
    posted = L.post_gl(headers, done["gl_lines"], date)
    assert posted["rejects"].count() == 0
    again = L.post_gl(posted["headers"], done["gl_lines"], date)
    assert {r[0] for r in listed(again["rejects"], "reason")} == {"already posted"}
    balance = lambda day: dict(listed(L.account_balances(
        accounts, done["gl_lines"], posted["headers"], F.to_timestamp(F.lit(day))), "account_number", "balance"))
    assert balance("2024-03-01") == {"1000": D("0.00"), "1200": D("119.00"), "4000": D("119.00")}
    assert balance("2024-02-29")["1200"] == D("0.00")


def test_missing_account_rejects_all(spark, listed, books):
    orders, lines, accounts = books
    done = L.invoice_orders(orders.select("sales_order_id"), orders, lines, accounts.filter("account_id = 2"),
                            F.to_timestamp(F.lit("2024-03-01")))
    assert done["ar"].count() == 0
    assert dict(listed(done["rejects"]))[1] == "revenue account not found"


def test_out_of_balance(spark, listed):
    headers = spark.createDataFrame([(1, "GL-1", False, None), (2, "GL-2", False, None)],
                                    "gl_transaction_id int, transaction_number string, is_posted boolean, posting_date timestamp")
    lines = spark.createDataFrame([(1, D(5), None), (1, None, D("4.50"))],
                                  "gl_transaction_id int, debit_amount decimal(18,2), credit_amount decimal(18,2)")
    done = L.post_gl(headers, lines, F.to_timestamp(F.lit("2024-03-01")))
    assert listed(done["rejects"]) == [(1, "GL-1", "out of balance. Debits: 5.00, Credits: 4.50")]
    assert dict(listed(done["headers"], "gl_transaction_id", "is_posted")) == {1: False, 2: True}


def test_payments(spark, listed):
    invoices = spark.createDataFrame([(1, "A", D(100), "Open"), (2, "B", D(50), "Open"), (3, "C", D(5), "Open")],
                                     "ar_transaction_id int, customer_name string, outstanding_amount decimal(18,2), transaction_status string")
    payments = spark.createDataFrame([(1, 1, D(30)), (2, 1, D(20)), (3, 2, D(50)), (4, 9, D(1))],
                                     "payment_id int, ar_transaction_id int, amount decimal(18,2)")
    done = L.apply_payments(invoices, payments, F.to_timestamp(F.lit("2024-03-01")))
    assert listed(done["invoices"], "ar_transaction_id", "outstanding_amount", "transaction_status") == [
        (1, D("50.00"), "Partially Paid"), (2, D("0.00"), "Paid"), (3, D("5.00"), "Open")]
    assert listed(done["payments"], "payment_id", "description") == [
        (1, "Partial payment received"), (2, "Partial payment received"), (3, "Full payment received")]


def test_amend_and_delete(spark, listed, books):
    orders, lines, _ = books
    amendments = spark.createDataFrame([
        (1, "add", "RUSH", D(1), D(75), D(75), D(6), " [M]"), (3, "cancel", None, None, None, None, None, " [C]"),
        (4, "add", "RUSH", D(1), D(75), D(75), D(6), " [M]"), (2, "cancel", None, None, None, None, None, " x"),
        (2, "cancel", None, None, None, None, None, " y"), (9, "cancel", None, None, None, None, None, " z")],
        "sales_order_id int, kind string, product_code string, quantity decimal(18,4), unit_price decimal(18,4), "
        "amount decimal(18,2), tax decimal(18,2), note string")
    done = L.amend_orders(orders, lines, amendments)
    assert listed(done["orders"], "sales_order_id", "order_status", "total_amount", "notes") == [
        (1, "Open", D("189.00"), " [M]"), (2, "Invoiced", D("54.00"), "n"), (3, "Cancelled", D("11.00"), "n [C]"),
        (4, "Cancelled", D("1.00"), None)]
    assert listed(done["lines"].filter("product_code = 'RUSH'"), "sales_order_id", "line_number", "line_total") == [(1, 3, D("75.0000"))]
    assert listed(done["rejects"], "sales_order_id", "reason") == [
        (2, "amended more than once"), (2, "amended more than once"), (4, "not open"), (9, "not found")]
    gone = L.delete_orders(spark.createDataFrame([(1,), (2,), (8,)], "sales_order_id int"), orders, lines)
    assert listed(gone["orders"], "sales_order_id") == [(2,), (3,), (4,)]
    assert listed(gone["lines"], "sales_order_id") == [(3,)]
    assert listed(gone["rejects"]) == [(2, "cannot delete an invoiced order"), (8, "not found")]


def test_modified_stamp(spark, listed):
    schema = "id int, v string, modified_date string"
    before = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], schema)
    after = spark.createDataFrame([(1, "a", "own"), (2, "x", "own"), (3, "n", "own")], schema)
    assert listed(L.stamp_modified(before, after, ["id"], F.lit("now"))) == [(1, "a", "own"), (2, "x", "now"), (3, "n", "own")]


def test_document_numbers_continue_per_year(spark, listed):
    used = spark.createDataFrame([("AR-2023-009",), ("AR-2024-998",), ("GL-2024-999",), ("AR-2024-0x",)], "n string")
    new = spark.createDataFrame([(i, f"{y}-05-05") for i, y in enumerate([2023, 2024, 2024, 2024, 2025])], "i int, d string")
    got = L.assign_document_numbers(used, "n", "AR", new.withColumn("d", F.to_date("d")), "d", ["i"])
    assert [r[1] for r in listed(got, "i", "transaction_number")] == [
        "AR-2023-010", "AR-2024-999", "AR-2024-1000", "AR-2024-1001", "AR-2025-001"]
