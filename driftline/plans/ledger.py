"""Queries over ledger tables derived from orders and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.text import document_number
from driftline.operators import ledger as L
from driftline.plans import inputs as I
from driftline.plans.catalog import Catalog

catalog = Catalog()

# Chart of accounts (fixed values).
ACCOUNTS = (
    (1, "1000", "Cash and Cash Equivalents", "Asset"), (2, "1200", "Accounts Receivable", "Asset"),
    (3, "1300", "Inventory", "Asset"), (4, "1400", "Prepaid Expenses", "Asset"),
    (5, "2000", "Accounts Payable", "Liability"), (6, "2100", "Accrued Expenses", "Liability"),
    (7, "3000", "Retained Earnings", "Equity"), (8, "3100", "Common Stock", "Equity"),
    (9, "4000", "Sales Revenue", "Revenue"), (10, "4100", "Service Revenue", "Revenue"),
    (11, "5000", "Cost of Goods Sold", "Expense"), (12, "6000", "Operating Expenses", "Expense"),
)
_VALUES = ", ".join(f"({i}, '{n}', '{a}', '{t}')" for i, n, a, t in ACCOUNTS)
ACCOUNT_SQL = f"SELECT * FROM (VALUES {_VALUES}) AS a(account_id, account_number, account_name, account_type)"


def money(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(18,2))"


ORDER_EXPRS = [
    "o_orderkey AS sales_order_id", "concat('SO-', CAST(o_orderkey AS {text})) AS order_number",
    "concat('Customer ', CAST(o_custkey AS {text})) AS customer_name", "o_orderdate AS order_date",
    "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Invoiced' ELSE 'Cancelled' END AS order_status",
    f"{money('o_totalprice')} AS sub_total", f"{money('0')} AS tax_amount", f"{money('o_totalprice')} AS total_amount",
    "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS notes",
]
LINE_EXPRS = [
    "l_orderkey AS sales_order_id", "CAST(l_linenumber AS BIGINT) AS line_number",
    "concat('P', CAST(l_partkey AS {text})) AS product_code", "CAST(l_quantity AS DECIMAL(18,4)) AS quantity",
    "CAST(l_extendedprice AS DECIMAL(18,4)) AS unit_price",
]
AR_EXPRS = [
    "o_orderkey + 1 AS ar_transaction_id",
    "concat('AR-', CAST(year(o_orderdate) AS {text}), '-', lpad(CAST(o_orderkey % 900 + 1 AS {text}), 3, '0')) AS transaction_number",
    "CASE WHEN o_orderkey % 10 = 0 THEN 'Payment' ELSE 'Invoice' END AS transaction_type",
    "concat('Customer ', CAST(o_custkey AS {text})) AS customer_name", "o_orderdate AS transaction_date",
    f"{money('o_totalprice')} AS transaction_amount",
    f"CASE WHEN o_orderkey % 3 = 0 THEN {money('0')} ELSE {money('o_totalprice')} END AS outstanding_amount",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'Paid' WHEN o_orderkey % 3 = 1 THEN 'Open' ELSE 'Partially Paid' END AS transaction_status",
]
GL_EXPRS = [
    "o_orderkey AS gl_transaction_id", "concat('GL-', CAST(o_orderkey AS {text})) AS transaction_number",
    "o_orderkey % 4 <> 0 AS is_posted", "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS posting_date",
    f"{money('o_totalprice')} AS total_debit_amount",
    f"CASE WHEN o_orderkey % 71 = 0 THEN {money('o_totalprice + 1')} ELSE {money('o_totalprice')} END AS total_credit_amount",
]


def _exprs(exprs, text):
    return [e.replace("{text}", text) for e in exprs]


def _sql(exprs, source):
    return f"SELECT {', '.join(_exprs(exprs, 'VARCHAR'))} FROM {source}"


def _df(spark, sf, exprs, source):
    return I.table(spark, sf, source).selectExpr(*_exprs(exprs, "STRING"))


def orders(spark, sf):
    return _df(spark, sf, ORDER_EXPRS, "orders")


def lines(spark, sf):
    return _df(spark, sf, LINE_EXPRS, "lineitem")


def invoices(spark, sf):
    return _df(spark, sf, AR_EXPRS, "orders")


def gl_headers(spark, sf):
    return _df(spark, sf, GL_EXPRS, "orders")


def accounts(spark, sf):
    return spark.sql(ACCOUNT_SQL)


ORDER_SQL, LINE_SQL, AR_SQL, GL_SQL = (
    _sql(ORDER_EXPRS, "orders"), _sql(LINE_EXPRS, "lineitem"), _sql(AR_EXPRS, "orders"), _sql(GL_EXPRS, "orders"))

# Two postings per order; every 71st order credits one more than it debits.
GL_LINE_SQL = f"""SELECT o_orderkey AS gl_transaction_id, 1 AS line_number, CAST(o_custkey % 12 + 1 AS INTEGER) AS account_id,
  {money('o_totalprice')} AS debit_amount, CAST(NULL AS DECIMAL(18,2)) AS credit_amount FROM orders
UNION ALL SELECT o_orderkey, 2, CAST(o_custkey % 7 + 5 AS INTEGER), NULL,
  CASE WHEN o_orderkey % 71 = 0 THEN {money('o_totalprice + 1')} ELSE {money('o_totalprice')} END FROM orders"""


def gl_lines(spark, sf):
    total = money("o_totalprice")
    credit = f"CASE WHEN o_orderkey % 71 = 0 THEN {money('o_totalprice + 1')} ELSE {total} END"
    return I.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS gl_transaction_id",
        "inline(array(named_struct('line_number', 1, 'account_id', CAST(o_custkey % 12 + 1 AS INT), "
        f"'debit_amount', {total}, 'credit_amount', CAST(NULL AS DECIMAL(18,2))), "
        "named_struct('line_number', 2, 'account_id', CAST(o_custkey % 7 + 5 AS INT), "
        f"'debit_amount', CAST(NULL AS DECIMAL(18,2)), 'credit_amount', {credit})))")


def doubles(df):
    """Decimal columns as doubles, timestamps as days, for the check."""
    shown = []
    for f in df.schema:
        kind = f.dataType.typeName()
        column = F.col(f.name)
        if kind == "decimal":
            column = column.cast("double").alias(f.name)
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd").alias(f.name)
        shown.append(column)
    return df.select(*shown)


# --- checks and reports -------------------------------------------------------------------

@catalog.add("orphans_order_lines", f"SELECT count(*) AS orphans FROM lineitem ANTI JOIN ({I.after_sql('orders', 'test')}) o ON l_orderkey = o_orderkey")
def orphans_order_lines(spark, sf):
    """Lines whose order the workload deleted."""
    return L.orphans(I.table(spark, sf, "lineitem"), I.after_state(spark, sf, "orders", "test"), "l_orderkey", "o_orderkey")


@catalog.add("orphans_ar_lines", f"SELECT count(*) AS orphans FROM lineitem ANTI JOIN ({AR_SQL}) a ON l_orderkey = ar_transaction_id")
def orphans_ar_lines(spark, sf):
    return L.orphans(I.table(spark, sf, "lineitem"), invoices(spark, sf), "l_orderkey", "ar_transaction_id")


@catalog.add("orphans_gl_lines", f"""SELECT count(*) AS orphans FROM ({GL_LINE_SQL}) d
WHERE gl_transaction_id NOT IN (SELECT o_orderkey FROM ({I.after_sql('orders', 'baseline')}) o)""")
def orphans_gl_lines(spark, sf):
    return L.orphans(gl_lines(spark, sf), I.after_state(spark, sf, "orders", "baseline"), "gl_transaction_id", "o_orderkey")


@catalog.add("order_line_counts", f"""SELECT order_number, order_status, CAST(total_amount AS DOUBLE) AS total_amount, count(l.sales_order_id) AS line_items
FROM ({ORDER_SQL}) o LEFT JOIN ({LINE_SQL}) l USING (sales_order_id) GROUP BY ALL""")
def order_line_counts(spark, sf):
    return doubles(L.order_line_counts(orders(spark, sf), lines(spark, sf)))


AS_OF = "1998-06-30"


@catalog.add("gl_posted_lines", f"""SELECT gl_transaction_id, line_number, account_id, CAST(debit_amount AS DOUBLE) AS debit_amount,
  CAST(credit_amount AS DOUBLE) AS credit_amount FROM ({GL_LINE_SQL}) d JOIN ({GL_SQL}) h USING (gl_transaction_id)
WHERE is_posted AND posting_date <= TIMESTAMP '{AS_OF}'""")
def gl_posted_lines(spark, sf):
    rows = L.gl_posted_lines(gl_lines(spark, sf), gl_headers(spark, sf), F.to_timestamp(F.lit(AS_OF)))
    return doubles(rows.drop("posting_date"))


@catalog.add("account_balances", f"""SELECT a.account_id, account_number, account_name, account_type, CAST(coalesce(sum(
  CASE WHEN account_type IN ('Asset', 'Expense') THEN coalesce(debit_amount, 0) - coalesce(credit_amount, 0)
  ELSE coalesce(credit_amount, 0) - coalesce(debit_amount, 0) END), 0) AS DOUBLE) AS balance
FROM ({ACCOUNT_SQL}) a LEFT JOIN (SELECT d.* FROM ({GL_LINE_SQL}) d JOIN ({GL_SQL}) h USING (gl_transaction_id)
  WHERE is_posted AND posting_date <= TIMESTAMP '{AS_OF}') p ON p.account_id = a.account_id GROUP BY ALL""")
def account_balances(spark, sf):
    return doubles(L.account_balances(accounts(spark, sf), gl_lines(spark, sf), gl_headers(spark, sf),
                                      F.to_timestamp(F.lit(AS_OF))))


TOTALS_SQL = (f"SELECT gl_transaction_id, sum(coalesce(debit_amount, 0)) AS debits, sum(coalesce(credit_amount, 0)) AS credits "
              f"FROM ({GL_LINE_SQL}) d GROUP BY gl_transaction_id")


@catalog.add("unbalanced_gl", f"SELECT gl_transaction_id, CAST(debits AS DOUBLE) AS debits, CAST(credits AS DOUBLE) AS credits FROM ({TOTALS_SQL}) t WHERE debits <> credits")
def unbalanced_gl(spark, sf):
    return doubles(L.unbalanced_gl(gl_lines(spark, sf)))


@catalog.add("unbalanced_headers", f"SELECT count(*) AS unbalanced FROM ({GL_SQL}) h WHERE total_debit_amount <> total_credit_amount")
def unbalanced_headers(spark, sf):
    return L.unbalanced_headers(gl_headers(spark, sf))


@catalog.add("status_counts", f"""
SELECT 'Sales Orders' AS transaction_type, count(*) AS total_count, count(*) FILTER (order_status = 'Open') AS count_1,
  count(*) FILTER (order_status = 'Invoiced') AS count_2, count(*) FILTER (order_status = 'Cancelled') AS count_3 FROM ({ORDER_SQL}) o
UNION ALL SELECT 'AR Transactions', count(*), count(*) FILTER (transaction_status = 'Open'),
  count(*) FILTER (transaction_status = 'Paid'), count(*) FILTER (transaction_status = 'Partially Paid') FROM ({AR_SQL}) a
UNION ALL SELECT 'GL Transactions', count(*), count(*) FILTER (is_posted), count(*) FILTER (NOT is_posted), 0 FROM ({GL_SQL}) g""")
def status_counts(spark, sf):
    return L.status_counts(orders(spark, sf), invoices(spark, sf), gl_headers(spark, sf))


COUNTED = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
           "orders", "pages", "part", "region", "supplier")


@catalog.add("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in COUNTED))
def row_counts(spark, sf):
    return L.row_counts({t: I.table(spark, sf, t) for t in COUNTED})


@catalog.add("union_all_report", f"""SELECT 'order' AS kind, order_status AS status, count(*) AS n FROM ({ORDER_SQL}) o GROUP BY ALL
UNION ALL SELECT 'invoice', transaction_status, count(*) FROM ({AR_SQL}) a GROUP BY ALL""")
def union_all_report(spark, sf):
    """Status totals of orders and invoices as one report."""
    counted = lambda df, kind, c: df.groupBy(F.col(c).alias("status")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(kind).alias("kind"), "status", "n")
    return counted(orders(spark, sf), "order", "order_status").union(
        counted(invoices(spark, sf), "invoice", "transaction_status"))


# --- numbering ----------------------------------------------------------------------------

@catalog.add("first_open_invoices", f"""SELECT ar_transaction_id, transaction_number FROM ({AR_SQL}) a
WHERE transaction_type = 'Invoice' AND transaction_status = 'Open' ORDER BY ar_transaction_id LIMIT 2""")
def first_open_invoices(spark, sf):
    return L.first_open_invoices(invoices(spark, sf)).select("ar_transaction_id", "transaction_number")


@catalog.add("next_line_number", "SELECT l_orderkey AS sales_order_id, CAST(max(l_linenumber) + 1 AS BIGINT) AS next_line_number FROM lineitem GROUP BY ALL")
def next_line_number(spark, sf):
    return L.next_line_numbers(lines(spark, sf))


@catalog.add("add_lines", f"""SELECT sales_order_id, s AS seq, coalesce(m, 0) + row_number() OVER (PARTITION BY sales_order_id ORDER BY s) AS line_number
FROM (SELECT o_orderkey AS sales_order_id, unnest([1, 2, 3]) AS s FROM orders) n
LEFT JOIN (SELECT l_orderkey AS sales_order_id, max(l_linenumber) AS m FROM lineitem GROUP BY ALL) l USING (sales_order_id)""")
def add_lines(spark, sf):
    """Three new lines per order, numbered on."""
    new = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sales_order_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq"))
    return L.add_lines(lines(spark, sf), new, ["seq"])


NUMBERS = "SELECT CAST(substr(transaction_number, 4, 4) AS INTEGER) AS year, max(CAST(substr(transaction_number, 9) AS BIGINT)) AS n FROM ({AR_SQL}) a GROUP BY ALL".replace("{AR_SQL}", AR_SQL)
NUMBER_TEXT = "CASE WHEN {n} < 1000 THEN lpad(CAST({n} AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END"


@catalog.add("next_document_number", f"SELECT year, 'AR-' || year || '-' || {NUMBER_TEXT.format(n='(n + 1)')} AS next_number FROM ({NUMBERS}) x")
def next_document_number(spark, sf):
    return L.next_document_numbers(invoices(spark, sf), "transaction_number", "AR")


@catalog.add("assign_document_numbers", f"""SELECT l_orderkey, p, 'AR-' || y || '-' || {NUMBER_TEXT.format(n='(coalesce(n, 0) + rn)')} AS transaction_number
FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY l_orderkey, p) AS rn FROM (
  SELECT l_orderkey, l_partkey * 100 + l_linenumber AS p, year(min(l_shipdate)) AS y FROM lineitem GROUP BY ALL)) d
LEFT JOIN ({NUMBERS}) x ON x.year = d.y""")
def assign_document_numbers(spark, sf):
    """A document per order line, numbered on within its year."""
    new = I.table(spark, sf, "lineitem").groupBy(
        "l_orderkey", (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("p")).agg(F.min("l_shipdate").alias("d"))
    rows = L.assign_document_numbers(invoices(spark, sf), "transaction_number", "AR", new, "d", ["l_orderkey", "p"])
    return rows.select("l_orderkey", "p", "transaction_number")


@catalog.add("document_number", f"SELECT o_orderkey, 'GL-' || year(o_orderdate) || '-' || {NUMBER_TEXT.format(n='o_orderkey')} AS number FROM orders")
def document_number_query(spark, sf):
    return I.table(spark, sf, "orders").select(
        "o_orderkey", document_number("GL", F.year("o_orderdate"), F.col("o_orderkey")).alias("number"))


@catalog.add("line_total", f"SELECT sales_order_id, line_number, CAST(sum(CAST(quantity * unit_price AS DECIMAL(28,4))) AS DOUBLE) AS line_total FROM ({LINE_SQL}) l GROUP BY ALL")
def line_total(spark, sf):
    total = L.line_total(F.col("quantity"), F.col("unit_price"))
    return lines(spark, sf).groupBy("sales_order_id", "line_number").agg(F.sum(total).cast("double").alias("line_total"))


@catalog.add("payment_status", f"""SELECT ar_transaction_id, CASE WHEN outstanding_amount - CAST(200000 AS DECIMAL(18,2)) <= 0 THEN 'Paid' ELSE 'Partially Paid' END AS status
FROM ({AR_SQL}) a""")
def payment_status(spark, sf):
    return invoices(spark, sf).select("ar_transaction_id", L.payment_status(
        F.col("outstanding_amount"), F.lit(200000).cast("decimal(18,2)")).alias("status"))


# --- batch jobs ---------------------------------------------------------------------------

INVOICE_DATE = "2024-03-15"
# Every order is asked for, and some unknown ones.
REQUESTS = "SELECT o_orderkey AS sales_order_id FROM orders UNION ALL SELECT -(o_orderkey + 1) FROM orders WHERE o_orderkey % 50 = 0"


def requests(spark, sf):
    asked = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sales_order_id"))
    return asked.union(asked.filter("sales_order_id % 50 = 0").selectExpr("-(sales_order_id + 1)"))


def _invoiced(spark, sf):
    return L.invoice_orders(requests(spark, sf), orders(spark, sf), lines(spark, sf), accounts(spark, sf),
                            F.to_timestamp(F.lit(INVOICE_DATE)), last_ar=100, last_gl=200)


ACCEPTED = f"(SELECT *, row_number() OVER (ORDER BY sales_order_id) AS n FROM ({ORDER_SQL}) o WHERE order_status = 'Open') i"
AR_NO = f"'AR-2024-' || {NUMBER_TEXT.format(n='(n + 100)')}"
GL_NO = f"'GL-2024-' || {NUMBER_TEXT.format(n='(n + 200)')}"


@catalog.add("invoice_orders", f"""SELECT n + 100 AS ar_transaction_id, {AR_NO} AS transaction_number, 'Invoice' AS transaction_type,
  sales_order_id, customer_name, '2024-03-15' AS transaction_date, '2024-04-14' AS due_date, CAST(total_amount AS DOUBLE) AS transaction_amount,
  CAST(total_amount AS DOUBLE) AS outstanding_amount, 'Open' AS transaction_status, 'Invoice for Sales Order ' || order_number AS description FROM {ACCEPTED}""")
def invoice_orders(spark, sf):
    return doubles(_invoiced(spark, sf)["ar"])


@catalog.add("invoice_orders_lines", f"""SELECT n + 100 AS ar_transaction_id, line_number, product_code, CAST(quantity AS DOUBLE) AS quantity,
  CAST(unit_price AS DOUBLE) AS unit_price FROM {ACCEPTED} JOIN ({LINE_SQL}) l USING (sales_order_id)""")
def invoice_orders_lines(spark, sf):
    return doubles(_invoiced(spark, sf)["ar_lines"])


@catalog.add("invoice_orders_gl", f"""SELECT n + 200 AS gl_transaction_id, {GL_NO} AS transaction_number, n + 100 AS source_transaction_id,
  'Sales Invoice ' || {AR_NO} AS description, CAST(total_amount AS DOUBLE) AS total_debit_amount FROM {ACCEPTED}""")
def invoice_orders_gl(spark, sf):
    rows = _invoiced(spark, sf)["gl"]
    return doubles(rows.select("gl_transaction_id", "transaction_number", "source_transaction_id", "description",
                               "total_debit_amount"))


@catalog.add("invoice_orders_gl_lines", f"""SELECT n + 200 AS gl_transaction_id, 1 AS line_number, 2 AS account_id, CAST(total_amount AS DOUBLE) AS debit_amount,
  CAST(NULL AS DOUBLE) AS credit_amount, 'AR for Invoice ' || {AR_NO} AS description FROM {ACCEPTED}
UNION ALL SELECT n + 200, 2, 9, NULL, CAST(total_amount AS DOUBLE), 'Sales Revenue for Invoice ' || {AR_NO} FROM {ACCEPTED}""")
def invoice_orders_gl_lines(spark, sf):
    return doubles(_invoiced(spark, sf)["gl_lines"])


@catalog.add("invoice_orders_after", f"SELECT sales_order_id, CASE WHEN order_status = 'Open' THEN 'Invoiced' ELSE order_status END AS order_status FROM ({ORDER_SQL}) o")
def invoice_orders_after(spark, sf):
    return _invoiced(spark, sf)["orders"].select("sales_order_id", "order_status")


@catalog.add("invoice_orders_rejects", f"""SELECT sales_order_id, CASE WHEN order_status IS NULL THEN 'not found'
  ELSE 'cannot be invoiced, status ' || order_status END AS reason
FROM ({REQUESTS}) r LEFT JOIN ({ORDER_SQL}) o USING (sales_order_id) WHERE order_status IS DISTINCT FROM 'Open'""")
def invoice_orders_rejects(spark, sf):
    return _invoiced(spark, sf)["rejects"]


# A payment per order and line number, some on invoices that do not exist.
PAYMENTS = f"""SELECT l_orderkey * 10 + l_linenumber AS payment_id, l_orderkey + 2 AS ar_transaction_id, {money('sum(CAST(l_extendedprice AS DECIMAL(18,2)))')} AS amount
FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def payments(spark, sf):
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)")
    rows = I.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(total.alias("amount"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("payment_id"),
                       (F.col("l_orderkey") + 2).alias("ar_transaction_id"), "amount")


@catalog.add("apply_payments", f"""SELECT ar_transaction_id, CAST(outstanding_amount - coalesce(paid, 0) AS DOUBLE) AS outstanding_amount,
  CASE WHEN paid IS NULL THEN transaction_status WHEN outstanding_amount - paid <= 0 THEN 'Paid' ELSE 'Partially Paid' END AS transaction_status
FROM ({AR_SQL}) a LEFT JOIN (SELECT ar_transaction_id, sum(amount) AS paid FROM ({PAYMENTS}) p GROUP BY ALL) s USING (ar_transaction_id)""")
def apply_payments(spark, sf):
    after = L.apply_payments(invoices(spark, sf), payments(spark, sf), F.to_timestamp(F.lit(INVOICE_DATE)))["invoices"]
    return doubles(after.select("ar_transaction_id", "outstanding_amount", "transaction_status"))


@catalog.add("apply_payments_rows", f"""SELECT payment_id, ar_transaction_id, customer_name, CAST(amount AS DOUBLE) AS transaction_amount,
  CASE WHEN amount >= outstanding_amount THEN 'Full payment received' ELSE 'Partial payment received' END AS description
FROM ({PAYMENTS}) p JOIN ({AR_SQL}) a USING (ar_transaction_id)""")
def apply_payments_rows(spark, sf):
    rows = L.apply_payments(invoices(spark, sf), payments(spark, sf), F.to_timestamp(F.lit(INVOICE_DATE)))["payments"]
    return doubles(rows.select("payment_id", "ar_transaction_id", "customer_name", "transaction_amount", "description"))


@catalog.add("post_gl", f"""SELECT gl_transaction_id, is_posted OR debits = credits AS is_posted,
  strftime(CASE WHEN NOT is_posted AND debits = credits THEN TIMESTAMP '{INVOICE_DATE}' ELSE posting_date END, '%Y-%m-%d') AS posting_date
FROM ({GL_SQL}) h JOIN ({TOTALS_SQL}) t USING (gl_transaction_id)""")
def post_gl(spark, sf):
    posted = L.post_gl(gl_headers(spark, sf), gl_lines(spark, sf), F.to_timestamp(F.lit(INVOICE_DATE)))["headers"]
    return doubles(posted.select("gl_transaction_id", "is_posted", "posting_date"))


@catalog.add("post_gl_rejects", f"""SELECT gl_transaction_id, transaction_number, CASE WHEN is_posted THEN 'already posted' ELSE
  'out of balance. Debits: ' || CAST(CAST(debits AS DECIMAL(18,2)) AS VARCHAR) || ', Credits: ' || CAST(CAST(credits AS DECIMAL(18,2)) AS VARCHAR) END AS reason
FROM ({GL_SQL}) h JOIN ({TOTALS_SQL}) t USING (gl_transaction_id) WHERE is_posted OR debits <> credits""")
def post_gl_rejects(spark, sf):
    return L.post_gl(gl_headers(spark, sf), gl_lines(spark, sf), F.to_timestamp(F.lit(INVOICE_DATE)))["rejects"]


def _deleted(spark, sf):
    return L.delete_orders(requests(spark, sf), orders(spark, sf), lines(spark, sf))


GONE = f"(SELECT sales_order_id FROM ({ORDER_SQL}) o WHERE order_status <> 'Invoiced')"


@catalog.add("delete_orders", f"SELECT sales_order_id, order_status FROM ({ORDER_SQL}) o WHERE sales_order_id NOT IN {GONE}")
def delete_orders(spark, sf):
    return _deleted(spark, sf)["orders"].select("sales_order_id", "order_status")


@catalog.add("delete_orders_lines", f"SELECT sales_order_id, line_number, product_code FROM ({LINE_SQL}) l WHERE sales_order_id NOT IN {GONE}")
def delete_orders_lines(spark, sf):
    return _deleted(spark, sf)["lines"].select("sales_order_id", "line_number", "product_code")


@catalog.add("delete_orders_rejects", f"""SELECT sales_order_id, CASE WHEN order_status IS NULL THEN 'not found' ELSE 'cannot delete an invoiced order' END AS reason
FROM ({REQUESTS}) r LEFT JOIN ({ORDER_SQL}) o USING (sales_order_id)
WHERE order_status IS NULL OR order_status = 'Invoiced'""")
def delete_orders_rejects(spark, sf):
    return _deleted(spark, sf)["rejects"]


# Amendments: every order gets a line or a cancellation, some twice.
AMENDMENT_EXPRS = [
    "o_orderkey AS sales_order_id", "CASE WHEN o_orderkey % 5 = 0 THEN 'cancel' ELSE 'add' END AS kind",
    "'RUSH-DELIVERY' AS product_code", "CAST(1 AS DECIMAL(18,4)) AS quantity",
    "CAST(75 AS DECIMAL(18,4)) AS unit_price", "CAST(75 AS DECIMAL(18,2)) AS amount",
    "CAST(6 AS DECIMAL(18,2)) AS tax", "' [MODIFIED]' AS note"]
AMENDMENTS = (f"SELECT {', '.join(AMENDMENT_EXPRS)} FROM orders "
              f"UNION ALL SELECT {', '.join(AMENDMENT_EXPRS)} FROM orders WHERE o_orderkey % 11 = 0")


def _amended(spark, sf):
    source = I.table(spark, sf, "orders")
    amendments = source.selectExpr(*AMENDMENT_EXPRS).unionByName(
        source.filter("o_orderkey % 11 = 0").selectExpr(*AMENDMENT_EXPRS))
    priced = lines(spark, sf).withColumn("line_total", L.line_total(F.col("quantity"), F.col("unit_price")))
    return L.amend_orders(orders(spark, sf), priced, amendments)


APPLIED = f"""(SELECT o.*, CASE WHEN sales_order_id % 11 = 0 THEN NULL WHEN sales_order_id % 5 = 0 THEN 'cancel'
  WHEN order_status = 'Open' THEN 'add' END AS kind FROM ({ORDER_SQL}) o) x"""


@catalog.add("amend_orders", f"""SELECT sales_order_id, CAST(total_amount + CASE WHEN kind = 'add' THEN 81 ELSE 0 END AS DOUBLE) AS total_amount,
  CAST(tax_amount + CASE WHEN kind = 'add' THEN 6 ELSE 0 END AS DOUBLE) AS tax_amount, CASE WHEN kind = 'cancel' THEN 'Cancelled' ELSE order_status END AS order_status,
  CASE WHEN kind IS NOT NULL THEN coalesce(notes, '') || ' [MODIFIED]' ELSE notes END AS notes FROM {APPLIED}""")
def amend_orders(spark, sf):
    after = _amended(spark, sf)["orders"]
    return doubles(after.select("sales_order_id", "total_amount", "tax_amount", "order_status", "notes"))


@catalog.add("amend_orders_lines", f"""SELECT sales_order_id, CAST(max(line_number) + CASE WHEN kind = 'add' THEN 1 ELSE 0 END AS BIGINT) AS last_line,
  count(*) + CASE WHEN kind = 'add' THEN 1 ELSE 0 END AS line_count FROM ({LINE_SQL}) l JOIN {APPLIED} USING (sales_order_id) GROUP BY sales_order_id, kind
UNION ALL SELECT sales_order_id, 1, 1 FROM {APPLIED} WHERE kind = 'add' AND sales_order_id NOT IN (SELECT l_orderkey FROM lineitem)""")
def amend_orders_lines(spark, sf):
    rows = _amended(spark, sf)["lines"]
    return rows.groupBy("sales_order_id").agg(F.max("line_number").alias("last_line"), F.count(F.lit(1)).alias("line_count"))


@catalog.add("amend_orders_rejects", f"""SELECT a.sales_order_id, a.kind, CASE WHEN a.sales_order_id % 11 = 0 THEN 'amended more than once' ELSE 'not open' END AS reason
FROM ({AMENDMENTS}) a JOIN ({ORDER_SQL}) o USING (sales_order_id) WHERE a.sales_order_id % 11 = 0 OR (a.kind = 'add' AND order_status <> 'Open')""")
def amend_orders_rejects(spark, sf):
    return _amended(spark, sf)["rejects"]


@catalog.add("stamp_modified", f"""SELECT a.o_orderkey, CASE WHEN b.o_orderkey IS NOT NULL AND (a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
  OR a.o_totalprice IS DISTINCT FROM b.o_totalprice) THEN '2024-03-15' ELSE strftime(a.o_orderdate, '%Y-%m-%d') END AS modified_date
FROM ({I.after_sql('orders', 'test')}) a LEFT JOIN ({I.before_sql('orders')}) b ON a.o_orderkey = b.o_orderkey""")
def stamp_modified(spark, sf):
    """Edited orders get the workload's time, others keep their own."""
    shown = lambda df: df.withColumn("modified_date", F.col("o_orderdate"))
    rows = L.stamp_modified(shown(I.before_state(spark, sf, "orders")), shown(I.after_state(spark, sf, "orders", "test")),
                            ["o_orderkey"], F.to_timestamp(F.lit(INVOICE_DATE)))
    return doubles(rows.select("o_orderkey", "modified_date"))
