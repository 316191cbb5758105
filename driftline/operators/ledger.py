"""Set-based ledger checks, reports and batch jobs over orders, receivables and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.text import document_number
from driftline.functions.values import micros
from driftline.operators.ordering import number_rows

# Accounts an invoice posts to (fixed values).
RECEIVABLE_ACCOUNT = "1200"
REVENUE_ACCOUNT = "4000"
DEBIT_NORMAL_TYPES = ("Asset", "Expense")


# --- checks and reports -------------------------------------------------------------------

def orphans(details: DataFrame, headers: DataFrame, detail_key: str, header_key: str) -> DataFrame:
    """One row: detail rows without a header.

    Details are counted per key before the join, so a key with many lines is one row.
    """
    per_key = details.groupBy(F.col(detail_key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    keys = headers.select(F.col(header_key).alias("_key"))
    return per_key.join(keys, "_key", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphans"))


def order_line_counts(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Line count per order, orders without lines included."""
    counts = lines.groupBy("sales_order_id").agg(F.count(F.lit(1)).alias("line_items"))
    return orders.join(counts, "sales_order_id", "left").select(
        "order_number", "order_status", "total_amount",
        F.coalesce("line_items", F.lit(0)).cast("bigint").alias("line_items"))


def gl_posted_lines(details: DataFrame, headers: DataFrame, as_of: Column) -> DataFrame:
    """Lines of transactions posted by ``as_of``."""
    posted = headers.filter(F.col("is_posted") & (F.col("posting_date") <= as_of))
    return details.join(posted.select("gl_transaction_id", "posting_date"), "gl_transaction_id")


def account_balances(accounts: DataFrame, details: DataFrame, headers: DataFrame, as_of: Column) -> DataFrame:
    """Balance of every account over posted lines; zero where there are none.

    Lines are summed per account before they meet the accounts.
    """
    sums = gl_posted_lines(details, headers, as_of).groupBy("account_id").agg(
        F.sum(F.coalesce("debit_amount", F.lit(0)) - F.coalesce("credit_amount", F.lit(0))).alias("net"))
    net = F.coalesce("net", F.lit(0))
    balance = F.when(F.col("account_type").isin(*DEBIT_NORMAL_TYPES), net).otherwise(-net)
    return accounts.join(sums, "account_id", "left").select(
        "account_id", "account_number", "account_name", "account_type",
        balance.cast("decimal(28,2)").alias("balance"))


def gl_totals(details: DataFrame) -> DataFrame:
    """Debit and credit totals per transaction."""
    return details.groupBy("gl_transaction_id").agg(
        F.sum(F.coalesce("debit_amount", F.lit(0))).cast("decimal(28,2)").alias("debits"),
        F.sum(F.coalesce("credit_amount", F.lit(0))).cast("decimal(28,2)").alias("credits"))


def unbalanced_gl(details: DataFrame) -> DataFrame:
    """Transactions whose lines do not balance."""
    return gl_totals(details).filter(F.col("debits") != F.col("credits"))


def unbalanced_headers(headers: DataFrame) -> DataFrame:
    return headers.filter(F.col("total_debit_amount") != F.col("total_credit_amount")).agg(
        F.count(F.lit(1)).alias("unbalanced"))


def status_counts(orders: DataFrame, invoices: DataFrame, postings: DataFrame) -> DataFrame:
    """Totals by status for orders, receivables and postings, one row each."""
    def counted(df: DataFrame, name: str, conditions: list[Column]) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("total_count"), *[
            F.count_if(c).alias(f"count_{i + 1}") for i, c in enumerate(conditions)
        ]).select(F.lit(name).alias("transaction_type"), "total_count", "count_1", "count_2", "count_3")

    is_order = F.col("order_status")
    is_invoice = F.col("transaction_status")
    return (
        counted(orders, "Sales Orders", [is_order == "Open", is_order == "Invoiced", is_order == "Cancelled"])
        .union(counted(invoices, "AR Transactions",
                       [is_invoice == "Open", is_invoice == "Paid", is_invoice == "Partially Paid"]))
        .union(counted(postings, "GL Transactions", [F.col("is_posted"), ~F.col("is_posted"), F.lit(False)]))
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table."""
    union = None
    for name, df in tables.items():
        count = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        union = count if union is None else union.union(count)
    return union.orderBy("table_name")


# --- numbering ----------------------------------------------------------------------------

def first_open_invoices(invoices: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` open invoices by id."""
    return invoices.filter((F.col("transaction_type") == "Invoice") & (F.col("transaction_status") == "Open")
                           ).orderBy("ar_transaction_id").limit(n)


def next_line_numbers(lines: DataFrame) -> DataFrame:
    """The next free line number of every order."""
    return lines.groupBy("sales_order_id").agg(
        (F.coalesce(F.max("line_number"), F.lit(0)) + 1).cast("bigint").alias("next_line_number"))


def add_lines(lines: DataFrame, new_lines: DataFrame, order: list[str]) -> DataFrame:
    """New lines numbered on from the last line of their order."""
    numbered = number_rows(new_lines, ["sales_order_id"], order, "_n")
    return numbered.join(next_line_numbers(lines), "sales_order_id", "left").withColumn(
        "line_number", (F.coalesce("next_line_number", F.lit(1)) + F.col("_n") - 1).cast("bigint")
    ).drop("_n", "next_line_number")


def last_document_numbers(documents: DataFrame, number: str, prefix: str) -> DataFrame:
    """Largest used number per year among ``XX-YYYY-NNN`` document numbers."""
    used = documents.filter(F.col(number).rlike(rf"^{prefix}-\d{{4}}-\d+$"))
    return used.groupBy(F.substring(number, 4, 4).cast("int").alias("year")).agg(
        F.max(F.substr(number, F.lit(9)).try_cast("bigint")).alias("last_number"))


def next_document_numbers(documents: DataFrame, number: str, prefix: str) -> DataFrame:
    """The next free document number per year."""
    last = last_document_numbers(documents, number, prefix)
    return last.select("year", document_number(prefix, F.col("year"), F.col("last_number") + 1).alias("next_number"))


def assign_document_numbers(documents: DataFrame, number: str, prefix: str, new: DataFrame, date: str,
                            order: list[str], name: str = "transaction_number") -> DataFrame:
    """New documents numbered on from the last of their year.

    A year can hold most documents; ``number_rows`` spreads it over many partitions.
    """
    numbered = number_rows(new.withColumn("_year", F.year(date)), ["_year"], order, "_n")
    last = last_document_numbers(documents, number, prefix)
    return numbered.join(last, numbered["_year"] == last["year"], "left").withColumn(
        name, document_number(prefix, F.col("_year"), F.coalesce("last_number", F.lit(0)) + F.col("_n"))
    ).drop("_n", "_year", "year", "last_number")


# --- batch jobs ---------------------------------------------------------------------------

def line_total(quantity: Column, unit_price: Column) -> Column:
    return (quantity.cast("decimal(18,4)") * unit_price.cast("decimal(18,4)")).cast("decimal(28,4)")


def payment_status(outstanding: Column, payment: Column) -> Column:
    return F.when(outstanding - payment <= 0, "Paid").otherwise("Partially Paid")


def invoice_orders(requests: DataFrame, orders: DataFrame, lines: DataFrame, accounts: DataFrame,
                   invoice_date: Column, last_ar: int = 0, last_gl: int = 0, due_days: int = 30) -> dict[str, DataFrame]:
    """Invoice the requested orders as one batch.

    Returns ``ar`` and ``gl`` headers, ``ar_lines``, ``gl_lines``, the ``orders`` after and
    the ``rejects`` with their reason. Documents are numbered by order id.
    """
    def account(number: str) -> Column:
        return accounts.filter(F.col("account_number") == number).agg(F.min("account_id")).scalar()

    wanted = requests.select("sales_order_id").distinct().withColumn("_asked", F.lit(True))
    found = orders.withColumn("_found", F.lit(True))
    reason = (
        F.when(F.col("_found").isNull(), "not found")
        .when(F.col("order_status") != "Open",
              F.concat(F.lit("cannot be invoiced, status "), F.col("order_status")))
        .when(account(RECEIVABLE_ACCOUNT).isNull(), "receivable account not found")
        .when(account(REVENUE_ACCOUNT).isNull(), "revenue account not found")
    )
    checked = wanted.join(found, "sales_order_id", "left").withColumn("reason", reason)
    rejects = checked.filter("reason IS NOT NULL").select("sales_order_id", "reason")
    accepted = number_rows(checked.filter("reason IS NULL").drop("_asked", "_found", "reason"),
                           [], ["sales_order_id"], "n")

    year = F.year(invoice_date)
    ids = accepted.withColumns({
        "ar_transaction_id": F.col("n") + last_ar,
        "gl_transaction_id": F.col("n") + last_gl,
        "ar_number": document_number("AR", year, F.col("n") + last_ar),
        "gl_number": document_number("GL", year, F.col("n") + last_gl),
    })
    due = F.timestamp_micros(micros(invoice_date) + F.lit(due_days * 86_400_000_000))
    ar = ids.select(
        "ar_transaction_id", F.col("ar_number").alias("transaction_number"),
        F.lit("Invoice").alias("transaction_type"), "sales_order_id", "customer_name",
        invoice_date.alias("transaction_date"), due.alias("due_date"),
        F.col("total_amount").alias("transaction_amount"), F.col("total_amount").alias("outstanding_amount"),
        F.lit("Open").alias("transaction_status"),
        F.concat(F.lit("Invoice for Sales Order "), F.col("order_number")).alias("description"))
    ar_lines = lines.join(ids.select("sales_order_id", "ar_transaction_id"), "sales_order_id").select(
        "ar_transaction_id", *[c for c in lines.columns if c != "sales_order_id"])
    gl = ids.select(
        "gl_transaction_id", F.col("gl_number").alias("transaction_number"),
        F.lit("Sales").alias("transaction_type"), F.lit("AR").alias("source_module"),
        F.col("ar_transaction_id").alias("source_transaction_id"), invoice_date.alias("transaction_date"),
        F.concat(F.lit("Sales Invoice "), F.col("ar_number")).alias("description"),
        F.col("total_amount").alias("total_debit_amount"), F.col("total_amount").alias("total_credit_amount"),
        F.lit(False).alias("is_posted"))
    none = F.lit(None).cast(orders.schema["total_amount"].dataType)

    def posting(number: int, account_id: Column, debit: Column, credit: Column, text: str) -> Column:
        return F.struct(
            F.lit(number).alias("line_number"), account_id.alias("account_id"), debit.alias("debit_amount"),
            credit.alias("credit_amount"), F.concat(F.lit(text), F.col("ar_number")).alias("description"))

    total = F.col("total_amount")
    gl_lines = ids.select("gl_transaction_id", F.inline(F.array(
        posting(1, account(RECEIVABLE_ACCOUNT), total, none, "AR for Invoice "),
        posting(2, account(REVENUE_ACCOUNT), none, total, "Sales Revenue for Invoice "))))
    invoiced = ids.select("sales_order_id", F.lit(True).alias("_invoiced"))
    after = orders.join(invoiced, "sales_order_id", "left").withColumn(
        "order_status", F.when(F.col("_invoiced"), "Invoiced").otherwise(F.col("order_status"))
    ).select(*orders.columns)
    return {"ar": ar, "ar_lines": ar_lines, "gl": gl, "gl_lines": gl_lines, "orders": after, "rejects": rejects}


def apply_payments(invoices: DataFrame, payments: DataFrame, payment_date: Column) -> dict[str, DataFrame]:
    """Payments against invoices: the ``invoices`` after, and one ``payments`` row each.

    ``payments`` holds ``payment_id, ar_transaction_id, amount``; amounts are summed per
    invoice before the join.
    """
    paid = payments.groupBy("ar_transaction_id").agg(F.sum("amount").cast("decimal(18,2)").alias("_paid"))
    outstanding = F.col("outstanding_amount")
    after = invoices.join(paid, "ar_transaction_id", "left").withColumns({
        "transaction_status": F.when(F.col("_paid").isNotNull(), payment_status(outstanding, F.col("_paid")))
        .otherwise(F.col("transaction_status")),
        "outstanding_amount": (outstanding - F.coalesce("_paid", F.lit(0))).cast("decimal(18,2)"),
    }).select(*invoices.columns)
    full = F.col("amount") >= outstanding
    rows = payments.join(invoices.select("ar_transaction_id", "customer_name", "outstanding_amount"),
                         "ar_transaction_id").select(
        "payment_id", "ar_transaction_id", "customer_name", payment_date.alias("transaction_date"),
        F.lit("Payment").alias("transaction_type"), F.col("amount").alias("transaction_amount"),
        F.lit(0).cast("decimal(18,2)").alias("outstanding_amount"), F.lit("Paid").alias("transaction_status"),
        F.when(full, "Full payment received").otherwise("Partial payment received").alias("description"))
    return {"invoices": after, "payments": rows}


def post_gl(headers: DataFrame, details: DataFrame, posting_date: Column) -> dict[str, DataFrame]:
    """Post balanced, unposted transactions: ``headers`` after, ``rejects`` with reasons.

    A transaction without lines has no totals to disagree and is posted.
    """
    reason = (
        F.when(F.col("is_posted"), "already posted")
        .when(F.col("debits") != F.col("credits"), F.format_string(
            "out of balance. Debits: %s, Credits: %s", F.col("debits").cast("string"), F.col("credits").cast("string")))
    )
    checked = headers.join(gl_totals(details), "gl_transaction_id", "left").withColumn("reason", reason)
    posting = F.col("reason").isNull()
    after = checked.withColumns({
        "posting_date": F.when(posting, posting_date).otherwise(F.col("posting_date")),
        "is_posted": posting | F.col("is_posted"),
    }).select(*headers.columns)
    rejects = checked.filter("reason IS NOT NULL").select("gl_transaction_id", "transaction_number", "reason")
    return {"headers": after, "rejects": rejects}


def delete_orders(requests: DataFrame, orders: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """Delete the requested orders with their lines; invoiced or unknown ones are refused."""
    wanted = requests.select("sales_order_id").distinct()
    found = orders.select("sales_order_id", "order_status", F.lit(True).alias("_found"))
    reason = F.when(F.col("_found").isNull(), "not found").when(
        F.col("order_status") == "Invoiced", "cannot delete an invoiced order")
    checked = wanted.join(found, "sales_order_id", "left").withColumn("reason", reason)
    gone = checked.filter("reason IS NULL").select("sales_order_id")
    return {
        "orders": orders.join(gone, "sales_order_id", "left_anti"),
        "lines": lines.join(gone, "sales_order_id", "left_anti"),
        "rejects": checked.filter("reason IS NOT NULL").select("sales_order_id", "reason"),
    }


def amend_orders(orders: DataFrame, lines: DataFrame, amendments: DataFrame) -> dict[str, DataFrame]:
    """Add a line to open orders, or cancel orders, with a note.

    ``amendments`` holds ``sales_order_id, kind (add or cancel), product_code, quantity,
    unit_price, amount, tax, note``. A batch amends an order once: further amendments of
    the same order are rejected whole, as are amendments of unknown or, for lines, not
    open orders.
    """
    repeated = amendments.groupBy("sales_order_id").agg(F.count(F.lit(1)).alias("_times"))
    found = orders.select("sales_order_id", "order_status", F.lit(True).alias("_found"))
    reason = (
        F.when(F.col("_times") > 1, "amended more than once")
        .when(F.col("_found").isNull(), "not found")
        .when((F.col("kind") == "add") & (F.col("order_status") != "Open"), "not open")
    )
    checked = amendments.join(repeated, "sales_order_id").join(found, "sales_order_id", "left").withColumn(
        "reason", reason)
    accepted = checked.filter("reason IS NULL").select(*amendments.columns)

    added = accepted.filter("kind = 'add'").select("sales_order_id", "product_code", "quantity", "unit_price")
    new_lines = added.join(next_line_numbers(lines), "sales_order_id", "left").select(
        "sales_order_id", F.coalesce("next_line_number", F.lit(1)).cast("bigint").alias("line_number"),
        "product_code", "quantity", "unit_price",
        line_total(F.col("quantity"), F.col("unit_price")).alias("line_total"))

    change = accepted.select("sales_order_id", "kind", "amount", "tax", "note")
    adding, zero = F.col("kind") == "add", F.lit(0)
    amount = F.when(adding, F.coalesce("amount", zero)).otherwise(zero)
    tax = F.when(adding, F.coalesce("tax", zero)).otherwise(zero)
    money = lambda c: c.cast("decimal(18,2)")
    after = orders.join(change, "sales_order_id", "left").withColumns({
        "total_amount": money(F.col("total_amount") + amount + tax),
        "sub_total": money(F.col("sub_total") + amount),
        "tax_amount": money(F.col("tax_amount") + tax),
        "order_status": F.when(F.col("kind") == "cancel", "Cancelled").otherwise(F.col("order_status")),
        "notes": F.when(F.col("note").isNotNull(), F.concat(F.coalesce("notes", F.lit("")), F.col("note")))
        .otherwise(F.col("notes")),
    }).select(*orders.columns)
    rejects = checked.filter("reason IS NOT NULL").select("sales_order_id", "kind", "reason")
    return {"orders": after, "lines": lines.unionByName(new_lines), "rejects": rejects}


def stamp_modified(before: DataFrame, after: DataFrame, keys: list[str], modified_at: Column,
                   column: str = "modified_date") -> DataFrame:
    """The state after, with the modified time set on rows that existed and changed."""
    data = [c for c in after.columns if c not in keys and c != column]
    old = before.select(*keys, F.struct(*data).alias("_old"))
    updated = F.col("_old").isNotNull() & ~F.struct(*data).eqNullSafe(F.col("_old"))
    return after.join(old, keys, "left").withColumn(
        column, F.when(updated, modified_at).otherwise(F.col(column))).select(*after.columns)
