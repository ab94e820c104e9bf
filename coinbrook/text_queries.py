"""Queries over what sources and changes do, on text and tables made from the star schema. Their SQL never takes
the text apart: it says what the text was made from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import binding as b
from .functions import merchants, money
from .operators import changes, dedup
from .sources import csv


def _orders(spark, sf_dir) -> DataFrame:
    return b.table(spark, sf_dir, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)")).withColumn("day", F.col("o_orderdate").cast("date"))


def _by(n: int, *forms):
    """The form that the remainder of the order's key picks."""
    return F.element_at(F.array(*forms), (F.col("o_orderkey") % n + 1).cast("int"))


def parse_money(spark, sf_dir) -> DataFrame:
    digits, plain = F.format_number("amount", 2), F.col("amount").cast("string")
    text = _by(6, F.concat(F.lit("$"), digits), F.concat(F.lit("("), digits, F.lit(")")), F.concat(plain, F.lit(" CR")), F.lit("N/A"), F.concat(F.lit(" -$"), digits), F.concat(digits, F.lit("-")))
    return _orders(spark, sf_dir).select("o_orderkey", money.parse_money(text).alias("value"))


def parse_european(spark, sf_dir) -> DataFrame:
    digits = F.translate(F.format_number("amount", 2), ",.", " ,")
    return _orders(spark, sf_dir).select("o_orderkey", money.parse_european(_by(2, digits, F.translate(digits, " ", "."))).alias("value"))


def statement_dates(spark, sf_dir) -> DataFrame:
    month = lambda c: F.month(c)
    closed = (F.col("o_orderkey") % 12 + 1).cast("int")
    found = money.statement_date(month("day"), F.dayofmonth("day"), F.year("day"), closed)
    return _orders(spark, sf_dir).where("NOT (month(day) = 2 AND day(day) = 29)").select("o_orderkey", found.alias("date"))


def _rows(spark, sf_dir, **columns) -> DataFrame:
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(", "), "o_orderpriority")
    place = [F.lit("export.csv").alias("source_file"), F.col("o_orderkey").alias("row_index")]
    return _orders(spark, sf_dir).withColumn("text", text).select(*place, *[c.alias(k.replace("_", " ")) for k, c in columns.items()])


def csv_debit_credit(spark, sf_dir) -> DataFrame:
    paid = F.col("o_orderkey") % 3 == 0
    rows = _rows(
        spark, sf_dir, Transaction_Date=F.date_format("day", "MM/dd/yyyy"), Description=F.col("text"),
        Debit=F.when(~paid, F.format_number("amount", 2)), Credit=F.when(paid, F.format_number("amount", 2)),
    )
    return csv.parse(rows).select("row_index", "date", "description_raw", "amount", "currency", "is_credit")


def csv_single_amount(spark, sf_dir) -> DataFrame:
    signed = F.when(F.col("o_orderkey") % 4 == 0, F.col("amount")).otherwise(-F.col("amount"))
    rows = _rows(spark, sf_dir, Date=F.date_format("day", "yyyy-MM-dd"), Description=F.col("text"), Amount=signed.cast("string"))
    return csv.parse(rows).select("row_index", "date", "description_raw", "amount", "is_credit")


def csv_unreadable_rows(spark, sf_dir) -> DataFrame:
    """Rows without a date or an amount that can be read are left out."""
    late = F.col("o_orderkey") >= 40  # a layout is told from the first rows
    day = F.when(late & (F.col("o_orderkey") % 7 == 0), "soon").otherwise(F.date_format("day", "yyyy-MM-dd"))
    amount = F.when(late & (F.col("o_orderkey") % 5 == 0), "n/a").otherwise(F.col("amount").cast("string"))
    return csv.parse(_rows(spark, sf_dir, Date=day, Description=F.col("text"), Amount=amount)).select("row_index", "date", "amount", "is_credit")


def manual_transactions(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 3 == 0, "INCOME").otherwise("EXPENSE")
    entries = _orders(spark, sf_dir).select(
        F.col("o_custkey").cast("string").alias("account_id"), F.col("day").alias("date"), F.col("o_orderkey").cast("string").alias("description_raw"), (-F.col("amount")).alias("amount"), kind.alias("transaction_type"), "o_orderkey"
    )
    ledger = entries.where("o_orderkey % 2 = 0").select(dedup.manual_key("account_id", "date", "description_raw", "amount").alias("hash_dedup_key"))
    out = changes.manual_transactions(entries.union(entries.where("o_orderkey % 5 = 0")), ledger)
    return out.select("o_orderkey", "amount", "classification_method", "confidence", "is_spend", "is_income")


def _ledger(spark, sf_dir) -> DataFrame:
    return b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"), F.lit("EXPENSE").alias("transaction_type"), F.lit(True).alias("is_spend"), F.lit(False).alias("is_income"))


def update_rows(spark, sf_dir) -> DataFrame:
    old = _ledger(spark, sf_dir)
    new = old.where("id % 10 = 0").select("id", F.when(F.col("id") % 20 == 0, "Rent").alias("category"), F.when(F.col("id") % 30 == 0, "INCOME").alias("transaction_type"))
    return changes.update(old, new)


def delete_rows(spark, sf_dir) -> DataFrame:
    old = _ledger(spark, sf_dir)
    return changes.delete(old, old.where("category LIKE '1%' OR category LIKE '2%'").select("id")).select("id", "category")


def upsert_rows(spark, sf_dir) -> DataFrame:
    old = _ledger(spark, sf_dir).select("id", "category", F.lit(1).alias("uses")).where("id % 2 = 0")
    new = _ledger(spark, sf_dir).select("id", F.lit("New").alias("category"), F.lit(7).alias("uses")).where("id % 3 = 0")
    return changes.upsert(old, new, ["id"], keep=["uses"])


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    """Customers as accounts, orders as snapshots with their lines as positions, and as transactions of imports."""
    orders = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), (F.col("o_orderkey") % 100).alias("import_id"))
    return {
        "accounts": b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")),
        "holdings_snapshots": orders.select("id", "account_id"),
        "positions": b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), "l_linenumber"),
        "transactions": orders,
        "import_records": orders.select(F.col("import_id").alias("id"), "account_id").distinct(),
    }


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.union(one)
    return out


def delete_account(spark, sf_dir) -> DataFrame:
    return _sizes(changes.delete_account(_tables(spark, sf_dir), 7))


def delete_import(spark, sf_dir) -> DataFrame:
    tables = _tables(spark, sf_dir)
    return _sizes(changes.delete_import({k: tables[k] for k in ("transactions", "import_records")}, 42))


#: What each bank prints around a merchant's name: before, behind.
_PRINTED = {
    "amex": ("", " https://shop.example/x 2125551234 NY"), "chase": ("", "*A1B2 800-555-1212 WA"), "wells_fargo": ("TST* ", " #123"), "capital_one": ("SQ *", " 123456"),
    "boa": ("", " 0123 4567"), "chase_bank": ("", " PPD ID: 12345"), "generic": ("", "  800-555-1212 CA"),
}


def clean_merchants(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("Store of "), F.initcap(F.substring_index("p_name", " ", 1)), F.lit("ware"))
    parts, out = b.table(spark, sf_dir, "part"), None
    for bank, (before, behind) in _PRINTED.items():
        one = parts.select("p_partkey", F.lit(bank).alias("bank"), merchants.clean(F.concat(F.lit(before), name, F.lit(behind)), bank).alias("merchant"))
        out = one if out is None else out.union(one)
    return out


def first_words(spark, sf_dir) -> DataFrame:
    text = F.concat_ws(" ", "p_brand", F.upper("p_brand"), F.concat(F.lit("No"), "p_partkey"), F.concat(F.lit("no"), "p_partkey"))
    return b.table(spark, sf_dir, "part").select("p_partkey", merchants.first_words(text).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_money, parse_european, statement_dates, csv_debit_credit, csv_single_amount, csv_unreadable_rows, manual_transactions, update_rows,
        delete_rows, upsert_rows, delete_account, delete_import, clean_merchants, first_words,
    )
}

_ROW = "o_orderkey AS row_index, CAST(o_orderdate AS DATE) AS date, 'Order ' || o_orderkey || ', ' || o_orderpriority AS description_raw, CAST(o_totalprice AS DECIMAL(15,2)) AS amount"

SQL = {
    "parse_money": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 3 THEN NULL ELSE -1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS value FROM orders",
    "parse_european": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS value FROM orders",
    "statement_dates": """SELECT o_orderkey, make_date(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 10 AND o_orderkey % 12 + 1 <= 3 THEN 1 ELSE 0 END, month(o_orderdate), day(o_orderdate)) AS date
      FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)""",
    "csv_debit_credit": f"SELECT {_ROW}, 'USD' AS currency, o_orderkey % 3 = 0 AS is_credit FROM orders",
    "csv_single_amount": f"SELECT {_ROW}, o_orderkey % 4 = 0 AS is_credit FROM orders",
    "csv_unreadable_rows": f"SELECT * EXCLUDE (description_raw), false AS is_credit FROM (SELECT {_ROW} FROM orders) WHERE row_index < 40 OR (row_index % 7 <> 0 AND row_index % 5 <> 0)",
    "manual_transactions": """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, 'MANUAL' AS classification_method, CAST(1 AS DOUBLE) AS confidence, o_orderkey % 3 <> 0 AS is_spend, o_orderkey % 3 = 0 AS is_income
      FROM orders WHERE o_orderkey % 2 = 1""",
    "update_rows": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 20 = 0 THEN 'Rent' ELSE o_orderpriority END AS category, CASE WHEN o_orderkey % 30 = 0 THEN 'INCOME' ELSE 'EXPENSE' END AS transaction_type,
      o_orderkey % 30 <> 0 AS is_spend, o_orderkey % 30 = 0 AS is_income FROM orders""",
    "delete_rows": "SELECT o_orderkey AS id, o_orderpriority AS category FROM orders WHERE o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%'",
    "upsert_rows": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'New' ELSE o_orderpriority END AS category, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 7 END AS uses FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
    "delete_account": """SELECT 'accounts' AS name, COUNT(*) AS rows FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'holdings_snapshots', COUNT(*) FROM orders WHERE o_custkey <> 7
      UNION ALL SELECT 'positions', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7) UNION ALL SELECT 'transactions', COUNT(*) FROM orders WHERE o_custkey <> 7
      UNION ALL SELECT 'import_records', COUNT(*) FROM (SELECT DISTINCT o_orderkey % 100, o_custkey FROM orders WHERE o_custkey <> 7)""",
    "delete_import": """SELECT 'transactions' AS name, COUNT(*) AS rows FROM orders WHERE o_orderkey % 100 <> 42
      UNION ALL SELECT 'import_records', COUNT(*) FROM (SELECT DISTINCT o_orderkey % 100, o_custkey FROM orders WHERE o_orderkey % 100 <> 42)""",
    "clean_merchants": f"""SELECT p_partkey, bank, 'Store of ' || upper(left(word, 1)) || lower(substr(word, 2)) || 'ware' AS merchant
      FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS word FROM part), (SELECT unnest([{", ".join(f"'{x}'" for x in _PRINTED)}]) AS bank)""",
    "first_words": "SELECT p_partkey, p_brand || ' No' || p_partkey AS name FROM part",
}
