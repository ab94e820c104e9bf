"""Queries over bank statements written from the star schema: a statement for each customer, a line for each order.
Their SQL never takes the text apart: it says what each line was made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import binding as b
from . import shared
from .sources import folder, statements


def _orders(spark, sf_dir) -> DataFrame:
    o = b.table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    paid = F.when(F.col("o_orderkey") % 5 == 0, "AUTOPAY PAYMENT THANK YOU ").otherwise("Order ")
    text = F.concat(paid, F.col("o_orderkey").cast("string"), F.lit(" "), F.substring("o_orderpriority", 3, 20))
    rows = o.select("o_orderkey", "o_custkey", day.alias("day"), text.alias("text"), F.format_number(F.col("o_totalprice").cast("decimal(15,2)"), 2).alias("value"), (F.col("o_orderkey") % 3 == 0).alias("credit"))
    return rows.where("NOT (month(day) = 2 AND day(day) = 29)")


def _made(spark, sf_dir, line: Column, head: str = "", foot: str = "") -> DataFrame:
    """(source_file, text) with the lines of each customer by order."""
    by = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    return by.select(F.col("o_custkey").cast("string").alias("source_file"), F.concat_ws("\n", F.lit(head), F.array_join("l.line", "\n"), F.lit(foot)).alias("text"))


def _if(mark: str) -> Column:
    return F.when(F.col("credit"), mark).otherwise("")


def _day(form: str) -> Column:
    return F.date_format("day", form)


#: The head of each bank's statements, its foot, and its lines.
_LINES = {
    "amex": ("American Express", "", lambda: F.concat(_day("MM/dd/yy"), _if("*"), F.lit(" "), "text", F.lit(" "), _if("-"), F.lit("$"), "value")),
    "chase": ("chase.com\nClosing Date: 02/15/1998", "01/02 Total fees in 1998 9.00\n01/03 2025 Totals Year-to-Date 8.00", lambda: F.concat(_day("MM/dd"), F.lit(" "), "text", F.lit(" "), _if("-"), "value")),
    "wells_fargo": ("Wells Fargo\nClosing Date: 02/15/1998\n01/01 01/02 BEFORE $1.00\nTransaction Summary\nTrans Date Post Date", "01/01 01/02 Interest Charge on cash $1.00\nTotal", lambda: F.concat(F.lit("01/01 "), _day("MM/dd"), F.lit(" "), "text", F.lit(" $"), "value", _if("-"))),
    "capital_one": ("Capital One\nJan 16, 1998 - Feb 15, 1998", "", lambda: F.concat(F.lit("Jan 2 "), _day("MMM d"), F.lit(" "), "text", F.lit(" "), _if("- "), F.lit("$"), "value")),
    "boa": ("Bank of America\nClosing Date: 02/15/1998", "", lambda: F.concat(_day("MM/dd"), F.lit(" 01/01 "), "text", F.lit(" "), _if("-"), "value")),
    "ally_bank": ("Ally Bank\n01/01/1998 Before 1.00 -0.00 1.00\nDate Description Credits Debits Balance", "Ending Balance $0.00",
                  lambda: F.concat(_day("MM/dd/yyyy"), F.lit(" "), "text", F.when(F.col("credit"), F.concat(F.lit(" $"), "value", F.lit(" -$0.00"))).otherwise(F.concat(F.lit(" $0.00 -$"), "value")), F.lit(" $9.99"))),
    "chase_bank": ("Chase Total Checking\nJanuary 16, 1998 through February 15, 1998\n01/01 Before 1.00 2.00\nTRANSACTION DETAIL\nBeginning Balance 5.00", "*end*transaction detail\n01/02 After 1.00 2.00",
                   lambda: F.concat(_day("MM/dd"), F.lit(" "), "text", F.when(F.col("credit"), " ").otherwise(" -"), "value", F.lit(" 9.99"))),
    "fidelity": ("Fidelity Rewards\nClosing Date: 02/15/1998", "", lambda: F.concat(_day("MM/dd"), F.lit(" 01/01 R7 "), "text", F.lit(" $"), "value", _if("CR"))),
}


def _parsed(name: str):
    head, foot, line = _LINES[name]
    return lambda s, d: statements.parse(_made(s, d, line(), head, foot), name, 1998, 2)


def statement_generic(spark, sf_dir) -> DataFrame:
    """Lines in three forms of dates, credits by sign or mark, and lines that are no transaction."""
    forms = F.array(
        F.concat(_day("yyyy-MM-dd"), F.lit(" "), "text", F.lit(" "), "value"), F.concat(_day("MM/dd/yyyy"), F.lit(" "), "text", F.lit(" $"), "value", F.lit(" CR")),
        F.concat(_day("MM-dd-yyyy"), F.lit(" "), "text", F.lit(" -"), "value"), F.concat(_day("MM/dd/yyyy"), F.lit(" Previous balance "), "value"),
    )
    return statements.parse_generic(_made(spark, sf_dir, F.element_at(forms, (F.col("o_orderkey") % 4 + 1).cast("int"))), 1998)


def statement_banks(spark, sf_dir) -> DataFrame:
    """What tells the banks' statements apart."""
    out = None
    for name, (head, foot, line) in _LINES.items():
        one = _made(spark, sf_dir, line(), head, foot).select("source_file", F.lit(name).alias("made"), statements.bank(F.col("text")).alias("bank"))
        out = one if out is None else out.unionByName(one)
    return out


#: A mark for each institution, in their order.
_MARKS = [marks[-1] for marks in statements.INSTITUTIONS.values()]


def statement_institutions(spark, sf_dir) -> DataFrame:
    mark = F.element_at(F.array(*[F.lit(m.title()) for m in [*_MARKS, "the bank around the corner"]]), (F.col("c_custkey") % 18 + 1).cast("int"))
    text = F.concat(F.lit("Dear customer, thank you for using "), mark, F.lit(" since 1998."))
    return b.table(spark, sf_dir, "customer").select("c_custkey", statements.institution(text).alias("institution"))


def statement_chase_balances(spark, sf_dir) -> DataFrame:
    """Every third customer has no savings."""
    value = lambda factor: F.format_number((F.abs(F.col("c_acctbal").cast("decimal(15,2)")) + factor).cast("decimal(15,2)"), 2)
    last4 = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    savings = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("Chase Savings 000003"), last4, F.lit(" "), value(3), F.lit(" "), value(4)))
    text = F.concat_ws("\n", F.lit("May 23, 1998throughJune 24, 1998"), F.lit("CONSOLIDATED BALANCE SUMMARY"), F.concat(F.lit("Chase Total Checking 00000075"), last4, F.lit(" $"), value(1), F.lit(" $"), value(2)), savings)
    return statements.chase_balances(b.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_file"), text.alias("text")))


def statement_ally_balances(spark, sf_dir) -> DataFrame:
    value = lambda factor: F.format_number((F.abs(F.col("c_acctbal").cast("decimal(15,2)")) + factor).cast("decimal(15,2)"), 2)
    last4 = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    each = [F.concat(F.lit(f"{name} Account xxxxxx"), last4, F.lit(" $"), value(i), F.lit(" $"), value(i + 1)) for i, name in enumerate(("Spending", "Savings"))]
    return statements.ally_balances(b.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_file"), F.concat_ws("\n", F.lit("Ally Bank"), *each).alias("text")))


#: Descriptions by order: payments to cards, transfers, and words that look alike.
_MOVES = ["WF CREDIT CRD", "Ext Trnsfr to me", "AutoPay of rent", "coffee", "Zelle or Moneyline", "Amex and wire transfer"]
_MOVED = {name: ["Credit Card Payments", "Transfers", "Credit Card Payments", None, "Transfers", "Credit Card Payments"] for name in ("ally_bank", "chase_bank")}


def _transfers(name: str):
    """What leaves an account for a card or another account; equal words in what comes in mean nothing."""
    head, foot, _ = _LINES[name]

    def query(spark, sf_dir) -> DataFrame:
        move = F.element_at(F.array(*[F.lit(m) for m in _MOVES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
        if name == "ally_bank":
            line = F.concat(_day("MM/dd/yyyy"), F.lit(" "), "text", F.when(F.col("credit"), F.concat(F.lit(" $"), "value", F.lit(" -$0.00"))).otherwise(F.concat(F.lit(" $0.00 -$"), "value")), F.lit(" $9.99\n"), move, F.lit("\ncontinued"))
        else:
            line = F.concat(_day("MM/dd"), F.lit(" "), move, F.lit(" "), "text", F.when(F.col("credit"), " ").otherwise(" -"), "value", F.lit(" 9.99"))
        made = _orders(spark, sf_dir).withColumn("text", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")))
        by = made.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
        texts = by.select(F.col("o_custkey").cast("string").alias("source_file"), F.concat_ws("\n", F.lit(head), F.array_join("l.line", "\n"), F.lit(foot)).alias("text"))
        return statements.parse(texts, name, 1998, 2, transfers=True).select("source_file", "row_index", "description_raw", "is_credit", "is_payment", "transfer_category")

    return query


_THANKS = ["THANK YOU - MOBILE PAYMENT", "PAYMENT RECEIVED, THANK YOU", "PAYMENT OF A BILL", "thank you", "AutoPay"]


def statement_amex_payments(spark, sf_dir) -> DataFrame:
    """Payments with their words in either order; both are needed."""
    words = F.element_at(F.array(*[F.lit(w) for w in _THANKS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    line = F.concat(_day("MM/dd/yy"), F.lit(" "), words, F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" -$"), "value")
    return statements.parse(_made(spark, sf_dir, line, "American Express"), "amex", 1998, 2).select("source_file", "row_index", "description_raw", "is_payment")


def statement_amex_later(spark, sf_dir) -> DataFrame:
    """Credits whose amount stands one to three lines below the date."""
    rest = F.element_at(F.array(F.lit(""), F.lit("of last month\n"), F.lit("of last\nmonth\n")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    line = F.concat(_day("MM/dd/yy"), F.lit("* CREDIT "), F.col("o_orderkey").cast("string"), F.lit("\n"), rest, F.lit("-$"), "value")
    found = statements.parse(_made(spark, sf_dir, line, "American Express\nPayments and Credits"), "amex", 1998, 2)
    return found.select("source_file", "row_index", "date", "description_raw", "amount", "is_credit")


def statement_card_tables(spark, sf_dir) -> DataFrame:
    """Two tables for each customer, of credits and debits; of the credits only some bear their mark. A third table is none
    of transactions, and some rows lack a cell or have a total."""
    o = _orders(spark, sf_dir)
    number = F.row_number().over(Window.partitionBy("o_custkey", "credit").orderBy("o_orderkey"))
    o = o.withColumn("row_no", number)
    odd = F.col("o_custkey") % 2 == 1
    words = F.element_at(F.array(*[F.lit(w) for w in _THANKS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    mark = F.when(F.col("credit") & ((F.col("row_no") == 3) | (F.col("o_orderkey") % 2 == 0) | (F.col("row_no") == 1)), "CR").otherwise("")
    day = F.when(odd, _day("MM/dd/yyyy")).otherwise(_day("MM/dd"))
    header = F.when(odd, F.array(*[F.lit(x) for x in ("Post Date", "Ref #", "Transaction Description", "Amount")])).otherwise(F.array(*[F.lit(x) for x in ("AMOUNT ($)", "Trans Date", "Description", "Ref #")]))
    value, text = F.concat(F.lit("$"), "value", mark), F.concat(words, F.lit(" "), F.col("o_orderkey").cast("string"))
    cells = F.when(odd, F.array(day, F.lit("R1"), text, value)).otherwise(F.array(value, day, text, F.lit("R1")))
    lacking = F.when(F.col("o_orderkey") % 11 == 0, F.transform(cells, lambda c: F.when(c != day, c))).otherwise(cells)
    rows = o.select(F.col("o_custkey").cast("string").alias("source_file"), F.when(F.col("credit"), 2).otherwise(1).alias("table_no"), "row_no", header.alias("header"), lacking.alias("cells"))
    other = o.select(F.col("o_custkey").cast("string").alias("source_file"), F.lit(3).alias("table_no"), "row_no", F.array(F.lit("Date"), F.lit("Amount")).alias("header"), F.array(day, value).alias("cells"))
    return statements.card_tables(rows.unionByName(other), 1998)


def statement_folder(spark, sf_dir) -> DataFrame:
    """A file for each nation, of one of two banks or none, and a copy of every fourth; those of every fifth nation were
    imported before."""
    o = _orders(spark, sf_dir).join(b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    forms = F.array(_LINES["chase"][2](), _LINES["capital_one"][2](), F.concat(_day("yyyy-MM-dd"), F.lit(" "), "text", F.lit(" "), _if("-"), "value"))
    line = F.element_at(forms, (F.col("nation") % 3 + 1).cast("int"))
    by = o.groupBy("nation").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    head = F.element_at(F.array(F.lit(_LINES["chase"][0]), F.lit(_LINES["capital_one"][0]), F.lit("of 1998")), (F.col("nation") % 3 + 1).cast("int"))
    texts = by.select("nation", F.concat_ws("\n", head, F.array_join("l.line", "\n")).alias("value"))
    path = shared.folder(spark, "inbox")
    copies = F.explode(F.when(F.col("nation") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    texts.select("value", "nation", copies).repartition("nation").write.partitionBy("nation", "copy").text(path)
    known = texts.where("nation % 5 = 0").select(F.sha2(F.concat("value", F.lit("\n")), 256).alias("source_file_hash"))
    found = folder.parse(folder.read(spark, path, known, "*.txt"), 1998, 2)
    return found.select(F.regexp_extract("source_file", "nation=(\\d+)", 1).cast("int").alias("nation"), "bank", "row_index", "date", "description_raw", "amount", "is_credit")


def statement_generic_months(spark, sf_dir) -> DataFrame:
    """Names of months in any case; APR is also a rate, so lines of April are left out."""
    month = F.element_at(F.array(F.upper(_day("MMM")), F.lower(_day("MMM")), _day("MMM")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    line = F.concat(month, F.lit("  "), _day("d"), F.lit(" "), "text", F.lit(" $"), "value")
    return statements.parse_generic(_made(spark, sf_dir, line, "In 1998"), 1998).select("source_file", "row_index", "date", "amount", "description_raw")


QUERIES = {f"statement_{name}": _parsed(name) for name in _LINES} | {f"statement_{name}_transfers": _transfers(name) for name in _MOVED} | {
    f.__name__: f for f in (statement_folder, statement_card_tables, statement_amex_payments, statement_amex_later, statement_generic_months, statement_generic, statement_banks, statement_institutions, statement_chase_balances, statement_ally_balances)
}

_BASE = """WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(15,2)) AS value, o_orderkey % 3 = 0 AS credit,
  CASE WHEN o_orderkey % 5 = 0 THEN 'AUTOPAY PAYMENT THANK YOU ' ELSE 'Order ' END || o_orderkey || ' ' || substr(o_orderpriority, 3, 20) AS text
  FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29))
SELECT CAST(o_custkey AS VARCHAR) AS source_file, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_index, {date} AS date, text AS description_raw, {amount} AS amount, {credit} AS is_credit, {payment} AS is_payment FROM o"""
_SIGNED = "CAST(CASE WHEN credit THEN -value ELSE value END AS DECIMAL(15,2))"
_PAID = "o_orderkey % 5 = 0"
#: The statements close in February 1998, so the last months are those of the year before; two banks do not roll.
_ROLLED = "make_date(CASE WHEN month(day) >= 10 THEN 1997 ELSE 1998 END, month(day), day(day))"
_FIXED = "make_date(1998, month(day), day(day))"
_SHORT = "make_date(2000 + year(day) % 100, month(day), day(day))"


def _sql(date: str, amount: str = _SIGNED, credit: str = "credit", payment: str = _PAID) -> str:
    return _BASE.format(date=date, amount=amount, credit=credit, payment=payment)


_BANK_NAMES = list(_LINES)
_ABS = "CAST(abs(CAST(c_acctbal AS DECIMAL(15,2))) + {} AS DECIMAL(15,2))".format
_FOUR = "lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"



def _sql_by(values: list, key: str) -> str:
    return f"list_extract([{', '.join('NULL' if v is None else repr(v) for v in values)}], CAST({key} % {len(values)} + 1 AS INT))"


def _sql_text(text: str, *args: str, more: str = "") -> str:
    return _sql(*args).replace("text AS description_raw", f"{text} AS description_raw{more}")


def _sql_transfers(name: str) -> str:
    move, kind = _sql_by(_MOVES, "o_orderkey"), _sql_by(_MOVED[name], "o_orderkey")
    text = f"'Order ' || o_orderkey || ' ' || {move} || ' continued'" if name == "ally_bank" else f"{move} || ' Order ' || o_orderkey"
    return f"SELECT source_file, row_index, description_raw, is_credit, kind IS NOT NULL AND NOT is_credit AS is_payment, CASE WHEN NOT is_credit THEN kind END AS transfer_category FROM ({_sql_text(text, 'day', more=f', {kind} AS kind')})"


_LATER = f"'CREDIT ' || o_orderkey || {_sql_by(['', ' of last month', ' of last month'], 'o_orderkey')}"

SQL = {
    "statement_ally_bank_transfers": _sql_transfers("ally_bank"),
    "statement_chase_bank_transfers": _sql_transfers("chase_bank"),
    "statement_amex_payments": f"SELECT source_file, row_index, description_raw, o_paid AS is_payment FROM ({_sql_text(_sql_by(_THANKS, 'o_orderkey') + " || ' ' || o_orderkey", 'day', more=', o_orderkey % 5 IN (0, 1, 4) AS o_paid')})",
    "statement_folder": f"""SELECT nation, list_extract(['chase', 'capital_one', 'unknown'], CAST(nation % 3 + 1 AS INT)) AS bank, CAST(row_number() OVER (PARTITION BY nation ORDER BY key) - 1 AS INT) AS row_index,
        CASE WHEN nation % 3 = 2 THEN full_day ELSE date END AS date, description_raw, amount, is_credit
      FROM ({_sql(_ROLLED).replace('text AS description_raw', 'text AS description_raw, o_orderkey AS key, o_custkey AS customer, day AS full_day')}) JOIN (SELECT c_custkey, c_nationkey AS nation FROM customer) ON c_custkey = customer WHERE nation % 5 > 0""",
    "statement_card_tables": f"""SELECT source_file, CAST(row_number() OVER (PARTITION BY source_file ORDER BY is_credit DESC, row_index) - 1 AS INT) AS row_index, date, description_raw, amount, is_credit, is_payment
      FROM ({_sql_text(_sql_by(_THANKS, 'o_orderkey') + " || ' ' || o_orderkey", 'CASE WHEN o_custkey % 2 = 1 THEN day ELSE make_date(1998, month(day), day(day)) END', _SIGNED, 'credit', 'o_orderkey % 5 < 2')} WHERE o_orderkey % 11 > 0)""",
    "statement_amex_later": f"SELECT source_file, row_index, date, description_raw, amount, is_credit FROM ({_sql_text(_LATER, _SHORT, 'CAST(-value AS DECIMAL(15,2))', 'true')})",
    "statement_generic_months": f"SELECT source_file, CAST(row_number() OVER (PARTITION BY source_file ORDER BY row_index) - 1 AS INT) AS row_index, date, amount, description_raw FROM ({_sql(_FIXED, 'value')} WHERE month(day) <> 4)",
    "statement_amex": _sql(_SHORT),
    "statement_chase": _sql(_ROLLED),
    "statement_wells_fargo": _sql(_ROLLED),
    "statement_capital_one": _sql(_ROLLED),
    "statement_boa": _sql(_ROLLED, "value"),
    "statement_ally_bank": _sql("day", payment=f"{_PAID} AND NOT credit"),
    "statement_chase_bank": _sql(_FIXED, payment=f"{_PAID} AND NOT credit"),
    "statement_fidelity": _sql(_FIXED),
    "statement_generic": f"SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY source_file ORDER BY row_index) - 1 AS INT) AS row_index) FROM ({_sql('day', 'CASE WHEN o_orderkey % 4 > 0 THEN -value ELSE value END', 'o_orderkey % 4 > 0').replace('AS is_payment FROM o', 'AS is_payment FROM o WHERE o_orderkey % 4 <> 3')})",
    "statement_banks": f"SELECT CAST(o_custkey AS VARCHAR) AS source_file, name AS made, name AS bank FROM (SELECT DISTINCT o_custkey FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)), (SELECT unnest([{', '.join(repr(n) for n in _BANK_NAMES)}]) AS name)",
    "statement_institutions": f"SELECT c_custkey, list_extract([{', '.join(repr(n) for n in statements.INSTITUTIONS)}], CAST(c_custkey % 18 + 1 AS INT)) AS institution FROM customer",
    "statement_chase_balances": f"""SELECT CAST(c_custkey AS VARCHAR) AS source_file, DATE '1998-06-24' AS statement_date, 'checking' AS account, {_FOUR} AS last4, {_ABS(1)} AS beginning, {_ABS(2)} AS ending FROM customer
      UNION ALL SELECT CAST(c_custkey AS VARCHAR), DATE '1998-06-24', 'savings', {_FOUR}, {_ABS(3)}, {_ABS(4)} FROM customer WHERE c_custkey % 3 > 0""",
    "statement_ally_balances": f"""SELECT CAST(c_custkey AS VARCHAR) AS source_file, 'spending' AS account, {_FOUR} AS last4, {_ABS(0)} AS beginning, {_ABS(1)} AS ending FROM customer
      UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'savings', {_FOUR}, {_ABS(1)}, {_ABS(2)} FROM customer""",
}
