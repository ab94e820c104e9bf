"""Queries over brokerage statements written from the star schema: one for each order or customer, a holding for each
line item. Their SQL never takes a text apart: it says what each statement was made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import binding as b
from .sources import holdings

#: Names of securities, by line number.
_NAMES = ["ACME INC", "WORLD ETF", "TREASURY NOTES", "GROWTH FUND", "GOLD SHARES", "MONEY MARKET"]
_FUNDS = ["Vanguard Target Retire Tr", "Total Stock Index Fund", "Stable Value Trust", "Core Bond Fund", "Growth ETF Fund", "Money Market Fund"]


def _pick(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _money(c) -> Column:
    return F.format_number(c if isinstance(c, Column) else F.col(c), 2)


def _holdings(spark, sf_dir) -> DataFrame:
    """Each line item as a holding, with its order."""
    lines = b.table(spark, sf_dir, "lineitem")
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    own = lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("value"), F.col("l_quantity").cast("decimal(18,0)").alias("quantity"), "l_suppkey",
        F.translate(F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"), "0123456789", "KLMNOPQRST").alias("symbol"), (F.col("l_partkey") % 900 + F.lit(1.25)).cast("decimal(18,2)").alias("price"),
    )
    return own.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _blocks(spark, sf_dir, line: Column, first: Column | None = None) -> DataFrame:
    """(o_orderkey, o_custkey, day, body, value): the lines of each order, in order, and what they are worth together."""
    key = ([first] if first is not None else []) + [F.col(c) for c in ("l_linenumber", "l_partkey", "value", "quantity", "l_suppkey")]
    own = _holdings(spark, sf_dir).select("o_orderkey", "o_custkey", "day", "value", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)], line.alias("line")).alias("one"))
    return own.groupBy("o_orderkey", "o_custkey", "day").agg(F.array_sort(F.collect_list("one")).alias("l"), F.sum("value").cast("decimal(18,2)").alias("value")).select("o_orderkey", "o_custkey", "day", F.array_join("l.line", "\n").alias("body"), "value")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _each(found: DataFrame, text: Column) -> DataFrame:
    return found.select(F.col("o_orderkey").cast("string").alias("source_file"), text.alias("text"))


def _fidelity(spark, sf_dir) -> DataFrame:
    """Statements of customers, an account for each order on a page of its own. Every fifth value is reported too high."""
    symbol = F.col("symbol")
    low = F.col("l_partkey") % 2 == 0
    line = _text(_pick(_NAMES, "l_linenumber"), F.when(low, _text(" (", symbol, ")")).otherwise(""), " ", _money("price"), " ", F.col("quantity").cast("string"), ".000 ", _money("price"), " ", _money("value"), " ", _money("price"), " -12.00", F.when(~low, _text("\nUSD\n(", symbol, ") 1.580")).otherwise(""))
    own = _blocks(spark, sf_dir, line)
    number = _text(F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), "-", F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))
    core = F.col("o_orderkey") % 50 + 1
    reported = F.when(F.col("o_orderkey") % 5 == 0, F.col("value") * 2).otherwise(F.col("value") + F.when(F.col("single"), core).otherwise(0)).cast("decimal(18,2)")
    period = _text(F.date_format("day", "MMMM"), " 1, ", F.date_format("day", "yyyy"), " - ", F.date_format(F.last_day("day"), "MMMM d, yyyy"))
    kind = _pick(["Roth IRA", "Rollover IRA of California", "Individual"], "o_orderkey")
    page = _text(period, "\n", kind, "\nAccount Number: ", number, "\nEnding Account Value $", _money(reported), "\nDescription\n", F.col("body"), "\nFIDELITY GOVERNMENT CASH $1.00 $", _money(core), "\nTotal Core Account (3% of account holdings) $1.00 $", _money(core), "\nTotal Exchange Traded Products (97% of account holdings) $2.00 $", _money("value"))
    row = _text("FIDELITY ", F.upper(_pick(["Roth IRA", "Traditional IRA", "Brokerage"], "o_orderkey")), " JANE DOE - INDIVIDUAL ", number, " $12.49 ", _money(reported))
    several = own.groupBy("o_custkey").agg(F.count("*").alias("n"))
    own = own.join(several, "o_custkey").withColumn("single", F.col("n") == 1)
    pages = own.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", page.alias("page"), row.alias("row")))).alias("p"))
    table = F.array_join(F.transform("p", lambda x, i: _text((i + 2).cast("string"), " ", x["row"])), "\n")
    return pages.select(F.col("o_custkey").cast("string").alias("source_file"), _text("Fidelity Investments\nAccounts Included in This Report\n", table, "\f", F.array_join("p.page", "\f")).alias("text"))


def _schwab(spark, sf_dir) -> DataFrame:
    """Every second statement has its cash as an ending balance only."""
    own = _blocks(spark, sf_dir, _text(F.col("symbol"), " ", _pick(_NAMES, "l_linenumber"), " ", F.col("quantity").cast("string"), ".0000 ", _money("price"), " ", _money("value")))
    number = _text(F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), "-", F.lpad((F.col("o_orderkey") % 9999).cast("string"), 4, "0"))
    cash = (F.col("o_orderkey") % 300).cast("decimal(18,2)")
    swept = F.when(F.col("o_orderkey") % 2 == 0, _text("Total Cash and Cash Investments $1.00 $", _money(cash))).otherwise(_text("Ending Balance on 12/31 $", _money(cash)))
    total = F.when(F.col("o_orderkey") % 5 == 0, F.lit(0)).otherwise(F.col("value") + cash).cast("decimal(18,2)")
    text = _text("Charles Schwab\nSchwab One Account\nAccount Number: ", number, "\nStatement Period ", F.date_format("day", "MMMM"), "1-", F.date_format("day", "d"), ",", F.date_format("day", "yyyy"), "\nEnding Account Value as of 12/31 $", _money(total), "\nTotal Equities $", _money("value"), "\nquantity 1\n", F.col("body"), "\n", swept)
    return _each(own, text)


def _vanguard(spark, sf_dir) -> DataFrame:
    line = _text(_pick(_FUNDS, "l_linenumber"), F.when(F.col("l_partkey") % 3 == 0, "®").otherwise(""), " $", _money("price"), " $2.00 - $4.34 $", _money("value"), F.when(F.col("l_partkey") % 2 == 0, "\nSeries P").otherwise(""))
    own = _blocks(spark, sf_dir, line)
    text = _text("Vanguard\nBIG CORP 401(K) PLAN–– ", F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), "\nACCOUNT SUMMARY: 01/01/1990 - ", F.date_format("day", "MM/dd/yyyy"), "\nVanguard Old Fund $1.00 $2.00\nTotal Account Balance: $", _money("value"), "\nShort-Term Reserves $", _money(F.col("o_orderkey") % 70), "\nInvestment Activity\n", F.col("body"), "\nFee Summary\nVanguard Late Fund $1.00 $3.00")
    return _each(own, text)


def _wealthfront(spark, sf_dir) -> DataFrame:
    """Holdings in three sections; every seventh has a quantity that can't be right."""
    section = F.col("l_linenumber") % 3
    mark = F.when(F.col("l_partkey") % 4 == 0, F.lpad(F.col("l_partkey").cast("string"), 9, "0")).otherwise(F.col("symbol"))
    quantity = F.when(F.col("l_partkey") % 7 == 0, _text(F.col("quantity").cast("string"), ",000,001")).otherwise(F.col("quantity").cast("string"))
    line = _text(_pick(_NAMES, "l_linenumber"), " ", mark, " ", quantity, " $", _money("price"), " $", _money("value"))
    # each section's header comes before its lines: a line with the least key
    heads = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.explode(F.array(*[F.struct(F.lit(i).alias("section"), F.lit(h).alias("line")) for i, h in enumerate(["ETFS / STOCKS", "MONEY MARKET FUNDS", "OTHER"])])).alias("h"))
    own = _holdings(spark, sf_dir).select("o_orderkey", "o_custkey", "day", "value", F.struct(section.alias("k0"), F.lit(1).alias("k1"), *[F.col(c).alias(f"k{i + 2}") for i, c in enumerate(("l_linenumber", "l_partkey", "value", "quantity", "l_suppkey"))], line.alias("line")).alias("one"))
    zero = [F.lit(None).cast(own.schema["one"].dataType[f"k{i}"].dataType).alias(f"k{i}") for i in range(2, 7)]
    marks = heads.join(own.select("o_orderkey").distinct(), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey", "day", F.lit(None).cast("decimal(18,2)").alias("value"), F.struct(F.col("h.section").cast(own.schema["one"].dataType["k0"].dataType).alias("k0"), F.lit(0).alias("k1"), *zero, F.col("h.line").alias("line")).alias("one"))
    by = own.unionByName(marks).groupBy("o_orderkey", "o_custkey", "day").agg(F.array_sort(F.collect_list("one")).alias("l"), F.sum("value").cast("decimal(18,2)").alias("value"))
    text = _text("Monthly Statement for ", F.date_format("day", "MMMM"), " 1 - ", F.date_format("day", "d, yyyy"), "\nWealthfront Brokerage LLC\nACCOUNT NUMBERS\nWealthfront: ", F.lpad(F.col("o_orderkey").cast("string"), 8, "W"), "\nI. Holdings\nSUMMARY FUND SMX 1.0 $1.00 $1.00\nHoldings as of today\nSecurity Symbol Shares Share Price Value\n", F.array_join("l.line", "\n"), "\nCASH\nCurrency Value\nUS Dollar $", _money(F.col("o_orderkey") % 90), "\nTotal Holdings $", _money("value"), "\nTRADES Trade Date\nOLD FUND OLD 1.0 $1.00 $1.00")
    return _each(by, text)


def _spaced(c: Column) -> Column:
    return F.replace(_money(c), F.lit(","), F.lit(" "))


def _equatex(spark, sf_dir) -> DataFrame:
    """One plan with its dollars beside the shares, one locked for every second participant, one without locked shares."""
    o = b.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("value"))
    o = o.repartition("o_orderkey")  # a file has few row groups, and a row makes a long text
    shares = (F.col("o_orderkey") % 1000).cast("string")
    own = _text("Own SAP ", _spaced(F.col("value") * 3), " USD\nShares Total\n", shares, ".5 ", _spaced(F.col("value")), " USD\nAvailable ", shares, ".5 10 133.70 EUR\nLocked 7 10.00 EUR\n")
    move = _text("Move SAP ", _spaced(F.col("value")), " USD\nLocked 25 ", _spaced(F.col("value")), " USD\n", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(_text("93.8634 22 960.29 USD\nAvailable 93.8634 20 000.00 EUR\n")))
    grow = _text("Grow SAP ", _spaced(F.col("value") * 2), " USD\nShares Total\nAvailable 12.25 1 000.00 EUR\nLocked 0 0.00 EUR\n")
    text = _text("EquatePlus by Equatex\nUser ID: ", F.lpad(F.col("o_orderkey").cast("string"), 7, "1"), "\nas of ", F.date_format("day", "d MMM yyyy"), "\n1 Jan 1990 - ", F.date_format("day", "d MMM yyyy"), "\nSAP: 208,35 EUR as of 30 Dec 2025 (XETRA)\nAvailable\nLocked\n", _spaced(F.col("value") * 3), " USD\nOwn SAP 1.00 USD\n", "x" * 700, "\n", own, "-" * 600, "\n", move, "-" * 600, "\n", grow)
    return _each(o, text)


def _ibkr(spark, sf_dir) -> DataFrame:
    """Statements of customers, an account for each order, with rates of its own; every second has none for pounds."""
    currency = F.element_at(F.array(*[F.lit(c) for c in ("EUR", "GBP", "USD")]), (F.col("l_suppkey") % 3 + 1).cast("int"))
    key = F.struct(currency.alias("currency"), "l_linenumber", "l_partkey", "value", "quantity", "l_suppkey", _text(F.col("symbol"), " ", F.col("quantity").cast("string"), " 1 23.5 ", _money("price"), " ", F.col("price").cast("string"), " ", _money("value")).alias("line"))
    own = _holdings(spark, sf_dir).select("o_orderkey", "o_custkey", "day", "value", key.alias("one"), "symbol")
    by = own.groupBy("o_orderkey", "o_custkey", "day").agg(F.array_sort(F.collect_list("one")).alias("l"), F.array_sort(F.collect_set("symbol")).alias("symbols"), F.sum("value").cast("decimal(18,2)").alias("value"))
    block = lambda c: F.when(F.exists("l", lambda x: x["currency"] == c), _text(f"\n{c}\n", F.array_join(F.transform(F.filter("l", lambda x: x["currency"] == c), lambda x: x["line"]), "\n"), "\nTotal 1.00")).otherwise("")
    euro, cash = F.format_string("1.%02d", F.col("o_orderkey") % 10), F.col("o_orderkey") % 100
    pound = F.when(F.col("o_orderkey") % 2 == 1, "GBP 5 1.2 6.00 1.25 6\n").otherwise("")
    number = _text("U", F.lpad(F.col("o_orderkey").cast("string"), 7, "9"))
    text = _text(
        "Account Information\nName Jane Doe\nAccount ", number, "\nAccount Alias main\nBase Currency USD\n", F.date_format("day", "MMMM"), " 1, ", F.date_format("day", "yyyy"), " - ", F.date_format("day", "MMMM d, yyyy"),
        "\nNet Asset Value\nCash 1.00 2.00 3.00 4.00\nStock 5.00 6.00 7.00 ", _money("value"), "\nTotal 1.00 1.00 1.00 ", _money("value"), "\nOpen Positions\nSymbol Quantity Mult Cost Price\nStocks", block("EUR"), block("GBP"), block("USD"),
        "\nTotal Stocks in USD 1.00\nForex Balances\nDescription Quantity Cost Price Close Price\nForex USD\nEUR -", _money(cash), " 1.1 7.00 ", euro, " 1\n", pound, "USD ", _money(F.col("o_orderkey") % 1000), " 1.0 1.00 1.0 1\nTotal\nFinancial Instrument Information\n",
        F.array_join(F.transform("symbols", lambda s: _text(s, " HOUSE OF ", s, " LTD 607961218")), "\n"), "\n",
    )
    parts = by.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", text.alias("text")))).alias("p"))
    return parts.select(F.col("o_custkey").cast("string").alias("source_file"), _text("Interactive Brokers\nAccount Summary\n", F.array_join("p.text", "")).alias("text"))


MADE = {"fidelity": _fidelity, "schwab": _schwab, "vanguard": _vanguard, "wealthfront": _wealthfront, "equatex": _equatex, "ibkr": _ibkr}


def _accounts(of: str):
    def query(spark, sf_dir):
        return holdings.accounts(MADE[of](spark, sf_dir), of).drop("positions", "fx_rates", "cash_by_currency", "account_number", "provider")

    return query


def _positions(of: str):
    def query(spark, sf_dir):
        return holdings.positions(holdings.accounts(MADE[of](spark, sf_dir), of)).drop("account_identifier", "statement_date")

    return query


def brokerage_providers(spark, sf_dir) -> DataFrame:
    out = None
    for name, make in MADE.items():
        one = make(spark, sf_dir).select("source_file", F.lit(name).alias("made"), holdings.provider(F.col("text")).alias("provider"))
        out = one if out is None else out.unionByName(one)
    return out


#: Words of accounts and what they mean, with words that look alike.
_KINDS = {"My 401(k) with Roth IRA": "RETIREMENT_401K", "Roth IRA of California": "IRA_ROTH", "an IRA at last": "IRA_TRADITIONAL", "in California, individual": "BROKERAGE", "the Retirement Plan": "RETIREMENT_401K", "pursuant to nothing": "BROKERAGE", "your RSU grant": "STOCK_PLAN", "the ESPP": "STOCK_PLAN", "roth, and some ira": "BROKERAGE"}


def brokerage_account_types(spark, sf_dir) -> DataFrame:
    return b.table(spark, sf_dir, "customer").select("c_custkey", holdings.account_type(F.concat(_pick(list(_KINDS), "c_custkey"), F.lit(" of "), "c_name")).alias("account_type"))


def brokerage_cash(spark, sf_dir) -> DataFrame:
    return holdings.cash_balances(holdings.accounts(_ibkr(spark, sf_dir), "ibkr")).drop("account_identifier")


def brokerage_rates(spark, sf_dir) -> DataFrame:
    return holdings.rates(holdings.accounts(_ibkr(spark, sf_dir), "ibkr"))


QUERIES = {f"brokerage_{of}_accounts": _accounts(of) for of in MADE} | {f"brokerage_{of}_positions": _positions(of) for of in MADE} | {f.__name__: f for f in (brokerage_providers, brokerage_account_types, brokerage_cash, brokerage_rates)}

# --- the same from the tables

_M = "CAST({} AS DECIMAL(18,2))".format
_BASE = """WITH h AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS value, CAST(l_quantity AS DECIMAL(18,0)) AS quantity,
    CAST(l_partkey % 900 + 1.25 AS DECIMAL(18,2)) AS price, translate(lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0'), '0123456789', 'KLMNOPQRST') AS symbol
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT o_orderkey, o_custkey, day, CAST(sum(value) AS DECIMAL(18,2)) AS value, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS account, count(*) OVER (PARTITION BY o_custkey) = 1 AS single FROM h GROUP BY o_orderkey, o_custkey, day)
"""
_KEY = "l_linenumber, l_partkey, value, quantity, l_suppkey"


def _sql_pick(values: list[str], key: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({key} % {len(values)} + 1 AS INT))"


def _sql_accounts(file: str, account: str, kind: str, number: str, day: str, start: str, total: str, cash: str, securities: str, own: str, compared: str, tolerance: float = 0.01, source: str = "o") -> str:
    own, compared, total = _M(own), _M(compared), _M(total)
    return f"""{_BASE}SELECT CAST({file} AS VARCHAR) AS source_file, {account} AS account, {kind} AS account_type, '****' || right({number}, 4) AS account_identifier, {day} AS statement_date, {start} AS statement_start_date,
  'USD' AS base_currency, {total} AS total_value, {_M(cash)} AS total_cash, {_M(securities)} AS total_securities, {own} AS calculated_total, {_M(f'abs({total} - {compared})')} AS reconciliation_diff,
  CASE WHEN {total} = 0 THEN {compared} = 0 ELSE CAST(abs({total} - {compared}) AS DOUBLE) / CAST({total} AS DOUBLE) <= {tolerance} END AS is_reconciled FROM {source}"""


_FIELDS = {
    "source_file": "CAST(o_orderkey AS VARCHAR)", "account": "0", "row_index": f"CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY {_KEY}) - 1 AS INT)", "symbol": "symbol", "cusip": "CAST(NULL AS VARCHAR)",
    "security_name": _sql_pick(_NAMES, "l_linenumber"), "security_type": "", "asset_class": "", "quantity": "CAST(quantity AS DECIMAL(18,6))", "price": "CAST(price AS DECIMAL(18,4))", "market_value": "value",
    "cost_basis": "CAST(NULL AS DECIMAL(18,2))", "currency": "'USD'", "market_value_usd": "CAST(NULL AS DECIMAL(18,2))", "fx_rate_used": "CAST(NULL AS DECIMAL(18,8))", "is_vested": "CAST(NULL AS BOOLEAN)",
}


def _sql_positions(source: str = "h", **fields: str) -> str:
    return f"SELECT {', '.join(f'{v} AS {k}' for k, v in (_FIELDS | fields).items())} FROM {source}"


_FIRST = "CAST(date_trunc('month', day) AS DATE)"
_F_TYPES, _F_CLASSES = ["STOCK", "ETF", "BOND", "MUTUAL_FUND", "ETF", "MONEY_MARKET"], ["EQUITY", "EQUITY", "FIXED_INCOME", "EQUITY", "ALTERNATIVE", "CASH"]
_F_CASH = "(o_orderkey % 50 + 1)"
_F_OWN = f"(value + CASE WHEN single THEN {_F_CASH} ELSE 0 END)"
_F_HAS_CASH = "(single OR EXISTS (SELECT 1 FROM h WHERE h.o_orderkey = o.o_orderkey AND l_linenumber % 6 = 5))"
_S_CASH = "CAST(o_orderkey % 300 AS DECIMAL(18,2))"
_W_BAD = "l_partkey % 7 = 0"
_W_KIND = "CASE l_linenumber % 3 WHEN 1 THEN 'MONEY_MARKET' WHEN 0 THEN CASE WHEN l_linenumber % 6 = 3 THEN 'ETF' ELSE 'STOCK' END ELSE CASE WHEN l_linenumber % 6 = 5 THEN 'MONEY_MARKET' ELSE 'STOCK' END END"
_W_LONG = "l_partkey % 4 = 0"
_E = "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS value, {} FROM orders"
_I_CURRENCY = "list_extract(['EUR', 'GBP', 'USD'], CAST(l_suppkey % 3 + 1 AS INT))"
_I_RATE = "CASE l_suppkey % 3 WHEN 0 THEN CAST(1 + (o_orderkey % 10) / 100.0 AS DECIMAL(18,8)) WHEN 1 THEN CASE WHEN o_orderkey % 2 = 1 THEN CAST(1.25 AS DECIMAL(18,8)) ELSE CAST(1 AS DECIMAL(18,8)) END ELSE CAST(1 AS DECIMAL(18,8)) END"
_I_ORDER = "CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END"
_I_USD = f"CAST(round(value * ({_I_RATE}), 2) AS DECIMAL(18,2))"
_I_CASH = "(-(o_orderkey % 100) * (1 + (o_orderkey % 10) / 100.0) + CASE WHEN o_orderkey % 2 = 1 THEN 5 * 1.25 ELSE 0 END + o_orderkey % 1000)"
_I_OWN = f"((SELECT sum({_I_USD}) FROM h WHERE h.o_orderkey = o.o_orderkey) + CAST({_I_CASH} AS DECIMAL(18,8)))"
#: Accounts of customers are numbered over the orders that have line items.
_I_ACCOUNT = "(SELECT account FROM o WHERE o.o_orderkey = h.o_orderkey)"
_VALUED = f"(SELECT coalesce(sum(value), 0) FROM h WHERE h.o_orderkey = o.o_orderkey AND NOT ({_W_BAD}))"

SQL = {
    "brokerage_fidelity_accounts": _sql_accounts(
        "o_custkey", "account", "list_extract(['IRA_ROTH', 'IRA_TRADITIONAL', 'BROKERAGE'], CAST(o_orderkey % 3 + 1 AS INT))", "lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0')", "last_day(day)", _FIRST,
        f"CASE WHEN o_orderkey % 5 = 0 THEN value * 2 ELSE {_F_OWN} END", _F_CASH, "value", _F_OWN, f"CASE WHEN {_F_HAS_CASH} THEN {_F_OWN} ELSE value + {_F_CASH} END",
    ),
    "brokerage_fidelity_positions": f"""{_BASE}, p AS (SELECT h.*, account FROM h JOIN o USING (o_orderkey)), c AS (SELECT o_orderkey, o_custkey, (SELECT count(*) FROM h WHERE h.o_orderkey = o.o_orderkey) AS n FROM o WHERE single)
      {_sql_positions('p', source_file='CAST(o_custkey AS VARCHAR)', account='account', security_type=_sql_pick(_F_TYPES, 'l_linenumber'), asset_class=_sql_pick(_F_CLASSES, 'l_linenumber'), cost_basis='price')}
      UNION ALL {_sql_positions('c', source_file='CAST(o_custkey AS VARCHAR)', row_index='CAST(n AS INT)', symbol='NULL', security_name="'FIDELITY GOVERNMENT CASH'", security_type="'MONEY_MARKET'", asset_class="'CASH'", quantity=f'CAST({_F_CASH} AS DECIMAL(18,6))', price='1', market_value=_M(_F_CASH))}""",
    "brokerage_schwab_accounts": _sql_accounts(
        "o_orderkey", "0", "'BROKERAGE'", "lpad(CAST(o_orderkey % 9999 AS VARCHAR), 4, '0')", "day", _FIRST, f"CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE value + {_S_CASH} END",
        f"CASE WHEN o_orderkey % 2 = 0 THEN {_S_CASH} ELSE 0 END", "value", f"value + {_S_CASH}", f"value + {_S_CASH}",
    ),
    "brokerage_schwab_positions": f"""{_BASE}, c AS (SELECT o_orderkey, {_S_CASH} AS cash, (SELECT count(*) FROM h WHERE h.o_orderkey = o.o_orderkey) AS n FROM o WHERE o_orderkey % 300 > 0)
      {_sql_positions(security_type=_sql_pick(['STOCK', 'ETF', 'BOND', 'MUTUAL_FUND', 'STOCK', 'MONEY_MARKET'], 'l_linenumber'), asset_class=_sql_pick(['EQUITY', 'EQUITY', 'FIXED_INCOME', 'EQUITY', 'EQUITY', 'CASH'], 'l_linenumber'))}
      UNION ALL {_sql_positions('c', row_index='CAST(n AS INT)', symbol='NULL', security_name="'CHARLES SCHWAB BANK SWEEP'", security_type="'CASH'", asset_class="'CASH'", quantity='CAST(cash AS DECIMAL(18,6))', price='1', market_value='cash')}""",
    "brokerage_vanguard_accounts": _sql_accounts("o_orderkey", "0", "'RETIREMENT_401K'", "lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0')", "day", "DATE '1990-01-01'", "value", "o_orderkey % 70", "value - o_orderkey % 70", "value", "value"),
    "brokerage_vanguard_positions": _BASE + _sql_positions(
        security_name=f"{_sql_pick(_FUNDS, 'l_linenumber')} || CASE WHEN l_partkey % 2 = 0 THEN ' Series P' ELSE '' END", symbol="NULL", quantity="CAST(NULL AS DECIMAL(18,6))", price="CAST(NULL AS DECIMAL(18,4))",
        security_type=_sql_pick(["MUTUAL_FUND", "MUTUAL_FUND", "MUTUAL_FUND", "BOND", "ETF", "MONEY_MARKET"], "l_linenumber"), asset_class=_sql_pick(["EQUITY", "EQUITY", "FIXED_INCOME", "FIXED_INCOME", "EQUITY", "CASH"], "l_linenumber"),
    ),
    "brokerage_wealthfront_accounts": _sql_accounts("o_orderkey", "0", "'BROKERAGE'", "lpad(CAST(o_orderkey AS VARCHAR), 8, 'W')", "day", _FIRST, "value", "o_orderkey % 90", "value - o_orderkey % 90", _VALUED, _VALUED),
    "brokerage_wealthfront_positions": f"{_BASE}, w AS (SELECT *, {_W_KIND} AS kind FROM h WHERE NOT ({_W_BAD})) " + _sql_positions(
        "w", row_index=f"CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber % 3, {_KEY}) - 1 AS INT)", symbol=f"CASE WHEN NOT ({_W_LONG}) THEN symbol END", cusip=f"CASE WHEN {_W_LONG} THEN lpad(CAST(l_partkey AS VARCHAR), 9, '0') END",
        security_type="kind", asset_class="CASE WHEN kind = 'MONEY_MARKET' THEN 'CASH' WHEN l_linenumber % 6 = 2 THEN 'FIXED_INCOME' WHEN l_linenumber % 6 = 4 THEN 'ALTERNATIVE' ELSE 'EQUITY' END",
    ),
    "brokerage_equatex_accounts": _sql_accounts(
        "o_orderkey", "0", "'STOCK_PLAN'", "lpad(CAST(o_orderkey AS VARCHAR), 7, '1')", "day", "DATE '1990-01-01'", "3 * value", "0", "3 * value", "3 * value + CASE WHEN o_orderkey % 2 = 1 THEN 22960.29 ELSE 0 END", "3 * value + CASE WHEN o_orderkey % 2 = 1 THEN 22960.29 ELSE 0 END",
        source="(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS value FROM orders)",
    ),
    "brokerage_equatex_positions": " UNION ALL ".join(
        _sql_positions(
            f"({_E.format('0 AS x')} {where})", symbol="'SAP'", row_index=row, security_name=f"'{name} - Shares'", security_type=f"'{kind}'", asset_class="'EQUITY'", quantity=f"CAST({shares} AS DECIMAL(18,6))", price="CAST(208.35 AS DECIMAL(18,4))", market_value=_M(value), is_vested="true",
        )
        for name, kind, shares, value, row, where in [
            ("Own SAP", "ESPP", "o_orderkey % 1000 + 0.5", "value", "0", ""), ("Move SAP", "STOCK", "93.8634", "22960.29", "1", "WHERE o_orderkey % 2 = 1"), ("Grow SAP", "STOCK", "12.25", "2 * value", "CAST(1 + o_orderkey % 2 AS INT)", ""),
        ]
    ),
    "brokerage_ibkr_accounts": _sql_accounts("o_custkey", "account", "'BROKERAGE'", "lpad(CAST(o_orderkey AS VARCHAR), 7, '9')", "day", _FIRST, "value", "4", "value", _I_OWN, _I_OWN, 0.02),
    "brokerage_ibkr_positions": _BASE + _sql_positions(
        source_file="CAST(o_custkey AS VARCHAR)", account=_I_ACCOUNT, row_index=f"CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, {_KEY}) - 1 AS INT)", security_name="'HOUSE OF ' || symbol || ' LTD'",
        security_type="'STOCK'", asset_class="'EQUITY'", cost_basis="price", currency=_I_CURRENCY, market_value_usd=_I_USD, fx_rate_used=_I_RATE,
    ),
    "brokerage_providers": f"{_BASE} SELECT CAST(o_orderkey AS VARCHAR) AS source_file, name AS made, name AS provider FROM o, (SELECT unnest(['schwab', 'vanguard', 'wealthfront']) AS name) UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'equatex', 'equatex' FROM orders UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), name, name FROM o, (SELECT unnest(['fidelity', 'ibkr']) AS name)",
    "brokerage_account_types": f"SELECT c_custkey, {_sql_pick(list(_KINDS.values()), 'c_custkey')} AS account_type FROM customer",
    "brokerage_cash": f"""{_BASE} SELECT CAST(o_custkey AS VARCHAR) AS source_file, account, day AS statement_date, 'EUR' AS currency, {_M('-(o_orderkey % 100)')} AS amount, {_M('round(-(o_orderkey % 100) * CAST(1 + (o_orderkey % 10) / 100.0 AS DECIMAL(18,8)), 2)')} AS amount_usd FROM o
      UNION ALL SELECT CAST(o_custkey AS VARCHAR), account, day, 'GBP', 5, 6.25 FROM o WHERE o_orderkey % 2 = 1
      UNION ALL SELECT CAST(o_custkey AS VARCHAR), account, day, 'USD', {_M('o_orderkey % 1000')}, {_M('o_orderkey % 1000')} FROM o""",
    "brokerage_rates": f"""{_BASE} SELECT CAST(o_custkey AS VARCHAR) AS source_file, account, day AS statement_date, 'EUR' AS currency, CAST(1 + (o_orderkey % 10) / 100.0 AS DECIMAL(18,8)) AS rate FROM o
      UNION ALL SELECT CAST(o_custkey AS VARCHAR), account, day, 'GBP', 1.25 FROM o WHERE o_orderkey % 2 = 1 UNION ALL SELECT CAST(o_custkey AS VARCHAR), account, day, 'USD', 1 FROM o""",
}
