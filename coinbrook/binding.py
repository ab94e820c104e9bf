"""Ledger tables made from the star schema, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in {"BUILDING": "CHECKING", "HOUSEHOLD": "SAVINGS", "AUTOMOBILE": "CREDIT_CARD", "MACHINERY": "BROKERAGE", "FURNITURE": "RETIREMENT_401K"}.items() for x in pair])
    currency = F.when(F.col("c_nationkey") % 5 == 0, "EUR").when(F.col("c_nationkey") % 5 == 1, "GBP").otherwise("USD")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_nationkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("Bank "), (F.col("c_custkey") % 7).cast("string")).alias("institution"),
        kind[F.col("c_mktsegment")].alias("account_type"),
        currency.alias("currency"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0").alias("last4"),
    )


def flags(kind) -> tuple:
    """(is_spend, is_income) of a transaction type."""
    return kind == "EXPENSE", kind == "INCOME"


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions before currency conversion."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    joined = joined.join(accounts(spark, sf_dir), F.col("o_custkey") == F.col("account_id"))
    kind = F.when(F.col("l_returnflag") == "R", "INCOME").when(F.col("l_returnflag") == "A", "EXPENSE").when(F.col("l_linestatus") == "O", "TRANSFER").otherwise("UNCATEGORIZED")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    spend, income = flags(kind)
    return joined.select(
        "account_id", "user_id", "account_type", "currency",
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("p_brand").alias("merchant"),
        F.concat(F.upper("p_name"), F.lit(" "), "p_brand").alias("description_raw"),
        F.nullif("p_type", F.lit("STANDARD")).alias("category"),
        (F.col("l_extendedprice").cast("decimal(15,2)") * sign).cast("decimal(15,2)").alias("amount"),
        kind.alias("transaction_type"), spend.alias("is_spend"), income.alias("is_income"),
        (F.col("l_linenumber") == 7).alias("needs_review"),
    )


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the first twenty days of each month; the others are missing. They are made from a sequence of days, so
    the line items are not read a second time for them."""
    every = F.sequence(F.lit("1990-01-01").cast("date"), F.lit("2034-12-31").cast("date"))
    days = spark.range(1).select(F.explode(every).alias("rate_date")).where(F.dayofmonth("rate_date") <= 20)
    step = (F.month("rate_date").cast("decimal(18,8)") / 100).cast("decimal(18,8)")
    return days.select("rate_date", F.inline(F.array(*[F.struct(F.lit(c).alias("from_currency"), (F.lit(r).cast("decimal(18,8)") + step).cast("decimal(18,8)").alias("rate")) for c, r in (("EUR", "1.05"), ("GBP", "1.25"))])))


def shipped_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the rates whose day has a shipment."""
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("rate_date"))
    return fx_rates(spark, sf_dir).join(days, "rate_date", "left_semi")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.fx import convert

    return convert(raw_transactions(spark, sf_dir), fx_rates(spark, sf_dir))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("account_id"), F.col("o_orderdate").cast("date").alias("statement_date"), F.col("o_totalprice").cast("decimal(18,2)").alias("total_value")
    )
    return orders.join(accounts(spark, sf_dir).select("account_id", "user_id", "account_type"), "account_id")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = F.array(*[F.lit(c) for c in ("EQUITY", "FIXED_INCOME", "CASH", "ALTERNATIVE", "UNKNOWN")])
    value = F.col("l_extendedprice").cast("decimal(18,2)")
    usd = F.when(F.col("l_linenumber") == 1, F.lit(0).cast("decimal(18,2)")).when(F.col("l_linenumber") <= 4, value)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("snapshot_id"), value.alias("market_value"), usd.alias("market_value_usd"), F.element_at(classes, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("asset_class")
    )


#: The same tables in SQL.
SQL = """
accounts AS (
  SELECT c_custkey AS account_id, c_nationkey AS user_id, c_name AS name, 'Bank ' || CAST(c_custkey % 7 AS VARCHAR) AS institution,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'CHECKING' WHEN 'HOUSEHOLD' THEN 'SAVINGS' WHEN 'AUTOMOBILE' THEN 'CREDIT_CARD'
      WHEN 'MACHINERY' THEN 'BROKERAGE' WHEN 'FURNITURE' THEN 'RETIREMENT_401K' END AS account_type,
    CASE c_nationkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'USD' END AS currency, c_acctbal >= 0 AS is_active,
    lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS last4
  FROM customer),
fx AS (
  SELECT rate_date, from_currency, CAST(base + month(rate_date) / CAST(100 AS DECIMAL(5,0)) AS DECIMAL(18,8)) AS rate
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS rate_date FROM lineitem) d,
    (VALUES ('EUR', CAST('1.05' AS DECIMAL(18,8))), ('GBP', CAST('1.25' AS DECIMAL(18,8)))) v(from_currency, base)
  WHERE day(rate_date) <= 20),
raw AS (
  SELECT a.account_id, a.user_id, a.account_type, a.currency, CAST(l_shipdate AS DATE) AS date, p_brand AS merchant,
    upper(p_name) || ' ' || p_brand AS description_raw, NULLIF(p_type, 'STANDARD') AS category,
    CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS DECIMAL(15,2)) AS amount,
    CASE WHEN l_returnflag = 'R' THEN 'INCOME' WHEN l_returnflag = 'A' THEN 'EXPENSE' WHEN l_linestatus = 'O' THEN 'TRANSFER' ELSE 'UNCATEGORIZED' END AS transaction_type,
    l_returnflag = 'A' AS is_spend, l_returnflag = 'R' AS is_income, l_linenumber = 7 AS needs_review
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN accounts a ON o_custkey = a.account_id),
tx AS (
  SELECT raw.*, rate AS fx_rate_used, CASE WHEN currency = 'USD' THEN amount ELSE CAST(round(amount * rate, 2) AS DECIMAL(15,2)) END AS amount_usd,
    CASE WHEN currency = 'USD' THEN 'same' WHEN rate IS NULL THEN 'none' ELSE 'table' END AS fx_rate_source,
    COALESCE(CASE WHEN currency = 'USD' THEN amount ELSE CAST(round(amount * rate, 2) AS DECIMAL(15,2)) END, amount) AS eff
  FROM raw LEFT JOIN fx ON raw.currency = fx.from_currency AND raw.date = fx.rate_date),
snaps AS (
  SELECT o_orderkey AS snapshot_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS statement_date, CAST(o_totalprice AS DECIMAL(18,2)) AS total_value, user_id, account_type
  FROM orders JOIN accounts ON o_custkey = account_id),
pos AS (
  SELECT l_orderkey AS snapshot_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS market_value,
    CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber <= 4 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS market_value_usd,
    CASE l_suppkey % 5 WHEN 0 THEN 'EQUITY' WHEN 1 THEN 'FIXED_INCOME' WHEN 2 THEN 'CASH' WHEN 3 THEN 'ALTERNATIVE' ELSE 'UNKNOWN' END AS asset_class
  FROM lineitem)
"""
