"""The ledger's queries over the star schema, and the SQL that each is held against."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import binding as b
from . import brokerage_queries, statement_queries, text_queries, upkeep_queries
from .functions import classify
from .operators import changes, dedup, lists, networth, rules, spending
from .schemas import ASSET_CLASSES

START, END, AS_OF = dt.date(1997, 3, 15), dt.date(1998, 9, 10), dt.date(2001, 6, 30)

#: Rules and learned merchants of every user, for the queries below.
RULES = [
    {"id": "r1", "rule_type": "MERCHANT_MATCH", "pattern": "brand#1", "priority": 20, "created_at": "2024-01-01", "action": '{"category": "First", "transaction_type": null}'},
    {"id": "r2", "rule_type": "DESCRIPTION_REGEX", "pattern": "^(red|BLUE)\\s+", "priority": 10, "created_at": "2024-01-02", "action": '{"category": "Colour", "transaction_type": "TRANSFER", "subcategory": "Hue"}'},
    {"id": "r3", "rule_type": "AMOUNT_RANGE", "pattern": '{"min": 90000}', "priority": 10, "created_at": "2024-01-01", "action": '{"transaction_type": "EXPENSE"}'},
    {"id": "r4", "rule_type": "COMPOSITE", "pattern": '{"merchant": "Brand#2", "amount_min": 1000, "amount_max": 20000.5, "description_regex": "RING|gear"}', "priority": 15, "created_at": "2024-01-01", "action": '{"category": "Both", "transaction_type": "INCOME"}'},
    {"id": "r5", "rule_type": "MERCHANT_MATCH", "pattern": "brand", "priority": 1, "created_at": "2024-01-01", "is_active": False, "action": '{"category": "Never"}'},
    {"id": "r6", "rule_type": "DESCRIPTION_REGEX", "pattern": "([", "priority": 1, "created_at": "2024-01-01", "action": '{"category": "Broken"}'},
]
_RULE_SQL = {
    "r2": "regexp_matches(description_raw, '(?i)^(red|BLUE)\\s+')",
    "r3": "CAST(amount AS DOUBLE) >= 90000",
    "r4": "((contains(lower(merchant), 'brand#2') OR contains(lower(description_raw), 'brand#2')) AND CAST(amount AS DOUBLE) BETWEEN 1000 AND 20000.5 AND regexp_matches(description_raw, '(?i)RING|gear'))",
    "r1": "(contains(lower(merchant), 'brand#1') OR contains(lower(description_raw), 'brand#1'))",
}
_MATCHED = "CASE " + " ".join(f"WHEN {p} THEN '{r}'" for r, p in _RULE_SQL.items()) + " END"


def _tx(s, d):
    return b.transactions(s, d)


def merchants(spark, sf_dir) -> DataFrame:
    """A learned merchant for every third brand of each user."""
    nations = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"))
    brands = b.table(spark, sf_dir, "part").select(F.col("p_brand").alias("merchant_normalized")).distinct().withColumn("user_id", F.explode(F.sequence(F.lit(0), F.lit(24))))
    number = F.regexp_extract("merchant_normalized", "[0-9]+", 0).cast("int")
    category = F.when(number % 2 == 0, "Transfers").otherwise("Hobbies")
    return brands.where(number % 3 == 0).join(nations, "user_id", "left_semi").select("user_id", "merchant_normalized", category.alias("category"), F.lit(0.8).alias("confidence"), (number * 100).alias("times_applied"))


_MERCHANTS = """
mc AS (SELECT n_nationkey AS user_id, brand AS merchant_normalized, CASE WHEN num % 2 = 0 THEN 'Transfers' ELSE 'Hobbies' END AS category, 0.8 AS confidence, num * 100 AS times_applied
  FROM nation, (SELECT DISTINCT p_brand AS brand, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS num FROM part) WHERE num % 3 = 0)"""

#: Documents' lines as descriptions, for the functions over text.
def _descriptions(spark, sf_dir) -> DataFrame:
    parts = b.table(spark, sf_dir, "part")
    words = ["COFFEE HOUSE", "REFUND OF", "AUTOPAY", "PAYROLL", "GARDEN", "LATE FEE", "ZELLE TO", "CASHBACK", "SHELL", "*#Mixed  Case#"]
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % len(words) + 1).cast("int"))
    amount = (F.col("p_retailprice").cast("decimal(15,2)") * F.when(F.col("p_partkey") % 4 == 0, -1).otherwise(1)).cast("decimal(15,2)")
    return parts.select(F.col("p_partkey").alias("id"), F.concat(word, F.lit(" "), "p_name").alias("description_raw"), amount.alias("amount"))


_DESCRIPTIONS = """
descr AS (SELECT p_partkey AS id, list_extract(['COFFEE HOUSE', 'REFUND OF', 'AUTOPAY', 'PAYROLL', 'GARDEN', 'LATE FEE', 'ZELLE TO', 'CASHBACK', 'SHELL', '*#Mixed  Case#'], CAST(p_partkey % 10 + 1 AS INT)) || ' ' || p_name AS description_raw,
  CAST(CAST(p_retailprice AS DECIMAL(15,2)) * CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE 1 END AS DECIMAL(15,2)) AS amount FROM part)"""


def _any(words, of="d"):
    return "(" + " OR ".join("contains({}, '{}')".format(of, w.replace("'", "''")) for w in words) + ")"


def _cascade(of="d"):
    return "CASE " + " ".join(f"WHEN {_any(words, of)} THEN '{category}'" for category, words in classify.KEYWORDS) + " ELSE 'Other Expenses' END"


def _import_rows(spark, sf_dir) -> DataFrame:
    """Orders as parsed rows: a file for each day, with rows that repeat."""
    o = b.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("account_id"), F.md5(F.col("o_orderstatus")).alias("file_hash"), (F.col("o_orderkey") % 400).alias("row_index"))


_IMPORTS = "imp AS (SELECT o_orderkey AS id, o_custkey % 50 AS account_id, md5(o_orderstatus) AS file_hash, o_orderkey % 400 AS row_index FROM orders), keyed AS (SELECT *, sha256(CAST(account_id AS VARCHAR) || '|' || file_hash || '|' || CAST(row_index AS VARCHAR)) AS hash_dedup_key FROM imp)"


def _keyed(s, d):
    return _import_rows(s, d).withColumn("hash_dedup_key", dedup.import_key("account_id", "file_hash", "row_index"))


def _near(s, d):
    e = b.table(s, d, "events")
    return dedup.near_duplicates(e.select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("date"), F.col("value").cast("decimal(15,2)").alias("amount"), F.concat_ws(" ", F.upper("event_type"), (F.col("user_id") % 20).cast("string")).alias("description_raw")))


def _event_snaps(s, d):
    e = b.table(s, d, "events")
    return e.select(F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("account_id"), (F.col("user_id") % 7).alias("user_id"), F.col("ts").cast("date").alias("statement_date"), F.col("value").cast("decimal(18,2)").alias("total_value"))


QUERIES = {
    "range_summary": lambda s, d: spending.range_summary(_tx(s, d), START, END),
    "monthly_summary": lambda s, d: spending.monthly_summary(_tx(s, d), 1998, 12),
    "monthly_category_breakdown": lambda s, d: spending.period_categories(_tx(s, d), *spending.month_range(1998, 12), half_open=True),
    "yearly_summary": lambda s, d: spending.yearly_summary(_tx(s, d), 1998),
    "category_breakdown": lambda s, d: spending.category_breakdown(_tx(s, d), START, END),
    "top_merchants": lambda s, d: spending.top_merchants(_tx(s, d), START, END, limit=5),
    "overview": lambda s, d: spending.overview(_tx(s, d), AS_OF),
    "yoy_year": lambda s, d: spending.yoy_year(_tx(s, d), 1998, 1997),
    "yoy_year_months": lambda s, d: spending.yoy_year_months(_tx(s, d), 1998, 1997),
    "yoy_month_categories": lambda s, d: spending.yoy_month_categories(_tx(s, d), 1998, 1997, 6),
    "spending_velocity": lambda s, d: spending.spending_velocity(_tx(s, d), AS_OF, 12),
    **{f"group_by_{k}": lambda s, d, k=k: spending.group_by(_tx(s, d), k) for k in ("merchant", "category", "type", "account", "month")},
    "displayed_net": lambda s, d: spending.displayed_net(_tx(s, d)),
    "insights": lambda s, d: spending.insights(_tx(s, d), START, END),
    "distinct_categories": lambda s, d: spending.distinct_categories(_tx(s, d)),
    "merchant_count": lambda s, d: spending.merchant_count(_tx(s, d), "Brand#7"),
    "account_counts": lambda s, d: lists.account_counts(b.accounts(s, d), _tx(s, d), b.snapshots(s, d), b.positions(s, d), _keyed(s, d).select("account_id", "file_hash").distinct()),
    "account_families": lambda s, d: lists.families(b.accounts(s, d)),
    "account_search_words": lambda s, d: b.accounts(s, d).where(lists.has_words(F.concat("name", F.lit(" "), "institution"), "bank 3 0012")).select("account_id", "name"),
    "import_visibility": lambda s, d: lists.visible_imports(b.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("account_id"), (F.col("o_orderkey") % 25).alias("user_id")), b.accounts(s, d), 4).select("id"),
    "list_transactions_page": lambda s, d: lists.page(_tx(s, d).select("date", "account_id", "description_raw", F.col("amount").cast("double").alias("amount")), [F.desc("date"), "account_id", "description_raw", "amount"], 3, 50),
    "list_snapshots_page": lambda s, d: lists.page(b.snapshots(s, d).select("snapshot_id", "statement_date", F.col("total_value").cast("double").alias("total_value")), [F.desc("statement_date"), "snapshot_id"], 3, 50),
    "search_description": lambda s, d: lists.filtered(_tx(s, d), search="r_ng%brand#1").groupBy("user_id", "description_raw").agg(F.count("*").alias("n")),
    "list_filtered": lambda s, d: lists.filtered(_tx(s, d), user=3, kind="EXPENSE", is_spend=True, needs_review=False, start=START, end=END).groupBy("account_id", "category").agg(F.count("*").alias("n")),
    "net_worth_current": lambda s, d: networth.current(b.snapshots(s, d)),
    "latest_snapshot": lambda s, d: networth.latest(b.snapshots(s, d)).select("account_id", "snapshot_id", "statement_date", F.col("total_value").cast("double").alias("total_value")),
    "net_worth_history": lambda s, d: networth.history(b.snapshots(s, d)),
    "net_worth_by_account": lambda s, d: networth.history_by_account(b.snapshots(s, d)),
    "asset_class_current": lambda s, d: networth.asset_classes(b.snapshots(s, d), b.positions(s, d)),
    "asset_class_history": lambda s, d: networth.asset_class_history(b.snapshots(s, d), b.positions(s, d)),
    "reconciliation": lambda s, d: networth.reconciliation(b.snapshots(s, d), b.positions(s, d)),
    "cash_vs_investment": lambda s, d: networth.cash_and_investments(b.snapshots(s, d)),
    "snapshot_list": lambda s, d: networth.snapshot_list(b.snapshots(s, d), b.positions(s, d), start=START, end=END),
    "relative_window": lambda s, d: networth.recent(networth.history(b.snapshots(s, d)), AS_OF, 6),
    "carry_forward_events": lambda s, d: networth.history(_event_snaps(s, d)),
    "fx_convert": lambda s, d: _tx(s, d).groupBy("currency", "fx_rate_source").agg(F.count("*").alias("n"), F.sum("amount_usd").cast("double").alias("usd"), F.sum("amount").cast("double").alias("amount")),
    "rule_apply": lambda s, d: rules.applied(_tx(s, d).select("account_id", "merchant", "description_raw", "amount", "category", "transaction_type", "is_spend", "is_income", "needs_review"), RULES)
    .groupBy("matched_rule_id", "category", "subcategory", "transaction_type", "is_spend", "is_income", "needs_review").agg(F.count("*").alias("n")),
    "rule_match_counts": lambda s, d: rules.match_counts(_tx(s, d), RULES),
    "rule_join": lambda s, d: rules.matched_by_join(b.snapshots(s, d).select("snapshot_id", "user_id", F.concat(F.lit("Brand#"), (F.col("snapshot_id") % 25).cast("string")).alias("merchant"), F.lit("").alias("description_raw")), "snapshot_id",
        merchants(s, d).select("user_id", F.col("merchant_normalized").alias("rule_id"), F.lower("merchant_normalized").alias("pattern"), F.col("times_applied").alias("priority"))).select("snapshot_id", "rule_id"),
    "learned_merchant": lambda s, d: classify.learned(_tx(s, d), merchants(s, d)).groupBy("user_id", "learned_category").agg(F.count("*").alias("n")),
    "merchant_usage_refresh": lambda s, d: changes.refresh_usage(merchants(s, d), _tx(s, d)),
    "learn_merchants": lambda s, d: changes.learn_merchants(merchants(s, d).withColumn("source", F.lit("LLM")), b.table(s, d, "nation").select(F.col("n_nationkey").alias("user_id"), F.lit("Brand#3").alias("merchant_normalized"), F.lit("Gifts").alias("category"))
        .unionByName(b.table(s, d, "nation").select(F.col("n_nationkey").alias("user_id"), F.lit("Brand#1").alias("merchant_normalized"), F.lit("Taxes").alias("category")))),
    "keyword_category": lambda s, d: _descriptions(s, d).select("id", classify.keyword_category(F.upper("description_raw")).alias("category")),
    "default_classifier": lambda s, d: _descriptions(s, d).select("id", *[c.alias(n) for c, n in zip(classify.default_class(F.col("description_raw"), F.col("amount")), ("transaction_type", "category"))]),
    "fallback_classifier": lambda s, d: _descriptions(s, d).select("id", *[c.alias(n) for c, n in zip(classify.default_class(F.col("description_raw"), F.col("amount"), after_failure=True), ("transaction_type", "category"))]),
    "llm_validator": lambda s, d: b.table(s, d, "events").select("event_id", *[c.alias(n) for c, n in zip(classify.validated(F.when(F.col("event_type") == "click", "PAYMENT").when(F.col("event_type") == "view", "REFUND").when(F.col("event_type") == "error", "income").when(F.col("event_type") == "signup", None).otherwise(F.lit("EXPENSE")), (F.col("value") / 20)), ("transaction_type", "confidence", "needs_review"))]),
    "import_keys": lambda s, d: _keyed(s, d).select("id", "hash_dedup_key"),
    "dedup_in_batch": lambda s, d: dedup.first_in_batch(_keyed(s, d), "hash_dedup_key", ["id"]).select("id"),
    "dedup_new_rows": lambda s, d: dedup.new_rows(_keyed(s, d), _keyed(s, d).where("id % 2 = 0")).select("id"),
    "existing_hashes": lambda s, d: dedup.existing(_keyed(s, d), _keyed(s, d).where("id % 2 = 0")),
    "near_duplicates": _near,
    "account_hash": lambda s, d: b.table(s, d, "customer").select(F.col("c_custkey").alias("id"), dedup.account_hash(F.concat(F.lit(" ab-"), F.col("c_custkey").cast("string"), F.lit(" - x"))).alias("hash")),
    "plain_descriptions": lambda s, d: _descriptions(s, d).select("id", dedup.plain_description(F.col("description_raw")).alias("plain")),
    "keep_last_balance": lambda s, d: changes.keep_last(b.table(s, d, "orders").select(F.col("o_custkey").alias("account_id"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_totalprice"), ["account_id", "day"], "o_orderkey"),
    "event_windows": lambda s, d: _windows(s, d),
    "event_stream": lambda s, d: _streamed(s, d),
    "rule_join_first": lambda s, d: _first_matches(s, d),
    "rule_join_counts": lambda s, d: rules.counted_by_join(_tx(s, d), _patterns(s, d)),
    "keyword_many": lambda s, d: _keyword_many(s, d),
    "import_commit": lambda s, d: _commit(s, d),
}


def _commit(s, d):
    """Descriptions as parsed rows of two currencies, of which the ledger has every odd one already."""
    from .plans import imports

    parsed = _descriptions(s, d).select(
        "id", "description_raw", "amount", (F.col("id") % 25).cast("int").alias("user_id"), (F.col("id") % 50).alias("account_id"), F.lit("f").alias("file_hash"), F.col("id").alias("row_index"),
        F.date_add(F.lit(dt.date(1998, 1, 1)), (F.col("id") % 28).cast("int")).alias("date"), F.concat(F.lit("Brand#"), (F.col("id") % 7).cast("string")).alias("merchant"), F.when(F.col("id") % 3 == 0, "EUR").otherwise("USD").alias("currency"),
    )
    ledger = parsed.where("id % 2 = 1").select(dedup.import_key("account_id", "file_hash", "row_index").alias("hash_dedup_key"))
    out = imports.commit(parsed.union(parsed.where("id % 4 = 0")), ledger, [], merchants(s, d), b.shipped_rates(s, d))
    return out.select("id", "transaction_type", "category", "classification_method", "confidence", "is_spend", "is_income", F.col("amount_usd").cast("double").alias("amount_usd"))


def _windows(s, d):
    from .streaming.inbox import windowed_totals

    e = b.table(s, d, "events").withColumn("value", F.col("value").cast("decimal(15,2)"))
    return windowed_totals(e).select(F.col("start").cast("date").alias("day"), "event_type", F.col("total").cast("double").alias("total"), "events")


def _streamed(s, d):
    """The events as files of an inbox, read by a stream in several batches; the last state of each window."""
    from . import shared
    from .streaming import inbox

    e = b.table(s, d, "events").select(F.to_timestamp(F.col("ts").cast("string")).alias("ts"), "event_type", F.col("value").cast("decimal(15,2)").alias("value"))
    base = shared.folder(s, "events")
    e.repartition(5, "ts").write.parquet(f"{base}/inbox")
    inbox.totals(s, f"{base}/inbox", e.schema, f"{base}/totals", f"{base}/state", late="36500 days", files=2)
    found = inbox.latest_totals(s, f"{base}/totals")
    return found.select(F.col("start").cast("date").alias("day"), "event_type", F.col("total").cast("double").alias("total"), "events")


def _patterns(s, d) -> DataFrame:
    """A rule of each customer for the user of its nation: some part of a part's name or brand, in capitals; every
    hundredth is empty."""
    c, p = b.table(s, d, "customer"), b.table(s, d, "part").select("p_partkey", "p_name", "p_brand")
    joined = c.join(p, F.col("p_partkey") == F.col("c_custkey"))
    name = F.substr("p_name", (F.col("c_custkey") % 4 + 1).cast("int"), (F.col("c_custkey") % 9 + 1).cast("int"))
    pattern = F.when(F.col("c_custkey") % 100 == 0, "").when(F.col("c_custkey") % 3 == 0, F.upper("p_brand")).when(F.col("c_custkey") % 7 == 0, "no such words").otherwise(F.upper(name))
    return joined.select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("rule_id"), pattern.alias("pattern"), (F.col("c_custkey") * 7 % 50).alias("priority"))


def _first_matches(s, d) -> DataFrame:
    rows = _tx(s, d).select("user_id", "account_id", F.when(F.col("account_id") % 2 == 0, F.col("merchant")).alias("merchant"), "description_raw")
    return rules.matched_by_join(rows, "account_id", _patterns(s, d)).groupBy("user_id", "rule_id").agg(F.count("*").alias("matches"))


def _keyword_rows(s, d) -> DataFrame:
    """(position, category, keyword): words, names and brands of parts; many stand in others."""
    p = b.table(s, d, "part")
    words = F.concat(F.split(F.upper("p_name"), " "), F.array(F.upper("p_name"), F.upper("p_brand"), F.substring(F.upper("p_name"), 2, 5)))
    each = p.select("p_partkey", F.explode(words).alias("keyword")).groupBy("keyword").agg(F.min("p_partkey").alias("k"))
    return each.where("k % 4 > 0").select((F.col("k") * 13 % 97).alias("position"), F.concat(F.lit("C"), (F.col("k") * 13 % 97 % 11).cast("string")).alias("category"), "keyword")


def _keyword_many(s, d) -> DataFrame:
    text = F.concat(F.upper("p_name"), F.lit(" "), F.upper("p_brand"), F.lit(" "), F.upper("p_type"))
    return b.table(s, d, "part").select("p_partkey", classify.keyword_category(text, classify.keyword_table(_keyword_rows(s, d))).alias("category"))


_PATTERNS = """patterns AS (SELECT c_nationkey AS user_id, c_custkey AS rule_id, CASE WHEN c_custkey % 100 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN upper(p_brand) WHEN c_custkey % 7 = 0 THEN 'no such words'
  ELSE upper(substr(p_name, CAST(c_custkey % 4 + 1 AS INT), CAST(c_custkey % 9 + 1 AS INT))) END AS pattern, c_custkey * 7 % 50 AS priority FROM customer JOIN part ON p_partkey = c_custkey)"""
_S, _E = f"DATE '{START}'", f"DATE '{END}'"
_FLOW = """COALESCE(CAST(SUM(CASE WHEN is_spend {0} THEN eff END) AS DOUBLE), 0.0) AS total_spend{1},
  abs(COALESCE(CAST(SUM(CASE WHEN is_income {0} THEN eff END) AS DOUBLE), 0.0)) AS total_income{1},
  abs(COALESCE(CAST(SUM(CASE WHEN is_income {0} THEN eff END) AS DOUBLE), 0.0)) - COALESCE(CAST(SUM(CASE WHEN is_spend {0} THEN eff END) AS DOUBLE), 0.0) AS net{1}"""
_FLOWS = _FLOW.format("", "")
_MONTHS = "(SELECT unnest(range(1, 13))::INT AS month)"


def _pct(part, whole):
    return f"CASE WHEN {whole} > 0 THEN {part} / {whole} * 100.0 ELSE 0.0 END"


def _default(after_failure: bool) -> str:
    c = classify
    payment = _any([*c.PAYMENT, "PAYMENT"] if after_failure else c.PAYMENT)
    salary = _any([w for w in c.SALARY if not (after_failure and w == "DEPOSIT")])
    fee = _any([w for w in c.FEE if not (after_failure and w == "MEMBERSHIP FEE")])
    back = "'Refunds & Reimbursements'"
    return f"""SELECT id, CASE WHEN {payment} THEN 'TRANSFER' WHEN {salary} THEN 'INCOME' WHEN {_any(c.TRANSFER)} THEN 'TRANSFER' WHEN amount < 0 OR {_any(c.REFUND)} THEN 'INCOME' ELSE 'EXPENSE' END AS transaction_type,
      CASE WHEN {payment} THEN 'Credit Card Payments' WHEN {salary} THEN 'Paychecks/Salary' WHEN {_any(c.TRANSFER)} THEN 'Transfers'
        WHEN amount < 0 THEN CASE WHEN {_any(c.REFUND + c.CREDIT)} THEN {back} WHEN kw = 'Other Expenses' THEN {back} ELSE kw END
        WHEN {_any(c.REFUND)} THEN {back} WHEN {fee} THEN 'Service Charges/Fees' ELSE kw END AS category
      FROM (SELECT *, {_cascade()} AS kw FROM (SELECT *, upper(description_raw) AS d FROM descr))"""


_CLASSES = ", ".join(f"SUM(CASE WHEN asset_class = '{c}' THEN COALESCE(NULLIF(market_value_usd, 0), market_value) END) AS {c.lower()}" for c in ASSET_CLASSES)
_NAMES = [c.lower() for c in ASSET_CLASSES]
_HELD = " + ".join(_NAMES)
_LATEST = "latest AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY account_id ORDER BY statement_date DESC) AS rk FROM snaps) WHERE rk = 1)"
_DAILY = "daily AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id, statement_date ORDER BY snapshot_id DESC) AS rn FROM {0}) WHERE rn = 1)"
_BYCLASS = f"cls AS (SELECT snapshot_id, {_CLASSES} FROM pos GROUP BY snapshot_id)"
_OUT = ", ".join(f"CAST({n}{' + greatest(total - (' + _HELD + '), 0)' if n == 'cash' else ''} AS DOUBLE) AS {n}" for n in _NAMES)
#: Carried forward by looking each account's latest snapshot up for every date of its user.
_HISTORY = """, days AS (SELECT DISTINCT user_id, statement_date FROM daily), accts AS (SELECT DISTINCT user_id, account_id FROM daily),
  spine AS (SELECT d.user_id, d.statement_date, a.account_id FROM days d JOIN accts a ON d.user_id = a.user_id),
  held AS (SELECT s.user_id, s.statement_date AS day, x.* EXCLUDE (user_id, account_id, statement_date) FROM spine s ASOF JOIN daily x ON s.account_id = x.account_id AND s.statement_date >= x.statement_date)"""

_BODIES = {
    "range_summary": f"SELECT user_id, {_FLOWS}, COUNT(*) AS transaction_count FROM tx WHERE date BETWEEN {_S} AND {_E} GROUP BY user_id",
    "monthly_summary": f"SELECT user_id, {_FLOWS} FROM tx WHERE date >= DATE '1998-12-01' AND date < DATE '1999-01-01' GROUP BY user_id",
    "monthly_category_breakdown": f"""SELECT user_id, category, CAST(s AS DOUBLE) AS amount, n AS count, {_pct('CAST(s AS DOUBLE)', 'CAST(w AS DOUBLE)')} AS percentage FROM (
      SELECT *, SUM(s) OVER (PARTITION BY user_id) AS w FROM (SELECT user_id, category, SUM(eff) AS s, COUNT(*) AS n FROM tx WHERE is_spend AND date >= DATE '1998-12-01' AND date < DATE '1999-01-01' GROUP BY ALL)) WHERE category IS NOT NULL""",
    "yearly_summary": f"""SELECT y.user_id, m.month, COALESCE(x.total_spend, 0.0) AS total_spend, COALESCE(x.total_income, 0.0) AS total_income, COALESCE(x.net, 0.0) AS net, total_spend_year, total_income_year, net_year, total_spend_year / 12 AS avg_monthly_spend
      FROM (SELECT user_id, {_FLOW.format('', '_year')} FROM tx WHERE year(date) = 1998 GROUP BY user_id) y CROSS JOIN {_MONTHS} m
      LEFT JOIN (SELECT user_id, CAST(month(date) AS INT) AS month, {_FLOWS} FROM tx WHERE year(date) = 1998 GROUP BY ALL) x ON y.user_id = x.user_id AND m.month = x.month""",
    "category_breakdown": f"""SELECT user_id, category, CAST(s AS DOUBLE) AS total, n AS count, CAST(s AS DOUBLE) / n AS average, {_pct('CAST(s AS DOUBLE)', 'CAST(w AS DOUBLE)')} AS percentage FROM (
      SELECT *, SUM(s) OVER (PARTITION BY user_id) AS w FROM (SELECT user_id, category, SUM(eff) AS s, COUNT(*) AS n FROM tx WHERE is_spend AND category IS NOT NULL AND date BETWEEN {_S} AND {_E} GROUP BY ALL))""",
    "top_merchants": f"""SELECT user_id, merchant, CAST(s AS DOUBLE) AS total, n AS count, CAST(s AS DOUBLE) / n AS average, CAST(rk AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, merchant) AS rk FROM (SELECT user_id, merchant, SUM(eff) AS s, COUNT(*) AS n FROM tx WHERE is_spend AND date BETWEEN {_S} AND {_E} GROUP BY ALL)) WHERE rk <= 5""",
    "overview": f"SELECT user_id, {_FLOW.format(' AND date >= DATE {0}2001-06-01{0} AND date < DATE {0}2001-07-01{0}'.format(chr(39)), '')}, COUNT(*) FILTER (needs_review) AS needs_review_count FROM tx GROUP BY user_id",
    "yoy_year": f"""SELECT *, total_spend_1 - total_spend_2 AS spend_change, {_pct('(total_spend_1 - total_spend_2)', 'total_spend_2')} AS spend_change_pct FROM (
      SELECT user_id, {_FLOW.format('AND year(date) = 1998', '_1')}, {_FLOW.format('AND year(date) = 1997', '_2')} FROM tx WHERE year(date) IN (1997, 1998) GROUP BY user_id)""",
    "yoy_year_months": f"""SELECT user_id, month, spend_1, spend_2, spend_1 - spend_2 AS change, {_pct('(spend_1 - spend_2)', 'spend_2')} AS change_pct, monthname(make_date(1998, month, 1)) AS month_name FROM (
      SELECT u.user_id, m.month, COALESCE(s1, 0.0) AS spend_1, COALESCE(s2, 0.0) AS spend_2 FROM (SELECT DISTINCT user_id FROM tx WHERE year(date) IN (1997, 1998)) u CROSS JOIN {_MONTHS} m LEFT JOIN (
        SELECT user_id, CAST(month(date) AS INT) AS month, CAST(SUM(CASE WHEN is_spend AND year(date) = 1998 THEN eff END) AS DOUBLE) AS s1, CAST(SUM(CASE WHEN is_spend AND year(date) = 1997 THEN eff END) AS DOUBLE) AS s2 FROM tx GROUP BY ALL) x ON u.user_id = x.user_id AND m.month = x.month)""",
    "yoy_month_categories": f"""SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY abs(change) DESC, category) AS INT) AS rank FROM (SELECT *, amount_1 - amount_2 AS change, {_pct('(amount_1 - amount_2)', 'amount_2')} AS change_pct FROM (
      SELECT user_id, category, COALESCE(CAST(SUM(CASE WHEN year(date) = 1998 THEN eff END) AS DOUBLE), 0.0) AS amount_1, COALESCE(CAST(SUM(CASE WHEN year(date) = 1997 THEN eff END) AS DOUBLE), 0.0) AS amount_2
      FROM tx WHERE is_spend AND category IS NOT NULL AND month(date) = 6 AND year(date) IN (1997, 1998) GROUP BY ALL))""",
    "spending_velocity": """SELECT user_id, avg_spend, avg_income, slope, CASE WHEN slope > 10 THEN 'increasing' WHEN slope < -10 THEN 'decreasing' ELSE 'stable' END AS trend FROM (
      SELECT user_id, CAST(SUM(y) AS DOUBLE) / 12 AS avg_spend, CAST(SUM(i) AS DOUBLE) / 12 AS avg_income, CAST(12 * SUM(x * y) - 66 * SUM(y) AS DOUBLE) / CAST(12 * 506 - 66 * 66 AS DOUBLE) AS slope FROM (
        SELECT user_id, (year(date) - 2000) * 12 + month(date) - 7 AS x, COALESCE(SUM(CASE WHEN is_spend THEN eff END), 0) AS y, abs(COALESCE(SUM(CASE WHEN is_income THEN eff END), 0)) AS i
        FROM tx WHERE date >= DATE '2000-07-01' AND date < DATE '2001-07-01' GROUP BY ALL) GROUP BY user_id)""",
    **{f"group_by_{k}": f"SELECT user_id, {e} AS key, CAST(SUM(abs(amount)) AS DOUBLE) AS total, COUNT(*) AS count FROM tx GROUP BY ALL" for k, e in {"merchant": "merchant", "category": "COALESCE(category, 'Uncategorized')", "type": "transaction_type", "account": "CAST(account_id AS VARCHAR)", "month": "strftime(date, '%Y-%m')"}.items()},
    "displayed_net": "SELECT user_id, -CAST(SUM(amount) AS DOUBLE) AS net FROM tx WHERE is_spend OR is_income GROUP BY user_id",
    "insights": f"SELECT user_id, {(END - START).days + 1} AS days, total_spend / {(END - START).days + 1} AS daily_average, {_pct('net', 'total_income')} AS savings_rate FROM (SELECT user_id, {_FLOWS} FROM tx WHERE date BETWEEN {_S} AND {_E} GROUP BY user_id)",
    "distinct_categories": "SELECT DISTINCT user_id, category FROM tx WHERE category IS NOT NULL",
    "merchant_count": "SELECT user_id, COUNT(*) AS count FROM tx WHERE merchant = 'Brand#7' GROUP BY user_id",
    "account_counts": f"""SELECT a.account_id, a.user_id, COALESCE(t.n, 0) AS transactions, COALESCE(i.n, 0) AS imports, COALESCE(s.n, 0) AS snapshots, COALESCE(p.n, 0) AS positions FROM accounts a
      LEFT JOIN (SELECT account_id, COUNT(*) AS n FROM tx GROUP BY 1) t ON a.account_id = t.account_id
      LEFT JOIN (SELECT o_custkey % 50 AS account_id, COUNT(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1) i ON a.account_id = i.account_id LEFT JOIN (SELECT account_id, COUNT(*) AS n FROM snaps GROUP BY 1) s ON a.account_id = s.account_id
      LEFT JOIN (SELECT account_id, COUNT(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY account_id ORDER BY statement_date DESC) AS rk FROM snaps) l JOIN pos ON l.snapshot_id = pos.snapshot_id WHERE rk = 1 GROUP BY 1) p ON a.account_id = p.account_id""",
    "account_families": "SELECT user_id, CASE WHEN account_type IN ('CHECKING', 'SAVINGS', 'CREDIT_CARD') THEN 'bank' WHEN account_type IN ('BROKERAGE', 'RETIREMENT_401K') THEN 'brokerage' ELSE 'other' END AS family, account_type, COUNT(*) AS accounts, COUNT(*) FILTER (is_active) AS active FROM accounts GROUP BY ALL",
    "account_search_words": "SELECT account_id, name FROM accounts WHERE contains(lower(name || ' ' || institution), 'bank') AND contains(lower(name || ' ' || institution), '3') AND contains(lower(name || ' ' || institution), '0012')",
    "import_visibility": "SELECT i.id FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS account_id, o_orderkey % 25 AS user_id FROM orders) i LEFT JOIN accounts a ON i.account_id = a.account_id WHERE a.user_id = 4 OR i.user_id = 4",
    "list_transactions_page": "SELECT date, account_id, description_raw, CAST(amount AS DOUBLE) AS amount, (SELECT COUNT(*) FROM tx) AS total, (SELECT COUNT(*) FROM tx) > 150 AS has_more FROM tx ORDER BY date DESC, account_id, description_raw, amount LIMIT 50 OFFSET 100",
    "list_snapshots_page": "SELECT snapshot_id, statement_date, CAST(total_value AS DOUBLE) AS total_value, (SELECT COUNT(*) FROM snaps) AS total, (SELECT COUNT(*) FROM snaps) > 150 AS has_more FROM snaps ORDER BY statement_date DESC, snapshot_id LIMIT 50 OFFSET 100",
    "search_description": "SELECT user_id, description_raw, COUNT(*) AS n FROM tx WHERE description_raw ILIKE '%r_ng%brand#1%' OR merchant ILIKE '%r_ng%brand#1%' GROUP BY ALL",
    "list_filtered": f"SELECT account_id, category, COUNT(*) AS n FROM tx WHERE user_id = 3 AND transaction_type = 'EXPENSE' AND is_spend AND NOT needs_review AND date BETWEEN {_S} AND {_E} GROUP BY ALL",
    "net_worth_current": f", {_LATEST} SELECT user_id, CAST(SUM(total_value) AS DOUBLE) AS net_worth, COUNT(DISTINCT account_id) AS accounts FROM latest GROUP BY user_id",
    "latest_snapshot": f", {_LATEST} SELECT account_id, snapshot_id, statement_date, CAST(total_value AS DOUBLE) AS total_value FROM latest",
    "net_worth_history": f", {_DAILY.format('snaps')}{_HISTORY} SELECT user_id, day AS statement_date, CAST(SUM(total_value) AS DOUBLE) AS net_worth FROM held GROUP BY ALL",
    "net_worth_by_account": f", {_DAILY.format('snaps')} SELECT user_id, account_id, statement_date AS valid_from, lead(statement_date) OVER (PARTITION BY account_id ORDER BY statement_date) AS valid_until, CAST(total_value AS DOUBLE) AS value FROM daily",
    "asset_class_current": f", {_LATEST}, {_BYCLASS} SELECT user_id, CAST(total AS DOUBLE) AS total, {_OUT} FROM (SELECT user_id, SUM(total_value) AS total, {', '.join(f'SUM(COALESCE({n}, 0)) AS {n}' for n in _NAMES)} FROM latest l LEFT JOIN cls ON l.snapshot_id = cls.snapshot_id GROUP BY user_id)",
    "asset_class_history": f", {_DAILY.format('snaps')}, {_BYCLASS}{_HISTORY} SELECT user_id, day AS statement_date, CAST(total AS DOUBLE) AS total, {_OUT} FROM (SELECT user_id, day, SUM(total_value) AS total, {', '.join(f'SUM(COALESCE({n}, 0)) AS {n}' for n in _NAMES)} FROM held l LEFT JOIN cls ON l.snapshot_id = cls.snapshot_id GROUP BY ALL)",
    "reconciliation": """SELECT snapshot_id, COALESCE(n, 0) AS position_count, CAST(total_value - COALESCE(c, 0) AS DOUBLE) AS difference, CASE WHEN total_value = 0 THEN COALESCE(c, 0) = 0 ELSE abs(total_value - COALESCE(c, 0)) <= abs(total_value) * CAST(0.01 AS DECIMAL(4,2)) END AS is_reconciled
      FROM snaps LEFT JOIN (SELECT snapshot_id AS sid, SUM(COALESCE(NULLIF(market_value_usd, 0), market_value)) AS c, COUNT(*) AS n FROM pos GROUP BY 1) ON snapshot_id = sid""",
    "cash_vs_investment": f", {_LATEST} SELECT user_id, cash, total - cash AS investments, {_pct('cash', 'total')} AS cash_share FROM (SELECT user_id, COALESCE(CAST(SUM(CASE WHEN account_type IN ('CHECKING', 'SAVINGS', 'CASH', 'DIGITAL_WALLET') THEN total_value END) AS DOUBLE), 0.0) AS cash, CAST(SUM(total_value) AS DOUBLE) AS total FROM latest GROUP BY user_id)",
    "snapshot_list": f"SELECT snapshot_id, account_id, statement_date, CAST(total_value AS DOUBLE) AS total_value, COALESCE(n, 0) AS position_count FROM snaps LEFT JOIN (SELECT snapshot_id AS sid, COUNT(*) AS n FROM pos GROUP BY 1) ON snapshot_id = sid WHERE statement_date BETWEEN {_S} AND {_E}",
    "relative_window": f", {_DAILY.format('snaps')}{_HISTORY} SELECT user_id, day AS statement_date, CAST(SUM(total_value) AS DOUBLE) AS net_worth FROM held GROUP BY ALL HAVING day >= DATE '2000-12-30'",
    "carry_forward_events": f", es AS (SELECT event_id AS snapshot_id, user_id AS account_id, user_id % 7 AS user_id, CAST(ts AS DATE) AS statement_date, CAST(value AS DECIMAL(18,2)) AS total_value FROM events), {_DAILY.format('es')}{_HISTORY} SELECT user_id, day AS statement_date, CAST(SUM(total_value) AS DOUBLE) AS net_worth FROM held GROUP BY ALL",
    "fx_convert": "SELECT currency, fx_rate_source, COUNT(*) AS n, CAST(SUM(amount_usd) AS DOUBLE) AS usd, CAST(SUM(amount) AS DOUBLE) AS amount FROM tx GROUP BY ALL",
    "rule_apply": f"""SELECT m AS matched_rule_id, CASE m WHEN 'r1' THEN 'First' WHEN 'r2' THEN 'Colour' WHEN 'r4' THEN 'Both' ELSE category END AS category, CASE m WHEN 'r2' THEN 'Hue' END AS subcategory, k AS transaction_type,
      CASE WHEN m IS NULL THEN is_spend ELSE k = 'EXPENSE' END AS is_spend, CASE WHEN m IS NULL THEN is_income ELSE k = 'INCOME' END AS is_income, CASE WHEN m IS NULL THEN needs_review ELSE false END AS needs_review, COUNT(*) AS n
      FROM (SELECT *, CASE m WHEN 'r2' THEN 'TRANSFER' WHEN 'r3' THEN 'EXPENSE' WHEN 'r4' THEN 'INCOME' ELSE transaction_type END AS k FROM (SELECT *, {_MATCHED} AS m FROM tx)) GROUP BY ALL""",
    "rule_match_counts": "SELECT 'r6' AS rule_id, 0 AS match_count UNION ALL " + " UNION ALL ".join(f"SELECT '{r}', COUNT(*) FILTER ({p}) FROM tx" for r, p in _RULE_SQL.items()),
    "rule_join": f", {_MERCHANTS} SELECT snapshot_id, rule_id FROM (SELECT s.snapshot_id, merchant_normalized AS rule_id, row_number() OVER (PARTITION BY s.snapshot_id ORDER BY times_applied, merchant_normalized) AS rn FROM snaps s JOIN mc ON s.user_id = mc.user_id AND contains('brand#' || CAST(s.snapshot_id % 25 AS VARCHAR), lower(merchant_normalized))) WHERE rn = 1",
    "learned_merchant": f", {_MERCHANTS} SELECT tx.user_id, mc.category AS learned_category, COUNT(*) AS n FROM tx LEFT JOIN mc ON tx.user_id = mc.user_id AND tx.merchant = mc.merchant_normalized GROUP BY ALL",
    "merchant_usage_refresh": f", {_MERCHANTS} SELECT * FROM (SELECT mc.user_id, merchant_normalized, times_applied, COALESCE(n, 0) AS actual FROM mc LEFT JOIN (SELECT user_id, merchant, COUNT(*) AS n FROM tx GROUP BY ALL) t ON mc.user_id = t.user_id AND mc.merchant_normalized = t.merchant) WHERE times_applied <> actual",
    "learn_merchants": f""", {_MERCHANTS} SELECT user_id, merchant_normalized, CASE merchant_normalized WHEN 'Brand#3' THEN 'Gifts' ELSE category END AS category, CASE merchant_normalized WHEN 'Brand#3' THEN 1.0 ELSE confidence END AS confidence, times_applied, CASE merchant_normalized WHEN 'Brand#3' THEN 'USER' ELSE 'LLM' END AS source FROM mc
      UNION ALL SELECT n_nationkey, 'Brand#1', 'Taxes', 1.0, 0, 'USER' FROM nation UNION ALL SELECT n_nationkey, 'Brand#3', 'Gifts', 1.0, 0, 'USER' FROM nation WHERE NOT EXISTS (SELECT 1 FROM mc WHERE merchant_normalized = 'Brand#3')""",
    "keyword_category": f", {_DESCRIPTIONS} SELECT id, {_cascade()} AS category FROM (SELECT *, upper(description_raw) AS d FROM descr)",
    "default_classifier": f", {_DESCRIPTIONS} {_default(False)}",
    "fallback_classifier": f", {_DESCRIPTIONS} {_default(True)}",
    "llm_validator": """SELECT event_id, k AS transaction_type, c AS confidence, c < 0.6 OR k = 'UNCATEGORIZED' AS needs_review FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'TRANSFER' WHEN 'view' THEN 'INCOME' WHEN 'error' THEN 'UNCATEGORIZED' ELSE 'EXPENSE' END AS k, greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), COALESCE(value / 20, 0.8))) AS c FROM events)""",
    "import_commit": f""", {_DESCRIPTIONS}, {_MERCHANTS}, base AS ({_default(False)}),
      fresh AS (SELECT d.*, base.transaction_type AS k0, base.category AS c0, mc.category AS mcat, DATE '1998-01-01' + CAST(d.id % 28 AS INT) AS day FROM descr d JOIN base USING (id) LEFT JOIN mc ON mc.user_id = d.id % 25 AND mc.merchant_normalized = 'Brand#' || CAST(d.id % 7 AS VARCHAR) WHERE d.id % 2 = 0),
      typed AS (SELECT *, CASE WHEN mcat = 'Transfers' THEN 'TRANSFER' WHEN mcat IS NULL THEN k0 WHEN amount < 0 THEN 'INCOME' ELSE 'EXPENSE' END AS k FROM fresh)
      SELECT id, k AS transaction_type, COALESCE(mcat, c0) AS category, CASE WHEN mcat IS NULL THEN 'DEFAULT' ELSE 'LEARNED' END AS classification_method, CASE WHEN mcat IS NULL THEN 0.7 ELSE 0.8 END AS confidence, k = 'EXPENSE' AS is_spend, k = 'INCOME' AS is_income,
        CAST(CASE WHEN id % 3 > 0 THEN amount ELSE round(amount * rate, 2) END AS DOUBLE) AS amount_usd FROM typed LEFT JOIN fx ON from_currency = 'EUR' AND rate_date = day""",
    "import_keys": f", {_IMPORTS} SELECT id, hash_dedup_key FROM keyed",
    "dedup_in_batch": f", {_IMPORTS} SELECT MIN(id) AS id FROM keyed GROUP BY hash_dedup_key",
    "dedup_new_rows": f", {_IMPORTS} SELECT id FROM keyed WHERE hash_dedup_key NOT IN (SELECT hash_dedup_key FROM keyed WHERE id % 2 = 0)",
    "existing_hashes": f", {_IMPORTS} SELECT DISTINCT hash_dedup_key FROM keyed WHERE hash_dedup_key IN (SELECT hash_dedup_key FROM keyed WHERE id % 2 = 0)",
    "near_duplicates": """, ev AS (SELECT event_id AS id, CAST(ts AS DATE) AS date, CAST(value AS DECIMAL(15,2)) AS amount, lower(event_type) || ' ' || CAST(user_id % 20 AS VARCHAR) AS description FROM events)
      SELECT x.id, x.class_id, COUNT(*) AS links, x.description FROM (SELECT *, min(id) OVER (PARTITION BY description, date, amount) AS class_id FROM ev) x
      JOIN ev y ON x.description = y.description AND x.id <> y.id AND abs(x.amount - y.amount) <= 0.01 AND abs(date_diff('day', x.date, y.date)) <= 3 GROUP BY ALL""",
    "account_hash": "SELECT c_custkey AS id, sha256('AB' || CAST(c_custkey AS VARCHAR) || 'X') AS hash FROM customer",
    "plain_descriptions": f", {_DESCRIPTIONS} SELECT id, trim(regexp_replace(lower(description_raw), '[*#\\s]+', ' ', 'g')) AS plain FROM descr",
    "keep_last_balance": "SELECT o_custkey AS account_id, CAST(o_orderdate AS DATE) AS day, MAX(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL",
    "event_stream": "SELECT CAST(ts AS DATE) AS day, event_type, CAST(SUM(CAST(value AS DECIMAL(15,2))) AS DOUBLE) AS total, COUNT(*) AS events FROM events GROUP BY ALL",
    "rule_join_first": f""", {_PATTERNS}, texts AS (SELECT DISTINCT user_id, CASE WHEN account_id % 2 = 0 THEN lower(merchant) ELSE '' END AS m, lower(description_raw) AS t FROM tx),
      first AS (SELECT user_id, m, t, min((priority, rule_id))[2] AS rule_id FROM texts JOIN patterns USING (user_id) WHERE contains(m, lower(pattern)) OR contains(t, lower(pattern)) GROUP BY ALL)
      SELECT tx.user_id, rule_id, COUNT(*) AS matches FROM tx JOIN first ON tx.user_id = first.user_id AND lower(description_raw) = t AND CASE WHEN account_id % 2 = 0 THEN lower(merchant) ELSE '' END = m GROUP BY ALL""",
    "rule_join_counts": f""", {_PATTERNS}, texts AS (SELECT user_id, lower(merchant) AS m, lower(description_raw) AS t, COUNT(*) AS n FROM tx GROUP BY ALL),
      found AS (SELECT user_id, rule_id, SUM(n) AS n FROM patterns JOIN texts USING (user_id) WHERE contains(m, lower(pattern)) OR contains(t, lower(pattern)) GROUP BY ALL)
      SELECT user_id, rule_id, CAST(COALESCE(n, 0) AS BIGINT) AS match_count FROM patterns LEFT JOIN found USING (user_id, rule_id)""",
    "keyword_many": """, words AS (SELECT p_partkey, unnest(list_concat(string_split(upper(p_name), ' '), [upper(p_name), upper(p_brand), substr(upper(p_name), 2, 5)])) AS keyword FROM part),
      kw AS (SELECT keyword, min(p_partkey) AS k FROM words GROUP BY keyword HAVING min(p_partkey) % 4 > 0), p AS (SELECT p_partkey, upper(p_name) || ' ' || upper(p_brand) || ' ' || upper(p_type) AS text FROM part)
      SELECT p_partkey, COALESCE('C' || min(k * 13 % 97) % 11, 'Other Expenses') AS category FROM p LEFT JOIN kw ON contains(text, keyword) GROUP BY p_partkey""",
    "event_windows": "SELECT CAST(ts AS DATE) AS day, event_type, CAST(SUM(CAST(value AS DECIMAL(15,2))) AS DOUBLE) AS total, COUNT(*) AS events FROM events GROUP BY ALL",
}

SQL = {name: f"WITH {b.SQL.strip()}{body if body.startswith(',') else ' ' + body}" for name, body in _BODIES.items()}

QUERIES |= text_queries.QUERIES | statement_queries.QUERIES | upkeep_queries.QUERIES | brokerage_queries.QUERIES
SQL |= text_queries.SQL | statement_queries.SQL | upkeep_queries.SQL | brokerage_queries.SQL
