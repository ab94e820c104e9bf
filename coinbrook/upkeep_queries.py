"""Queries over rules and learned merchants as tables, imports, balances, reports and backups, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import binding as b
from .functions import categories, classify
from .operators import lists, networth, upkeep
from .plans import reports
from .schemas import RULE_TYPES
from .sources import backup

START, END, AT = dt.date(1997, 3, 15), dt.date(1998, 9, 10), dt.date(2024, 5, 6)


def _rules(s, d) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in RULE_TYPES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    day = F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("p_partkey") % 1000).cast("int"))
    return b.table(s, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 25).alias("user_id"), kind.alias("rule_type"), F.col("p_name").alias("name"), (F.col("p_partkey") % 4 > 0).alias("is_active"),
        F.col("p_size").alias("priority"), day.alias("created_at"), F.lit(1).alias("match_count"), F.lit(None).cast("date").alias("last_matched_at"),
    )


_RULES = f"""rules AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey % 25 AS user_id, list_extract({RULE_TYPES}, CAST(p_partkey % 5 + 1 AS INT)) AS rule_type, p_name AS name, p_partkey % 4 > 0 AS is_active,
  p_size AS priority, DATE '2020-01-01' + CAST(p_partkey % 1000 AS INT) AS created_at, 1 AS match_count, CAST(NULL AS DATE) AS last_matched_at FROM part)"""


def _merchants(s, d) -> DataFrame:
    source = F.when(F.col("p_partkey") % 3 == 0, "USER").otherwise("LLM")
    return b.table(s, d, "part").select((F.col("p_partkey") % 25).alias("user_id"), F.concat("p_brand", F.lit(" "), F.col("p_partkey").cast("string")).alias("merchant_normalized"), F.col("p_type").alias("category"), source.alias("source"), F.col("p_size").alias("times_applied"))


_MC = "mcs AS (SELECT p_partkey % 25 AS user_id, p_brand || ' ' || p_partkey AS merchant_normalized, p_type AS category, CASE WHEN p_partkey % 3 = 0 THEN 'USER' ELSE 'LLM' END AS source, p_size AS times_applied FROM part)"

_RULE = {"id": "r9", "rule_type": "COMPOSITE", "pattern": '{"merchant": "brand#1", "amount_min": 1000}', "is_active": False, "action": '{"category": "Rent", "transaction_type": "INCOME"}'}
_HIT = "(contains(lower(merchant), 'brand#1') OR contains(lower(description_raw), 'brand#1')) AND amount >= 1000"


def _tx(s, d) -> DataFrame:
    return b.transactions(s, d)


def apply_one_rule(s, d) -> DataFrame:
    table = s.createDataFrame([("r9", 5), ("r8", 1)], "id string, match_count long").withColumn("last_matched_at", F.lit(None).cast("date"))
    rows = _tx(s, d).select("merchant", "description_raw", "amount", "category", "transaction_type", "is_spend", "is_income", "needs_review")
    return upkeep.apply_one(rows, [_RULE], "r9", table, AT)[1]


def rule_counters(s, d) -> DataFrame:
    """Orders as classified rows, of which two thirds were matched by a rule."""
    hit = b.table(s, d, "orders").select(F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_custkey") % 40).cast("string")).alias("matched_rule_id"))
    return upkeep.counted(_rules(s, d), hit, AT).select("id", "match_count", "last_matched_at")


def merchant_counters(s, d) -> DataFrame:
    learned = b.table(s, d, "lineitem").join(b.table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select((F.col("p_partkey") % 25).alias("user_id"), F.concat("p_brand", F.lit(" "), F.col("p_partkey").cast("string")).alias("merchant"))
    return upkeep.used(_merchants(s, d), learned).select("merchant_normalized", "times_applied")


def _owned(s, d) -> DataFrame:
    return b.table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("user_id"), F.concat(F.lit("Clerk "), (F.col("o_orderkey") % 50).cast("string")).alias("merchant"), F.col("o_orderpriority").alias("category"),
        F.lit("EXPENSE").alias("transaction_type"), F.lit(True).alias("is_spend"), F.lit(False).alias("is_income"), F.lit("DEFAULT").alias("classification_method"),
    )


def _asked(s, d) -> DataFrame:
    return _owned(s, d).where("user_id = 2 AND id % 3 = 0").select("id", F.lit("1-URGENT").alias("category"), F.when(F.col("id") % 2 == 0, "INCOME").alias("transaction_type"))


def bulk_update(s, d) -> DataFrame:
    return upkeep.bulk_update(_owned(s, d), _asked(s, d), 2).select("id", "category", "transaction_type", "is_spend", "is_income", "classification_method")


def learned_corrections(s, d) -> DataFrame:
    return upkeep.corrections(_owned(s, d), _asked(s, d))


def currency_backfill(s, d) -> DataFrame:
    rows = b.raw_transactions(s, d).select(F.when(F.col("user_id") % 4 > 0, F.col("currency")).alias("currency"), "amount", F.lit(None).cast("decimal(15,2)").alias("amount_usd"))
    return upkeep.with_dollars(rows).groupBy("currency").agg(F.sum("amount_usd").cast("double").alias("usd"), F.count_if(F.col("amount_usd").isNull()).alias("missing"))


def _files(s, d) -> DataFrame:
    return b.table(s, d, "orders").select((F.col("o_custkey") % 50).alias("account_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("file_hash"), "o_orderkey")


def reimported_files(s, d) -> DataFrame:
    records = _files(s, d).where("o_orderkey % 4 = 0").select("account_id", "file_hash", F.col("o_orderkey").alias("id"), F.date_add(F.lit(AT), (F.col("o_orderkey") % 9).cast("int")).alias("created_at"))
    again = records.withColumns({"id": F.col("id") + 1, "created_at": F.date_add("created_at", 1)})
    return upkeep.imported_before(_files(s, d), records.union(again)).select("o_orderkey", "import_id", "imported_at")


def unseen_files(s, d) -> DataFrame:
    files = _files(s, d)
    return upkeep.unseen(files.union(files.where("o_orderkey % 5 = 0")), files.where("o_orderkey % 2 = 0").select(F.col("file_hash").alias("source_file_hash"))).select("o_orderkey")


def _parsed(s, d) -> DataFrame:
    return b.table(s, d, "orders").select((F.col("o_custkey") % 10).alias("import_id"), F.col("o_orderkey").alias("row_index"), F.sha2((F.col("o_orderkey") % 300).cast("string"), 256).alias("hash_dedup_key"))


def import_preview_rows(s, d) -> DataFrame:
    return upkeep.preview(_parsed(s, d), _parsed(s, d))[0].select("import_id", "row_index")


def import_preview_totals(s, d) -> DataFrame:
    return upkeep.preview(_parsed(s, d), _parsed(s, d).where("row_index % 300 < 40"))[1]


def import_life_cycle(s, d) -> DataFrame:
    """A third of the runs fails, a third succeeds, a third is not done."""
    o = b.table(s, d, "orders")
    records = o.select(F.col("o_orderkey").alias("id"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("transactions_imported"), F.lit(0).alias("transactions_duplicate"), F.lit(None).cast("date").alias("completed_at"))
    errors = F.when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("no date"), F.concat(F.lit("row "), F.col("o_orderkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    outcomes = o.where("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).cast("int").alias("imported"), (F.col("o_orderkey") % 5).cast("int").alias("duplicate"), errors.alias("errors"))
    return upkeep.finished(records, outcomes, AT)


def _balances(s, d) -> DataFrame:
    name = F.element_at(F.array(F.lit("Spending"), F.lit("savings"), F.lit("Vault")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    owned = b.table(s, d, "orders").join(b.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    user = F.when(F.col("o_orderkey") % 4 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))  # some of another user
    return owned.select(F.col("o_orderkey").alias("balance_id"), user.alias("user_id"), F.concat(F.lit("Bank "), (F.col("o_custkey") % 7).cast("string")).alias("institution"), name.alias("account"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0").alias("last4"))


def balance_accounts(s, d) -> DataFrame:
    return upkeep.balance_accounts(_balances(s, d), b.accounts(s, d)).select("balance_id", "account_type", "account_id")


def balance_snapshots(s, d) -> DataFrame:
    o = b.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("account_id"), F.trunc("o_orderdate", "month").alias("statement_date"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("source_file_hash"))
    old = o.where("o_orderkey % 2 = 0").select("account_id", "statement_date", F.col("v").alias("total_value"), "source_file_hash")
    new = o.where("o_orderkey % 5 = 0").select("account_id", "statement_date", F.when(F.col("o_orderkey") % 10 == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("v")).alias("ending"), "source_file_hash")
    return upkeep.balance_snapshots(old, new).select("account_id", "statement_date", F.col("total_value").cast("double").alias("total_value"), "source_file_hash")


def statements_preview(s, d) -> DataFrame:
    """Orders as statements of a customer's account; every tenth names no account, every seventh has no positions."""
    o = b.table(s, d, "orders").select(
        F.concat(F.lit("file "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("filename"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_custkey").cast("string")).alias("account_identifier"), F.col("o_orderdate").cast("date").alias("statement_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total_value"), (F.col("o_orderkey") % 7).alias("positions"),
    )
    return upkeep.statements_preview(o).withColumn("latest_value", F.col("latest_value").cast("double"))


def snapshots_by_account(s, d) -> DataFrame:
    return upkeep.snapshots_by_account(b.snapshots(s, d)).select("snapshot_id", "place", "statements", "is_cash")


def match_statements(s, d) -> DataFrame:
    """Statements of half of the accounts by hash, the others by institution, type and last digits; some hashes are not known."""
    accounts = b.accounts(s, d).withColumn("account_hash", F.when(F.col("account_id") % 2 == 0, F.concat(F.lit("h"), F.col("account_id").cast("string"))))
    statements = accounts.select(F.col("account_id").alias("statement_id"), "user_id", "institution", "account_type", "last4", F.when(F.col("account_id") % 3 == 0, F.coalesce("account_hash", F.lit("new"))).when(F.col("account_id") % 3 == 1, F.lit("other")).alias("account_hash"))
    return lists.match_accounts(statements, accounts)


def account_names(s, d) -> DataFrame:
    holder = F.when(F.col("c_custkey") % 4 > 0, F.concat(F.upper(F.concat(F.lit("anna"), F.col("c_custkey").cast("string"))), F.lit(" Q Public"))).when(F.col("c_custkey") % 8 == 0, "  ")
    product = F.when(F.col("c_custkey") % 3 == 0, "Savings").when(F.col("c_custkey") % 3 == 1, "Gold Card")
    return b.table(s, d, "customer").select("c_custkey", upkeep.display_name(holder, product, F.lit("Ally Bank"), F.lit("Credit Card")).alias("name"))


def llm_answers(s, d) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("EXPENSE", "INCOME", "PAYMENT", "REFUND", "FEE_INTEREST", "nonsense", "UNCATEGORIZED", None)])
    answers = b.table(s, d, "orders").select("o_orderkey", F.element_at(kinds, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("transaction_type"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 13).cast("double") / 10).alias("confidence"), F.lit("Gifts").alias("category"), F.lit("because").alias("reasoning"))
    return classify.validated_answers(answers, ["o_orderkey"])


def list_sorted_page(s, d) -> DataFrame:
    """The second page of transactions sorted by merchant, descriptions where there is none."""
    rows = _tx(s, d).select(F.when(F.col("user_id") % 3 > 0, F.col("merchant")).alias("merchant"), "description_raw", "category", "transaction_type", F.col("amount").cast("double").alias("amount"), "date", "account_id")
    return lists.page(rows, [*lists.sort_key("description"), "description_raw", "account_id", "date", "amount"], 2, 40).select("merchant", "description_raw", "account_id", "date", "amount", "total")


def _backup(s, d) -> tuple[dict, dict]:
    """(tables, backup): every second account is there already, every fourth order's account is in neither."""
    accounts = b.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    account = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("gone "), F.col("o_custkey").cast("string"))).otherwise(F.col("o_custkey").cast("string"))
    tx = b.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), account.alias("account_id"), (F.col("o_orderkey") % 3).cast("string").alias("matched_rule_id"))
    rules = s.createDataFrame([("0",), ("1",)], "id string")
    current = {"accounts": accounts.where("CAST(id AS LONG) % 2 = 0"), "rules": rules.limit(0), "transactions": tx.where("CAST(id AS LONG) % 10 = 1")}
    return current, {"accounts": accounts, "rules": rules, "transactions": tx}


def restore_report(s, d) -> DataFrame:
    return backup.restore(*_backup(s, d))[1]


def restored_transactions(s, d) -> DataFrame:
    return backup.restore(*_backup(s, d))[0]["transactions"]


def backup_export(s, d) -> DataFrame:
    o = b.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(15,2)").alias("amount"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    return backup.exported(o)


def csv_export(s, d) -> DataFrame:
    rows = _tx(s, d).withColumns({"tags": F.when(F.col("needs_review"), F.array(F.lit("a"), F.lit("b"))), "classification_method": F.lit("RULE"), "user_note": F.lit(None).cast("string")})
    return reports.export_rows(rows)


def rule_matching_none(s, d) -> DataFrame:
    """For each account how many rows it has and how many a rule matches that there is not."""
    none = upkeep.matching(_tx(s, d), [_RULE], "r7").select("account_id", F.lit(1).alias("hit"))
    return _tx(s, d).select("account_id", F.lit(0).alias("hit")).unionByName(none).groupBy("account_id").agg(F.count("*").alias("n"), F.sum("hit").alias("matched"))


QUERIES = {
    "rule_list": lambda s, d: upkeep.rule_list(_rules(s, d), kind="COMPOSITE", active=True, search="w_dg").select("id", "user_id", "priority"),
    "rule_list_page": lambda s, d: lists.page(upkeep.rule_list(_rules(s, d), user=3), upkeep.rule_order(), 1, 5).select("id", "priority", "total", "has_more"),
    "merchant_list": lambda s, d: upkeep.merchant_list(_merchants(s, d), search="BRAND#1", source="LLM", category="ECONOMY"),
    "merchant_list_page": lambda s, d: lists.page(upkeep.merchant_list(_merchants(s, d), user=4), upkeep.merchant_order(), 1, 5).select("merchant_normalized", "times_applied", "total"),
    "rule_toggle": lambda s, d: upkeep.toggled(_rules(s, d), _rules(s, d).where("priority < 10").select("id")).select("id", "is_active"),
    "rule_matching_rows": lambda s, d: upkeep.matching(lists.filtered(_tx(s, d), is_spend=True), [_RULE], "r9").groupBy("account_id").agg(F.count("*").alias("n")),
    "rule_matching_none": rule_matching_none,
    "filter_other_than": lambda s, d: lists.filtered(_owned(s, d), user=2, other_than=8).where("merchant = 'Clerk 8'").select("id"),
    "family_counts": lambda s, d: upkeep.family_counts(b.snapshots(s, d)),
    "chart_scale": lambda s, d: upkeep.chart_scale(networth.history(b.snapshots(s, d)), "net_worth"),
    "category_table": lambda s, d: b.table(s, d, "part").select((F.col("p_partkey") % 73 + 1).alias("category_id")).join(categories.table(s), "category_id").groupBy("transaction_type").agg(F.count("*").alias("n"), F.countDistinct("category").alias("categories")),
    "category_types": lambda s, d: b.table(s, d, "part").select("p_partkey", categories.type_of(F.element_at(F.array(*[F.lit(c) for c in ("Rent", "Interest", "Savings", "Uncategorized", "No such")]), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("transaction_type")),
    "report_summary": lambda s, d: reports.summary_lines(_tx(s, d), START, END, 3),
    "report_categories": lambda s, d: reports.category_lines(_tx(s, d), START, END, 3, 15),
    "report_transactions": lambda s, d: reports.transaction_lines(_tx(s, d), START, END, 3),
} | {
    f.__name__: f
    for f in (
        apply_one_rule, rule_counters, merchant_counters, bulk_update, learned_corrections, currency_backfill, reimported_files, unseen_files, import_preview_rows, import_preview_totals, import_life_cycle,
        balance_accounts, balance_snapshots, statements_preview, snapshots_by_account, match_statements, account_names, llm_answers, list_sorted_page, restore_report, restored_transactions, backup_export, csv_export,
    )
}

_DAY = f"DATE '{AT}'"
_RANGE = f"user_id = 3 AND date BETWEEN DATE '{START}' AND DATE '{END}'"
_CASH = "COALESCE(account_type IN ('CHECKING', 'SAVINGS', 'CASH', 'DIGITAL_WALLET'), false)"
_OWNED = "owned AS (SELECT o_orderkey AS id, o_custkey % 4 AS user_id, 'Clerk ' || o_orderkey % 50 AS merchant, o_orderpriority AS category, o_custkey % 4 = 2 AND o_orderkey % 3 = 0 AS asked FROM orders)"

_LEDGER = {
    "rule_list": f", {_RULES} SELECT id, user_id, priority FROM rules WHERE rule_type = 'COMPOSITE' AND is_active AND name ILIKE '%w_dg%'",
    "rule_list_page": f", {_RULES} SELECT id, priority, (SELECT COUNT(*) FROM rules WHERE user_id = 3) AS total, (SELECT COUNT(*) > 5 FROM rules WHERE user_id = 3) AS has_more FROM rules WHERE user_id = 3 ORDER BY priority, created_at DESC, id LIMIT 5",
    "merchant_list": f", {_MC} SELECT * FROM mcs WHERE merchant_normalized ILIKE '%brand#1%' AND source = 'LLM' AND category = 'ECONOMY'",
    "merchant_list_page": f", {_MC} SELECT merchant_normalized, times_applied, (SELECT COUNT(*) FROM mcs WHERE user_id = 4) AS total FROM mcs WHERE user_id = 4 ORDER BY times_applied DESC, merchant_normalized LIMIT 5",
    "rule_toggle": f", {_RULES} SELECT id, CASE WHEN priority < 10 THEN NOT is_active ELSE is_active END AS is_active FROM rules",
    "rule_matching_rows": f"SELECT account_id, COUNT(*) AS n FROM tx WHERE is_spend AND {_HIT} GROUP BY ALL",
    "rule_matching_none": "SELECT account_id, COUNT(*) AS n, 0 AS matched FROM tx GROUP BY account_id",
    "filter_other_than": f", {_OWNED} SELECT id FROM owned WHERE user_id = 2 AND merchant = 'Clerk 8' AND id <> 8",
    "family_counts": f"SELECT {_CASH} AS is_cash, COUNT(DISTINCT account_id) AS accounts, COUNT(*) AS statements FROM snaps GROUP BY ALL",
    "chart_scale": """, daily AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id, statement_date ORDER BY snapshot_id DESC) AS rn FROM snaps) WHERE rn = 1),
      days AS (SELECT DISTINCT user_id, statement_date AS day FROM daily), hist AS (SELECT d.user_id, d.day, CAST(SUM(x.total_value) AS DOUBLE) AS v FROM days d JOIN (
        SELECT *, lead(statement_date) OVER (PARTITION BY account_id ORDER BY statement_date) AS until FROM daily) x ON d.user_id = x.user_id AND x.statement_date <= d.day AND (x.until IS NULL OR d.day < x.until) GROUP BY ALL)
      SELECT user_id, greatest(MAX(abs(v)), 1.0) AS largest, MIN(v) AS least, MAX(v) AS most, bool_or(v < 0) AS has_negative FROM hist GROUP BY user_id""",
    "category_table": """SELECT CASE WHEN id <= 41 OR id = 58 THEN 'EXPENSE' WHEN id <= 50 OR id IN (68, 69, 72, 73) THEN 'INCOME' WHEN id = 56 THEN 'UNCATEGORIZED' ELSE 'TRANSFER' END AS transaction_type, COUNT(*) AS n, COUNT(DISTINCT id) AS categories FROM (SELECT p_partkey % 73 + 1 AS id FROM part) GROUP BY 1""",
    "category_types": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'EXPENSE' WHEN 1 THEN 'INCOME' WHEN 2 THEN 'TRANSFER' WHEN 3 THEN 'UNCATEGORIZED' END AS transaction_type FROM part",
    "report_summary": f"""SELECT unnest([1, 2, 3]) AS line, unnest(['Total Spend', 'Total Income', 'Net']) AS label, unnest([printf('$%.2f', s), printf('$%.2f', i), printf('$%.2f', i - s)]) AS value FROM (
      SELECT CAST(SUM(CASE WHEN is_spend THEN eff END) AS DOUBLE) AS s, abs(CAST(SUM(CASE WHEN is_income THEN eff END) AS DOUBLE)) AS i FROM tx WHERE {_RANGE} HAVING COUNT(*) > 0)""",
    "report_categories": f"""SELECT category, printf('$%.2f', CAST(s AS DOUBLE)) AS amount, n AS count, printf('%.1f%%', CAST(s AS DOUBLE) / CAST(w AS DOUBLE) * 100.0) AS share FROM (
      SELECT *, SUM(s) OVER () AS w FROM (SELECT category, SUM(eff) AS s, COUNT(*) AS n FROM tx WHERE is_spend AND {_RANGE} GROUP BY ALL)) WHERE category IS NOT NULL ORDER BY s DESC, category LIMIT 15""",
    "report_transactions": f"SELECT strftime(date, '%Y-%m-%d') AS date, substr(description_raw, 1, 50) AS description, COALESCE(category, '') AS category, printf('$%.2f', CAST(amount AS DOUBLE)) AS amount, transaction_type FROM tx WHERE {_RANGE}",
    "apply_one_rule": f"SELECT 'r9' AS id, 5 + COUNT(*) AS match_count, CASE WHEN COUNT(*) > 0 THEN {_DAY} END AS last_matched_at FROM tx WHERE {_HIT} UNION ALL SELECT 'r8', 1, NULL",
    "rule_counters": f", {_RULES} SELECT id, CAST(match_count + COALESCE(n, 0) AS INT) AS match_count, CASE WHEN n > 0 THEN {_DAY} END AS last_matched_at FROM rules LEFT JOIN (SELECT CAST(o_custkey % 40 AS VARCHAR) AS m, COUNT(*) AS n FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1) ON id = m",
    "merchant_counters": "SELECT p_brand || ' ' || p_partkey AS merchant_normalized, CAST(p_size + (SELECT COUNT(*) FROM lineitem WHERE l_partkey = p_partkey) AS INT) AS times_applied FROM part",
    "bulk_update": f""", {_OWNED} SELECT id, CASE WHEN asked THEN '1-URGENT' ELSE category END AS category, CASE WHEN asked AND id % 2 = 0 THEN 'INCOME' ELSE 'EXPENSE' END AS transaction_type, NOT (asked AND id % 2 = 0) AS is_spend, asked AND id % 2 = 0 AS is_income,
      CASE WHEN asked THEN 'MANUAL' ELSE 'DEFAULT' END AS classification_method FROM owned""",
    "learned_corrections": f", {_OWNED} SELECT DISTINCT user_id, merchant AS merchant_normalized, '1-URGENT' AS category FROM owned WHERE asked AND category <> '1-URGENT'",
    "currency_backfill": "SELECT c AS currency, CAST(SUM(CASE WHEN c IS NULL OR c = 'USD' THEN amount END) AS DOUBLE) AS usd, COUNT(*) FILTER (c <> 'USD') AS missing FROM (SELECT CASE WHEN user_id % 4 > 0 THEN currency END AS c, amount FROM raw) GROUP BY c",
    "reimported_files": f"SELECT o_orderkey, o_orderkey AS import_id, {_DAY} + CAST(o_orderkey % 9 AS INT) AS imported_at FROM orders WHERE o_orderkey % 4 = 0",
    "unseen_files": "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1",
    "import_preview_rows": "SELECT import_id, row_index FROM (SELECT o_custkey % 10 AS import_id, o_orderkey AS row_index, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 20",
    "import_preview_totals": "SELECT o_custkey % 10 AS import_id, COUNT(*) AS total_count, COUNT(DISTINCT CASE WHEN o_orderkey % 300 < 40 THEN o_orderkey % 300 END) AS duplicate_count FROM orders GROUP BY 1",
    "import_life_cycle": f"""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' ELSE 'PENDING' END AS status, CASE WHEN o_orderkey % 3 = 1 THEN 'no date; row ' || o_orderkey END AS error_message,
      CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 ELSE 0 END AS INT) AS transactions_imported, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 ELSE 0 END AS INT) AS transactions_duplicate, CASE WHEN o_orderkey % 3 = 0 THEN {_DAY} END AS completed_at FROM orders""",
    "balance_accounts": """SELECT o_orderkey AS balance_id, k AS account_type, MIN(account_id) AS account_id FROM (SELECT *, list_extract(['CHECKING', 'SAVINGS', 'OTHER'], CAST(o_orderkey % 3 + 1 AS INT)) AS k FROM orders) o
      JOIN customer ON c_custkey = o_custkey LEFT JOIN accounts a ON a.user_id = CASE WHEN o_orderkey % 4 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AND a.account_type = k AND a.institution = 'Bank ' || o_custkey % 7 AND a.last4 = lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') GROUP BY 1, 2""",
    "balance_snapshots": """, o AS (SELECT *, date_trunc('month', o_orderdate)::DATE AS day FROM orders), new AS (SELECT o_custkey, day, MAX(o_orderkey) AS k, arg_max(o_totalprice, o_orderkey) AS v FROM o WHERE o_orderkey % 10 = 5 GROUP BY ALL)
      SELECT o_custkey AS account_id, day AS statement_date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total_value, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS source_file_hash FROM o WHERE o_orderkey % 2 = 0 AND (o_custkey, day) NOT IN (SELECT (o_custkey, day) FROM new)
      UNION ALL SELECT o_custkey, day, CAST(CAST(v AS DECIMAL(18,2)) AS DOUBLE), lpad(CAST(k AS VARCHAR), 12, '0') FROM new""",
    "statements_preview": """, f AS (SELECT CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'file ' || o_orderkey END AS account, CAST(o_orderdate AS DATE) AS day, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders WHERE o_orderkey % 7 > 0)
      SELECT COUNT(*) AS accounts, CAST(SUM(v) AS DOUBLE) AS latest_value, (SELECT MIN(day) FROM f) AS first_date, (SELECT MAX(day) FROM f) AS last_date FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY day DESC, o_orderkey) AS rn FROM f) WHERE rn = 1""",
    "snapshots_by_account": f"SELECT snapshot_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY statement_date DESC, snapshot_id DESC) AS INT) AS place, COUNT(*) OVER (PARTITION BY account_id) AS statements, {_CASH} AS is_cash FROM snaps",
    "match_statements": """, h AS (SELECT *, CASE WHEN account_id % 2 = 0 THEN 'h' || account_id END AS hash FROM accounts), s AS (SELECT *, CASE WHEN account_id % 3 = 0 THEN COALESCE(hash, 'new') WHEN account_id % 3 = 1 THEN 'other' END AS asked FROM h)
      SELECT s.account_id AS statement_id, COALESCE(MIN(CASE WHEN h.hash = s.asked THEN h.account_id END), MIN(CASE WHEN h.institution = s.institution AND h.account_type = s.account_type AND h.last4 = s.last4 AND (h.hash IS NULL OR s.asked IS NULL) THEN h.account_id END)) AS account_id
      FROM s LEFT JOIN h ON h.user_id = s.user_id AND h.is_active GROUP BY 1""",
    "account_names": """SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN 'Anna' || c_custkey || ' - ' || CASE c_custkey % 3 WHEN 0 THEN 'Ally Bank Savings' WHEN 1 THEN 'Gold Card' ELSE 'Ally Bank Credit Card' END ELSE 'Ally Bank Credit Card' END AS name FROM customer""",
    "llm_answers": """SELECT o_orderkey, k AS transaction_type, CASE WHEN k = 'UNCATEGORIZED' THEN 'Uncategorized' ELSE 'Gifts' END AS category, k = 'EXPENSE' AS is_spend, k = 'INCOME' AS is_income, least(c, 1.0) AS confidence, c < 0.6 OR k = 'UNCATEGORIZED' AS needs_review, 'LLM' AS classification_method FROM (
      SELECT o_orderkey, list_extract(['EXPENSE', 'INCOME', 'TRANSFER', 'INCOME', 'EXPENSE', 'UNCATEGORIZED', 'UNCATEGORIZED', 'EXPENSE'], CAST(o_orderkey % 8 + 1 AS INT)) AS k, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 13 AS DOUBLE) / 10 ELSE 0.8 END AS c FROM orders)""",
    "list_sorted_page": """, r AS (SELECT CASE WHEN user_id % 3 > 0 THEN merchant END AS merchant, description_raw, account_id, date, CAST(amount AS DOUBLE) AS amount FROM tx)
      SELECT *, (SELECT COUNT(*) FROM r) AS total FROM r ORDER BY lower(COALESCE(merchant, description_raw)), description_raw, account_id, date, amount LIMIT 40 OFFSET 40""",
    "restore_report": """, t AS (SELECT CASE WHEN o_orderkey % 10 = 1 THEN 'skipped' WHEN o_orderkey % 4 = 0 THEN 'errors' ELSE 'created' END AS status FROM orders)
      SELECT 'accounts' AS entity, CASE WHEN c_custkey % 2 = 0 THEN 'skipped' ELSE 'created' END AS status, COUNT(*) AS rows FROM customer GROUP BY ALL UNION ALL SELECT 'rules', 'created', 2 UNION ALL SELECT 'transactions', status, COUNT(*) FROM t GROUP BY ALL""",
    "restored_transactions": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'gone ' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS account_id, CASE WHEN o_orderkey % 10 = 1 OR o_orderkey % 3 < 2 THEN CAST(o_orderkey % 3 AS VARCHAR) END AS matched_rule_id
      FROM orders WHERE o_orderkey % 10 = 1 OR o_orderkey % 4 > 0""",
    "backup_export": "SELECT o_orderkey AS id, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at FROM orders",
    "csv_export": """SELECT strftime(date, '%Y-%m-%d') AS "Date", description_raw AS "Description", merchant AS "Merchant", CASE WHEN amount = 0 THEN '0' ELSE CAST(amount AS VARCHAR) END AS "Amount", transaction_type AS "Type", COALESCE(category, '') AS "Category", '' AS "Subcategory",
      CASE WHEN is_spend THEN 'Yes' ELSE 'No' END AS "Is Spend", CASE WHEN is_income THEN 'Yes' ELSE 'No' END AS "Is Income", 'RULE' AS "Classification Method", CAST(account_id AS VARCHAR) AS "Account ID", CASE WHEN needs_review THEN 'a,b' ELSE '' END AS "Tags", '' AS "Notes" FROM tx""",
}

SQL = {name: f"WITH {b.SQL.strip()}{body if body.startswith(',') else ' ' + body}" for name, body in _LEDGER.items()}
