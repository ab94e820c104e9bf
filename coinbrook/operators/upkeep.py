"""Upkeep of a ledger: rules and learned merchants as lists and counters, the life of an import, balances."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CASH_TYPES
from .changes import keep_last, update
from .rules import applied, predicate


def _only(rows: DataFrame, equal: dict, search: str | None, of: str) -> DataFrame:
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == v)
    return rows.where(F.col(of).ilike(f"%{search}%")) if search else rows


def rule_list(rules: DataFrame, user=None, kind: str | None = None, active: bool | None = None, search: str | None = None) -> DataFrame:
    """Rules of a type, a state and a part of their name (wildcards alive), whatever its case."""
    return _only(rules, {"user_id": user, "rule_type": kind, "is_active": active}, search, "name")


def rule_order() -> list[Column]:
    return [F.asc("priority"), F.desc("created_at"), F.asc("id")]


def merchant_list(merchants: DataFrame, user=None, search: str | None = None, source: str | None = None, category: str | None = None) -> DataFrame:
    return _only(merchants, {"user_id": user, "source": source, "category": category}, search, "merchant_normalized")


def merchant_order(updated: str | None = None) -> list[Column]:
    """Most used first, then last ``updated`` (a column, where the table has one), then by name."""
    return [F.desc("times_applied"), *([F.desc(updated)] if updated else []), F.asc("merchant_normalized")]


def matching(tx: DataFrame, rules: list[dict], rule_id) -> DataFrame:
    """The rows that one rule matches by itself, active or not; none if there is no such rule."""
    found = [r for r in rules if str(r["id"]) == str(rule_id)]
    return tx.where(F.coalesce(predicate(found[0]), F.lit(False)) if found else F.lit(False))


def pattern_fault(kind: str, pattern: str) -> str | None:
    """Why a rule's pattern can't be stored, or None: expressions must compile, ranges be objects with a bound."""
    if kind == "DESCRIPTION_REGEX":
        try:
            re.compile(pattern)
        except re.error as e:
            return f"not a regular expression: {e}"
    elif kind == "AMOUNT_RANGE":
        try:
            bounds = json.loads(pattern)
        except ValueError:
            return "not JSON"
        if not isinstance(bounds, dict) or not {"min", "max"} & set(bounds):
            return "needs min or max"
    return None


def toggled(rules: DataFrame, keys: DataFrame) -> DataFrame:
    """The rules of the given ids switched on or off, whichever they were not."""
    hit = rules.join(keys.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return hit.withColumn("is_active", F.when(F.col("__hit"), ~F.col("is_active")).otherwise(F.col("is_active"))).select(*rules.columns)


def counted(rules: DataFrame, matched: DataFrame, at) -> DataFrame:
    """Rules with the rows of a batch (``matched_rule_id``) added to their counts, and when."""
    n = matched.where("matched_rule_id IS NOT NULL").groupBy(F.col("matched_rule_id").alias("id")).agg(F.count("*").alias("__n"))
    joined = rules.join(n, "id", "left")
    new = {"match_count": F.col("match_count") + F.coalesce("__n", F.lit(0)), "last_matched_at": F.when(F.col("__n") > 0, F.lit(at)).otherwise(F.col("last_matched_at"))}
    return joined.withColumns({c: v.cast(rules.schema[c].dataType) for c, v in new.items()}).select(*rules.columns)


def used(merchants: DataFrame, learned: DataFrame) -> DataFrame:
    """Learned merchants with the rows of a batch that they classified (user_id, merchant) added to their uses."""
    n = learned.groupBy("user_id", F.col("merchant").alias("merchant_normalized")).agg(F.count("*").alias("__n"))
    joined = merchants.join(n, ["user_id", "merchant_normalized"], "left")
    return joined.withColumn("times_applied", (F.col("times_applied") + F.coalesce("__n", F.lit(0))).cast(merchants.schema["times_applied"].dataType)).select(*merchants.columns)


def apply_one(tx: DataFrame, rules: list[dict], rule_id, table: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """(transactions, rules) after one rule, active or not, was applied to all rows that it matches."""
    found = [r | {"is_active": True} for r in rules if str(r["id"]) == str(rule_id)]
    if not found:
        raise ValueError(f"no rule {rule_id}")
    hit = matching(tx, found, rule_id).select(F.lit(str(rule_id)).alias("matched_rule_id"))
    return applied(tx, found), counted(table, hit, at)


def bulk_update(old: DataFrame, asked: DataFrame, user, key: str = "id") -> DataFrame:
    """Changes to many rows at once, all of which must be the user's and be named once; else none is made."""
    mine = old.where(F.col("user_id") == user).select(key)
    once = asked.groupBy(key).agg(F.count("*").alias("__n")).join(mine.withColumn("__mine", F.lit(True)), key, "left")
    if not once.where("__n > 1 OR __mine IS NULL").isEmpty():
        raise ValueError("rows that are not the user's or are named twice")
    return update(old, asked.withColumn("classification_method", F.lit("MANUAL")), key)


def corrections(old: DataFrame, asked: DataFrame, key: str = "id") -> DataFrame:
    """What a user's changes teach: (user_id, merchant_normalized, category) of rows whose category they change; of
    several for a merchant the last by key."""
    joined = old.select(key, "user_id", F.col("merchant").alias("merchant_normalized"), F.col("category").alias("__was")).join(asked.select(key, "category"), key)
    changed = joined.where("category IS NOT NULL AND merchant_normalized IS NOT NULL AND NOT category <=> __was")
    return changed.groupBy("user_id", "merchant_normalized").agg(F.max_by("category", key).alias("category"))


def with_dollars(rows: DataFrame, value: str = "amount") -> DataFrame:
    """Fills ``<value>_usd`` of rows in dollars, or in no stated currency, that lack it."""
    dollars = F.coalesce("currency", F.lit("USD")) == "USD"
    return rows.withColumn(f"{value}_usd", F.when(F.col(f"{value}_usd").isNull() & dollars, F.col(value)).otherwise(F.col(f"{value}_usd")))


def imported_before(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files (account_id, file_hash) that a record has already, with the first such record: a warning only."""
    first = records.groupBy("account_id", "file_hash").agg(F.min(F.struct("created_at", "id")).alias("__r"))
    return files.join(first, ["account_id", "file_hash"]).select(*files.columns, F.col("__r.id").alias("import_id"), F.col("__r.created_at").alias("imported_at"))


def unseen(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files (file_hash) of a folder that no snapshot comes from yet, so a folder can be read again at will."""
    return files.dropDuplicates(["file_hash"]).join(snapshots.select(F.col("source_file_hash").alias("file_hash")), "file_hash", "left_anti")


def preview(parsed: DataFrame, ledger: DataFrame, rows: int = 20) -> tuple[DataFrame, DataFrame]:
    """(the first rows of each import, totals): parsed rows have import_id, row_index and hash_dedup_key. Totals are
    the rows of an import and how many of its distinct keys the ledger has."""
    place = F.row_number().over(Window.partitionBy("import_id").orderBy("row_index"))
    shown = parsed.withColumn("__place", place).where(F.col("__place") <= rows).drop("__place")
    total = parsed.groupBy("import_id").agg(F.count("*").alias("total_count"))
    known = parsed.select("import_id", "hash_dedup_key").distinct().join(ledger.select("hash_dedup_key"), "hash_dedup_key", "left_semi")
    known = known.groupBy("import_id").agg(F.count("*").alias("duplicate_count"))
    return shown, total.join(known, "import_id", "left").fillna(0, ["duplicate_count"])


def finished(records: DataFrame, outcomes: DataFrame, at) -> DataFrame:
    """Import records after a run: outcomes (id, imported, duplicate, errors array). Errors make a record FAILED and
    are joined by "; "; the others are a SUCCESS with their counts and the time. Records without outcome stay."""
    joined = records.join(outcomes.withColumn("__done", F.lit(True)), "id", "left")
    done = F.coalesce("__done", F.lit(False))
    failed = done & (F.coalesce(F.size("errors"), F.lit(0)) > 0)
    good = done & ~failed
    new = {
        "status": F.when(failed, "FAILED").when(good, "SUCCESS").otherwise(F.col("status")),
        "error_message": F.when(failed, F.array_join("errors", "; ")).otherwise(F.col("error_message")),
        "transactions_imported": F.when(good, F.col("imported")).otherwise(F.col("transactions_imported")),
        "transactions_duplicate": F.when(good, F.col("duplicate")).otherwise(F.col("transactions_duplicate")),
        "completed_at": F.when(good, F.lit(at)).otherwise(F.col("completed_at")),
    }
    return joined.withColumns({c: v.cast(records.schema[c].dataType) for c, v in new.items()}).select(*records.columns)


def balance_type(name: Column) -> Column:
    """The account type of a balance by the name that its statement gives."""
    lower = F.lower(name)
    return F.when(lower.isin("spending", "checking"), "CHECKING").when(lower == "savings", "SAVINGS").otherwise("OTHER")


def balance_accounts(balances: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balances (user_id, institution, account, last4, ...) with the user's own account of equal institution, type and
    last digits, of several the least id; null where one has to be made."""
    typed = balances.withColumn("account_type", balance_type(F.col("account")))
    keys = ["user_id", "institution", "account_type", "last4"]
    return typed.join(accounts.groupBy(*keys).agg(F.min("account_id").alias("account_id")), keys, "left").select(*balances.columns, "account_type", "account_id")


def balance_snapshots(snapshots: DataFrame, balances: DataFrame) -> DataFrame:
    """Snapshots (account_id, statement_date, total_value, source_file_hash) after balances (account_id,
    statement_date, ending, source_file_hash) came in: a later one replaces that of its account and day, by the order
    of the hashes among those of one batch; balances of zero are skipped."""
    new = balances.where("ending <> 0").select("account_id", "statement_date", F.col("ending").alias("total_value"), "source_file_hash")
    new = keep_last(new, ["account_id", "statement_date"], "source_file_hash")
    kept = snapshots.join(new.select("account_id", "statement_date"), ["account_id", "statement_date"], "left_anti")
    columns = ["account_id", "statement_date", "total_value", "source_file_hash"]
    return kept.select(*columns).unionByName(new.select(*columns))


def statements_preview(results: DataFrame) -> DataFrame:
    """Of parsed statements (filename, account_identifier, statement_date, total_value, positions) that have
    positions: how many accounts, their latest values summed, and the span of dates. Of several statements of an
    account's last day the first file name counts."""
    rows = results.where("positions > 0")
    latest = F.struct(F.coalesce("statement_date", F.lit("0001-01-01").cast("date")).alias("day"), "total_value", "filename")
    first = rows.groupBy(F.coalesce("account_identifier", "filename").alias("account"), "statement_date").agg(F.min_by("total_value", "filename").alias("total_value"), F.min("filename").alias("filename"))
    by = first.groupBy("account").agg(F.max_by(latest, latest["day"]).alias("l"), F.min("statement_date").alias("from"), F.max("statement_date").alias("to"))
    return by.agg(F.count("*").alias("accounts"), F.sum("l.total_value").alias("latest_value"), F.min("from").alias("first_date"), F.max("to").alias("last_date"))


def snapshots_by_account(snapshots: DataFrame) -> DataFrame:
    """Snapshots numbered within their account, newest first, with how many it has and whether it is a cash account."""
    own = Window.partitionBy("account_id")
    return snapshots.withColumns({
        "place": F.row_number().over(own.orderBy(F.desc("statement_date"), F.desc("snapshot_id"))),
        "statements": F.count("*").over(own),
        "is_cash": F.coalesce(F.col("account_type").isin(*CASH_TYPES), F.lit(False)),
    })


def family_counts(snapshots: DataFrame) -> DataFrame:
    """Accounts and statements of cash and of investments."""
    by = snapshots.groupBy("account_id", F.coalesce(F.col("account_type").isin(*CASH_TYPES), F.lit(False)).alias("is_cash")).agg(F.count("*").alias("n"))
    return by.groupBy("is_cash").agg(F.count("*").alias("accounts"), F.sum("n").alias("statements"))


def chart_scale(points: DataFrame, value: str, by: str = "user_id") -> DataFrame:
    """What a chart's axis needs of each series: the largest absolute value (1 at least), the span, any negative."""
    v = F.col(value)
    return points.groupBy(by).agg(F.greatest(F.max(F.abs(v)), F.lit(1.0)).alias("largest"), F.min(v).alias("least"), F.max(v).alias("most"), F.bool_or(v < 0).alias("has_negative"))


# Products whose name does not say whose they are.
_PLAIN_PRODUCTS = ["Spending", "Savings", "Checking"]


def display_name(holder: Column, product: Column, institution: Column, kind: Column) -> Column:
    """An account's name: the holder's first name and the product; the bank's name where the product's is a plain
    one or missing; without a holder the bank and the type."""
    first = F.initcap(F.split(F.nullif(F.trim(holder), F.lit("")), r"\s+")[0])
    named = F.nullif(product, F.lit(""))
    of = F.when(named.isin(*_PLAIN_PRODUCTS), F.concat_ws(" ", institution, named)).otherwise(F.coalesce(named, F.concat_ws(" ", institution, kind)))
    return F.when(first.isNotNull(), F.concat_ws(" - ", first, of)).otherwise(F.concat_ws(" ", institution, kind))
