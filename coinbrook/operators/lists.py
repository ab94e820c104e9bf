"""Filtered, sorted and paged lists, accounts and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BANK_TYPES, BROKERAGE_TYPES


def filtered(tx: DataFrame, user=None, account=None, kind=None, category=None, is_spend=None, needs_review=None, rule=None, search: str | None = None, start=None, end=None, other_than=None) -> DataFrame:
    """Rows that meet all conditions given. ``search`` is looked for in description or merchant without regard
    to case, its wildcards alive; a row without merchant can still match by its description. ``other_than``
    leaves out the row of that id."""
    equal = {"user_id": user, "account_id": account, "transaction_type": kind, "category": category, "is_spend": is_spend, "needs_review": needs_review, "matched_rule_id": rule}
    for c, v in equal.items():
        if v is not None:
            tx = tx.where(F.col(c) == v)
    if search:
        tx = tx.where(F.col("description_raw").ilike(f"%{search}%") | F.col("merchant").ilike(f"%{search}%"))
    if start is not None:
        tx = tx.where(F.col("date") >= F.lit(start))
    if end is not None:
        tx = tx.where(F.col("date") <= F.lit(end))
    return tx if other_than is None else tx.where(F.col("id") != other_than)


def page(rows: DataFrame, order: list, page: int = 1, size: int = 50) -> DataFrame:
    """A page of the ordered rows (give an order without ties), with the total and whether more follow."""
    if page < 1 or not 1 <= size <= 10_000:
        raise ValueError("page is 1 or more, size 1 to 10 000")
    total = rows.agg(F.count("*").alias("total"))
    shown = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    return shown.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > page * size)  # one row on the right


def has_words(text: Column, query: str) -> Column:
    """Whether every word of the query occurs in the text, without regard to case."""
    out = F.lit(True)
    for w in query.lower().split():
        out &= F.contains(F.lower(text), F.lit(w))
    return out


def family(kind: Column) -> Column:
    return F.when(kind.isin(*BANK_TYPES), "bank").when(kind.isin(*BROKERAGE_TYPES), "brokerage").otherwise("other")


def type_change_allowed(old: Column, new: Column) -> Column:
    return family(old) == family(new)


def account_counts(accounts: DataFrame, tx: DataFrame, snapshots: DataFrame, positions: DataFrame, imports: DataFrame) -> DataFrame:
    """Accounts with their numbers of transactions, imports, snapshots and positions in the latest snapshots."""
    from .networth import latest

    t = tx.groupBy("account_id").agg(F.count("*").alias("transactions"))
    i = imports.groupBy("account_id").agg(F.count("*").alias("imports"))
    s = snapshots.groupBy("account_id").agg(F.count("*").alias("snapshots"))
    p = latest(snapshots).select("account_id", "snapshot_id").join(positions, "snapshot_id").groupBy("account_id").agg(F.count("*").alias("positions"))
    out = accounts.select("account_id", "user_id")
    for part in (t, i, s, p):
        out = out.join(part, "account_id", "left")
    return out.fillna(0, ["transactions", "imports", "snapshots", "positions"])


def families(accounts: DataFrame) -> DataFrame:
    return accounts.groupBy("user_id", family(F.col("account_type")).alias("family"), "account_type").agg(F.count("*").alias("accounts"), F.count_if("is_active").alias("active"))


def visible_imports(imports: DataFrame, accounts: DataFrame, user) -> DataFrame:
    """Imports whose account is the user's, or that are the user's by themselves."""
    owner = accounts.select("account_id", F.col("user_id").alias("owner"))
    return imports.join(owner, "account_id", "left").where((F.col("owner") == user) | (F.col("user_id") == user)).drop("owner")


def match_accounts(statements: DataFrame, accounts: DataFrame, institution: str = "institution", last4: str = "last4") -> DataFrame:
    """The account of each statement (statement_id, user_id, account_hash, institution, last4): by hash, else by
    institution and last digits where the account's hash is missing or the same, or the statement has none. Where
    both tables have an account_type it has to agree too. Only active accounts count; of several the least id."""
    accounts = accounts.where("is_active")
    typed = ["account_type"] if "account_type" in accounts.columns and "account_type" in statements.columns else []
    by_hash = accounts.where("account_hash IS NOT NULL").groupBy("user_id", "account_hash").agg(F.min("account_id").alias("a1"))
    one = statements.join(by_hash, ["user_id", "account_hash"], "left")
    loose = accounts.select("user_id", institution, last4, *typed, F.col("account_hash").alias("h2"), F.col("account_id").alias("a2"))
    two = statements.join(loose, ["user_id", institution, last4, *typed]).where(F.col("account_hash").isNull() | F.col("h2").isNull() | (F.col("h2") == F.col("account_hash")))
    two = two.groupBy("statement_id").agg(F.min("a2").alias("a2"))
    return one.join(two, "statement_id", "left").select("statement_id", F.coalesce("a1", "a2").alias("account_id"))


def sort_key(column: str) -> list[Column]:
    """How a shown list is sorted: text without regard to case, the merchant before the description."""
    keys = {"description": F.lower(F.coalesce("merchant", "description_raw")), "category": F.lower(F.coalesce("category", F.lit(""))), "type": F.lower("transaction_type"), "amount": F.col("amount"), "date": F.col("date")}
    return [keys[column]]
