"""Duplicates among transactions: keys, membership, first of a batch, near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _part(c: Column | str) -> Column:
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))


def import_key(account: str, file_hash: str, row_index: str) -> Column:
    """SHA-256 of account, file and row; a missing part counts as empty and keeps its place."""
    return F.sha2(F.concat(_part(account), F.lit("|"), _part(file_hash), F.lit("|"), _part(row_index)), 256)


def manual_key(account: str, date: str, description: str, amount: str) -> Column:
    """Of a transaction entered by hand; the amount with two places, so 5 and 5.00 are one."""
    return F.sha2(F.concat(F.lit("manual:"), _part(account), F.lit(":"), _part(date), F.lit(":"), _part(description), F.lit(":"), _part(F.col(amount).cast("decimal(15,2)"))), 256)


def account_hash(number: Column) -> Column:
    return F.sha2(F.upper(F.trim(F.translate(number, "- ", ""))), 256)


def plain_description(c: Column) -> Column:
    """Lower case; white space, stars and hashes to one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[*#\s]+", " "))


def new_rows(incoming: DataFrame, ledger: DataFrame, key: str = "hash_dedup_key") -> DataFrame:
    return incoming.join(ledger.select(key), key, "left_anti")


def existing(incoming: DataFrame, ledger: DataFrame, key: str = "hash_dedup_key") -> DataFrame:
    """The distinct keys of ``incoming`` that the ledger has."""
    return incoming.select(key).distinct().join(ledger.select(key), key, "left_semi")


def first_in_batch(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def near_duplicates(tx: DataFrame, id: str = "id", days: int = 3, cents: str = "0.01") -> DataFrame:
    """One row per row of ``tx`` that has near ones, with their number (``links``) and its class: rows are near that
    have equal descriptions, amounts at most a cent apart and dates at most some days. Rows of equal description,
    date and amount are one class, named by its least id (``class_id``).

    Only classes are compared, so n equal rows cost one row, not n squared pairs. The band join is an equality join:
    each class is dealt to its bucket of days and, on one side, to the two buckets beside it, so a common description
    does not meet itself over all dates. Amounts are decimals of a cent, so a class meets few others.
    """
    keys = ["description", "date", "amount"]
    rows = tx.select(F.col(id).alias("id"), "date", "amount", plain_description(F.col("description_raw")).alias("description"))
    classes = rows.groupBy(*keys).agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    step = F.lit(cents).cast("decimal(15,2)")
    bucket = F.floor(F.unix_date("date") / (days + 1)).cast("long")
    cell = F.floor(F.col("amount") / step).cast("long")
    near = lambda c: F.explode(F.array(*[c + d for d in (-1, 0, 1)]))
    left = classes.select(*keys, "class_id", "n", bucket.alias("b"), cell.alias("c"))
    right = classes.select("description", F.col("date").alias("date_2"), F.col("amount").alias("amount_2"), F.col("n").alias("n_2"), bucket.alias("b0"), near(cell).alias("c")).withColumn("b", near(F.col("b0"))).drop("b0")
    joined = left.join(right, ["description", "b", "c"])
    close = (F.abs(F.col("amount") - F.col("amount_2")) <= step) & (F.abs(F.datediff("date", "date_2")) <= days)
    linked = joined.where(close).groupBy(*keys, "class_id").agg((F.sum("n_2") - 1).alias("links")).where("links > 0")
    return rows.join(linked, keys).select("id", "class_id", "links", "description")


def near_classes(tx: DataFrame, id: str = "id", days: int = 3) -> DataFrame:
    """The classes of near rows and how many rows each has: what a review shows."""
    near = near_duplicates(tx, id, days)
    return near.groupBy("class_id", "description", "links").agg(F.count("*").alias("rows"))
