"""The import of parsed rows into a ledger: duplicates, rules, learned merchants, words, currency, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import classified
from ..operators.dedup import first_in_batch, import_key, new_rows
from ..operators.fx import convert
from ..operators.rules import applied


def commit(parsed: DataFrame, ledger: DataFrame, rules: list[dict], merchants: DataFrame, rates: DataFrame, keywords=None) -> DataFrame:
    """The rows of ``parsed`` (user_id, account_id, file_hash, row_index, date, description_raw, merchant, amount,
    currency and optionally is_payment, is_credit) that the ledger lacks, classified and converted. Taking the
    same rows twice adds nothing."""
    keyed = parsed.withColumn("hash_dedup_key", import_key("account_id", "file_hash", "row_index"))
    fresh = first_in_batch(new_rows(keyed, ledger), "hash_dedup_key", ["row_index"])
    blank = {"transaction_type": "UNCATEGORIZED", "category": None, "needs_review": None, "is_spend": None, "is_income": None}
    kinds = {"needs_review": "boolean", "is_spend": "boolean", "is_income": "boolean"}
    for c, v in blank.items():
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(v).cast(kinds.get(c, "string")))
    return convert(classified(applied(fresh, rules), merchants, keywords), rates)


def reclassified(tx: DataFrame, rules: list[dict], merchants: DataFrame, keywords=None) -> DataFrame:
    """All rows but transfers and income classified anew, flags included."""
    held = tx.where(F.col("transaction_type").isin("TRANSFER", "INCOME"))
    again = classified(applied(tx.where(~F.col("transaction_type").isin("TRANSFER", "INCOME")), rules), merchants, keywords)
    return again.unionByName(held, allowMissingColumns=True)
