"""Changes to ledger tables as DataFrame rewrites: each takes tables and returns what they become."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import manual_key, new_rows


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of ``new`` replace or join those of ``old`` by key; columns named in ``keep`` stay as they were."""
    values = [c for c in old.columns if c not in keys]
    right = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in values if c in new.columns], F.lit(True).alias("__new"))
    joined = old.withColumn("__old", F.lit(True)).join(right, keys, "full")
    cols = []
    for c in values:
        if c not in new.columns or c in keep:
            fallback = F.col(f"__new_{c}") if c in new.columns else F.lit(None)
            cols.append(F.when(F.col("__old").isNotNull(), F.col(c)).otherwise(fallback).alias(c))
        else:
            cols.append(F.when(F.col("__new").isNotNull(), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*[c if c in keys else cols[values.index(c)] for c in old.columns])


def update(old: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Sets the columns of ``changes`` that are not null on the rows of their key; a new type sets the flags."""
    columns = [c for c in changes.columns if c != key]
    joined = old.join(changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns]), key, "left")
    new = {c: F.coalesce(f"__{c}", c) for c in columns}
    out = joined.withColumns(new)
    if "transaction_type" in columns:
        typed = F.col("__transaction_type").isNotNull()
        out = out.withColumns({f: F.when(typed, F.col("__transaction_type") == t).otherwise(F.col(f)) for f, t in (("is_spend", "EXPENSE"), ("is_income", "INCOME"))})
    return out.select(*old.columns)


def delete(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def delete_account(tables: dict[str, DataFrame], account) -> dict[str, DataFrame]:
    """An account and all that hangs on it: positions by their snapshots, the rest by the account."""
    gone = F.col("account_id") == account
    out = dict(tables)
    if "positions" in out:
        dead = tables["holdings_snapshots"].where(gone).select(F.col("id").alias("snapshot_id"))
        out["positions"] = tables["positions"].join(dead, "snapshot_id", "left_anti")
    for name in ("holdings_snapshots", "transactions", "import_records"):
        if name in out:
            out[name] = tables[name].where(~F.coalesce(gone, F.lit(False)))
    out["accounts"] = tables["accounts"].where(F.col("id") != account)
    return out


def delete_import(tables: dict[str, DataFrame], record) -> dict[str, DataFrame]:
    out = dict(tables)
    out["transactions"] = tables["transactions"].where(~F.coalesce(F.col("import_id") == record, F.lit(False)))
    out["import_records"] = tables["import_records"].where(F.col("id") != record)
    return out


def manual_transactions(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entries made by hand (account_id, date, description_raw, amount, transaction_type): keyed, stripped of
    what the ledger has already, amounts positive."""
    keyed = entries.withColumn("hash_dedup_key", manual_key("account_id", "date", "description_raw", "amount"))
    fresh = new_rows(keyed.dropDuplicates(["hash_dedup_key"]), ledger)
    kind = F.col("transaction_type")
    return fresh.withColumns({"amount": F.abs("amount"), "classification_method": F.lit("MANUAL"), "confidence": F.lit(1.0), "is_spend": kind == "EXPENSE", "is_income": kind == "INCOME"})


def learn_merchants(known: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections (user_id, merchant_normalized, category) as learned merchants of full confidence."""
    new = corrections.select("user_id", "merchant_normalized", "category").withColumns({"confidence": F.lit(1.0), "source": F.lit("USER"), "times_applied": F.lit(0)})
    return upsert(known, new, ["user_id", "merchant_normalized"], keep=["times_applied"])


def apply_merchant(tx: DataFrame, merchant: str, category: str) -> DataFrame:
    hit = F.coalesce(F.col("merchant") == merchant, F.lit(False))
    return tx.withColumns({"category": F.when(hit, category).otherwise(F.col("category")), "classification_method": F.when(hit, "LEARNED").otherwise(F.col("classification_method"))})


def refresh_usage(merchants: DataFrame, tx: DataFrame) -> DataFrame:
    """Learned merchants whose number of uses is not that of their transactions, with the right one."""
    counts = tx.groupBy("user_id", F.col("merchant").alias("merchant_normalized")).agg(F.count("*").alias("actual"))
    joined = merchants.join(counts, ["user_id", "merchant_normalized"], "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    return joined.where(F.col("times_applied") != F.col("actual")).select("user_id", "merchant_normalized", "times_applied", "actual")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the highest ``order`` for each key: later balances of a day replace earlier ones."""
    value = F.struct(*[c for c in [order, *[c for c in rows.columns if c not in (*keys, order)]]])
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias("v")).select(*[c if c in keys else F.col("v")[c].alias(c) for c in rows.columns])
