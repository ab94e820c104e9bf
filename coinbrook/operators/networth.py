"""Net worth from holdings snapshots: current value, carried-forward history, asset classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ASSET_CLASSES, CASH_TYPES


def latest(snapshots: DataFrame) -> DataFrame:
    """The snapshots of each account's last date, all of them where there are several."""
    rank = F.rank().over(Window.partitionBy("account_id").orderBy(F.desc("statement_date")))
    return snapshots.withColumn("rank", rank).where("rank = 1").drop("rank")


def one_a_day(snapshots: DataFrame) -> DataFrame:
    """One snapshot per account and day, the one of the highest id."""
    rank = F.row_number().over(Window.partitionBy("account_id", "statement_date").orderBy(F.desc("snapshot_id")))
    return snapshots.withColumn("rank", rank).where("rank = 1").drop("rank")


def current(snapshots: DataFrame) -> DataFrame:
    """Each user's net worth: the values of the latest snapshots, ties summed."""
    return latest(snapshots).groupBy("user_id").agg(F.sum("total_value").cast("double").alias("net_worth"), F.countDistinct("account_id").alias("accounts"))


def _carried(daily: DataFrame, values: list[str]) -> DataFrame:
    """For each user and date the sum of every account's latest values, from what changes on each date."""
    own = Window.partitionBy("account_id").orderBy("statement_date")
    changes = daily.select("user_id", "statement_date", *[(F.col(v) - F.coalesce(F.lag(v).over(own), F.lit(0).cast("decimal(18,2)"))).alias(v) for v in values])
    by_day = changes.groupBy("user_id", "statement_date").agg(*[F.sum(v).alias(v) for v in values])
    running = Window.partitionBy("user_id").orderBy("statement_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return by_day.select("user_id", "statement_date", *[F.sum(v).over(running).alias(v) for v in values])


def history(snapshots: DataFrame) -> DataFrame:
    """Net worth on each date of a snapshot, every account at its latest value up to then."""
    return _carried(one_a_day(snapshots), ["total_value"]).select("user_id", "statement_date", F.col("total_value").cast("double").alias("net_worth"))


def history_by_account(snapshots: DataFrame) -> DataFrame:
    """As intervals: from each snapshot's date until before the account's next one its value holds; so no
    row for every account and date is needed."""
    own = Window.partitionBy("account_id").orderBy("statement_date")
    nxt = F.lead("statement_date").over(own)
    return one_a_day(snapshots).select("user_id", "account_id", F.col("statement_date").alias("valid_from"), nxt.alias("valid_until"), F.col("total_value").cast("double").alias("value"))


def market_value() -> Column:
    """In dollars; a converted value of zero counts as missing."""
    return F.coalesce(F.nullif("market_value_usd", F.lit(0)), F.col("market_value"))


def by_class(positions: DataFrame) -> DataFrame:
    """One row per snapshot with the value of each asset class, unknown and null ones together."""
    known = F.when(F.col("asset_class").isin(*ASSET_CLASSES), F.col("asset_class")).otherwise("UNKNOWN")
    sums = [F.sum(F.when(known == c, market_value())).alias(c.lower()) for c in ASSET_CLASSES]
    return positions.groupBy("snapshot_id").agg(*sums)


def _with_classes(snapshots: DataFrame, positions: DataFrame) -> DataFrame:
    names = [c.lower() for c in ASSET_CLASSES]
    zero = F.lit(0).cast("decimal(28,2)")
    joined = snapshots.join(by_class(positions), "snapshot_id", "left")
    return joined.withColumns({n: F.coalesce(n, zero) for n in names})


def asset_classes(snapshots: DataFrame, positions: DataFrame) -> DataFrame:
    """Each user's current value by asset class. What the snapshots report beyond their positions is cash."""
    names = [c.lower() for c in ASSET_CLASSES]
    rows = _with_classes(latest(snapshots), positions)
    sums = rows.groupBy("user_id").agg(F.sum("total_value").alias("total"), *[F.sum(n).alias(n) for n in names])
    held = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    implied = F.greatest(F.col("total") - held, F.lit(0).cast("decimal(28,2)"))
    cols = [(F.col(n) + implied if n == "cash" else F.col(n)).cast("double").alias(n) for n in names]
    return sums.select("user_id", F.col("total").cast("double").alias("total"), *cols)


def asset_class_history(snapshots: DataFrame, positions: DataFrame) -> DataFrame:
    """The same on each date of a snapshot, accounts at their latest snapshot up to then."""
    names = [c.lower() for c in ASSET_CLASSES]
    rows = _carried(_with_classes(one_a_day(snapshots), positions), ["total_value", *names])
    held = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    implied = F.greatest(F.col("total_value") - held, F.lit(0).cast("decimal(28,2)"))
    cols = [(F.col(n) + implied if n == "cash" else F.col(n)).cast("double").alias(n) for n in names]
    return rows.select("user_id", "statement_date", F.col("total_value").cast("double").alias("total"), *cols)


def reconciliation(snapshots: DataFrame, positions: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Whether the positions of each snapshot add up to what it reports, within one per cent (two for some
    providers); a reported zero needs a calculated zero."""
    sums = positions.groupBy("snapshot_id").agg(F.sum(market_value()).alias("calculated"), F.count("*").alias("position_count"))
    rows = snapshots.join(sums, "snapshot_id", "left")
    calculated = F.coalesce("calculated", F.lit(0).cast("decimal(28,2)"))
    diff = F.col("total_value") - calculated
    within = F.abs(diff) <= F.abs(F.col("total_value")) * F.lit(tolerance).cast("decimal(4,2)")
    ok = F.when(F.col("total_value") == 0, calculated == 0).otherwise(within)
    return rows.select("snapshot_id", F.coalesce("position_count", F.lit(0).cast("long")).alias("position_count"), diff.cast("double").alias("difference"), ok.alias("is_reconciled"))


def cash_and_investments(snapshots: DataFrame) -> DataFrame:
    """Each user's cash accounts against all others, and their shares of net worth."""
    rows = latest(snapshots)
    cash = F.coalesce(F.sum(F.when(F.col("account_type").isin(*CASH_TYPES), F.col("total_value"))).cast("double"), F.lit(0.0))
    total = F.sum("total_value").cast("double")
    out = rows.groupBy("user_id").agg(cash.alias("cash"), total.alias("total"))
    part = F.when(F.col("total") > 0, F.col("cash") / F.col("total") * 100).otherwise(F.lit(0.0))
    return out.select("user_id", "cash", (F.col("total") - F.col("cash")).alias("investments"), part.alias("cash_share"))


def snapshot_list(snapshots: DataFrame, positions: DataFrame, account=None, start=None, end=None) -> DataFrame:
    """Snapshots with how many positions they have."""
    rows = snapshots
    for condition in ([F.col("account_id") == account] if account is not None else []) + ([F.col("statement_date") >= F.lit(start)] if start else []) + ([F.col("statement_date") <= F.lit(end)] if end else []):
        rows = rows.where(condition)
    counts = positions.groupBy("snapshot_id").agg(F.count("*").alias("position_count"))
    return rows.join(counts, "snapshot_id", "left").fillna(0, ["position_count"]).select("snapshot_id", "account_id", "statement_date", F.col("total_value").cast("double").alias("total_value"), "position_count")


def recent(points: DataFrame, as_of, months: int | None) -> DataFrame:
    """The last months of a history; all of it for None."""
    return points if months is None else points.where(F.col("statement_date") >= F.add_months(F.lit(as_of), -months))
