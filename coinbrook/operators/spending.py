"""Spending: summaries by month, year, range, category and merchant, comparisons and trends.

Every function takes transactions (with user_id and account_id) and returns a DataFrame, one set of rows for
each user, whom ``user`` restricts to one. Sums are taken in decimals and turned to doubles last. The effective
amount is the converted one, or the raw one where no rate was found.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective() -> Column:
    return F.coalesce("amount_usd", "amount")


def double(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """part / whole * scale, 0 unless the whole is positive."""
    return F.when(whole > 0, part / whole * scale).otherwise(F.lit(0.0))


def scoped(tx: DataFrame, user=None, account=None, start: dt.date | None = None, end: dt.date | None = None, half_open: bool = False) -> DataFrame:
    """Rows of a user, an account and a range of dates, closed unless ``half_open``."""
    if user is not None:
        tx = tx.where(F.col("user_id") == user)
    if account is not None:
        tx = tx.where(F.col("account_id") == account)
    if start is not None:
        tx = tx.where(F.col("date") >= F.lit(start))
    if end is not None:
        tx = tx.where(F.col("date") < F.lit(end) if half_open else F.col("date") <= F.lit(end))
    return tx


def month_range(year: int, month: int) -> tuple[dt.date, dt.date]:
    """First of the month, first of the next."""
    if not 1 <= month <= 12:
        raise ValueError("month is 1 to 12")
    return dt.date(year, month, 1), dt.date(year + month // 12, month % 12 + 1, 1)


def _total(flag: str, when: Column | None = None) -> Column:
    return F.sum(F.when(F.col(flag) if when is None else F.col(flag) & when, effective()))


def _flows(when: Column | None = None, suffix: str = "") -> list[Column]:
    """total_spend, total_income (the sum's absolute value) and their difference."""
    spend, income = double(_total("is_spend", when)), F.abs(double(_total("is_income", when)))
    return [spend.alias(f"total_spend{suffix}"), income.alias(f"total_income{suffix}"), (income - spend).alias(f"net{suffix}")]


def range_summary(tx: DataFrame, start: dt.date, end: dt.date, user=None, account=None) -> DataFrame:
    """Totals of a closed range, and how many rows it has, in one pass."""
    return scoped(tx, user, account, start, end).groupBy("user_id").agg(*_flows(), F.count("*").alias("transaction_count"))


def monthly_summary(tx: DataFrame, year: int, month: int, user=None, account=None) -> DataFrame:
    return scoped(tx, user, account, *month_range(year, month), half_open=True).groupBy("user_id").agg(*_flows())


def period_categories(tx: DataFrame, start: dt.date, end: dt.date, user=None, account=None, half_open: bool = False) -> DataFrame:
    """Spending by category, as a share of all spending, that without a category included."""
    rows = scoped(tx, user, account, start, end, half_open).where("is_spend")
    by = rows.groupBy("user_id", "category").agg(F.sum(effective()).alias("s"), F.count("*").alias("count"))
    whole = F.sum("s").over(Window.partitionBy("user_id"))
    by = by.withColumn("whole", double(whole)).where(F.col("category").isNotNull())
    return by.select("user_id", "category", double(F.col("s")).alias("amount"), "count", share(double(F.col("s")), F.col("whole")).alias("percentage"))


def _by_month(rows: DataFrame, *keys: Column, sums: dict[str, Column]) -> DataFrame:
    """(user_id, by): for each user a map from the keys, of which there are few, to sums. Rows are summed once, by user
    and keys; what is put together is what that leaves."""
    by = rows.groupBy("user_id", *keys).agg(*[c.alias(k) for k, c in sums.items()])
    names = [c for c in by.columns if c != "user_id" and c not in sums]
    key = F.struct(*names) if len(names) > 1 else F.col(names[0])
    entry = F.struct(key.alias("key"), F.struct(*sums).alias("value"))
    totals = [F.sum(k).alias(f"{k}_all") for k in sums]
    return by.groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("by"), *totals)


def yearly_summary(tx: DataFrame, year: int, user=None, account=None) -> DataFrame:
    """Twelve rows for each user, months without rows at zero, and the year's totals on each."""
    rows = scoped(tx, user, account, dt.date(year, 1, 1), dt.date(year, 12, 31))
    whole = _by_month(rows, F.month("date").alias("month"), sums={"spend": _total("is_spend"), "income": _total("is_income")})
    flows = lambda spend, income, suffix="": [spend.alias(f"total_spend{suffix}"), income.alias(f"total_income{suffix}"), (income - spend).alias(f"net{suffix}")]
    each = whole.select("user_id", "by", "spend_all", "income_all", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    own = F.element_at("by", F.col("month"))
    out = each.select("user_id", *flows(double(F.col("spend_all")), F.abs(double(F.col("income_all"))), "_year"), "month", *flows(double(own["spend"]), F.abs(double(own["income"]))))
    return out.withColumn("avg_monthly_spend", F.col("total_spend_year") / 12)


def category_breakdown(tx: DataFrame, start: dt.date, end: dt.date, user=None, account=None) -> DataFrame:
    """Spending by category over a closed range, as a share of all that has a category."""
    rows = scoped(tx, user, account, start, end).where("is_spend AND category IS NOT NULL")
    by = rows.groupBy("user_id", "category").agg(F.sum(effective()).alias("s"), F.count("*").alias("count"))
    whole = double(F.sum("s").over(Window.partitionBy("user_id")))
    own = double(F.col("s"))
    return by.select("user_id", "category", own.alias("total"), "count", (own / F.col("count")).alias("average"), share(own, whole).alias("percentage"))


def top_merchants(tx: DataFrame, start: dt.date, end: dt.date, user=None, limit: int = 20) -> DataFrame:
    """The merchants of most spending of each user; ties by name."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    rows = scoped(tx, user, None, start, end).where("is_spend AND merchant IS NOT NULL")
    by = rows.groupBy("user_id", "merchant").agg(F.sum(effective()).alias("s"), F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("s"), "merchant"))
    own = double(F.col("s"))
    return by.withColumn("rank", rank).where(F.col("rank") <= limit).select("user_id", "merchant", own.alias("total"), "count", (own / F.col("count")).alias("average"), "rank")


def overview(tx: DataFrame, as_of: dt.date, user=None) -> DataFrame:
    """The month of ``as_of``, and how many rows of all time need a review."""
    start, end = month_range(as_of.year, as_of.month)
    inside = (F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end))
    return scoped(tx, user).groupBy("user_id").agg(*_flows(inside), F.count_if("needs_review").alias("needs_review_count"))


def _change(of: Column, than: Column) -> tuple[Column, Column]:
    return of - than, share(of - than, than)


def _years(*years: int) -> Column:
    """Rows of the years, as ranges of dates that scans can use."""
    out = F.lit(False)
    for y in years:
        out = out | F.col("date").between(F.lit(dt.date(y, 1, 1)), F.lit(dt.date(y, 12, 31)))
    return out


def yoy_year(tx: DataFrame, year: int, than: int, user=None) -> DataFrame:
    """Totals of two years and how spending changed."""
    rows = tx.where(_years(year, than))
    both = scoped(rows, user).groupBy("user_id").agg(*_flows(F.year("date") == year, "_1"), *_flows(F.year("date") == than, "_2"))
    change, pct = _change(F.col("total_spend_1"), F.col("total_spend_2"))
    return both.withColumns({"spend_change": change, "spend_change_pct": pct})


def yoy_year_months(tx: DataFrame, year: int, than: int, user=None) -> DataFrame:
    """Spending of the twelve months of two years side by side."""
    rows = scoped(tx.where(_years(year, than)), user)
    whole = _by_month(rows, F.date_trunc("month", "date").cast("date").alias("first"), sums={"spend": _total("is_spend")})
    each = whole.select("user_id", "by", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    spend = lambda y: double(F.element_at("by", F.make_date(F.lit(y), "month", F.lit(1)))["spend"])
    full = each.select("user_id", "month", spend(year).alias("spend_1"), spend(than).alias("spend_2"))
    change, pct = _change(F.col("spend_1"), F.col("spend_2"))
    return full.withColumns({"change": change, "change_pct": pct, "month_name": F.date_format(F.make_date(F.lit(year), "month", F.lit(1)), "MMMM")})


def yoy_month_categories(tx: DataFrame, year: int, than: int, month: int, user=None) -> DataFrame:
    """Spending by category in the same month of two years: what one of them lacks counts 0. Ranked by how
    much changed, then by name."""
    rows = scoped(tx, user).where((F.month("date") == month) & _years(year, than) & F.col("is_spend") & F.col("category").isNotNull())
    by = rows.groupBy("user_id", "category").agg(*[double(F.sum(F.when(F.year("date") == y, effective()))).alias(f"amount_{i}") for i, y in ((1, year), (2, than))])
    change, pct = _change(F.col("amount_1"), F.col("amount_2"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.abs("change")), "category"))
    return by.withColumns({"change": change, "change_pct": pct}).withColumn("rank", rank)


def spending_velocity(tx: DataFrame, as_of: dt.date, months: int = 12, user=None) -> DataFrame:
    """Means of the last months, the one of ``as_of`` the last, and the least-squares slope of spending."""
    if not 3 <= months <= 36:
        raise ValueError("months is 3 to 36")
    first = F.add_months(F.trunc(F.lit(as_of), "month"), -(months - 1))
    end = F.add_months(F.trunc(F.lit(as_of), "month"), 1)
    rows = scoped(tx, user).where((F.col("date") >= first) & (F.col("date") < end))
    at = (F.year("date") - F.year(first)) * 12 + F.month("date") - F.month(first)
    zero = F.lit(0).cast("decimal(27,2)")
    by = rows.groupBy("user_id", at.cast("long").alias("x")).agg(F.coalesce(_total("is_spend"), zero).alias("y"), F.abs(F.coalesce(_total("is_income"), zero)).alias("i"))
    # months without rows add nothing to the sums; those over x are known
    n, sx = months, months * (months - 1) // 2
    sxx = (months - 1) * months * (2 * months - 1) // 6
    sums = by.groupBy("user_id").agg(F.sum("y").alias("sy"), F.sum("i").alias("si"), F.sum(F.col("y") * F.col("x").cast("decimal(4,0)")).alias("sxy"))
    slope = (F.col("sxy") * n - F.col("sy") * sx).cast("double") / float(n * sxx - sx * sx)
    label = F.when(F.col("slope") > 10, "increasing").when(F.col("slope") < -10, "decreasing").otherwise("stable")
    spend, income = double(F.col("sy")) / n, double(F.col("si")) / n
    return sums.select("user_id", spend.alias("avg_spend"), income.alias("avg_income"), slope.alias("slope")).withColumn("trend", label)


def group_by(tx: DataFrame, key: str, user=None) -> DataFrame:
    """Absolute amounts and counts by merchant, category, type, account or month."""
    keys = {
        "merchant": F.coalesce("merchant", "description_raw", F.lit("Unknown")),
        "category": F.coalesce("category", F.lit("Uncategorized")),
        "type": F.col("transaction_type"),
        "account": F.col("account_id").cast("string"),
        "month": F.date_format("date", "yyyy-MM"),
    }
    return scoped(tx, user).groupBy("user_id", keys[key].alias("key")).agg(double(F.sum(F.abs("amount"))).alias("total"), F.count("*").alias("count"))


def displayed_net(tx: DataFrame, user=None) -> DataFrame:
    return scoped(tx, user).where("is_spend OR is_income").groupBy("user_id").agg((-double(F.sum("amount"))).alias("net"))


def insights(tx: DataFrame, start: dt.date, end: dt.date, user=None) -> DataFrame:
    """Days in the range, spending a day, and what share of income was saved."""
    days = (end - start).days + 1
    rows = range_summary(tx, start, end, user)
    return rows.select("user_id", F.lit(days).alias("days"), (F.col("total_spend") / days).alias("daily_average"), share(F.col("net"), F.col("total_income")).alias("savings_rate"))


def distinct_categories(tx: DataFrame, user=None) -> DataFrame:
    return scoped(tx, user).where(F.col("category").isNotNull()).select("user_id", "category").distinct()


def merchant_count(tx: DataFrame, merchant: str, user=None) -> DataFrame:
    return scoped(tx, user).where(F.col("merchant") == merchant).groupBy("user_id").agg(F.count("*").alias("count"))
