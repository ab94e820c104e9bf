"""Reports and exports as plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import spending


def export_rows(tx: DataFrame) -> DataFrame:
    """Transactions as an export shows them, in its thirteen columns: text only, booleans as Yes and No, nulls empty,
    tags joined. Columns that ``tx`` lacks are empty."""
    yes = lambda c: F.when(F.col(c), "Yes").otherwise("No")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in tx.columns else F.lit("")
    amount = F.when(F.coalesce(F.col("amount"), F.lit(0)) == 0, "0").otherwise(F.col("amount").cast("string"))
    out = {
        "Date": F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")), "Description": text("description_raw"), "Merchant": text("merchant"), "Amount": amount,
        "Type": text("transaction_type"), "Category": text("category"), "Subcategory": text("subcategory"), "Is Spend": yes("is_spend"), "Is Income": yes("is_income"),
        "Classification Method": text("classification_method"), "Account ID": text("account_id"),
        "Tags": F.coalesce(F.array_join("tags", ","), F.lit("")) if "tags" in tx.columns else F.lit(""), "Notes": text("user_note"),
    }
    return tx.select(*[c.alias(n) for n, c in out.items()])


def summary_lines(tx: DataFrame, start, end, user) -> DataFrame:
    """The summary block of a report: (line, label, value)."""
    s = spending.range_summary(tx, start, end, user)
    rows = [("Total Spend", "total_spend"), ("Total Income", "total_income"), ("Net", "net")]
    return s.select(F.inline(F.array(*[F.struct(F.lit(i).alias("line"), F.lit(n).alias("label"), F.format_string("$%.2f", c).alias("value")) for i, (n, c) in enumerate(rows, 1)])))


def category_lines(tx: DataFrame, start, end, user, limit: int | None = None) -> DataFrame:
    """The categories of a report, most spending first; the printed one shows fifteen."""
    by = spending.period_categories(tx, start, end, user).orderBy(F.desc("amount"), "category")
    by = by.limit(limit) if limit else by
    return by.select("category", F.format_string("$%.2f", "amount").alias("amount"), "count", F.format_string("%.1f%%", "percentage").alias("share"))


def transaction_lines(tx: DataFrame, start, end, user) -> DataFrame:
    """The transactions of a report, newest first, descriptions cut to fifty characters."""
    rows = spending.scoped(tx, user, None, start, end).orderBy(F.desc("date"), "description_raw", "amount")
    return rows.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.substring("description_raw", 1, 50).alias("description"), F.coalesce("category", F.lit("")).alias("category"), F.format_string("$%.2f", F.col("amount").cast("double")).alias("amount"), "transaction_type")


def workbook(tx: DataFrame, start, end, user, year: int) -> dict[str, DataFrame]:
    """The four sheets of a spreadsheet report."""
    return {"Summary": summary_lines(tx, start, end, user), "Categories": category_lines(tx, start, end, user), "Transactions": transaction_lines(tx, start, end, user), "Monthly Trends": spending.yearly_summary(tx, year, user)}


def write_csv(tables: list[DataFrame], path: str) -> None:
    """The sections of a CSV report, each in a numbered folder."""
    for i, t in enumerate(tables, 1):
        t.write.mode("overwrite").option("header", True).csv(f"{path}/{i:02d}")
