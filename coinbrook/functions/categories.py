"""The categories of each transaction type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ids and names that existing ledgers hold.
CATEGORIES: dict[str, dict[int, str]] = {
    "EXPENSE": {
        2: "Advertising", 58: "Advisory Fee", 1: "ATM/Cash", 3: "Automotive", 4: "Business Miscellaneous", 5: "Cable/Satellite", 6: "Charitable Giving", 7: "Checks",
        8: "Child/Dependent", 9: "Clothing/Shoes", 10: "Dues & Subscriptions", 11: "Education", 12: "Electronics", 13: "Entertainment", 14: "Gasoline/Fuel",
        15: "General Merchandise", 16: "Gifts", 17: "Groceries", 18: "Healthcare/Medical", 19: "Hobbies", 20: "Home Improvement", 21: "Home Maintenance", 22: "Insurance",
        23: "Loans", 24: "Mortgages", 25: "Office Maintenance", 26: "Office Supplies", 27: "Online Services", 28: "Other Bills", 29: "Other Expenses", 30: "Personal Care",
        31: "Pets/Pet Care", 32: "Postage & Shipping", 33: "Printing", 34: "Rent", 35: "Restaurants", 36: "Service Charges/Fees", 37: "Taxes", 38: "Telephone", 39: "Travel",
        40: "Utilities", 41: "Wages Paid",
    },
    "INCOME": {
        42: "Consulting", 43: "Deposits", 68: "Dividends Received", 69: "Dividends Received (tax-advantaged)", 44: "Interest", 45: "Investment Income", 46: "Other Income",
        47: "Paychecks/Salary", 73: "Refunds & Reimbursements", 48: "Retirement Income", 72: "Rewards", 49: "Sales", 50: "Services",
    },
    "TRANSFER": {
        62: "Allocated Excess Cash", 60: "Cash Raised", 65: "Client Request", 51: "Credit Card Payments", 61: "Diversified Transferred-in Securities", 57: "Expense Reimbursement",
        63: "General Rebalance", 66: "Not Traded", 59: "Personal Strategy Implementation", 70: "Portfolio Management", 55: "Retirement Contributions", 52: "Savings",
        53: "Securities Trades", 67: "Strategy Change", 71: "Tax Location", 64: "Tax Loss Harvesting", 54: "Transfers",
    },
    "UNCATEGORIZED": {56: "Uncategorized"},
}


def table(spark: SparkSession) -> DataFrame:
    """(category_id, category, transaction_type)."""
    rows = [(id, name, kind) for kind, names in CATEGORIES.items() for id, name in names.items()]
    return spark.createDataFrame(rows, "category_id int, category string, transaction_type string")


def of_type(spark: SparkSession, kind: str | None) -> DataFrame:
    """The categories of a type; all of them for a type that there is not."""
    known = table(spark)
    return known.where(F.col("transaction_type") == kind) if kind in CATEGORIES else known


def type_of(category: Column) -> Column:
    """The type that a category belongs to, or null."""
    out = F.lit(None).cast("string")
    for kind, names in CATEGORIES.items():
        out = F.when(category.isin(*names.values()), kind).otherwise(out)
    return out
