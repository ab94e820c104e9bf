"""Schemas of the ledger's tables, and the values their enumerations take."""

from __future__ import annotations

from pyspark.sql import types as T

# They must equal what existing ledgers hold.
TRANSACTION_TYPES = ["EXPENSE", "INCOME", "TRANSFER", "UNCATEGORIZED"]
METHODS = ["RULE", "LLM", "MANUAL", "DEFAULT", "LEARNED"]
RULE_TYPES = ["MERCHANT_MATCH", "DESCRIPTION_REGEX", "AMOUNT_RANGE", "CATEGORY_OVERRIDE", "COMPOSITE"]
ASSET_CLASSES = ["EQUITY", "FIXED_INCOME", "CASH", "ALTERNATIVE", "UNKNOWN"]
BANK_TYPES = ["CHECKING", "SAVINGS", "CREDIT_CARD"]
BROKERAGE_TYPES = ["BROKERAGE", "IRA_ROTH", "IRA_TRADITIONAL", "RETIREMENT_401K", "STOCK_PLAN"]
CASH_TYPES = ["CHECKING", "SAVINGS", "CASH", "DIGITAL_WALLET"]

_KINDS = {
    "str": T.StringType(),
    "int": T.IntegerType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "ts": T.TimestampNTZType(),
    "money": T.DecimalType(15, 2),
    "value": T.DecimalType(18, 2),
    "rate": T.DecimalType(18, 8),
    "share": T.DecimalType(3, 2),
    "quantity": T.DecimalType(18, 6),
    "price": T.DecimalType(18, 4),
    "double": T.DoubleType(),
    "tags": T.ArrayType(T.StringType()),
    "cash": T.MapType(T.StringType(), T.DecimalType(18, 2)),
}


def _schema(**columns: str) -> T.StructType:
    """``kind="name name ..."`` in the order given; kinds as in _KINDS."""
    return T.StructType([T.StructField(n, _KINDS[kind.rstrip("_0123456789")]) for kind, names in columns.items() for n in names.split()])


ACTION = _schema(str="transaction_type category subcategory", bool="is_spend is_income", tags="tags")

TABLES = {
    "accounts": _schema(str="id user_id name institution account_type account_number_last4 account_number_hash currency", bool="is_active", ts="created_at updated_at"),
    "transactions": _schema(
        str="id account_id import_id hash_dedup_key description_raw merchant_normalized currency transaction_type category subcategory fx_rate_source matched_rule_id classification_method user_note metadata",
        date="date post_date fx_rate_date",
        money="amount amount_usd",
        rate="fx_rate_used",
        share="confidence",
        bool="is_spend is_income needs_review",
        tags="tags",
        ts="reviewed_at created_at updated_at",
    ),
    "import_records": _schema(str="id account_id user_id source_type filename file_hash status error_message metadata", int="file_size_bytes transactions_imported transactions_duplicate", ts="created_at completed_at"),
    "rules": _schema(str="id user_id rule_type pattern name description action", int="priority match_count", bool="is_active", ts="created_at updated_at last_matched_at"),
    "merchant_categories": _schema(str="id user_id merchant_normalized category source", double="confidence", int="times_applied", ts="created_at updated_at"),
    "holdings_snapshots": _schema(
        str="id account_id import_id base_currency currency source_file_hash metadata",
        date="statement_date statement_start_date",
        value="total_value total_cash total_securities calculated_total reconciliation_diff",
        bool="is_reconciled",
        cash="cash_balances",
    ),
    "positions": _schema(
        str="id snapshot_id symbol cusip security_name security_type asset_class currency",
        quantity="quantity",
        price="price",
        value="market_value cost_basis market_value_usd",
        rate="fx_rate_used",
        bool="is_vested",
        date="vesting_date",
        int="row_index",
    ),
    "fx_rates": _schema(str="id snapshot_id from_currency to_currency source", rate="rate", date="rate_date"),
}
