"""Holdings from single lines of brokerage statements, whatever stands around them; ``holdings`` reads whole statements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_european, parse_money
from .holdings import account_type, provider  # noqa: F401 - the same for both
from .statements import lines

# Words in a security's name that decide its class, in the order in which they are tried.
CLASSES = [
    ("CASH", r"(?i)money market|bank sweep|cash|treasury only"),
    ("FIXED_INCOME", r"(?i)bond|treasur|fixed income|municipal|\btips\b"),
    ("ALTERNATIVE", r"(?i)reit|real estate|commodit|gold|crypto"),
    ("EQUITY", r"(?i)stock|equity|etf|fund|index|inc\b|corp\b|ltd\b|trust"),
]
_N = r"-?\(?\$?[\d,]+(?:\.\d+)?\)?"


@dataclass
class Holding:
    """A line's pattern and which group is what; ``most_value`` and ``most_quantity`` bound what is credible."""

    pattern: str
    name: int
    quantity: int
    price: int
    value: int
    symbol: int = 0
    section: tuple[str, str] | None = None
    most_value: float | None = None
    most_quantity: float | None = None
    european: bool = False


# The holdings' lines of each provider.
HOLDINGS = {
    "wealthfront": Holding(rf"^(.+?)\s+([A-Z]{{1,5}}|[0-9A-Z]{{9}})\s+({_N})\s+({_N})\s+({_N})$", 1, 3, 4, 5, symbol=2, most_value=1e7, most_quantity=1e6),
    "ibkr": Holding(rf"^([A-Z.]+)\s+({_N})\s+\d+\s+{_N}\s+{_N}\s+({_N})\s+({_N})$", 1, 2, 3, 4, symbol=1),
    "schwab": Holding(rf"^([A-Z]{{1,5}})\s+(.+?)\s+({_N})\s+({_N})\s+({_N})$", 2, 3, 4, 5, symbol=1),
    "fidelity": Holding(rf"^(.+?)\s+\(([A-Z]{{1,5}})\)\s+({_N})\s+({_N})\s+({_N})$", 1, 3, 4, 5, symbol=2),
    "vanguard": Holding(rf"^(.+?(?:Fund|Trust|Index).*?)\s+({_N})\s+({_N})\s+({_N})$", 1, 2, 3, 4),
    "equatex": Holding(r"^(.+?)\s+([\d ]+(?:,\d+)?)\s+([\d ]+,\d{2})\s+[A-Z]{3}\s+([\d ]+,\d{2})$", 1, 2, 3, 4, european=True),
}


def _ordered(text: Column, choices, otherwise: str) -> Column:
    out = None
    for value, pattern in choices:
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out.otherwise(otherwise)


def asset_class(name: Column) -> Column:
    return _ordered(name, CLASSES, "UNKNOWN")


def security_type(name: Column) -> Column:
    return _ordered(name, [("ETF", r"(?i)\betf\b"), ("MUTUAL_FUND", r"(?i)fund|admiral|index"), ("BOND", r"(?i)bond|treasur"), ("CASH", r"(?i)money market|sweep|cash")], "STOCK")


def positions(statements: DataFrame, name: str, currency: str = "USD", rates: dict[str, float] | None = None) -> DataFrame:
    """Holdings of one provider's statements: symbol, security_name, quantity, price, market_value, currency,
    market_value_usd (at a rate of 1 where none is given), asset_class, security_type. A line's currency is the last one that stood
    alone on a line before it."""
    from pyspark.sql import Window

    form = HOLDINGS[name]
    money = parse_european if form.european else parse_money
    before = Window.partitionBy("source_file").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alone = F.when(F.col("line").rlike("^[A-Z]{3}$"), F.col("line"))
    rows = lines(statements).withColumn("currency", F.coalesce(F.last(alone, ignorenulls=True).over(before), F.lit(currency))).where(F.col("line").rlike(form.pattern))
    part = lambda i: F.regexp_extract("line", form.pattern, i)
    security = F.trim(part(form.name))
    out = rows.select(
        "source_file", "place", "currency", (part(form.symbol) if form.symbol else F.lit(None).cast("string")).alias("symbol"), security.alias("security_name"), money(part(form.quantity), "decimal(18,6)").alias("quantity"),
        money(part(form.price), "decimal(18,4)").alias("price"), money(part(form.value)).alias("market_value"), asset_class(security).alias("asset_class"), security_type(security).alias("security_type"),
    ).where("market_value IS NOT NULL AND quantity IS NOT NULL")
    if form.most_value:
        out = out.where((F.col("market_value") <= form.most_value) & (F.col("quantity") <= form.most_quantity))
    rate = F.lit(1.0)
    for code, value in (rates or {}).items():
        rate = F.when(F.col("currency") == code, F.lit(float(value))).otherwise(rate)
    return out.withColumn("market_value_usd", F.round(F.col("market_value") * rate.cast("decimal(18,8)"), 2).cast("decimal(18,2)"))


def split_accounts(statements: DataFrame, header: str) -> DataFrame:
    """Statements of several accounts as one per account, cut before each match of ``header``."""
    parts = F.filter(F.split("text", f"(?={header})"), lambda x: x.rlike(header))
    return statements.select(F.col("source_file"), F.posexplode(parts).alias("part", "text")).select(F.concat_ws("#", "source_file", "part").alias("source_file"), "text")
