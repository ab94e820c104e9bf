"""Bank exports in CSV: bank and column roles from the header, amounts by convention, rows numbered by file."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Header columns that tell a bank, in the order in which they are tried: all columns of a set.
BANKS: list[tuple[list[set[str]], str, str]] = [
    ([{"post date", "memo"}], "Chase", "CREDIT_CARD"),
    ([{"extended details"}], "American Express", "CREDIT_CARD"),
    ([{"card no."}, {"card no"}], "Capital One", "CREDIT_CARD"),
    ([{"ref #"}, {"reference number"}], "Wells Fargo", "CREDIT_CARD"),
    ([{"running bal."}, {"running balance"}], "Bank of America", "CHECKING"),
    ([{"ending balance", "transaction id"}], "Ally Bank", "CHECKING"),
    ([{"run date"}, {"trade date"}], "Fidelity", "CREDIT_CARD"),
    ([{"member name"}, {"billing date"}], "Citi", "CREDIT_CARD"),
    ([{"trans. date"}, {"trans date"}], "Discover", "CREDIT_CARD"),
]
# Parts of column names that suggest a role.
ROLES = {
    "date": ["date", "trans", "transaction", "post", "posting"],
    "description": ["description", "merchant", "name", "details", "memo"],
    "amount": ["amount", "total", "sum"],
    "debit": ["debit", "withdrawal", "payment", "charge"],
    "credit": ["credit", "deposit", "income"],
}
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "MM/dd/yy", "MM-dd-yyyy", "MMM d, yyyy", "MMMM d, yyyy"]


@dataclass
class Layout:
    institution: str | None = None
    account_type: str | None = None
    mapping: dict[str, str] = field(default_factory=dict)
    convention: str = "auto"
    confidence: float = 0.0

    def problems(self, columns: list[str]) -> list[str]:
        """What keeps a file from being read."""
        out = [f"Missing required field mapping: {r}" for r in ("date", "description") if r not in self.mapping]
        if self.convention == "debit_credit":
            out += ["Missing debit or credit column mapping"] * (not {"debit", "credit"} <= set(self.mapping))
        elif "amount" not in self.mapping:
            out.append("Missing amount column mapping")
        return out + [f"Mapped column '{c}' not found in CSV" for c in self.mapping.values() if c not in columns]


def bank(columns: list[str]) -> tuple[str | None, str | None]:
    names = {c.lower().strip() for c in columns}
    return next(((b, kind) for sets, b, kind in BANKS if any(s <= names for s in sets)), (None, None))


def as_date(c: Column, formats: list[str] = DATE_FORMATS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def as_number(c: Column) -> Column:
    """A decimal from plain text, null if it is none."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("decimal(15,2)")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the files at ``path`` as text, with source_file and row_index: the row's place in its own
    file. Files are read whole, so that the place is certain; a statement is small, and files spread over tasks."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.regexp_replace("value", "^\\uFEFF", "").alias("value"))
    lines = files.select("source_file", F.posexplode(F.split("value", r"\r?\n")).alias("place", "line")).where(F.trim("line") != "")
    header = lines.where("place = 0").select("line").first()
    if header is None:
        raise ValueError(f"no rows in {path}")
    names = _split(header["line"])
    rows = lines.where("place > 0")
    index = F.row_number().over(Window.partitionBy("source_file").orderBy("place")) - 1
    parsed = F.from_csv("line", ", ".join(f"`c{i}` string" for i in range(len(names))))
    out = rows.select("source_file", index.alias("row_index"), parsed.alias("r"))
    return out.select("source_file", "row_index", *[F.col("r")[f"c{i}"].alias(n) for i, n in enumerate(names)])


def _col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(f"`{name}`")


def _split(line: str) -> list[str]:
    import csv

    return [c.strip() for c in next(csv.reader([line]))]


def detect(rows: DataFrame) -> Layout:
    """The layout of rows read by ``read``: roles by column names, checked on the first values."""
    columns = [c for c in rows.columns if c not in ("source_file", "row_index")]
    out = Layout(*bank(columns))
    named = {r: [c for c in columns if any(k in c.lower() for k in words)] for r, words in ROLES.items()}
    debit, credit = named["debit"], [c for c in named["credit"] if c not in named["debit"]]
    single = [c for c in named["amount"] if c not in debit + credit]
    sample = rows.where("row_index < 20")
    checks = [F.count(_col(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    checks += [F.count_if(_col(c).isNotNull() & as_date(_col(c)).isNull()).alias(f"bad{i}") for i, c in enumerate(columns)]
    checks += [F.coalesce(F.avg(F.length(_col(c))), F.lit(0.0)).alias(f"len{i}") for i, c in enumerate(columns)]
    checks += [F.count_if(as_number(_col(c)).isNotNull()).alias(f"num{i}") for i, c in enumerate(columns)]
    found = sample.agg(*checks).first()
    place = {c: i for i, c in enumerate(columns)}
    scores = []
    dates = [c for c in named["date"] if found[f"n{place[c]}"] and not found[f"bad{place[c]}"]]
    if dates:
        out.mapping["date"] = dates[0]
        scores.append(0.9)
    texts = [c for c in columns if found[f"num{place[c]}"] < found[f"n{place[c]}"]]
    described = named["description"] or ([max(texts, key=lambda c: found[f"len{place[c]}"])] if texts else [])
    if described:
        out.mapping["description"] = described[0]
        scores.append(0.8)
    if len(debit) == 1 and len(credit) == 1:
        out.mapping |= {"debit": debit[0], "credit": credit[0]}
        out.convention = "debit_credit"
        scores.append(0.9)
    elif single:
        out.mapping["amount"] = single[0]
        negative = rows.where(as_number(_col(single[0])) < 0).limit(1).count()
        out.convention = "negative_is_expense" if negative else "positive_is_expense"
        scores.append(0.9)
    out.confidence = sum(scores) / len(scores) if scores else 0.0
    return out


def amounts(layout: Layout) -> tuple[Column, Column]:
    """(amount, is_credit): the absolute amount, and whether it came in, by the layout's convention."""
    m, zero = layout.mapping, F.lit(0).cast("decimal(15,2)")
    if layout.convention == "debit_credit":
        debit, credit = as_number(_col(m["debit"])), as_number(_col(m["credit"]))
        return F.abs(F.coalesce(debit, zero) - F.coalesce(credit, zero)), F.coalesce(credit > 0, F.lit(False))
    value = as_number(_col(m["amount"]))
    return F.abs(value), F.coalesce(value > 0 if layout.convention == "negative_is_expense" else value < 0, F.lit(False))


def parse(rows: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Transactions of the rows: date, description_raw, amount, currency (dollars), is_credit. Rows whose date
    or amount can't be read are left out; the others keep their place."""
    layout = layout or detect(rows)
    if problems := layout.problems(rows.columns):
        raise ValueError("; ".join(problems))
    amount, credit = amounts(layout)
    out = rows.select(
        "source_file", "row_index", as_date(F.trim(_col(layout.mapping["date"]))).alias("date"), F.coalesce(_col(layout.mapping["description"]), F.lit("")).alias("description_raw"),
        amount.cast("decimal(15,2)").alias("amount"), F.lit("USD").alias("currency"), credit.alias("is_credit"),
    )
    return out.where("date IS NOT NULL AND amount IS NOT NULL")
