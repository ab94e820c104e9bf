"""Amounts and dates written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_money(c: Column, scale: str = "decimal(18,2)") -> Column:
    """``$1,234.50``, ``(12.00)`` and ``-12.00`` as numbers; ``-``, ``--`` and N/A as null; a trailing CR or minus
    turns the sign."""
    t = F.upper(F.trim(c))
    credit = t.rlike(r"(CR|-)$") & ~t.rlike(r"^-+$")
    bare = F.regexp_replace(t, r"[$,\s]|CR$|-$", "")
    inner = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    value = F.when(t.isin("-", "--", "N/A", ""), None).otherwise(inner).try_cast(scale)
    return F.when(credit, -value).otherwise(value)


def parse_european(c: Column, scale: str = "decimal(18,2)") -> Column:
    """``1 234,50`` as a number."""
    return F.replace(F.regexp_replace(F.trim(c), r"[\s .]", ""), F.lit(","), F.lit(".")).try_cast(scale)


def statement_date(month: Column, day: Column, year: Column, statement_month: Column, rolls: bool = True) -> Column:
    """A date from its parts; in statements of the first quarter the last quarter's months are of the year
    before. A day that does not exist gives null."""
    y = F.when((month >= 10) & (statement_month <= 3), year - 1).otherwise(year) if rolls else year
    return F.try_make_date(y, month, day) if hasattr(F, "try_make_date") else F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, month, day), F.lit("yyyy-MM-dd")).cast("date")
