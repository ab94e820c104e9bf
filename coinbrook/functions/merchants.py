"""Merchants' names from the descriptions that banks print: what varies between visits is taken out.

Each bank has a list of (pattern, replacement) applied in order. The lists are kept short and general; a user's
own patterns, such as the cities of a region, come as a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in the order in which they are applied.
_PHONE = (r"\b\d{3}[-\s]?\d{3}[-\s]?\d{4}\b", "")
_LONG = (r"\b\d{10,}\b", "")
_STATE = (r"\s+[A-Z]{2}\s*$", "")
_BLANKS = (r"\s+", " ")
CLEANERS: dict[str, list[tuple[str, str]]] = {
    "amex": [(r"https?://\S+", ""), (r"\S+\.com\S*", ""), (r"\S+\.net\S*", ""), _LONG, _PHONE, _STATE],
    "chase": [(r"\*[A-Z0-9]+", ""), (r"\s+\S+\.com/\S*", ""), _PHONE, _LONG, _STATE, (r"\.com\b", "")],
    "wells_fargo": [
        (r"^\d{9,}\s+", ""), (r"^[A-Z0-9]{14,}\s+", ""), (r"(?i)^(TST|SQ|BPS|GDP)\s*\*\s*", ""), (r"(?i)^UBER\s*\*\s*", "UBER "), (r"\*[A-Z0-9]+", ""),
        (r"(?i)\s*\S+\.COM/\S*", ""), (r"(?i)\.COM\b", ""), _PHONE, _LONG, (r"#\d+", ""), (r"(?i)\s+Store\s+\d+", ""), (r"(?i)\s+LLC?(\s+|$)", " "), (r"(?i)\s+[A-Z]+\s+[A-Z]{2}\s*$", ""), _STATE,
    ],
    "capital_one": [(r"(?i)^SQ\s*\*\s*", ""), (r"(?i)^GOOGLE\s*\*", "Google "), (r"#\d+", ""), (r"\d{3}-\d{3}-\d{4}", ""), (r"\d{6,}", ""), (r"\s*\d+\s*$", ""), (r"(?i)\.COM\s*$", "")],
    "boa": [(r"\s+\d{4}\s+\d{4}$", ""), (r"\s*\d{3}[-.]?\d{3}[-.]?\d{4}\s*", " "), (r"\s+[A-Z]{2}$", "")],
    "chase_bank": [(r"(?i)\s*(PPD|Web) ID:\s*\d+\s*$", ""), (r"\s+[A-Za-z]+\d+[A-Za-z0-9]*\s*$", ""), (r"(?i)\s+(ACH Pmt|Auto Pay|Crcardpmt|Auto EFT|Online Pmt)\s*$", "")],
    "generic": [_PHONE, (r"\b\d{10}\b", ""), _STATE],
}


def clean(description: Column, bank: str = "generic", more: list[tuple[str, str]] = ()) -> Column:
    """The merchant's name; the description itself if nothing would be left."""
    out = description
    for pattern, by in [*CLEANERS[bank], *more, _BLANKS]:
        out = F.regexp_replace(out, pattern, by)
    out = F.trim(out)
    return F.when(out == "", description).otherwise(out)


def first_words(text: Column) -> Column:
    """A text without words that it had before, whatever their case."""
    words = F.split(text, r"\s+")
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(w)), acc).otherwise(F.concat(acc, F.array(w))))
    return F.array_join(kept, " ")
