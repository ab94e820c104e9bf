"""User rules compiled into column expressions.

The first matching rule wins, by priority (lower first), then newest, then id. A user's rules become one ordered
cascade; large sets of literal ones are looked up by their rarest parts (``matched_by_join``, ``counted_by_join``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas

#: Characters of the parts by which literal patterns are looked up where there are many.
GRAM = 3


def ordered(rules: Iterable[dict]) -> list[dict]:
    """Active rules in the order in which they are tried."""
    active = [r for r in rules if r.get("is_active", True)]
    active.sort(key=lambda r: str(r["id"]))
    active.sort(key=lambda r: str(r.get("created_at") or ""), reverse=True)
    active.sort(key=lambda r: r.get("priority", 100))
    return active


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _contains(pattern: str, merchant: str, description: str) -> Column:
    p = F.lower(F.lit(pattern))
    return F.contains(F.lower(_text(merchant)), p) | F.contains(F.lower(_text(description)), p)


def _matches(pattern: str, description: str) -> Column:
    try:
        re.compile(pattern)
    except re.error:  # a broken expression matches nothing
        return F.lit(False)
    return _text(description).rlike(f"(?i){pattern}")


def _number(x, default=None):
    try:
        return default if x is None else float(x)
    except (TypeError, ValueError):
        return default


def predicate(rule: dict, merchant: str = "merchant", description: str = "description_raw", amount: str = "amount") -> Column:
    """What a rule matches: a literal part of merchant or description; a regular expression in the description;
    an inclusive range of amounts; or all of the conditions given. A pattern that can't be read matches
    nothing; overrides match nothing by themselves."""
    kind, pattern = rule["rule_type"], rule.get("pattern") or ""
    value = F.col(amount).cast("double")
    if kind == "MERCHANT_MATCH":
        return _contains(pattern, merchant, description)
    if kind == "DESCRIPTION_REGEX":
        return _matches(pattern, description)
    if kind not in ("AMOUNT_RANGE", "COMPOSITE"):
        return F.lit(False)
    try:
        parts = json.loads(pattern)
        assert isinstance(parts, dict)
    except (ValueError, AssertionError):
        return F.lit(False)
    if kind == "AMOUNT_RANGE":
        out = value >= F.lit(_number(parts.get("min"), 0.0))
        return out & (value <= F.lit(_number(parts["max"]))) if parts.get("max") is not None else out
    out = F.lit(True)
    if parts.get("merchant"):
        out &= _contains(parts["merchant"], merchant, description)
    if parts.get("amount_min") is not None:
        out &= value >= F.lit(_number(parts["amount_min"]))
    if parts.get("amount_max") is not None:
        out &= value <= F.lit(_number(parts["amount_max"]))
    if parts.get("description_regex"):
        out &= _matches(parts["description_regex"], description)
    return out


def matched(tx: DataFrame, rules: Iterable[dict], to: str = "matched_rule_id") -> DataFrame:
    """Adds the id of the first rule that matches, or null."""
    rules = ordered(rules)
    if not rules:
        return tx.withColumn(to, F.lit(None).cast("string"))
    return tx.withColumn(to, F.coalesce(*[F.when(F.coalesce(predicate(r), F.lit(False)), F.lit(str(r["id"]))) for r in rules]))


def actions(spark, rules: Iterable[dict]) -> DataFrame:
    """Rules' actions as a table; a JSON null counts as absent."""
    rows = [(str(r["id"]), r["action"] if isinstance(r.get("action"), str) else json.dumps(r.get("action") or {})) for r in rules]
    table = spark.createDataFrame(rows, "matched_rule_id string, action string")
    return table.select("matched_rule_id", F.from_json("action", schemas.ACTION).alias("action"))


def applied(tx: DataFrame, rules: list[dict], keep_flags: bool = False) -> DataFrame:
    """Matches rules and sets type, category, subcategory, tags and flags from the matching one's action. Flags
    follow the type unless ``keep_flags`` lets an action set its own."""
    out = matched(tx, rules)
    for name, kind in (("subcategory", "string"), ("tags", "array<string>"), ("classification_method", "string"), ("confidence", "double")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    out = out.join(F.broadcast(actions(tx.sparkSession, rules)), "matched_rule_id", "left")  # one row per rule
    hit = F.col("matched_rule_id").isNotNull()
    new = {c: F.coalesce(F.col("action")[c], F.col(c)) for c in ("transaction_type", "category", "subcategory", "tags")}
    out = out.withColumns(new | {
        "classification_method": F.when(hit, "RULE").otherwise(F.col("classification_method")),
        "confidence": F.when(hit, F.lit(1.0)).otherwise(F.col("confidence")),
        "needs_review": F.when(hit, F.lit(False)).otherwise(F.col("needs_review")),
    })
    typed = {"is_spend": F.col("transaction_type") == "EXPENSE", "is_income": F.col("transaction_type") == "INCOME"}
    flags = {c: F.when(hit, F.coalesce(F.col("action")[c], t) if keep_flags else t).otherwise(F.col(c)) for c, t in typed.items()}
    return out.withColumns(flags).drop("action")


def match_counts(tx: DataFrame, rules: list[dict]) -> DataFrame:
    """How many rows each active rule matches by itself, in one pass."""
    rules = ordered(rules)
    counts = tx.agg(*[F.count_if(predicate(r)).alias(f"r{i}") for i, r in enumerate(rules)])
    pairs = F.array(*[F.struct(F.lit(str(r["id"])).alias("rule_id"), F.col(f"r{i}").alias("match_count")) for i, r in enumerate(rules)])
    return counts.select(F.inline(pairs))


def _grams(text: Column, size: Column) -> Column:
    """The different parts of ``size`` characters of a text; the empty one alone for a size of 0."""
    last = F.length(text) - size + 1
    parts = F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, size))
    return F.when(size == 0, F.array(F.lit(""))).when(last >= 1, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def pattern_matches(texts: DataFrame, patterns: DataFrame, text: list[str], key: str) -> DataFrame:
    """For large sets of literal patterns (user_id, pattern; in lower case, each once): each of the distinct ``texts``
    (user_id, the columns ``text`` in lower case, and a hash ``key`` of these) with each of its user's patterns that one
    of the columns contains. Texts of equal hashes stay together, and are compared each for itself.

    Every pattern is looked up by one of its parts of GRAM characters (all of it, if it is shorter), the one that fewest
    texts of the user have; only texts that have it are searched for the pattern. Both sides are dealt by user and part,
    and a pattern of frequent parts only is one that matches many texts.
    """
    wanted = patterns.select("user_id", "pattern", F.least(F.length("pattern"), F.lit(GRAM)).alias("size"))
    sizes = F.array(*[F.lit(n) for n in range(GRAM + 1)])
    gram = lambda t: F.flatten(F.transform(sizes, lambda n: F.flatten(F.array(*[_grams(t[c], n) for c in text]))))
    others = [c for c in texts.columns if c not in ("user_id", key)]
    held = texts.groupBy("user_id", key).agg(F.collect_list(F.struct(*others)).alias("same"))
    index = held.select("user_id", key, F.explode(F.array_distinct(F.flatten(F.transform("same", gram)))).alias("gram"))
    keyed = wanted.withColumn("gram", F.explode(_grams(F.col("pattern"), F.col("size"))))
    often = index.join(keyed.select("user_id", "gram").distinct(), ["user_id", "gram"]).groupBy("user_id", "gram").agg(F.count("*").alias("texts"))
    rarest = keyed.join(often, ["user_id", "gram"]).groupBy("user_id", "pattern").agg(F.min(F.struct("texts", "gram"))["gram"].alias("gram"), F.count("*").alias("found"), F.first("size").alias("size"))
    # a pattern with a part that no text has matches nothing
    rarest = rarest.where(F.col("found") == F.size(_grams(F.col("pattern"), F.col("size")))).select("user_id", "pattern", "gram")
    candidates = index.join(rarest, ["user_id", "gram"]).select("user_id", key, "pattern")  # a pattern has one part
    each = candidates.join(held, ["user_id", key]).select("user_id", key, "pattern", F.inline("same"))
    found = None
    for c in text:
        found = F.contains(c, "pattern") if found is None else found | F.contains(c, "pattern")
    return each.where(found).select(*texts.columns, "pattern")


def _distinct_texts(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their texts, the distinct texts and how many rows have each); a text is told by a hash, of which equal
    ones only cost a comparison more."""
    rows = tx.withColumns({"__merchant": F.lower(_text("merchant")), "__description": F.lower(_text("description_raw"))})
    texts = rows.groupBy("user_id", "__merchant", "__description").agg(F.count("*").alias("__rows"))
    return rows, texts.withColumn("__hash", F.xxhash64("__merchant", "__description"))


def _by_pattern(patterns: DataFrame, *columns: Column) -> DataFrame:
    """(user_id, pattern in lower case, ``columns``) of the rules that have a pattern."""
    return patterns.select("user_id", F.lower("pattern").alias("pattern"), *columns).where("pattern IS NOT NULL")


def matched_by_join(tx: DataFrame, id: str, patterns: DataFrame) -> DataFrame:
    """For large sets of literal rules (user_id, rule_id, pattern, priority): the first match of each row, rows
    without one left out. Each distinct pair of merchant and description of a user is looked up once, and so is each
    distinct pattern."""
    key = ["user_id", "__merchant", "__description"]
    rows, texts = _distinct_texts(tx)
    best = _by_pattern(patterns, F.struct("priority", "rule_id").alias("best")).groupBy("user_id", "pattern").agg(F.min("best").alias("best"))
    found = pattern_matches(texts, best, key[1:], "__hash")
    first = found.join(best, ["user_id", "pattern"]).groupBy(*key).agg(F.min("best").alias("__first"))
    return rows.join(first, key).select(*tx.columns, F.col("__first.rule_id").alias("rule_id"), F.col("__first.priority").alias("priority"))


def counted_by_join(tx: DataFrame, patterns: DataFrame) -> DataFrame:
    """For large sets of literal rules (user_id, rule_id, pattern): (user_id, rule_id, match_count), how many of its
    user's rows each matches by itself, none included."""
    _, texts = _distinct_texts(tx)
    rules = _by_pattern(patterns, F.col("rule_id"))
    found = pattern_matches(texts, rules.select("user_id", "pattern").distinct(), ["__merchant", "__description"], "__hash").groupBy("user_id", "pattern").agg(F.sum("__rows").alias("n"))
    counts = rules.join(found, ["user_id", "pattern"]).groupBy("user_id", "rule_id").agg(F.sum("n").alias("n"))
    return patterns.select("user_id", "rule_id").join(counts, ["user_id", "rule_id"], "left").select("user_id", "rule_id", F.coalesce("n", F.lit(0)).alias("match_count"))
