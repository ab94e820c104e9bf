"""Upkeep where SQL says nothing: faults, refusals, odd rows."""

import pytest

from coinbrook.functions import categories
from coinbrook.operators import dedup, rules, upkeep
from coinbrook.sources import statements


def test_pattern_faults():
    good = [("DESCRIPTION_REGEX", "^a+$"), ("AMOUNT_RANGE", '{"max": 3}'), ("MERCHANT_MATCH", "(["), ("COMPOSITE", "x")]
    bad = [("DESCRIPTION_REGEX", "(["), ("AMOUNT_RANGE", "min"), ("AMOUNT_RANGE", "[1]"), ("AMOUNT_RANGE", "{}")]
    assert not any(upkeep.pattern_fault(*p) for p in good) and all(upkeep.pattern_fault(*p) for p in bad)


def test_categories_hold_each_id_once():
    ids = [i for names in categories.CATEGORIES.values() for i in names]
    assert sorted(ids) == list(range(1, 74)) and len({n for names in categories.CATEGORIES.values() for n in names.values()}) == 73


def test_categories_of_type(spark):
    assert categories.of_type(spark, "INCOME").count() == 13 and categories.of_type(spark, "NO SUCH").count() == 73


def test_bulk_update_is_all_or_nothing(spark):
    old = spark.createDataFrame([(1, 7, "A", "LEARNED"), (2, 8, "A", "LEARNED")], "id int, user_id int, category string, classification_method string")
    ask = lambda *ids: spark.createDataFrame([(i, "B") for i in ids], "id int, category string")
    assert {(r.id, r.category, r.classification_method) for r in upkeep.bulk_update(old, ask(1), 7).collect()} == {(1, "B", "MANUAL"), (2, "A", "LEARNED")}
    for ids in ((1, 2), (1, 1), (9,)):
        with pytest.raises(ValueError):
            upkeep.bulk_update(old, ask(*ids), 7)


def test_apply_one_needs_a_rule(spark):
    with pytest.raises(ValueError):
        upkeep.apply_one(spark.range(1), [], "r1", spark.range(1), None)


def test_equal_rows_are_one_class(spark):
    rows = [(i, "2025-01-01", "5.00", "SHOP *1") for i in range(300)] + [(900, "2025-01-03", "5.01", "shop 1"), (901, "2025-01-05", "5.00", "shop 1"), (902, "2025-02-01", "5.00", "shop 1"), (903, "2025-01-01", None, None)]
    tx = spark.createDataFrame(rows, "id int, date string, amount string, description_raw string").selectExpr("id", "cast(date AS date) date", "cast(amount AS decimal(15,2)) amount", "description_raw")
    got = {r.id: (r.class_id, r.links) for r in dedup.near_duplicates(tx).collect()}
    assert got == {i: (0, 300) for i in range(300)} | {900: (900, 301), 901: (901, 1)}
    assert {r.class_id: r.rows for r in dedup.near_classes(tx).collect()} == {0: 300, 900: 1, 901: 1}


def test_many_rules_join_by_distinct_texts(spark):
    tx = spark.createDataFrame([(1, 1, "Coffee Bar", None), (2, 1, None, "BAR TAB"), (3, 2, "Bar", "x"), (4, 1, None, None)], "id int, user_id int, merchant string, description_raw string")
    patterns = spark.createDataFrame([(1, "a", "bar", 5), (1, "b", "COFFEE", 1), (1, "c", "bar", 5)], "user_id int, rule_id string, pattern string, priority int")
    assert {(r.id, r.rule_id) for r in rules.matched_by_join(tx, "id", patterns).collect()} == {(1, "b"), (2, "a")}


def test_balances_of_odd_statements(spark):
    texts = [("a", None), ("b", "Chase Savings 0001 5.00 6.00"), ("c", "January 1, 2025 through Smarch 31, 2025\nchase total checking 99 0001234 $1,000.00 2.50")]
    got = {tuple(r) for r in statements.chase_balances(spark.createDataFrame(texts, "source_file string, text string")).selectExpr("source_file", "statement_date", "account", "last4", "cast(ending AS string)").collect()}
    assert got == {("b", None, "savings", "0001", "6.00")}
    assert [r[0] for r in spark.createDataFrame([("see u.s. bank",), ("nothing",), (None,)], "t string").select(statements.institution(statements.F.col("t"))).collect()] == ["US Bank", None, None]
