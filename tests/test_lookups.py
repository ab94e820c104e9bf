"""Rules by their rarest parts, keywords in one scan, and totals kept up by a stream, each against plain Python."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from coinbrook.functions import classify
from coinbrook.operators import lists, rules, spending, upkeep
from coinbrook.streaming import inbox


@pytest.mark.parametrize("seed", range(3))
def test_rules_by_parts(spark, seed):
    """Patterns of every length, empty ones, ones that no text has, null texts, two users."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abAB .*é🙂") for _ in range(n))
    tx = [(i, rng.randrange(2), rng.choice([None, word(rng.randrange(6))]), rng.choice([None, "", word(rng.randrange(12))])) for i in range(120)]
    patterns = [(rng.randrange(2), k, rng.choice([word(rng.randrange(6)), "zzz", "a", None]) if k else "", rng.randrange(4)) for k in range(50)]
    df = spark.createDataFrame(tx, "id long, user_id int, merchant string, description_raw string")
    given = spark.createDataFrame(patterns, "user_id int, rule_id int, pattern string, priority int")
    hit = lambda p, m, d: p is not None and (p.lower() in (m or "").lower() or p.lower() in (d or "").lower())
    want = {}
    for i, user, m, d in tx:
        found = [(priority, k) for u, k, p, priority in patterns if u == user and hit(p, m, d)]
        if found:
            want[i] = min(found)[::-1]
    got = {r["id"]: (r["rule_id"], r["priority"]) for r in rules.matched_by_join(df, "id", given).collect()}
    assert got == want
    counts = {r["rule_id"]: r["match_count"] for r in rules.counted_by_join(df, given).collect()}
    assert counts == {k: sum(u == user and hit(p, m, d) for _, user, m, d in tx) for u, k, p, _ in patterns}
    assert rules.matched_by_join(df, "id", given.limit(0)).count() == 0 and rules.counted_by_join(df.limit(0), given).where("match_count > 0").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_keywords_in_one_scan(spark, seed):
    """Keywords that begin with others, that stand in others, that overlap, that several blocks have."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("AB*(+ ") for _ in range(n))
    blocks = [(f"c{k}", [word(rng.randrange(1, 5)) for _ in range(4)]) for k in range(6)] + [("plain", ["CAR WASH", "WASH", "CAR"])]
    if seed == 3:
        blocks.insert(3, ("all", ["", "Q"]))
    texts = [word(rng.randrange(0, 9)) for _ in range(200)] + ["A CAR WASH", "SCAR", "", "XYZ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", classify.keyword_category(F.col("t"), blocks).alias("c")).collect()}
    assert got == {i: next((c for c, words in blocks if any(w in t for w in words)), "Other Expenses") for i, t in enumerate(texts)}


def test_default_keywords_as_a_cascade(spark):
    texts = [f"{a}{w}{b}" for _, words in classify.KEYWORDS for w in words for a, b in (("", ""), ("X ", "ING"))]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(classify.keyword_category(F.col("t"))).collect()]
    assert got == [next(c for c, words in classify.KEYWORDS if any(w in t for w in words)) for t in texts]


def test_stream_counts_a_repeated_batch_once(spark, tmp_path):
    schema = "ts timestamp, event_type string, value decimal(15,2)"
    day = dt.datetime(2025, 1, 1, 12)
    put = lambda rows: spark.createDataFrame([(t, k, Decimal(v)) for t, k, v in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(day, "x", 1), (day, "y", 2), (day + dt.timedelta(days=1), "x", 3)])
    put([(day, "x", 4)])
    run = lambda: inbox.totals(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    read = lambda: sorted((str(r["start"])[:10], r["event_type"], float(r["total"]), r["events"]) for r in inbox.latest_totals(spark, str(tmp_path / "out")).collect())
    run()
    want = [("2025-01-01", "x", 5.0, 2), ("2025-01-01", "y", 2.0, 1), ("2025-01-02", "x", 3.0, 1)]
    assert read() == want
    commits = sorted((int(n) for n in os.listdir(tmp_path / "cp" / "commits") if n.isdigit()))
    for n in os.listdir(tmp_path / "cp" / "commits"):  # as if the driver was lost before the last batch was marked done
        if n.strip(".crc") == str(commits[-1]):
            os.remove(tmp_path / "cp" / "commits" / n)
    run()
    assert read() == want
    put([(day + dt.timedelta(days=1), "x", 10), (day - dt.timedelta(days=300), "x", 99)])  # the last is too late
    run()
    assert read() == [*want[:2], ("2025-01-02", "x", 13.0, 2)]


def test_balances_of_another_user(spark):
    balances = spark.createDataFrame([(1, "B", "Spending", "0001"), (2, "B", "spending", "0001"), (None, "B", "spending", "0001")], "user_id int, institution string, account string, last4 string")
    accounts = spark.createDataFrame([(7, 1, "B", "CHECKING", "0001"), (5, 1, "B", "CHECKING", "0001"), (3, 3, "B", "CHECKING", "0001")], "account_id int, user_id int, institution string, account_type string, last4 string")
    assert {(r["user_id"], r["account_id"]) for r in upkeep.balance_accounts(balances, accounts).collect()} == {(1, 5), (2, None), (None, None)}


def test_merchants_last_updated_first(spark):
    rows = [("b", 1, 1), ("a", 1, 1), ("c", 1, 2), ("d", 2, 0)]
    df = spark.createDataFrame(rows, "merchant_normalized string, times_applied int, updated_at int")
    assert [r["merchant_normalized"] for r in lists.page(df, upkeep.merchant_order("updated_at"), 1, 9).collect()] == ["d", "c", "a", "b"]


def test_yearly_plans_sum_rows_once(spark):
    """The rows are summed by user and month; what follows only sees those sums."""
    df = spark.createDataFrame([(1, 1, dt.date(2025, 3, 1), True, False, 5, None)], "user_id int, account_id int, date date, is_spend boolean, is_income boolean, amount int, amount_usd int")
    for out in (spending.yearly_summary(df, 2025), spending.yoy_year_months(df, 2025, 2024)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sum(") <= 8 and out.count() == 12


def test_rules_of_one_pattern_are_looked_up_once(spark, monkeypatch):
    """Many rules of a user that look for the same text cost one lookup; a rule given twice counts as in SQL."""
    df = spark.createDataFrame([(1, 1, "Shop", "at the shop"), (2, 1, "Café", "bar"), (3, 2, "Shop", "x")], "id int, user_id int, merchant string, description_raw string")
    given = spark.createDataFrame([(1, f"r{i:03}", "SHOP" if i % 2 else "shop", 100 - i) for i in range(40)] + [(2, "a", "shop", 1), (2, "a", "shop", 1), (2, "b", None, 0)], "user_id int, rule_id string, pattern string, priority int")
    asked, real = [], rules.pattern_matches

    def counted(texts, patterns, *rest):
        asked.append(patterns.count())
        return real(texts, patterns, *rest)

    monkeypatch.setattr(rules, "pattern_matches", counted)
    assert {(r["id"], r["rule_id"], r["priority"]) for r in rules.matched_by_join(df, "id", given).collect()} == {(1, "r039", 61), (3, "a", 1)}
    counts = [(r["user_id"], r["rule_id"], r["match_count"]) for r in rules.counted_by_join(df, given).collect()]
    assert asked == [2, 2] and len(counts) == 43
    assert {c for c in counts if c[0] == 1} == {(1, f"r{i:03}", 1) for i in range(40)} and {c for c in counts if c[0] == 2} == {(2, "a", 2), (2, "b", 0)}
