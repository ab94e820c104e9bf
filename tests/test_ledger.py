"""Operators that the star schema can't show, on a few rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from coinbrook.functions import classify, merchants, money
from coinbrook.operators import changes, dedup, fx, lists, networth, rules, spending
from coinbrook.plans import imports, reports
from coinbrook.sources import backup, brokerage, csv, statements
from coinbrook.streaming import inbox
from coinbrook import schemas

D = dt.date


def one(df):
    return [tuple(r) for r in df.collect()]


TX = "user_id int, account_id int, date date, description_raw string, merchant string, category string, amount decimal(15,2), currency string, transaction_type string, is_spend boolean, is_income boolean, needs_review boolean"


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [
        (1, 1, D(2025, 1, 5), "GROCER", "Grocer", "Groceries", 428.00, "USD", "EXPENSE", True, False, False),
        (1, 1, D(2025, 1, 9), "PAYMENT THANK YOU", None, "Credit Card Payments", -373.00, "USD", "TRANSFER", False, False, False),
        (1, 1, D(2025, 1, 31), "REFUND", "Shop", None, -355.00, None, "INCOME", False, True, True),
        (2, 2, D(2024, 12, 31), "X", "Shop", None, 10.00, "EUR", "EXPENSE", True, False, False),
    ]
    tx = spark.createDataFrame([(*r[:6], None, *r[7:]) for r in rows], TX).drop("amount").withColumn("n", F.lit(None))
    from decimal import Decimal

    tx = spark.createDataFrame([(*r[:6], Decimal(f"{r[6]:.2f}"), *r[7:]) for r in rows], TX)
    rates = spark.createDataFrame([(D(2024, 12, 31), "EUR", Decimal("1.10000000")), (D(2024, 12, 31), "EUR", Decimal("1.20000000"))], "rate_date date, from_currency string, rate decimal(18,8)")
    return fx.convert(tx, rates)


def test_payments_and_refunds_are_no_spending(ledger):
    (row,) = one(spending.monthly_summary(ledger, 2025, 1, user=1))
    assert row == (1, 428.0, 355.0, -73.0)
    (row,) = one(spending.range_summary(ledger, D(2024, 12, 31), D(2025, 1, 31), user=2))
    assert row == (2, 11.0, 0.0, -11.0, 1)


def test_months_add_up_to_the_year(ledger):
    rows = spending.yearly_summary(ledger, 2025).collect()
    assert len(rows) == 12 and sum(r["total_spend"] for r in rows) == rows[0]["total_spend_year"] == 428.0
    assert spending.yearly_summary(ledger, 1990).count() == 0


def test_bounds_are_checked(ledger):
    for call in (lambda: spending.month_range(2025, 13), lambda: spending.top_merchants(ledger, D(2025, 1, 1), D(2025, 1, 2), limit=101), lambda: spending.spending_velocity(ledger, D(2025, 1, 1), 2)):
        with pytest.raises(ValueError):
            call()


def test_page_bounds(ledger):
    with pytest.raises(ValueError):
        lists.page(ledger, ["date"], 0)
    last = lists.page(ledger, ["date"], 2, 3).collect()
    assert len(last) == 1 and last[0]["total"] == 4 and not last[0]["has_more"]


def test_rules_first_match_and_odd_patterns(spark, ledger):
    made = [
        {"id": "a", "rule_type": "MERCHANT_MATCH", "pattern": "shop", "priority": 5, "created_at": "2", "action": json.dumps({"category": "S", "transaction_type": None})},
        {"id": "b", "rule_type": "COMPOSITE", "pattern": "{}", "priority": 9, "created_at": "1", "action": "{}"},
        {"id": "c", "rule_type": "AMOUNT_RANGE", "pattern": "nonsense", "priority": 1, "created_at": "1", "action": "{}"},
        {"id": "d", "rule_type": "AMOUNT_RANGE", "pattern": '{"max": 5}', "priority": 1, "created_at": "1", "action": "{}"},
        {"id": "e", "rule_type": "CATEGORY_OVERRIDE", "pattern": "shop", "priority": 0, "created_at": "1", "action": "{}"},
    ]
    got = {(r["user_id"], r["description_raw"]): (r["matched_rule_id"], r["category"], r["transaction_type"]) for r in rules.applied(ledger, made).collect()}
    assert got[(1, "REFUND")] == ("a", "S", "INCOME")  # -355 is below the range's least amount of 0
    assert got[(1, "GROCER")] == ("b", "Groceries", "EXPENSE")
    assert got[(2, "X")] == ("a", "S", "EXPENSE")
    assert rules.matched(ledger, []).where("matched_rule_id IS NOT NULL").count() == 0


def test_import_is_idempotent_and_ordered(spark):
    from decimal import Decimal

    schema = "user_id int, account_id int, file_hash string, row_index int, date date, description_raw string, merchant string, amount decimal(15,2), currency string, is_payment boolean, is_credit boolean"
    parsed = spark.createDataFrame(
        [
            (1, 1, "f", 0, D(2025, 1, 1), "COFFEE BAR", "Bar", Decimal("3.00"), "USD", False, False),
            (1, 1, "f", 1, D(2025, 1, 1), "PMT", None, Decimal("-9.00"), "USD", True, False),
            (1, 1, "f", 2, D(2025, 1, 1), "SOMETHING", "Known", Decimal("-2.00"), "USD", False, True),
            (1, 1, "f", 3, D(2025, 1, 1), "SOMETHING", "Moved", Decimal("2.00"), "USD", False, False),
            (1, 1, "f", 3, D(2025, 1, 1), "SOMETHING", "Moved", Decimal("2.00"), "USD", False, False),
        ],
        schema,
    )
    known = spark.createDataFrame([(1, "Known", "Hobbies", 0.8), (1, "Moved", "Transfers", 0.9)], "user_id int, merchant_normalized string, category string, confidence double")
    rates = spark.createDataFrame([], "rate_date date, from_currency string, rate decimal(18,8)")
    empty = spark.createDataFrame([], "hash_dedup_key string")
    got = imports.commit(parsed, empty, [], known, rates)
    rows = {r["row_index"]: (r["transaction_type"], r["category"], r["classification_method"], r["is_spend"]) for r in got.collect()}
    assert rows == {0: ("EXPENSE", "Restaurants", "DEFAULT", True), 1: ("TRANSFER", "Credit Card Payments", "DEFAULT", False), 2: ("INCOME", "Hobbies", "LEARNED", False), 3: ("TRANSFER", "Transfers", "LEARNED", False)}
    assert imports.commit(parsed, got.select("hash_dedup_key"), [], known, rates).count() == 0


def test_carry_forward_and_ties(spark):
    from decimal import Decimal

    rows = [(1, 7, 1, D(2025, 1, 1), 10), (2, 7, 1, D(2025, 1, 1), 20), (3, 7, 2, D(2025, 2, 1), 5), (4, 7, 1, D(2025, 3, 1), 1)]
    s = spark.createDataFrame([(i, u, a, d, Decimal(v)) for i, u, a, d, v in rows], "snapshot_id int, user_id int, account_id int, statement_date date, total_value decimal(18,2)")
    assert sorted(r["net_worth"] for r in networth.history(s).collect()) == [6.0, 20.0, 25.0]
    assert networth.current(s.where("statement_date < '2025-02-01'")).first()["net_worth"] == 30.0


def test_text_helpers(spark):
    df = spark.createDataFrame([("$1,234.50",), ("(12.00)",), ("73.00CR",), ("--",), ("N/A",), (None,), ("25.00-",)], "t string")
    got = [None if r[0] is None else float(r[0]) for r in df.select(money.parse_money(F.col("t"))).collect()]
    assert got == [1234.5, -12.0, -73.0, None, None, None, -25.0]
    df = spark.createDataFrame([("ACME*AB12 555-123-4567 CA",), ("555-123-4567",)], "t string")
    assert [r[0] for r in df.select(merchants.clean(F.col("t"), "chase")).collect()] == ["ACME", "555-123-4567"]
    assert spark.range(1).select(merchants.first_words(F.lit("Acme acme Pay ACME x"))).first()[0] == "Acme Pay x"
    row = spark.range(1).select(dedup.import_key("id", "id", "id"), dedup.plain_description(F.lit("  A*#B  c "))).first()
    import hashlib

    assert row[0] == hashlib.sha256(b"0|0|0").hexdigest() and row[1] == "a b c"


def test_csv_layouts(spark, tmp_path):
    assert csv.bank(["Transaction Date", "Post Date", "Description", "Category", "Type", "Amount", "Memo"]) == ("Chase", "CREDIT_CARD")
    assert csv.bank(["Date", "Description", "Amount", "Extended Details"])[0] == "American Express"
    assert csv.bank(["When", "What"]) == (None, None)
    (tmp_path / "a.csv").write_text('﻿Transaction Date,Post Date,Description,Amount,Memo\n01/02/2025,01/03/2025,"ACME, INC",-12.50,x\n,,bad,zz,\n01/05/2025,01/06/2025,REFUND,3.00,\n')
    rows = csv.read(spark, str(tmp_path / "a.csv"))
    layout = csv.detect(rows)
    assert layout.convention == "negative_is_expense" and layout.mapping["date"] == "Transaction Date" and layout.confidence > 0.7
    got = sorted((r["row_index"], str(r["date"]), r["description_raw"], float(r["amount"]), r["is_credit"]) for r in csv.parse(rows, layout).collect())
    assert got == [(0, "2025-01-02", "ACME, INC", 12.5, False), (2, "2025-01-05", "REFUND", 3.0, True)]
    (tmp_path / "b.csv").write_text("Transaction Date,Posted Date,Card No.,Description,Debit,Credit\n2025-01-02,2025-01-02,1234,SHOP,5.00,\n2025-01-03,2025-01-03,1234,BACK,,7.25\n")
    rows = csv.read(spark, str(tmp_path / "b.csv"))
    got = sorted((float(r["amount"]), r["is_credit"]) for r in csv.parse(rows).collect())
    assert csv.detect(rows).convention == "debit_credit" and got == [(5.0, False), (7.25, True)]
    assert csv.Layout(mapping={"date": "x"}).problems(["y"]) == ["Missing required field mapping: description", "Missing amount column mapping", "Mapped column 'x' not found in CSV"]


@pytest.mark.parametrize(
    "bank, text, want",
    [
        ("amex", "03/04/25 ACME TOYS SPRINGFIELD IL $12.50", ("2025-03-04", 12.5, False, False)),
        ("amex", "03/05/25* AUTOPAY PAYMENT THANK YOU -$100.00", ("2025-03-05", -100.0, True, True)),
        ("chase", "February 2025\n12/29 Acme.com*AB12CD Acme.com/bill WA 44.94", ("2024-12-29", 44.94, False, False)),
        ("wells_fargo", "December 2024\n12/09 12/10 123456789 ACME SHOP CA $25.00-", ("2024-12-10", -25.0, True, False)),
        ("capital_one", "October 2024\nOct 4 Oct 5 ACME AUTOPAY PYMT - $149.48", ("2024-10-05", -149.48, True, True)),
        ("boa", "April 2024\n04/08 04/10 ACME ELECTRONIC PAYMENT 1111 2222 -32.81", ("2024-04-08", 32.81, True, True)),
        ("ally_bank", "Activity\n12/29/2025 ACH Withdrawal $0.00 -$64.99 $740.01\nACME EPAYMENT\nEnding Balance 3", ("2025-12-29", 64.99, False, True)),
        ("chase_bank", "November 2024\nTRANSACTION DETAIL\n11/28 Acme Cable PPD ID: 0001 -55.00 287.58", ("2024-11-28", 55.0, False, False)),
        ("fidelity", "November 2024\n11/17 11/17 MTC PAYMENT THANK YOU $73.00CR", ("2024-11-17", -73.0, True, True)),
    ],
)
def test_statement_lines(spark, bank, text, want):
    df = spark.createDataFrame([("f", text)], "source_file string, text string")
    (r,) = statements.parse(df, bank, 2025, 6).collect()
    amount = -float(r["amount"]) if bank == "chase_bank" and False else float(r["amount"])
    assert (str(r["date"]), amount, r["is_credit"], r["is_payment"]) == want and r["row_index"] == 0


def test_amex_amounts_on_later_lines(spark):
    text = """Payments and Credits
03/05/25* AUTOPAY RECEIVED
THANK YOU -$100.00
07/06/25 BEST BUY
SAN CARLOS CA

888BESTBUY
-$1,286.31 ⧫
07/07/25 NOTHING FOLLOWS
07/08/25 ACME -$1.00
New Charges
03/04/25 ACME TOYS
SPRINGFIELD IL $12.50
03/06/25 Total of nothing $5.00
03/07/25 ACME $7.00"""
    df = spark.createDataFrame([("f", text)], "source_file string, text string")
    got = [(str(r["date"]), r["description_raw"], float(r["amount"]), r["is_credit"]) for r in statements.parse(df, "amex", 2025, 6).orderBy("row_index").collect()]
    assert got == [
        ("2025-03-05", "AUTOPAY RECEIVED THANK YOU", -100.0, True),
        ("2025-07-06", "BEST BUY SAN CARLOS CA 888BESTBUY", -1286.31, True),
        ("2025-07-08", "ACME", -1.0, True),
        ("2025-03-07", "ACME", 7.0, False),
    ]


def test_generic_and_balances(spark):
    df = spark.createDataFrame([("f", "2025-01-15 ACME GROCER -10.00\nJan 15 ACME GROCER $10.00\n02/30 NO DAY 1.00\nSpending Account xxxxxx0001 $10.00 $20.00")], "source_file string, text string")
    got = [(str(r["date"]), float(r["amount"])) for r in statements.parse_generic(df, 2025).orderBy("row_index").collect()]
    assert got == [("2025-01-15", -10.0), ("2025-01-15", 10.0)]
    (b,) = statements.ally_balances(df).collect()
    assert (b["account"], b["last4"], float(b["ending"])) == ("spending", "0001", 20.0)


def test_holdings(spark):
    df = spark.createDataFrame([("f", "EUR\nABCD 1,000 1 10.5000 10,500.00 11.0000 11,000.00")], "source_file string, text string")
    (r,) = brokerage.positions(df, "ibkr", rates={"EUR": 1.1}).collect()
    assert (r["symbol"], r["currency"], float(r["market_value"]), float(r["market_value_usd"])) == ("ABCD", "EUR", 11000.0, 12100.0)
    df = spark.createDataFrame([("f", "ACME BOND ETF ABND 10.5 $100.00 $1,050.00\nX ETF XXXX 1 $1.00 $99,000,000.00")], "source_file string, text string")
    (r,) = brokerage.positions(df, "wealthfront").collect()
    assert (r["security_type"], r["asset_class"], float(r["quantity"])) == ("ETF", "FIXED_INCOME", 10.5)
    kinds = spark.createDataFrame([("My 401(k) Roth IRA",), ("Roth IRA",), ("an IRA here",), ("miracle",)], "t string").select(brokerage.account_type(F.col("t"))).collect()
    assert [k[0] for k in kinds] == ["RETIREMENT_401K", "IRA_ROTH", "IRA_TRADITIONAL", "BROKERAGE"]


def test_backup_round_trip(spark, tmp_path):
    empty = {n: spark.createDataFrame([], s) for n, s in schemas.TABLES.items()}
    fill = lambda name, **v: spark.createDataFrame([{f.name: v.get(f.name) for f in schemas.TABLES[name].fields}], schemas.TABLES[name])
    tables = dict(empty)
    tables["accounts"] = fill("accounts", id="a", user_id="u", is_active=True, created_at=dt.datetime(2025, 1, 2, 3, 4, 5))
    tables["transactions"] = fill("transactions", id="t", account_id="a", import_id="gone").unionByName(fill("transactions", id="x", account_id="none"))
    backup.write(tables, str(tmp_path / "b"))
    loaded = backup.read(spark, str(tmp_path / "b"))
    assert loaded["accounts"].first() == tables["accounts"].first()
    after, report = backup.restore(empty, loaded)
    counts = {(r["entity"], r["status"]): r["rows"] for r in report.collect()}
    assert counts == {("accounts", "created"): 1, ("transactions", "created"): 1, ("transactions", "errors"): 1}
    assert after["transactions"].first()["import_id"] is None
    _, again = backup.restore(after, loaded)
    assert {r["status"] for r in again.where("entity = 'accounts'").collect()} == {"skipped"}


def test_changes(spark):
    old = spark.createDataFrame([("1", "EXPENSE", True, False, "A"), ("2", "INCOME", False, True, "B")], "id string, transaction_type string, is_spend boolean, is_income boolean, category string")
    new = changes.update(old, spark.createDataFrame([("1", "INCOME", None)], "id string, transaction_type string, category string"))
    assert one(new.orderBy("id"))[0] == ("1", "INCOME", False, True, "A")
    assert one(changes.delete(new, spark.createDataFrame([("2",)], "id string")).select("id")) == [("1",)]
    from decimal import Decimal

    entries = spark.createDataFrame([(1, D(2025, 1, 1), "x", Decimal("-5.00"), "EXPENSE")] * 2, "account_id int, date date, description_raw string, amount decimal(15,2), transaction_type string")
    made = changes.manual_transactions(entries, spark.createDataFrame([], "hash_dedup_key string"))
    assert one(made.select(F.col("amount").cast("double"), "is_spend")) == [(5.0, True)]
    assert changes.manual_transactions(entries, made).count() == 0


def test_delete_account_cascades(spark):
    t = {"accounts": spark.createDataFrame([("a",), ("b",)], "id string"), "holdings_snapshots": spark.createDataFrame([("s", "a")], "id string, account_id string"), "positions": spark.createDataFrame([("p", "s")], "id string, snapshot_id string"), "transactions": spark.createDataFrame([("t", "a"), ("u", "b")], "id string, account_id string")}
    after = changes.delete_account(t, "a")
    assert {n: d.count() for n, d in after.items()} == {"accounts": 1, "holdings_snapshots": 0, "positions": 0, "transactions": 1}


def test_match_accounts(spark):
    acc = spark.createDataFrame([(1, 9, "B", "0001", "h1", True), (2, 9, "B", "0002", None, True), (3, 9, "B", "0001", "h9", True)], "account_id int, user_id int, institution string, last4 string, account_hash string, is_active boolean")
    st = spark.createDataFrame([("x", 9, "B", "7777", "h1"), ("y", 9, "B", "0002", "h2"), ("z", 9, "B", "0003", "h3")], "statement_id string, user_id int, institution string, last4 string, account_hash string")
    assert dict(one(lists.match_accounts(st, acc))) == {"x": 1, "y": 2, "z": None}


def test_export(ledger):
    row = reports.export_rows(ledger.where("description_raw = 'REFUND'")).first()
    assert row["Is Spend"] == "No" and row["Is Income"] == "Yes" and row["Category"] == "" and row["Amount"] == "-355.00"
    assert reports.summary_lines(ledger, D(2025, 1, 1), D(2025, 1, 31), 1).collect()[0]["value"] == "$428.00"
    assert set(reports.workbook(ledger, D(2025, 1, 1), D(2025, 1, 31), 1, 2025)) == {"Summary", "Categories", "Transactions", "Monthly Trends"}


def test_inbox_equals_batch(spark, tmp_path):
    schema = "account_id string, file_hash string, row_index int, ingested_at timestamp"
    rows = [("a", "f", 0, dt.datetime(2025, 1, 1)), ("a", "f", 1, dt.datetime(2025, 1, 1)), ("a", "f", 0, dt.datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    keyed = df.withColumn("hash_dedup_key", dedup.import_key("account_id", "file_hash", "row_index"))
    keyed.limit(0).write.parquet(str(tmp_path / "ledger"))
    for _ in range(2):
        inbox.run(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "ledger"), str(tmp_path / "cp"), lambda new, known: dedup.new_rows(new, known))
        assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2


def test_keywords_as_parameter(spark):
    table = spark.createDataFrame([(1, "Own", "ACME+"), (2, "Other", "ACME")], "position int, category string, keyword string")
    cascade = classify.keyword_table(table)
    got = spark.createDataFrame([("ACME+ X",), ("ACME",), ("Q",)], "d string").select(classify.keyword_category(F.col("d"), cascade)).collect()
    assert [g[0] for g in got] == ["Own", "Other", "Other Expenses"]
