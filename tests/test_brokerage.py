"""Brokerage statements by hand: what single statements print that the queries' statements don't."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from coinbrook.sources import holdings


def read(spark, of, *texts):
    found = holdings.accounts(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_file string, text string"), of)
    return [r.asDict(recursive=True) for r in found.orderBy("source_file", "account").collect()]


def names(account):
    return [(p["symbol"], p["security_name"], p["security_type"], p["asset_class"], p["market_value"]) for p in account["positions"]]


def test_several_accounts_by_pages(spark):
    text = "\f".join([
        "Fidelity Brokerage Services\nDecember 1, 2025 - December 31, 2025\nAccounts Included in This Report\n4 FIDELITY ROTH IRA JANE DOE - ROTH INDIVIDUAL 231-489641 $1.00 60.00\n2 FIDELITY TRADITIONAL IRA JANE DOE - TRADITIONAL IRA 226-722819 $12.49 $100.00\nYour Account Value: $160.00",
        "TRADITIONAL IRA\nACME BOND FUND 48.66 2.000 25.0000 50.00 40.70 8.44 7.1\nUSD\n(ABND) 1.580",
        "GOLD MINES 1.00 1.0 50.0000 $50.00 $1.00 -1.00\nTotal ACME 1.00 2.0 3.0 4.00 5.00 6.00",
        "ROTH INDIVIDUAL\nTESLA INC COM (TSLA) 1.00 1.0 40.0 40.00 1.00 1.00\nFIDELITY GOVERNMENT CASH 1.00 20.00\nTotal Core Account (3% of account holdings) $1.00 $20.00",
    ])
    a, b = read(spark, "fidelity", text)
    assert (a["account_identifier"], a["account_type"], a["total_value"], a["calculated_total"], a["is_reconciled"]) == ("****2819", "IRA_TRADITIONAL", D("100.00"), D("100.00"), True)
    assert names(a) == [("ABND", "ACME BOND FUND", "MUTUAL_FUND", "FIXED_INCOME", D("50.00")), (None, "GOLD MINES", "ETF", "ALTERNATIVE", D("50.00"))]
    # cash lines count in statements of one account only; here the total of the core account stands for them
    assert (b["account_type"], b["total_cash"], b["calculated_total"], b["reconciliation_diff"], b["is_reconciled"]) == ("IRA_ROTH", D("20.00"), D("40.00"), D("0.00"), True)
    assert names(b) == [("TSLA", "TESLA INC COM", "STOCK", "EQUITY", D("40.00"))]
    assert {a["statement_date"], b["statement_date"]} == {dt.date(2025, 12, 31)} and a["statement_start_date"] == dt.date(2025, 12, 1)
    (c,) = read(spark, "fidelity", "Account # Z09-403829 as of 1/2/2026\nAccount Value $20.00\nFIDELITY GOVERNMENT CASH 1.00 20.00\nUSD\n(SPAXX)")
    assert (c["account_identifier"], c["statement_date"], c["total_value"]) == ("****3829", dt.date(2026, 1, 2), D("20.00"))
    assert names(c) == [("SPAXX", "FIDELITY GOVERNMENT CASH", "MONEY_MARKET", "CASH", D("20.00"))]


def test_sweep_and_dates_without_blanks(spark):
    a, b, c = read(
        spark, "schwab",
        "Account Number: 6404-9694\nStatement Period December1-31,2025\nEnding Account Value as of 12/31 $215,073.31\nCash and Cash Investments 544.06 <1%\nEquities 214,529.25 100%\nMETA META PLATFORMS INC 325.0000 660.09000 214,529.25 198,149.87 16,379.38\nTotal Cash and Cash Investments $373.42 $544.06",
        "Statement 2024 asof12/31\nTotal $10.00 100%", "nothing",
    )
    assert names(a) == [("META", "META PLATFORMS INC", "STOCK", "EQUITY", D("214529.25")), (None, "CHARLES SCHWAB BANK SWEEP", "CASH", "CASH", D("544.06"))]
    assert (a["total_cash"], a["total_securities"], a["is_reconciled"], a["statement_start_date"]) == (D("544.06"), D("214529.25"), True, dt.date(2025, 12, 1))
    assert (b["statement_date"], b["statement_start_date"], b["total_value"], b["is_reconciled"]) == (dt.date(2024, 12, 31), None, D("10.00"), False)
    assert (c["account_identifier"], c["statement_date"], c["positions"], c["is_reconciled"]) == ("Unknown", None, [], True)


def test_funds_over_two_lines(spark):
    (a,) = read(spark, "vanguard", "401(K) PLAN–– 090061\n10/01/2025 - 12/31/2025\nEnding balance $345,193.16\nInvestment Activity Table\nFund Name\nVanguard® Target Retire $332,405.25 $2,637.18 - $4.34 $10,155.07 $0.00 $345,193.16\n2050 Tr P\nStable Trust $0.00 $0.00\nAdditional words\nLate Fund $1.00 $2.00")
    assert names(a) == [(None, "Vanguard Target Retire", "MUTUAL_FUND", "EQUITY", D("345193.16"))]  # a line that begins with a digit does not go on
    assert (a["account_type"], a["account_identifier"], a["total_securities"]) == ("RETIREMENT_401K", "****0061", D("345193.16"))


@pytest.mark.parametrize("text,number", [("Wealthfront: 8W15S8CW", "****S8CW"), ("ACCOUNT NUMBER\n8W15S8CX", "****S8CX"), ("JTWROS1 Apt 12\n8W15S8CY", "****S8CY"), ("words 12345678 and A1234567", "****4567"), ("nothing", "Unknown")])
def test_account_numbers(spark, text, number):
    assert read(spark, "wealthfront", text)[0]["account_identifier"] == number


def test_sections_bound_holdings(spark):
    text = """Statement Period: December 1 - December 31, 2025
OLD FUND OLD 1.0 $1.00 $1.00
I. Holdings as of December 31
Stocks
APPLE INC COM AAPL 5.61364 $271.8600 $1,526.12
BROWN FORMAN CORP CL B BF.B 0.07888 $26.0600 $2.06
12/31/2025 DIVIDEND AAPL 1 $1.00 $1.00
MUNI NOTES 123456AB9 1 $3.00 $3.00
MONEY MARKET FUNDS
RBC US Government TIMXX 19.46 $1.0000 $19.46
Other
GOLD TRUST GLD 1 $5.00 $5.00
HUGE CO HUG 2,000,000 $1.00 $2,000,000.00
Total Holdings $1,555.64
Deposits/Credits to Wealthfront
LATE FUND LAT 1.0 $1.00 $1.00"""
    (a,) = read(spark, "wealthfront", text)
    assert names(a) == [
        ("AAPL", "APPLE INC COM", "STOCK", "EQUITY", D("1526.12")), ("BF.B", "BROWN FORMAN CORP CL B", "STOCK", "EQUITY", D("2.06")), (None, "MUNI NOTES", "STOCK", "FIXED_INCOME", D("3.00")),
        ("TIMXX", "RBC US Government", "MONEY_MARKET", "CASH", D("19.46")), ("GLD", "GOLD TRUST", "ETF", "ALTERNATIVE", D("5.00")),
    ]
    assert a["positions"][2]["cusip"] == "123456AB9" and a["is_reconciled"] and a["statement_date"] == dt.date(2025, 12, 31)


def test_only_vested_shares(spark):
    body = "SAP: 208.35 EUR as of 30 Dec 2025\n95 063.24 USD\nAvailable\nLocked\n33 093.99 USD\n61 969.25 USD\nOwn SAP 1 000.00 USD\nMove SAP 2 000.00 USD\n" + "." * 300
    own = "Own SAP 10 133.70 USD\nShares Total\nAvailable 41.5 9 000.00 EUR\nLocked 0 0.00 EUR\n" + "." * 700
    move = "Move SAP 84 929.54 USD\nShares Total\n93.8634 22 960.29 USD\nAvailable 93.8634 20 000.00 EUR\nLocked 253 61 969.25 USD\n"
    (a,) = read(spark, "equatex", body + own + move + "." * 700 + "Grow SAP 5.00 USD\nLocked 12 5.00 USD\n")
    assert [(p["security_name"], p["security_type"], p["quantity"], p["market_value"], p["is_vested"]) for p in a["positions"]] == [("Own SAP - Shares", "ESPP", D("41.500000"), D("10133.70"), True), ("Move SAP - Shares", "STOCK", D("93.863400"), D("22960.29"), True)]
    assert a["total_value"] == D("33093.99") and a["is_reconciled"]


def test_rates_inside_the_statement(spark):
    text = """Interactive Brokers Account Summary
Account Information
Account U1111111
Base Currency EUR
December 1, 2025 - December 31, 2025
Total 1.00 2.00 3.00 1,174.60
Mark-to-Market
GBP 1.0 2.0 1.1 1.25
GBP 1.0 2.0 1.1 1.30
HKD 1.0 2.0 1.1 5000.0
Open Positions
Symbol Quantity Mult
Stocks
GBP
ABCD 100 1 10.5 10.00 1.0000 100.00
BCDE 200 1 10.5 20.00 1.0000 (200.00)
Total 300
CHF
ZZZZ 1 1 1.0 1.00 1.0 1.00
Total Stocks in USD 1
Financial Instrument Information
ABCD ALPHA BETA LTD 607961218
Account Information
Account U2222222
Open Positions
nothing here
XYZ 5 1 2.0 10.00 3.0 15.00"""
    a, b = read(spark, "ibkr", text)
    assert (a["account_identifier"], a["base_currency"], a["fx_rates"]) == ("****1111", "EUR", {"GBP": D("1.30000000"), "USD": D("1.00000000")})
    assert [(p["symbol"], p["security_name"], p["currency"], p["market_value_usd"]) for p in a["positions"]] == [("ABCD", "ALPHA BETA LTD", "GBP", D("130.00"))]
    assert [(p["symbol"], p["currency"], p["market_value_usd"]) for p in b["positions"]] == [("XYZ", "USD", D("15.00"))] and b["account_identifier"] == "****2222"


def test_nothing_is_shuffled(spark):
    for of in holdings.PROVIDERS:
        df = holdings.accounts(spark.createDataFrame([("f", None)], "source_file string, text string"), of)
        assert "partitioning" not in df._jdf.queryExecution().executedPlan().toString()
        (r,) = df.collect()
        assert r["total_value"] == 0 and r["positions"] == [] and r["is_reconciled"]


def test_providers_in_order(spark):
    rows = [("FMR LLC and Schwab.com",), ("schwab & co",), ("IBKR vanguard",), ("participant plan holdings",), ("Monthly Statement for May",), ("none",)]
    got = spark.createDataFrame(rows, "t string").select(holdings.provider(F.col("t"))).collect()
    assert [r[0] for r in got] == ["fidelity", "schwab", "ibkr", "equatex", "wealthfront", None]


@pytest.mark.parametrize("of,pattern", [("fidelity", r"[A-Z][A-Z0-9\s&'\-]+"), ("schwab", r"([A-Z]{1,5})\s+([A-Z][A-Z\s]+"), ("vanguard", r"\$?([\d,]+\.?\d{0,2}),"), ("wealthfront", r"[A-Z][A-Z0-9.]{0,5}"), ("equatex", r"Available\s+([\d\.]+)\s+"), ("ibkr", r"(\d[\d,]*)\s+1\s+")])
def test_holdings_are_matched_once(spark, of, pattern):
    """No line is matched for each of its fields, and no array of holdings is made once more to see whether it is empty."""
    df = holdings.positions(holdings.accounts(spark.createDataFrame([("f", "t")], "source_file string, text string"), of))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    most = {"equatex": 12, "ibkr": 16}.get(of, 2)  # for each plan; for each currency and form without currencies
    assert pattern in plan and plan.count(pattern) <= most


def test_matches_are_taken_apart_in_the_pass_that_finds_them(spark):
    """A match's groups come with it: no holding, rate or balance is found first and then matched again."""
    df = holdings.accounts(spark.createDataFrame([("f", "t")], "source_file string, text string"), "ibkr").select("source_file", "calculated_total")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= 1  # the numbers of accounts
    got = spark.createDataFrame([("AB 1 CD 22 x", "AB 1CD 22"), ("none", "")], "a string, b string").select(*[holdings._matches(F.col(c), r"([A-Z]+) (\d+)?", 2).alias(c) for c in "ab"]).collect()
    assert [tuple(r) for r in got] == [([["AB", "1"], ["CD", "22"]], [["AB", "1"], ["CD", "22"]]), ([], [])]
    (a,) = read(spark, "ibkr", "Account U1111111\nOpen Positions\nSymbol\nStocks\nUSD\nAB\x02C 5 1 2.0 10.00 3.0 15.00\nTotal 1")
    assert [(p["symbol"], p["quantity"], p["market_value"]) for p in a["positions"]] == [("ABC", D("5.000000"), D("15.00"))]


def test_control_characters_split_no_line(spark):
    (a,) = read(spark, "schwab", "Account Number: 6404-9694\nME\x01TA META PLATFORMS INC 325.0000 660.09000 214,529.25")
    assert names(a) == [("META", "META PLATFORMS INC", "STOCK", "EQUITY", D("214529.25"))]


@pytest.mark.parametrize("of", ["fidelity", "schwab", "vanguard", "wealthfront"])
def test_totals_need_no_classes(spark, of):
    """Sums and reconciliations are worked out without telling what each security is."""
    found = holdings.accounts(spark.createDataFrame([("a", "nothing")], "source_file string, text string"), of)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "FIXED_INCOME" in plan(found.select("positions")) and "FIXED_INCOME" not in plan(found.drop("positions"))
