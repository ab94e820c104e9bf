"""Card tables, folders of statements and sections, by hand."""

from decimal import Decimal as D

import pytest

from coinbrook.sources import folder, statements


def test_votes_of_tables(spark):
    head = ["Post Date", "Ref #", "Transaction Description", "Amount"]
    rows = [
        ("f", 1, 1, head, ["11/14", "8459", "COMCAST CA", "$73.00"]), ("f", 1, 2, head, ["bad", "1", "NO DATE", "$1.00"]), ("f", 1, 3, head, ["11/15", "1", None, "$1.00"]), ("f", 1, 4, head, ["11/16", "1", "LATE MARK", "$2.00CR"]), ("f", 1, 5, head, ["11/17", "1", "SHOP", "1,355.00"]),
        ("f", 2, 1, head, ["11/17", "R", "MTC payment Thank You", None]), ("f", 2, 2, head, ["11/17/2025", "R", "MTC payment Thank You", "$373.00CR"]), ("f", 2, 3, head, ["11/18", "R", "REFUND", "$5.00"]), ("f", 3, 1, ["Date", "Amount"], ["11/18", "$5.00"]),
        ("g", 1, 1, [None, "DATE", "AMOUNT", "Description"], ["x", "2/29", "$9.00", "NO SUCH DAY"]), ("g", 1, 2, [None, "DATE", "AMOUNT", "Description"], ["x", "2/28", "x", "NO AMOUNT"]), ("h", 1, 1, head, ["1/2"]),
    ]
    df = spark.createDataFrame(rows, "source_file string, table_no int, row_no int, header array<string>, cells array<string>")
    got = [(r["source_file"], r["row_index"], str(r["date"]), r["description_raw"], r["amount"], r["is_credit"], r["is_payment"]) for r in statements.card_tables(df, 2025).orderBy("source_file", "row_index").collect()]
    assert got == [
        ("f", 0, "2025-11-17", "MTC payment Thank You", D("-373.00"), True, True), ("f", 1, "2025-11-18", "REFUND", D("-5.00"), True, False), ("f", 2, "2025-11-14", "COMCAST CA", D("73.00"), False, False),
        ("f", 3, "2025-11-16", "LATE MARK", D("2.00"), False, False), ("f", 4, "2025-11-17", "SHOP", D("1355.00"), False, False),
    ]
    assert statements.card_tables(df.limit(0), 2025).count() == 0


def test_known_files_are_dropped(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    texts = {"a.txt": "Chase.com nothing\n2025-01-15 ACME -10.00", "deep/b.txt": "chase.com\n12/29 ACME SHOP 44.94", "deep/c.txt": "chase.com\n12/29 ACME SHOP 44.94", "d.txt": "", "e.csv": "chase.com\n12/30 OTHER 1.00"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    first = folder.read(spark, str(tmp_path), pattern="*.txt")
    assert sorted(r["source_file"].rsplit("/", 1)[1] for r in first.collect()) == ["a.txt", "b.txt"]
    got = [(r["bank"], r["description_raw"], float(r["amount"]), len(r["source_file_hash"])) for r in folder.parse(first, 2025, 1).orderBy("bank", "source_file").collect()]
    assert got == [("chase", "ACME SHOP", 44.94, 64), ("unknown", "ACME", -10.0, 64)]
    assert folder.read(spark, str(tmp_path), first.select("source_file_hash"), "*.txt").count() == 0


@pytest.mark.parametrize("text,want", [
    ("THANK YOU - MOBILE PAYMENT", True), ("PAYMENT, THANK YOU", True), ("MOBILE PAYMENT", False), ("THANK YOU", False), ("autopay", True),
])
def test_words_of_payments_in_any_order(spark, text, want):
    df = spark.createDataFrame([("f", f"03/04/25 {text} -$12.50")], "source_file string, text string")
    assert [r["is_payment"] for r in statements.parse(df, "amex", 2025, 3).collect()] == [want]


def test_sections_and_headers(spark):
    line = "12/09 12/10 123456789 ACME SHOP CA $25.00"
    texts = [("a", f"{line}\nTransaction Summary\n{line.replace('ACME', 'B')}\n12/09 12/10 Interest Charge $1.00"), ("b", line)]
    got = statements.parse(spark.createDataFrame(texts, "source_file string, text string"), "wells_fargo", 2024, 12)
    assert sorted((r["source_file"], "B SHOP" in r["description_raw"]) for r in got.collect()) == [("a", True), ("b", False)]
    ally = "Ally Bank\nDate Description Credits Debits Balance\n01/02/2025 ACH $5.00 -$0.00 $9.00\nAUTOPAY of VENMO\n01/03/2025 ACH $0.00 -$5.00 $9.00\nTo Vanguard"
    (a, b) = statements.parse(spark.createDataFrame([("f", ally)], "source_file string, text string"), "ally_bank", 2025, 1, transfers=True).orderBy("row_index").collect()
    assert (a["is_payment"], a["transfer_category"], b["is_payment"], b["transfer_category"]) == (False, None, True, "Transfers")


@pytest.mark.parametrize("head,year", [("In 1998", 1998), ("Summary of 2021", 2021), ("Jan 15, 2022 is the due date", 2022)])
def test_numbers_of_transactions_are_no_years(spark, head, year):
    lines = [f"MAY  {i + 1} Order {2040 + i} URGENT $1,{i + 100}.50" for i in range(20)]
    (first, *_) = statements.parse_generic(spark.createDataFrame([("f", "\n".join([head, *lines]))], "source_file string, text string"), 1998).orderBy("row_index").collect()
    assert (first["date"].year, first["description_raw"]) == (year, "Order 2040 URGENT")


def test_a_line_is_matched_for_all_its_fields(spark):
    """No line is matched for each field, and no statement is made a second time for its year."""
    df = spark.createDataFrame([("f", "chase.com\n12/29 ACME SHOP 44.94")], "source_file string, text string")
    plan = statements.parse(df, "chase", 2025, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("regexp_extract(line") == 0


def test_a_line_is_matched_once(spark):
    """Filters on what a line holds do not match it again below the projection."""
    texts = spark.createDataFrame([("f", "Bank of America\nClosing Date: 02/15/1998\n01/02 01/03 A -1.00\nno line\n02/03 02/04 B 2.00")], "source_file string, text string")
    for name in ("boa", "capital_one", "ally_bank"):
        plan = statements.parse(texts, name, 1998, 2)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(line") == 1
    assert [(r["description_raw"], float(r["amount"])) for r in statements.parse(texts, "boa", 1998, 2).orderBy("row_index").collect()] == [("A", 1.0), ("B", 2.0)]
