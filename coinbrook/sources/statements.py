"""Transactions from the text of bank and card statements.

A statement is a row (source_file, text). Its lines are exploded with their place; sections are the last header
seen, by a window over the file; rows are found by one regular expression per bank, and what a bank continues on
the next lines is looked up by ``lead``. Every window is over one file, so files spread over tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import statement_date

# Marks of a bank in the text of the first page, in the order in which they are tried.
FORMATS = [
    ("ally_bank", ["Ally Bank"]),
    ("chase_bank", ["Chase Total Checking", "Chase Savings"]),
    ("capital_one", ["Capital One", "capitalone.com"]),
    ("wells_fargo", ["Wells Fargo", "wellsfargo.com"]),
    ("chase", ["chase.com", "JPMorgan Chase"]),
    ("amex", ["American Express", "americanexpress.com"]),
    ("boa", ["Bank of America", "bankofamerica.com"]),
    ("fidelity", ["Fidelity Rewards", "fidelity"]),
]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_MONEY = r"[\d,]+\.\d{2}"
#: Stands between the groups of a match. Statements do not print this control character; it is taken out of their texts.
_CUT = "\x01"
_TRANSACTION = rf"(?im)^[ \t]*(?:\d{{1,2}}[/-]\d{{1,2}}|\d{{4}}-\d{{2}}-\d{{2}}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{{1,2}})\b.*{_MONEY}\s*(?:CR|-|⧫)?[ \t\r]*$"


@dataclass
class Form:
    """How a bank prints a transaction. Groups of ``pattern`` by number; ``section``: (start, end) patterns of
    lines, and with ``without_header`` texts that don't have the start are read whole; ``stitch``: how many lines may continue a description, unless they match ``stop``. ``payment`` and
    ``transfer``: words of payments to cards and of transfers, with ``debits_only`` in what leaves the account alone."""

    pattern: str
    description: int
    amount: int
    month: int = 1
    day: int = 2
    year: int = 0
    minus: int = 0
    debit: int = 0
    section: tuple[str, str] | None = None
    without_header: bool = False
    stitch: int = 0
    stop: str = ""
    rolls: bool = True
    negative: str = ""
    absolute: bool = False
    skip: str = ""
    payment: str = r"(?i)AUTOPAY|PAYMENT"
    transfer: str = ""
    debits_only: bool = False


# The lines of each bank.
FORMS = {
    "amex": Form(rf"^(\d{{2}})/(\d{{2}})/(\d{{2}})\*?\s+(.+?)\s+(-?)\$?({_MONEY})⧫?$", 4, 6, year=3, minus=5, payment=r"(?i)AUTOPAY|^(?=.*PAYMENT).*THANK YOU"),
    "chase": Form(rf"^(\d{{2}})/(\d{{2}})\s+(.+?)\s+(-?)({_MONEY})$", 3, 5, minus=4,
        skip=r"Date of|Transaction|Merchant Name|\$ Amount|ACCOUNT ACTIVITY|ACCOUNT SUMMARY|Order Number|Year-to-Date|Total fees|Total interest|INTEREST CHARGES|Annual Percentage|Balance Type|Balance Subject|Days in Billing|Page|Statement Date|www\.chase\.com|chase\.com|Customer Service|20\d\d Totals|AACCCCOOUUNNTT|IINNTTEERREESSTT|YYeeaarr",
    ),
    "wells_fargo": Form(rf"^\d{{2}}/\d{{2}}\s+(\d{{2}})/(\d{{2}})\s+(.+?)\s+\$?({_MONEY})(-?)$", 3, 4, minus=5,
        section=("Transaction Summary", r"(?!)"), without_header=True, skip=r"Interest Charge|BiltProtect Summary|NOTICE: SEE REVERSE|PAGE|Trans Date.*Post Date|^Continued",
    ),
    "capital_one": Form(rf"^[A-Z][a-z]{{2}}\s+\d{{1,2}}\s+([A-Z][a-z]{{2}})\s+(\d{{1,2}})\s+(.+?)\s+(-?)\s*\$({_MONEY})$", 3, 5, minus=4),
    "boa": Form(rf"^(\d{{2}})/(\d{{2}})\s+\d{{2}}/\d{{2}}\s+(.+?)\s+(-?)({_MONEY})$", 3, 5, minus=4, absolute=True),
    "ally_bank": Form(
        rf"^(\d{{2}})/(\d{{2}})/(\d{{4}})\s+(.+?)\s+\$?({_MONEY})\s+-?\$?({_MONEY})\s+\$?{_MONEY}$", 4, 5, year=3, debit=6,
        section=(r"^Activity$|Date Description", r"Ending Balance|Interest Paid YTD|Interest Withheld YTD|Important Information|Sincerely,"), stitch=3, stop=r"^\d{2}/\d{2}/\d{4}|Ending Balance|Activity|Account", payment=r"(?i)CREDIT CARD|CREDIT CRD|EPAYMENT|AUTOPAY|AUTO PAY|WF CREDIT|CHASE CREDIT|AMEX|CAPITAL ONE|CITI CARD|DISCOVER|BARCLAYS",
        transfer=r"(?i)EXT TRNSFR|EXTERNAL TRANSFER|BANK TRANSFER|WIRE TRANSFER|JPMORGAN CHASE|FIDELITY|SCHWAB|VANGUARD|MONEYLINE|FID BKG SVC", debits_only=True,
    ),
    "chase_bank": Form(rf"^(\d{{2}})/(\d{{2}})\s+(.+?)\s+(-?)({_MONEY})\s+-?{_MONEY}$", 3, 5, minus=4, section=(r"TRANSACTION DETAIL", r"\*start\*|\*end\*"), rolls=False, skip=r"Beginning Balance|Ending Balance", negative="deposit",
        payment=r"(?i)CREDIT CARD|CREDIT CRD|CRCARDPMT|AUTOPAY|WF CREDIT|CHASE CREDIT|AMEX|AMERICAN EXPRESS|CAPITAL ONE|CITI CARD|DISCOVER|BARCLAYS|BANK OF AMERICA|SYNCHRONY",
        transfer=r"(?i)EXT TRNSFR|EXTERNAL TRANSFER|BANK TRANSFER|WIRE TRANSFER|ZELLE|VENMO|PAYPAL", debits_only=True,
    ),
    "fidelity": Form(rf"^(\d{{2}})/(\d{{2}})\s+\d{{2}}/\d{{2}}\s+\w+\s+(.*?)\s+\$?({_MONEY})(CR)?", 3, 4, minus=5, rolls=False, stitch=1, stop=r"^\d{2}/\d{2}"),
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of text files; texts of other formats come from an extractor of the caller's."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def extracted(spark: SparkSession, path: str, extract) -> DataFrame:
    """(source_file, text) of binary files, by ``extract(bytes) -> str`` on batches."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=pdf["content"].map(extract))[["source_file", "text"]]

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), "content")
    return files.mapInPandas(run, "source_file string, text string")


def bank(text: Column) -> Column:
    out = None
    for name, marks in FORMATS:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(text, F.lit(m))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    # not nullif, which Spark writes out as two matches
    return F.get(F.transform(F.array(F.regexp_extract(text, pattern, group)), lambda m: F.when(m != "", m)), F.lit(0))


def statement_year(text: Column, default: Column) -> Column:
    """The year on the first page, by the forms that banks use, else any year of this century at its beginning, else
    ``default``. Numbers in lines of transactions, which begin with a date and end with an amount, are no years."""
    names = "|".join(MONTHS)
    four = [r"Closing Date:?\s*\d{2}/\d{2}/(\d{4})", r"[A-Z][a-z]{2}\s+\d{1,2},\s+\d{4}\s*-\s*[A-Z][a-z]{2}\s+\d{1,2},\s+(\d{4})", rf"through\s*(?:{names})\s+\d{{1,2}},\s*(\d{{4}})", rf"(?:{names})\s+(\d{{4}})"]
    found = [_first(text, p).cast("int") for p in four]
    short = F.when(_first(text, r"Closing Date\s*\d{2}/\d{2}/(\d{2})\b").isNotNull(), _first(text, r"Closing Date\s*\d{2}/\d{2}/(\d{2})\b").cast("int") + 2000)
    # the line in which the beginning ends is taken whole, so that its amount is seen
    beginning = F.regexp_replace(F.regexp_extract(text, r"(?s)^.{0,500}[^\n]*", 0), _TRANSACTION, "")
    return F.coalesce(*found, short, _first(F.substring(beginning, 1, 500), r"\b(20\d{2})\b").cast("int"), default)


def month_number(name: Column) -> Column:
    """1 to 12 of a month's name or its first three letters, or of a number."""
    named = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m[:3].lower(), i)])
    return F.coalesce(name.try_cast("int"), named[F.lower(F.substring(name, 1, 3))])


def statement_month(text: Column, default: Column) -> Column:
    closing = _first(text, r"Closing Date:?\s+(\d{2})/\d{2}/\d{4}").cast("int")
    span = month_number(_first(text, r"[A-Z][a-z]{2}\s+\d{1,2},\s+\d{4}\s*-\s*([A-Z][a-z]{2})\s+\d{1,2},\s+\d{4}"))
    named = [F.when(text.rlike(rf"{m}\s+\d{{4}}"), i) for i, m in enumerate(MONTHS, 1)]
    return F.coalesce(closing, span, *named, default)


def lines(statements: DataFrame, *more: str) -> DataFrame:
    """The lines of texts, with the columns ``more`` of their statements."""
    return statements.select("source_file", *more, F.posexplode(F.split("text", "\r?\n")).alias("place", "line")).withColumn("line", F.trim("line"))


def _inside(rows: DataFrame, form: Form) -> DataFrame:
    """Rows between a section's start and its end."""
    if not form.section:
        return rows
    start, end = form.section
    mark = F.when(F.col("line").rlike(start), 1).when(F.col("line").rlike(end), 0)
    before = Window.partitionBy("source_file").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"__in": F.last(mark, ignorenulls=True).over(before), "__any": F.max(mark).over(Window.partitionBy("source_file"))})
    inside = F.col("__in") == 1
    return rows.where(inside | F.col("__any").isNull() if form.without_header else inside).drop("__in", "__any")


# Lines of Amex that are no transaction.
AMEX_SKIP = r"Account Ending|Closing Date|Customer Care|Page|Summary|Total|^Card Ending"


def _later_amounts(rows: DataFrame) -> DataFrame:
    """Amex prints the amount of some payments and credits up to five lines below the date: such a line gets what
    follows, up to and with the amount."""
    own = Window.partitionBy("source_file").orderBy("place")
    has = lambda mark: F.col("line").contains(mark)
    section = (
        F.when(has("Payments and Credits") | has("Detail") & has("Payments"), 1)
        .when(has("New Charges") & ~has("Total") & ~has("Summary"), 0)
        .when(F.col("line").startswith("Fees") & ~has("Total"), 0)
        .when(has("Credits") & ~has("Payment") & ~has("Total"), 1)
        .when(has("Payments") & ~has("Credits") & ~has("Total"), 1)
    )
    rows = rows.withColumns({f"__l{k}": F.lead("line", k).over(own) for k in range(1, 6)})
    rows = rows.withColumn("__credits", F.last(section, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    amount = rf"-?\s*\$?({_MONEY})\s*⧫?\s*$"

    def read(acc: Column, nxt: Column) -> Column:
        going = acc["going"] & nxt.isNotNull() & ~nxt.rlike(r"^\d{2}/\d{2}/\d{2}|New Charges|Fees|Total|Summary")
        ends = F.coalesce(nxt.rlike(amount), F.lit(False))
        minus = F.when(nxt.rlike(rf"-\s*\$?{_MONEY}"), "-$").otherwise("$")
        rest = F.nullif(F.trim(F.regexp_replace(nxt, amount, "")), F.lit(""))
        whole = F.concat_ws(" ", acc["said"], rest, F.concat(minus, F.regexp_extract(nxt, amount, 1)))
        said = F.when(going & ~ends & (nxt != ""), F.concat(acc["said"], F.lit(" "), nxt)).otherwise(acc["said"])
        return F.struct(said.alias("said"), F.when(going & ends, whole).otherwise(acc["whole"]).alias("whole"), F.coalesce(going & ~ends, F.lit(False)).alias("going"))

    start = F.struct(F.col("line").alias("said"), F.lit(None).cast("string").alias("whole"), F.lit(True).alias("going"))
    joined = F.aggregate(F.array(*[f"__l{k}" for k in range(1, 6)]), start, read)["whole"]
    opened = F.col("line").rlike(r"^\d{2}/\d{2}/\d{2}\*?\s+.+") & ~F.col("line").rlike(FORMS["amex"].pattern) & (F.col("__credits") == 1)
    return rows.where(~F.col("line").rlike(AMEX_SKIP)).select("source_file", "__year", "__month", "place", F.when(opened, F.coalesce(joined, "line")).otherwise(F.col("line")).alias("line"))


def parse(statements: DataFrame, name: str, as_of_year: int, as_of_month: int, transfers: bool = False) -> DataFrame:
    """Transactions of one bank's statements: row_index, date, description_raw, amount (charges positive, credits
    negative), is_credit, is_payment; with ``transfers`` also transfer_category, what kind of payment it is, where the
    bank tells. Lines that are no transaction, and days that don't exist, are left out."""
    form = FORMS[name]
    dated = statements.withColumns({"__year": statement_year(F.col("text"), F.lit(as_of_year)), "__month": statement_month(F.col("text"), F.lit(as_of_month))})
    rows = _inside(lines(dated.withColumn("text", F.replace("text", F.lit(_CUT), F.lit(""))), "__year", "__month"), form)
    if name == "amex":
        rows = _later_amounts(rows)
    # one match gives all groups of a line; a line that does not match has one part
    whole = F.regexp_replace("line", form.pattern + r"[\s\S]*", _CUT.join(f"${i}" for i in range(1, re.compile(form.pattern).groups + 1)))
    # by an outer generator, since filters that go below a projection match the line again
    rows = rows.select("*", F.explode_outer(F.array(F.split(whole, _CUT))).alias("__g"))
    group = lambda i: F.get("__g", F.lit(i - 1))
    own = Window.partitionBy("source_file").orderBy("place")
    described = F.trim(group(form.description))
    if form.stitch:
        going = F.lit(True)
        for k in range(1, form.stitch + 1):
            nxt = F.lead("line", k).over(own)
            going = going & nxt.isNotNull() & ~nxt.rlike(form.stop)
            described = F.when(going & (nxt != ""), F.concat(described, F.lit(" "), nxt)).otherwise(described)
    rows = rows.withColumn("description_raw", described).where(F.size("__g") > 1)
    if form.skip:
        rows = rows.where(~F.col("line").rlike(form.skip))
    money = lambda i: F.replace(group(i), F.lit(","), F.lit("")).try_cast("decimal(15,2)")
    if form.debit:
        amount = F.when(money(form.debit) > 0, money(form.debit)).otherwise(-money(form.amount))
        credit = amount < 0
    else:
        minus = group(form.minus) != ""
        credit = ~minus if form.negative == "deposit" else minus
        amount = money(form.amount) if form.absolute else F.when(credit, -money(form.amount)).otherwise(money(form.amount))
    year = F.col("__year") if not form.year else F.when(F.length(group(form.year)) == 2, group(form.year).cast("int") + 2000).otherwise(group(form.year).cast("int"))
    date = statement_date(month_number(group(form.month)), group(form.day).cast("int"), year, F.col("__month"), form.rolls and not form.year)
    leaves = ~credit if form.debits_only else F.lit(True)
    card = F.col("description_raw").rlike(form.payment) & leaves
    moved = F.col("description_raw").rlike(form.transfer) & leaves if form.transfer else F.lit(False)
    kind = F.when(card, "Credit Card Payments").when(moved, "Transfers") if form.transfer else F.lit(None).cast("string")
    out = rows.select("source_file", "place", date.alias("date"), "description_raw", amount.alias("amount"), credit.alias("is_credit"), (card | moved).alias("is_payment"), kind.alias("transfer_category"))
    index = F.row_number().over(Window.partitionBy("source_file").orderBy("place")) - 1
    return out.where("date IS NOT NULL AND amount IS NOT NULL").select("source_file", index.alias("row_index"), "date", "description_raw", "amount", "is_credit", "is_payment", *["transfer_category"] * transfers)


def card_tables(rows: DataFrame, as_of_year: int) -> DataFrame:
    """Transactions of a card's tables, given as rows (source_file, table_no, row_no, header and cells, arrays of text): the
    credits first, then the debits, as ``parse`` returns them.

    A table takes part if its header names a date, a description or transaction, and an amount, the first column of each;
    it is one of credits if one of its first three amounts is marked CR. Credits are negative whatever their own mark.
    Rows without one of the three, or whose date or amount can't be read, are left out; a date without a year is of
    ``as_of_year``."""
    low = F.transform("header", lambda h: F.lower(h))

    def cell(*words: str) -> Column:
        hit = F.transform(low, lambda h: F.coalesce(h.rlike("|".join(words)), F.lit(False)))
        at = F.array_position(hit, F.lit(True))
        return F.when(at > 0, F.nullif(F.trim(F.get("cells", at.cast("int") - 1)), F.lit("")))

    named = [F.exists(low, (lambda w: lambda h: h.rlike(w))(w)) for w in ("date", "description|transaction", "amount")]
    own = rows.where(named[0] & named[1] & named[2]).select("source_file", "table_no", "row_no", cell("date").alias("d"), cell("description", "transaction").alias("description_raw"), cell("amount").alias("a"))
    table = Window.partitionBy("source_file", "table_no")
    upto = F.count("a").over(table.orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = own.withColumn("voted", (upto <= 3) & F.lower("a").contains("cr"))
    own = own.withColumn("is_credit", F.coalesce(F.bool_or("voted").over(table), F.lit(False)))
    dated = [F.try_to_timestamp("d", F.lit(f)).cast("date") for f in ("M/d/yyyy", "yyyy-MM-dd")]
    short = F.try_to_timestamp(F.concat_ws("/", "d", F.lit(str(as_of_year))), F.lit("M/d/yyyy")).cast("date")
    value = F.abs(F.regexp_replace("a", r"CR|[$,\s]", "").try_cast("decimal(15,2)"))
    upper = F.upper("description_raw")
    found = own.select(
        "source_file", "table_no", "row_no", F.coalesce(*dated, short).alias("date"), "description_raw", F.when(F.col("is_credit"), -value).otherwise(value).alias("amount"), "is_credit",
        (F.contains(upper, F.lit("PAYMENT")) & F.contains(upper, F.lit("THANK YOU"))).alias("is_payment"),
    ).where("date IS NOT NULL AND amount IS NOT NULL AND description_raw IS NOT NULL")
    credits, debits = found.where("is_credit").withColumn("part", F.lit(0)), found.where("NOT is_credit").withColumn("part", F.lit(1))
    index = F.row_number().over(Window.partitionBy("source_file").orderBy("part", "table_no", "row_no")) - 1
    return credits.unionByName(debits).select("source_file", index.alias("row_index"), "date", "description_raw", "amount", "is_credit", "is_payment")


# Forms of lines of unknown banks, in the order in which they are tried: pattern, date format.
GENERIC = [
    (rf"^(\d{{2}}/\d{{2}}/\d{{4}})\s+(.+?)\s+\$?(-?{_MONEY})\s*((?i)CR)?$", "MM/dd/yyyy"),
    (rf"^(\d{{2}}/\d{{2}}/\d{{2}})\s+(.+?)\s+\$?(-?{_MONEY})\s*((?i)CR)?$", "MM/dd/yy"),
    (rf"^(\d{{2}}/\d{{2}})\s+(.+?)\s+\$?(-?{_MONEY})\s*((?i)CR)?$", "MM/dd"),
    (rf"^((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{{1,2}})\s+(.+?)\s+\$?(-?{_MONEY})()$", "MMM d"),
    (rf"^(\d{{4}}-\d{{2}}-\d{{2}})\s+(.+?)\s+\$?(-?{_MONEY})()$", "yyyy-MM-dd"),
    (rf"^(\d{{2}}-\d{{2}}-\d{{4}})\s+(.+?)\s+\$?(-?{_MONEY})()$", "MM-dd-yyyy"),
]
# Words of lines that are no transaction, and of payments.
GENERIC_SKIP = [
    "STATEMENT", "ACCOUNT", "PAGE", "BALANCE", "TOTAL", "OPENING", "CLOSING", "PREVIOUS", "NEW BALANCE", "PAYMENT DUE", "MINIMUM", "CREDIT LIMIT", "AVAILABLE",
    "APR", "INTEREST RATE", "CUSTOMER SERVICE", "QUESTIONS", "ADDRESS", "PHONE", "MEMBER SINCE", "REWARDS",
]
GENERIC_PAYMENT = ["PAYMENT", "AUTOPAY", "THANK YOU", "ACH PAYMENT"]


def parse_generic(statements: DataFrame, as_of_year: int) -> DataFrame:
    """Transactions of statements of any bank, where lines are a date, a description and an amount. An amount below
    zero or marked CR is a credit and negative."""
    year = statements.select("source_file", statement_year(F.col("text"), F.lit(as_of_year)).alias("__year"))
    rows = lines(statements).where(~F.upper("line").rlike("|".join(GENERIC_SKIP))).join(year, "source_file")
    dates, texts, values, marks = [], [], [], []
    for pattern, form in GENERIC:
        part = lambda i, p=pattern: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
        whole, full = (part(1), form) if "y" in form else (F.concat(part(1), F.lit(" "), F.col("__year").cast("string")), f"{form} yyyy")
        dates.append(F.try_to_timestamp(F.regexp_replace(F.initcap(whole) if "MMM" in form else whole, r"\s+", " "), F.lit(full)).cast("date"))
        texts.append(part(2))
        values.append(F.replace(part(3), F.lit(","), F.lit("")).try_cast("decimal(15,2)"))
        marks.append(part(4))
    amount = F.when(F.coalesce(*marks).isNotNull(), -F.abs(F.coalesce(*values))).otherwise(F.coalesce(*values))
    out = rows.select("source_file", "place", F.coalesce(*dates).alias("date"), F.trim(F.coalesce(*texts)).alias("description_raw"), amount.alias("amount"))
    out = out.where("date IS NOT NULL AND amount IS NOT NULL AND length(description_raw) >= 3")
    index = F.row_number().over(Window.partitionBy("source_file").orderBy("place")) - 1
    return out.select("source_file", index.alias("row_index"), "date", "description_raw", "amount", (F.col("amount") < 0).alias("is_credit"), F.upper("description_raw").rlike("|".join(GENERIC_PAYMENT)).alias("is_payment"))


# Institutions in the order in which they are tried, each with its marks in upper case.
INSTITUTIONS = {
    "Chase": ["CHASE.COM", "JPMORGAN CHASE", "CHASE CREDIT CARDS", "CHASE MOBILE"],
    "Bank of America": ["BANKOFAMERICA.COM", "BANK OF AMERICA"],
    "Wells Fargo": ["WELLSFARGO.COM", "WELLS FARGO"],
    "Citi": ["CITI.COM", "CITIBANK", "CITI CREDIT CARDS"],
    "US Bank": ["USBANK.COM", "U.S. BANK", "US BANK"],
    "Capital One": ["CAPITALONE.COM", "CAPITAL ONE"],
    "American Express": ["AMERICANEXPRESS.COM", "AMERICAN EXPRESS", "AMEX"],
    "Discover": ["DISCOVER.COM", "DISCOVER CARD", "DISCOVER BANK"],
    "PNC": ["PNC.COM", "PNC BANK"],
    "TD Bank": ["TD.COM", "TD BANK"],
    "Ally Bank": ["ALLY.COM", "ALLY BANK"],
    "Navy Federal": ["NAVYFEDERAL.ORG", "NAVY FEDERAL"],
    "USAA": ["USAA.COM", "USAA BANK"],
    "Fidelity": ["FIDELITY.COM", "FIDELITY INVESTMENTS", "FIDELITY REWARDS"],
    "Charles Schwab": ["SCHWAB.COM", "CHARLES SCHWAB"],
    "Synchrony": ["SYNCHRONY.COM", "SYNCHRONY BANK"],
    "Barclays": ["BARCLAYS.COM", "BARCLAY", "BARCLAYCARD"],
}


def institution(text: Column) -> Column:
    """The institution whose mark the text has, or null."""
    upper = F.upper(text)
    out = F.coalesce(*[F.when(upper.rlike("|".join(rf"\Q{m}\E" for m in marks)), name) for name, marks in INSTITUTIONS.items()])
    return out


def _balance(name: str) -> str:
    return rf"(?i){name}\s+\d*(\d{{4}})\s+\$?({_MONEY})\s+\$?({_MONEY})"


def chase_balances(statements: DataFrame) -> DataFrame:
    """Accounts of consolidated statements with last digits, beginning and ending balance, and the end date."""
    money = lambda p, i: F.replace(_first(F.col("text"), p, i), F.lit(","), F.lit("")).cast("decimal(15,2)")
    kinds = {"checking": _balance(r"Chase\s+Total\s+Checking"), "savings": _balance(r"Chase\s+Savings")}
    each = [F.struct(F.lit(k).alias("account"), _first(F.col("text"), p, 1).alias("last4"), money(p, 2).alias("beginning"), money(p, 3).alias("ending")) for k, p in kinds.items()]
    end = _first(F.col("text"), r"(?i)\w+\s+\d{1,2},\s*\d{4}\s*through\s*(\w+\s+\d{1,2},\s*\d{4})")
    day = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(end, r",\s*", ", "), r"\s+", " "), F.lit("MMMM d, yyyy")).cast("date")
    found = statements.select("source_file", day.alias("statement_date"), F.inline(F.array(*each)))
    return found.where("last4 IS NOT NULL")


def ally_balances(statements: DataFrame) -> DataFrame:
    """Accounts with last digits, beginning and ending balance."""
    pattern = rf"(Spending|Savings) Account\s+x*(\d{{4}})\s+\$({_MONEY})\s+\$({_MONEY})"
    found = statements.select("source_file", F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)).alias("line"))
    money = lambda i: F.replace(F.regexp_extract("line", pattern, i), F.lit(","), F.lit("")).cast("decimal(15,2)")
    return found.select("source_file", F.lower(F.regexp_extract("line", pattern, 1)).alias("account"), F.regexp_extract("line", pattern, 2).alias("last4"), money(3).alias("beginning"), money(4).alias("ending"))
