"""Accounts and their holdings from the texts of brokerage statements.

A statement is a row (source_file, text), its pages separated by form feeds. It is cut into accounts, an account into
sections, a section into lines; holdings come as an array of structs beside the totals that the statement reports, and
are summed and reconciled with these in the same row. A row is all that is ever needed, so nothing is shuffled: however
many statements there are, each is one narrow task's work.

``accounts`` gives one row for each account, ``positions``, ``cash_balances`` and ``rates`` take its arrays and maps apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of a provider in the lower-case text, in the order in which they are tried.
PROVIDERS = {
    "fidelity": ["fidelity investments", "fidelity brokerage", "national financial services", "fidelity management", "fmr llc"],
    "schwab": ["charles schwab", "schwab one", "schwab & co", "schwab.com"],
    "ibkr": ["interactive brokers", "ibkr", "interactivebrokers"],
    "vanguard": ["vanguard", "the vanguard group"],
    "equatex": ["equatex", "employee stock plan", "participant plan holdings"],
    "wealthfront": ["wealthfront", "monthly statement for", "261 hamilton ave"],
}
#: What ``\\s`` means in a pattern.
_BLANKS = " \t\n\x0b\f\r"
# Money, as the providers print it, and the currencies that one of them lists.
_N, _X = r"([\d,]+\.?\d*)", r"([\d,.-]+)"
_FOREIGN = "EUR|HKD|GBP|JPY|CHF|CAD|AUD"
_ORDER = ["EUR", "AUD", "CAD", "HKD", "GBP", "USD"]
MONEY, PRICE, QUANTITY, RATE = "decimal(18,2)", "decimal(18,4)", "decimal(18,6)", "decimal(18,8)"
#: Stand between the groups of a match, and around each match. Statements do not print these control characters; they are
#: taken out of their texts.
_CUT, _AROUND = "\x01", "\x02"
#: What Fidelity's cash is called.
_CASH_WORDS = ["money market", "cash"]
#: Share of the reported total that the sum may differ by.
TOLERANCE, TOLERANCE_FOREIGN = 0.01, 0.02

POSITION = {
    "symbol": "string", "cusip": "string", "security_name": "string", "security_type": "string", "asset_class": "string", "quantity": QUANTITY, "price": PRICE,
    "market_value": MONEY, "cost_basis": MONEY, "currency": "string", "market_value_usd": MONEY, "fx_rate_used": RATE, "is_vested": "boolean",
}

_STRUCT = f"struct<{','.join(f'{name}:{kind}' for name, kind in POSITION.items())}>"


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _cases(cases: list[tuple[Column, str]], otherwise: Column | str | None = None) -> Column:
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out.otherwise(otherwise) if otherwise is not None else out


def provider(text: Column) -> Column:
    """The provider whose mark the text has, the first in order; null if none."""
    return _let(F.lower(text), lambda low: _cases([(_any(low, marks), name) for name, marks in PROVIDERS.items()]))


def account_type(text: Column, of: Column | str = "") -> Column:
    """What kind of account the text is about; ``of``: its provider. Some have words that others need, so order counts."""
    of = F.lit(of) if isinstance(of, str) else of

    def told(low: Column) -> Column:
        has = lambda w: F.contains(low, F.lit(w))
        word = lambda w: has(w) & low.rlike(rf"\b{w}\b")
        # what several words share is looked for first: few texts have it
        return _cases([
            (has("401") & _any(low, ["401(k)", "401k"]), "RETIREMENT_401K"),
            (has("roth i") & _any(low, ["roth ira", "roth individual"]), "IRA_ROTH"),
            (has("ira") & (_any(low, ["traditional ira", "rollover ira"]) | word("ira") & ~has("roth")), "IRA_TRADITIONAL"),
            (_any(low, ["retirement plan"]), "RETIREMENT_401K"),
            ((of == "equatex") | _any(low, ["stock plan"]) | word("rsu") | word("espp"), "STOCK_PLAN"),
        ], "BROKERAGE")

    return _let(F.lower(text), told)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The groups of a pattern that spans the text, by one match; an array of one string where it does not match."""
    return F.split(F.regexp_replace(text, pattern, _CUT.join(f"${i}" for i in range(1, n + 1))), _CUT)


def _matches(text: Column, pattern: str, n: int) -> Column:
    """The groups of each match of a pattern in the text, by one pass over it."""
    cut = F.split(F.regexp_replace(text, pattern, _AROUND + _CUT.join(f"${i}" for i in range(1, n + 1)) + _AROUND), _AROUND)
    return F.transform(F.filter(cut, lambda x, i: i % 2 == 1), lambda x: F.split(x, _CUT))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    # not nullif, which Spark writes out as two matches
    return _let(F.regexp_extract(text, pattern, group), lambda m: F.when(m != "", m))


def _number(text: Column, kind: str = MONEY) -> Column:
    bare = F.translate(text, ",$" + _BLANKS, "")
    return F.when(F.startswith(bare, F.lit("(")), F.regexp_replace(bare, r"^\((.*)\)$", "-$1")).otherwise(bare).try_cast(kind)


def _amount(text: Column, *patterns: str, group: int = 1) -> Column:
    """The first amount that one of the patterns finds, else 0."""
    return F.coalesce(*[_number(_found(text, p, group)) for p in patterns], F.lit(0).cast(MONEY))


def _day(text: Column, form: str) -> Column:
    bare = F.initcap(F.regexp_replace(F.regexp_replace(text, r",\s*", ", "), r"\s+", " "))
    return F.try_to_timestamp(bare, F.lit(form)).cast("date")


def _day_of(year: Column, month: Column, day: Column, form: str = "MMMM d yyyy") -> Column:
    return _day(F.concat_ws(" ", month, day, year), form)


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: _stripped(x))


def _position(**values: Column | str | None) -> Column:
    own = {"currency": "USD"} | values
    return F.struct(*[(own[k] if isinstance(own.get(k), Column) else F.lit(own.get(k))).cast(kind).alias(k) for k, kind in POSITION.items()])


def _worth(found: Column, by: str = "worth") -> Column:
    """Of an array of holdings or nulls those that are worth something."""
    return F.filter(found, lambda p: p[by] > 0)


def _masked(number: Column, otherwise: str = "Unknown") -> Column:
    return F.coalesce(F.concat(F.lit("****"), F.right(number, F.lit(4))), F.lit(otherwise))


# --- what a security is: every provider's own words, in its own order


def security_type(of: str, name: Column, symbol: Column | None = None, category: Column | None = None) -> Column:
    return _let(F.lower(name), lambda low: _type(of, low, symbol, category))


def _type(of: str, low: Column, symbol: Column | None, category: Column | None) -> Column:
    has = lambda *words: _any(low, list(words))
    if of == "fidelity":
        return _cases([
            (has(*_CASH_WORDS), "MONEY_MARKET"), (has("etf", "exchange traded"), "ETF"), (has("fund") & has("index", "etf"), "ETF"), (has("fund"), "MUTUAL_FUND"),
            (has("bond", "treasury", "fixed income"), "BOND"), (has("gold", "silver", "commodity"), "ETF"),
        ], "STOCK")
    if of == "schwab":
        return _cases([
            (has("bank", "sweep", "cash"), "CASH"), (has("money market"), "MONEY_MARKET"), (has("etf", "exchange traded"), "ETF"), (has("fund"), "MUTUAL_FUND"), (has("bond", "treasury"), "BOND"),
        ], "STOCK")
    if of == "vanguard":
        return _cases([
            (has("money market", "cash"), "MONEY_MARKET"), (has("target") & has("retire") | has("trust", "index", "idx"), "MUTUAL_FUND"), (has("etf"), "ETF"), (has("bond", "fixed"), "BOND"),
        ], "MUTUAL_FUND")
    if of == "wealthfront":
        known = F.coalesce(symbol, F.lit(""))
        return _cases([
            (category == "MONEY_MARKET", "MONEY_MARKET"), (category == "CASH", "CASH"), (known.isin("TIMXX", "SWVXX", "SPAXX", "FDRXX") | has("money market"), "MONEY_MARKET"), (low == "cash", "CASH"),
            (has("etf", "exchange traded", "index", "fund"), "ETF"), (known.isin("VTI", "VEA", "VWO", "VIG", "VTIP", "SCHF", "IEMG", "MUB", "LQD", "BNDX", "VNQ", "GLD", "XLE", "VOO"), "ETF"),
        ], "STOCK")
    raise ValueError(f"no words for the securities of {of}")


def asset_class(of: str, kind: Column, name: Column) -> Column:
    """The class of a security of type ``kind``."""
    return _let(F.lower(name), lambda low: _class(of, kind, low))


def _class(of: str, kind: Column, low: Column) -> Column:
    has = lambda *words: _any(low, list(words))
    cash, owned = (kind.isin("CASH", "MONEY_MARKET"), "CASH"), (kind.isin("STOCK", "ETF", "MUTUAL_FUND"), "EQUITY")
    if of == "fidelity":
        return _cases([cash, ((kind == "BOND") | has("bond", "treasury"), "FIXED_INCOME"), (has("gold", "silver", "commodity"), "ALTERNATIVE"), owned], "UNKNOWN")
    if of == "schwab":
        return _cases([cash, ((kind == "BOND") | has("bond", "treasury"), "FIXED_INCOME"), owned], "UNKNOWN")
    if of == "vanguard":
        return _cases([(kind == "MONEY_MARKET", "CASH"), (has("bond", "fixed", "income", "stable", "trust"), "FIXED_INCOME")], "EQUITY")
    if of == "wealthfront":
        return _cases([
            cash, (has("bond", "treasury", "fixed income", "tip", "inflation", "muni"), "FIXED_INCOME"), (has("gold", "silver", "commodity", "real estate", "reit"), "ALTERNATIVE"), owned,
        ], "UNKNOWN")
    raise ValueError(f"no words for the securities of {of}")


# --- cutting statements into accounts: (source_file, account, block, number, reported, several), and what only the whole says

# The period of a statement; a row of the table of accounts: page, name, number, beginning and ending value.
_SPAN = r"(\w+\s+\d{1,2},\s+\d{4})\s*[-–]\s*(\w+\s+\d{1,2},\s+\d{4})"
_ACCOUNT_ROW = rf"(?i)(\d+)\s+(FIDELITY[A-Z\s]+(?:IRA|BROKERAGE|ACCOUNT)[^0-9]+)(\d{{3}}-\d{{6}})\s+\$?{_N}\s+\$?{_N}"


def _one_account(statements: DataFrame) -> DataFrame:
    whole = F.replace(F.col("text"), F.lit("\f"), F.lit("\n"))
    return statements.select("source_file", F.lit(0).alias("account"), whole.alias("block"), F.lit(None).cast("string").alias("number"), F.lit(None).cast(MONEY).alias("reported"), F.lit(False).alias("several"))


def _by_pages(statements: DataFrame) -> DataFrame:
    """Accounts by the pages on which the table of accounts says that they begin; each goes up to the next."""
    rows = F.transform(
        F.regexp_extract_all("text", F.lit(_ACCOUNT_ROW), 0),
        lambda m, i: F.struct(F.regexp_extract(m, _ACCOUNT_ROW, 1).cast("int").alias("page"), i.alias("i"), F.regexp_extract(m, _ACCOUNT_ROW, 3).alias("number"), _number(F.regexp_extract(m, _ACCOUNT_ROW, 5)).alias("reported")),
    )
    own = statements.select("source_file", "text", F.split("text", "\f").alias("pages"), F.array_sort(rows).alias("rows"))
    several = F.contains(F.col("text"), F.lit("Accounts Included in This Report")) & (F.size("rows") > 1)

    def block(row: Column, i: Column) -> Column:
        first = F.greatest(row["page"], F.lit(1))
        upto = F.coalesce(F.get("rows", i + 1)["page"], F.size("pages") + 1)
        pages = F.slice("pages", first, F.greatest(upto - first, F.lit(0)))
        return F.struct(i.alias("account"), F.array_join(pages, "\n").alias("block"), row["number"].alias("number"), row["reported"].alias("reported"))

    alone = F.array(F.struct(F.lit(0).alias("account"), F.array_join("pages", "\n").alias("block"), F.lit(None).cast("string").alias("number"), F.lit(None).cast(MONEY).alias("reported")))
    whole = F.array_join("pages", "\n")
    as_of = F.when(~whole.rlike(_SPAN), _day(_found(whole, r"(?i)as\s+of\s+(\d{1,2}/\d{1,2}/\d{4})"), "M/d/yyyy"))
    # an account's row gets the dates of the whole, not its text
    dates = [F.coalesce(_day(_found(whole, _SPAN, 2), "MMMM d, yyyy"), as_of).alias("end"), _day(_found(whole, _SPAN, 1), "MMMM d, yyyy").alias("start")]
    cut = own.select("source_file", *dates, several.alias("several"), F.when(several, F.transform("rows", block)).otherwise(alone).alias("blocks"))
    return cut.select("source_file", "end", "start", "several", F.inline_outer("blocks")).where("account IS NOT NULL")


def _by_headers(statements: DataFrame) -> DataFrame:
    """Accounts of activity statements: each begins with its account information."""
    whole = F.replace(F.col("text"), F.lit("\f"), F.lit("\n"))
    own = statements.select("source_file", whole.alias("whole"))
    numbers = F.array_distinct(F.regexp_extract_all("whole", F.lit(r"Account\s+(U\d{7,})"), 1))
    several = F.contains(F.col("whole"), F.lit("Account Summary")) & (F.size(numbers) > 1)
    blocks = F.filter(F.split("whole", r"(?=Account Information\s*\n)"), lambda b: b.startswith("Account Information"))
    cut = own.select("source_file", several.alias("several"), F.when(several, blocks).otherwise(F.array("whole")).alias("blocks"))
    cut = cut.select("source_file", "several", F.posexplode_outer("blocks").alias("account", "block")).where("account IS NOT NULL")
    mark = F.when(F.col("several"), F.coalesce(_found(F.col("block"), r"Account\s+(U\d{7,})"), F.concat(F.lit("Unknown_"), "account"))).otherwise(_found(F.col("block"), r"Account\s+([A-Z]\d{7,})"))
    return cut.select("source_file", "account", "block", mark.alias("number"), F.lit(None).cast(MONEY).alias("reported"), "several")


# --- each provider: what an account's block says


def _fidelity(t: DataFrame) -> dict[str, Column]:
    text = F.col("block")
    money2 = r"\$?([\d,]+\.?\d{0,2})"
    held = rf"^([A-Z][A-Z0-9\s&'\-]+(?:\s*\([A-Z]{{1,5}}\))?)\s+{money2}\s+([\d,]+\.?\d{{0,4}})\s+\$?([\d,]+\.?\d{{0,4}})\s+{money2}\s+{money2}\s+-?{money2}"
    core = rf"^(FIDELITY[A-Z\s]+|FDIC[A-Z\s]+)\s+{money2}\s+{money2}"
    mark = r"\(([A-Z]{1,5})\)"

    bare = lambda raw: _stripped(F.regexp_replace(raw, r"\s*\([A-Z]{1,5}\)\s*", ""))

    def line(x: Column, i: Column) -> Column:
        one = lambda g, worth, core: F.struct(i.alias("i"), g.alias("g"), _number(F.get(g, F.lit(worth - 1))).alias("worth"), F.lit(core).alias("core"))
        skipped = _let(F.lower(x), lambda low: _any(low, ["total", "description", "beginning", "continued", "page ", "account"]))
        cash = lambda g: F.when(F.size(g) > 1, one(g, 3, True))
        return F.when(~skipped, _let(_groups(x, held + r"[\s\S]*", 7), lambda g: F.when(F.size(g) > 1, one(g, 5, False)).when(~F.col("several"), _let(_groups(x, core + r"[\s\S]*", 3), cash))))

    def full(m: Column) -> Column:
        below = F.coalesce(_found(F.get("lines", m["i"] + 1), mark), _found(F.get("lines", m["i"] + 2), mark))
        number = lambda k, to=MONEY: _number(F.get(m["g"], F.lit(k - 1)), to)
        known = lambda raw, name, kind: _position(
            symbol=F.coalesce(_found(raw, mark), below), security_name=name, security_type=kind, asset_class=asset_class("fidelity", kind, name),
            quantity=number(3, QUANTITY), price=number(4, PRICE), market_value=m["worth"], cost_basis=number(6),
        )
        security = lambda raw: _let(bare(raw), lambda name: _let(security_type("fidelity", name), lambda kind: known(raw, name, kind)))
        cash = lambda raw: _position(symbol=below, security_name=raw, security_type="MONEY_MARKET", asset_class="CASH", quantity=m["worth"], price=F.lit("1.00"), market_value=m["worth"])
        return _let(_stripped(F.get(m["g"], F.lit(0))), lambda raw: F.when(m["core"], cash(raw)).otherwise(security(raw)))

    def is_cash(m: Column) -> Column:
        """Whether a holding's class is that of cash, by the words that tell ``security_type`` so."""
        return m["core"] | _let(F.lower(bare(_stripped(F.get(m["g"], F.lit(0))))), lambda low: _any(low, _CASH_WORDS))

    pair = lambda name: rf"(?i){name}[^$]*\$[\d,]+\.?\d*[^$]*\${_N}"
    value = _amount(text, *[rf"(?i){p}[:\s]*\$?{_N}" for p in (r"Your\s+Account\s+Value", r"Ending\s+Account\s+Value", r"Account\s+Value")])
    return {
        "number": F.coalesce("number", _found(text, r"(?i)Account\s*(?:Number|#)[:\s]*([A-Z]?\d{2,3}-\d{6})")),
        "statement_date": F.coalesce(_day(_found(text, _SPAN, 2), "MMMM d, yyyy"), "end"),
        "statement_start_date": F.coalesce(_day(_found(text, _SPAN, 1), "MMMM d, yyyy"), "start"),
        # the table of accounts has each account's own value; the section may print that of all
        "total_value": F.coalesce(F.when(F.col("reported") != 0, F.col("reported")), value),
        "total_cash": _amount(text, pair(r"Total\s+Core\s+Account")),
        "total_securities": _amount(text, pair(r"Total\s+Exchange\s+Traded\s+Products")),
        "held": lambda: _worth(F.transform("lines", line)),
        "full": full,
        "is_cash": is_cash,
    }


def _schwab(t: DataFrame) -> dict[str, Column]:
    text = F.col("block")
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    span = rf"(?i)({months})\s*(\d{{1,2}})-(\d{{1,2}}),?\s*(\d{{4}})"
    part = lambda k: F.get("period", F.lit(k - 1))
    as_of = r"(?i)as\s*of\s*(\d{1,2}/\d{1,2})(?:/(\d{4}))?"
    year = F.coalesce(_found(text, as_of, 2), _found(text, r"(?i)(?:Period|Statement).*?(20\d{2})"), _found(text, r"(20\d{2})"))
    held = rf"([A-Z]{{1,5}})\s+([A-Z][A-Z\s]+(?:INC|CORP|LLC|LTD|CO)?)\s+{_N}\s+{_N}\s+{_N}"

    def full(m: Column) -> Column:
        number = lambda k, to=MONEY: _number(F.get(m["g"], F.lit(k - 1)), to)
        known = lambda name, kind: _position(symbol=F.get(m["g"], F.lit(0)), security_name=name, security_type=kind, asset_class=asset_class("schwab", kind, name), quantity=number(3, QUANTITY), price=number(4, PRICE), market_value=m["worth"])
        sweep = _position(security_name="CHARLES SCHWAB BANK SWEEP", security_type="CASH", asset_class="CASH", quantity=m["worth"], price=F.lit("1.00"), market_value=m["worth"])
        return F.when(m["g"].isNull(), sweep).otherwise(_let(_stripped(F.get(m["g"], F.lit(1))), lambda name: _let(security_type("schwab", name), lambda kind: known(name, kind))))

    one = lambda g, worth: F.struct(g.alias("g"), worth.cast(MONEY).alias("worth"))

    total_swept = F.coalesce(_number(_found(text, rf"(?i)Total\s+Cash\s+and\s+Cash\s+Investments[^$]*\$[\d,]+\.?\d*[^$]*\${_N}")), F.lit(0))
    swept = _let(total_swept, lambda w: F.when(w > 0, w).otherwise(_number(_found(text, rf"(?i)Ending\s+Balance[^$]*\${_N}"))))
    matched = F.transform(F.regexp_extract_all(text, F.lit(held), 0), lambda m: _let(_groups(m, held, 5), lambda g: one(g, _number(F.get(g, F.lit(4))))))
    nonzero = lambda a, b: _let(a, lambda x: F.when(x != 0, x).otherwise(b))
    return {
        "early": {"period": _groups(_found(text, span, 0), span, 4)},
        "number": _found(text, r"(?i)Account\s*Number[:\s]*(\d{4}-\d{4})"),
        "statement_date": F.coalesce(_day_of(part(4), part(1), part(3)), _day(F.concat_ws("/", _found(text, as_of), year), "M/d/yyyy")),
        "statement_start_date": _day_of(part(4), part(1), part(2)),
        "total_value": _amount(text, rf"(?i)Ending\s+Account\s+Value[^$]*\${_N}", rf"(?i)Account\s+Value[:\s]*\${_N}", rf"(?i)Total[:\s]*\${_N}\s+100%"),
        "total_cash": nonzero(_amount(text, rf"(?i)Cash\s+and\s+Cash\s+Investments[:\s]*{_N}"), _amount(text, rf"(?i)Total\s+Cash\s+and\s+Cash\s+Investments[^$]*\${_N}[^$]*\${_N}", group=2)),
        "total_securities": nonzero(_amount(text, rf"(?i)(?:Equities|Total\s+Equities)[:\s]*{_N}"), _amount(text, rf"(?i)Total\s+Equities[^$]*\${_N}")),
        "held": _worth(F.concat(matched, F.array(one(F.lit(None).cast("array<string>"), swept)))),
        "full": full,
    }


def _vanguard(t: DataFrame) -> dict[str, Column]:
    text = F.col("block")
    span = r"(\d{1,2}/\d{1,2}/\d{4})\s*[-–]\s*(\d{1,2}/\d{1,2}/\d{4})"
    value = _amount(text, *[rf"(?i){p}[:\s]*\$?{_N}" for p in (r"Total\s+Account\s+Balance", r"Ending\s+balance", r"Total\s+Invested")])
    cash = _amount(text, rf"(?i)Short-Term\s+Reserves[:\s]*\$?{_N}", rf"(?i)Money\s+Market[:\s]*\$?{_N}")
    section = F.regexp_extract(text, r"(?s)Investment Activity[^\n]*\n(.*)", 1)
    section = F.regexp_replace(section, r"(?s)(?:^|\n)[^\n]*(?:Fee Summary|Recommendations|Additional).*$", "")

    def line(x: Column, i: Column) -> Column:
        amounts = F.regexp_extract_all(x, F.lit(r"\$?([\d,]+\.?\d{0,2})"), 1)
        below = F.coalesce(F.get("section", i + 1), F.lit(""))
        goes_on = (F.length(below) > 0) & (F.length(below) < 30) & ~F.contains(below, F.lit("$")) & ~below.rlike(r"^\d")
        name = F.concat(_stripped(F.substring_index(x, "$", 1)), F.when(goes_on, F.concat(F.lit(" "), below)).otherwise(""))
        name = _stripped(F.regexp_replace(name, "[®™]", ""))
        named = lambda worth: _let(name, lambda n: F.when(F.length(n) >= 3, F.struct(n.alias("name"), _number(worth).alias("worth"))))
        fund = F.contains(x, F.lit("$")) & _let(F.lower(x), lambda low: _any(low, ["vanguard", "target", "retire", "trust", "fund", "index"]))
        return F.when(fund, _let(amounts, lambda found: F.when(F.size(found) >= 2, named(F.element_at(found, -1)))))

    return {
        "number": F.coalesce(_found(text, r"(?i)401\(K\)\s*PLAN[–\-]+\s*(\d{6})"), _found(text, r"(?i)Account(?:\s+Number)?[:\s]+(\d{6,})")),
        "statement_date": F.coalesce(_day(_found(text, span, 2), "M/d/yyyy"), _day(_found(text, r"(?i)as\s+of\s+(\d{1,2}/\d{1,2}/\d{4})"), "M/d/yyyy")),
        "statement_start_date": _day(_found(text, span, 1), "M/d/yyyy"),
        "total_value": value,
        "total_cash": cash,
        "total_securities": (value - cash).cast(MONEY),
        "section": _lines(section),
        "held": lambda: _worth(F.transform("section", line)),
        "full": lambda m: _let(security_type("vanguard", m["name"]), lambda kind: _position(security_name=m["name"], security_type=kind, asset_class=asset_class("vanguard", kind, m["name"]), market_value=m["worth"])),
    }


# Headers inside the holdings, and lines there that are no holding.
_WEALTH_HEADER = r"(?im)^(?=[ \t]*(?:(?!.*\$[\d,])(?:(?!.*MONEY MARKET).*(?:ETF|STOCK).*|MONEY MARKET.*|OTHER|CASH))[ \t]*$)"
_WEALTH_SKIP = r"(?i)^security\s+symbol|^total\s+\$|^page\s+\d+|^\d{1,2}/\d{1,2}/\d{4}|^starting\s+balance|^ending\s+balance|^december\s+\d|wealthfront\s*:|^currency\s+value|^us\s+dollar|^holdings\s+as\s+of|^i\.\s+holdings"


def _wealthfront(t: DataFrame) -> dict[str, Column]:
    text = F.col("block")
    value = _amount(text, *[rf"(?i){p}\s*\$?{_N}" for p in (r"Total\s+Holdings\s", r"Ending\s+Balance\s", r"Account\s+Value[:\s]*")])
    cash = _amount(text, rf"(?i)CASH\s+Currency\s+Value\s+US\s+Dollar\s+\$?{_N}")
    month = r"(?i)Monthly\s+Statement\s+for\s+(\w+)\s+(\d{1,2})\s*[-–]\s*(\d{1,2}),?\s+(\d{4})"
    span = r"(?i)Statement\s+Period[:\s]+(\w+\s+\d{1,2})\s*[-–]\s*(\w+\s+\d{1,2}),?\s+(\d{4})"
    part = lambda k: _found(text, month, k)
    day = lambda k: _day(F.concat_ws(", ", _found(text, span, k), _found(text, span, 3)), "MMMM d, yyyy")
    section = F.coalesce(_found(text, r"(?is)(Holdings\s+as\s+of.*)"), text)
    section = _let(section, lambda s: F.coalesce(_found(s, r"(?s)^(.*?Total\s+Holdings\s+\$[\d,]+\.?\d*)"), _found(s, r"(?is)^(.*?)Deposits/Credits\s+to\s+Wealthfront"), _found(s, r"(?is)^(.*?)TRADES\s+Trade\s+Date"), s))
    forms = [rf"^(.+?)\s+({mark})\s+{_N}\s+\$?{_N}\s+\$?{_N}$" for mark in (r"[A-Z][A-Z0-9.]{0,5}", r"[A-Z0-9]{9}")]
    groups = lambda x: _let(_groups(x, forms[0], 5), lambda g: F.when(F.size(g) > 1, g).otherwise(_groups(x, forms[1], 5)))

    def line(category: Column, g: Column) -> Column:
        number = lambda k, to=MONEY: _number(F.get(g, F.lit(k - 1)), to)
        return F.struct(category.alias("category"), g.alias("g"), number(3, QUANTITY).alias("quantity"), number(5).alias("worth"))

    def full(m: Column) -> Column:
        name, mark, category = _stripped(F.get(m["g"], F.lit(0))), F.get(m["g"], F.lit(1)), m["category"]
        long = F.length(mark) == 9
        known = lambda name, kind: _position(
            symbol=F.when(~long, mark), cusip=F.when(long, mark), security_name=name, security_type=kind, asset_class=asset_class("wealthfront", kind, name),
            quantity=m["quantity"], price=_number(F.get(m["g"], F.lit(3)), PRICE), market_value=m["worth"],
        )
        return _let(name, lambda n: _let(security_type("wealthfront", n, F.when(~long, mark), category), lambda kind: known(n, kind)))

    def block(b: Column) -> Column:
        head = F.upper(_stripped(F.substring_index(b, "\n", 1)))
        category = lambda titled: _let(head, lambda h: F.when(~titled, "ETF").when(h.startswith("MONEY MARKET"), "MONEY_MARKET").when(h.isin("OTHER", "CASH"), h).otherwise("ETF"))
        lines = lambda titled: _let(_lines(b), lambda all: F.when(titled, F.slice(all, 2, F.size(all))).otherwise(all))
        read = lambda x, c: _let(groups(x), lambda g: F.when(F.size(g) > 1, F.when(~x.rlike(_WEALTH_SKIP), line(c, g))))
        return _let(b.rlike(_WEALTH_HEADER.replace("(?im)^", "(?im)\\A")), lambda titled: _let(category(titled), lambda c: F.transform(lines(titled), lambda x: read(x, c))))

    # values and quantities beyond these are misread lines
    credible = F.filter(F.flatten(F.transform(F.split(section, _WEALTH_HEADER), block)), lambda p: (p["worth"] <= 10_000_000) & (p["quantity"] <= 1_000_000))
    first = F.filter(F.regexp_extract_all(F.substring(text, 1, 1500), F.lit(r"\b([0-9][A-Z0-9]{7}|[A-Z][0-9A-Z]{7})\b"), 1), lambda m: m.rlike("[A-Z]") & m.rlike("[0-9]"))
    numbers = [r"Wealthfront:\s*([A-Z0-9]{8})\b", r"(?i)ACCOUNT\s+NUMBERS?\s*[\n\r]+(?:Wealthfront:\s*)?([A-Z0-9]{8})", r"JTWROS\d?\s*(?:Apt\s+\d+)?\s*\n?\s*([A-Z0-9]{8})\b"]
    return {
        "account_type": _let(F.lower(text), lambda low: _cases([(_any(low, ["roth ira", "roth individual"]), "IRA_ROTH"), (_any(low, ["traditional ira", "rollover ira"]), "IRA_TRADITIONAL")], "BROKERAGE")),
        "number": F.coalesce(*[_found(text, p) for p in numbers], F.get(first, 0)),
        "statement_date": F.coalesce(_day_of(part(4), part(1), part(3)), day(2)),
        "statement_start_date": F.coalesce(_day_of(part(4), part(1), part(2)), day(1)),
        "total_value": value,
        "total_cash": cash,
        "total_securities": (value - cash).cast(MONEY),
        "held": _worth(credible),
        "full": full,
    }


# Plans of the stock programme and what their shares are.
PLANS = [("Own SAP", "ESPP"), ("Move SAP", "STOCK"), ("Grow SAP", "STOCK")]


def _equatex(t: DataFrame) -> dict[str, Column]:
    text = F.col("block")
    usd, when = r"([\d\s]+\.\d{2})\s*USD", r"(\d{1,2}\s+\w+\s+\d{4})"
    value = _amount(text, r"(?i)Available\s*\n?\s*(?:Locked\s*\n?\s*)?([\d\s]+\.?\d*)\s*USD", rf"(?is)Available.*?Locked.*?{usd}", rf"(?i)[\d\s]+\.\d{{2}}\s*USD\s*\n?\s*Available\s*\n?\s*Locked\s*\n?\s*{usd}")
    price = F.replace(_found(text, r"SAP[:\s]+([\d,\.]+)\s*EUR\s*as\s*of"), F.lit(","), F.lit(".")).try_cast(PRICE)
    free = r"Available\s+([\d\.]+)\s+([\d\s]+\.\d{2})\s*EUR"

    def plan(name: str, kind: str) -> Column:
        """The vested shares of a plan, from the first of its sections that gives details."""
        header = rf"(?s)\Q{name}\E(?=(\s+{usd}.{{0,600}}))\s+{usd}"
        found = F.transform(F.regexp_extract_all(text, F.lit(header), 1), lambda m: _let(_groups(m, rf"(?s)^\s+{usd}(.*)$", 2), lambda g: F.struct(F.get(g, F.lit(0)).alias("worth"), F.get(g, F.lit(1)).alias("body"))))
        near = lambda s: F.substring(s["body"], 1, 200)
        detailed = F.filter(found, lambda s: F.contains(near(s), F.lit("Shares Total")) | near(s).rlike(r"Locked\s+\d+\s+[\d\s]+\.\d{2}\s*USD"))

        def vested(s: Column, before: Column, shares: Column) -> Column:
            same = F.filter(F.regexp_extract_all(before, F.lit(rf"[\d\.]+\s+{usd}"), 0), lambda m: F.abs(_number(F.regexp_extract(m, r"^([\d\.]+)", 1), QUANTITY) - shares) < 0.001)
            worth = _number(_found(F.get(same, 0), rf"^[\d\.]+\s+{usd}"))
            worth = F.coalesce(worth, F.when(s["body"].rlike(r"Locked\s+0\s+0\.00\s*EUR"), _number(s["worth"])))
            held = lambda w: _position(symbol="SAP", security_name=f"{name} - Shares", security_type=kind, asset_class="EQUITY", quantity=shares, price=F.col("price"), market_value=w, is_vested=F.lit(True))
            return F.when(shares > 0, _let(worth, lambda w: F.when(w > 0, F.struct(F.lit(True).alias("settles"), held(w).alias("held")))))

        def read(s: Column) -> Column:
            """Whether a section settles the plan, and with what; locked shares alone settle it with nothing."""
            locked = s["body"].rlike(r"Locked\s+\d+\s+[\d\s]+\.\d{2}\s*USD")
            nothing = F.struct(locked.alias("settles"), F.lit(None).cast(_STRUCT).alias("held"))
            # the first place that the match's text has is that of the match
            owned = lambda m: _let(_number(F.regexp_extract(m, free, 1), QUANTITY), lambda shares: vested(s, F.call_function("substring_index", s["body"], m, F.lit(1)), shares))
            return _let(_found(s["body"], free, 0), lambda m: F.when(m.isNotNull(), owned(m)).otherwise(nothing))

        return F.get(F.filter(F.transform(detailed, read), lambda s: s["settles"]), 0)["held"]

    span = r"(\d{1,2}\s+\w{3}\s+\d{4})\s*[-–]\s*(\d{1,2}\s+\w{3}\s+\d{4})"
    return {
        "number": _found(text, r"(?i)User\s+ID[:\s]+(\d+)"),
        "statement_date": F.coalesce(_day(_found(text, rf"(?i)as\s+of\s+{when}"), "d MMM yyyy"), _day(_found(text, span, 2), "d MMM yyyy")),
        "statement_start_date": _day(_found(text, span, 1), "d MMM yyyy"),
        "total_value": value,
        "total_cash": F.lit(0).cast(MONEY),
        "total_securities": value,
        "price": price,
        "held": lambda: _worth(F.array(*[plan(*p) for p in PLANS]), "market_value"),
        "worth": "market_value",
    }


def _last_of_key(entries: Column) -> Column:
    """A map of (key, value) entries; of equal keys the last counts."""
    kept = lambda all: F.filter(all, lambda e, i: ~F.exists(F.slice(all, i + 2, F.size(all)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(_let(entries, kept))


def _entries(text: Column, pattern: str, groups: int, kind: str) -> Column:
    """(key, value) by the first and the last group of a pattern."""
    entry = lambda g: F.struct(F.get(g, F.lit(0)).alias("key"), _number(F.get(g, F.lit(groups - 1)), kind).alias("value"))
    found = F.transform(_matches(text, pattern, groups), entry)
    return F.filter(found, lambda e: e["value"].isNotNull())


def _ibkr(t: DataFrame) -> dict[str, Column]:
    text = F.col("block")
    span = r"(\w+\s+\d{1,2},\s+\d{4})\s*-\s*(\w+\s+\d{1,2},\s+\d{4})"
    fourth = lambda name: _amount(text, rf"{name}\s+{_X}\s+{_X}\s+{_X}\s+{_X}", group=4)
    forex = F.regexp_extract(text, r"(?is)Forex Balances.*?Description\s+Quantity\s+Cost Price.*?Forex\s*USD(.*?)(?:Total|Trades|\n\n)", 1)
    closing = _entries(forex, rf"(?=[EHGJCA])({_FOREIGN})\s+{_X}\s+([\d.]+)\s+{_X}\s+([\d.]+)", 5, RATE)
    marked = F.filter(_entries(text, rf"(?=[EHGJCA])({_FOREIGN})\s+[\d,.-]+\s+[\d,.-]+\s+[\d.]+\s+([\d.]+)", 2, RATE), lambda e: (e["value"] >= 0.01) & (e["value"] <= 1000))
    dollar = F.array(F.struct(F.lit("USD").alias("key"), F.lit(1).cast(RATE).alias("value")))
    rates = _last_of_key(F.concat(_let(closing, lambda own: F.when(F.size(own) > 0, own).otherwise(marked)), dollar))
    cash = _last_of_key(_entries(text, rf"(?=[EHGJCAU])({_FOREIGN}|USD)\s+{_X}\s+[\d.]+\s+", 2, MONEY))
    named = F.transform(
        F.regexp_extract_all(text, F.lit(r"[A-Z0-9]{2,10}\s+[A-Z][A-Za-z\s&.'()-]+?\s+\d{6,}"), 0),
        lambda m: F.struct(F.regexp_extract(m, r"^([A-Z0-9]{2,10})\s", 1).alias("key"), _stripped(F.regexp_extract(m, r"^[A-Z0-9]{2,10}\s+(.*?)\s+\d{6,}$", 1)).alias("value")),
    )
    names = _last_of_key(F.filter(named, lambda e: F.length(e["value"]) > 3))
    held = rf"([A-Z0-9]{{2,10}})\s+(\d[\d,]*)\s+1\s+([\d.]+)\s+{_X}\s+([\d.]+)\s+{_X}"
    opened = F.regexp_extract(text, r"(?s)Open Positions.*?Symbol.*?Stocks\s*(.*?)(?:Total Stocks in USD|Forex Balances|Financial Instrument|\z)", 1)

    def rows(part: Column, currency: str) -> Column:
        rate = F.coalesce(F.element_at("fx_rates", F.lit(currency)), F.lit(1).cast(RATE))

        def match(g: Column) -> Column:
            dollars = lambda worth: F.struct(g.alias("g"), worth.alias("own"), F.round(worth * rate, 2).cast(MONEY).alias("worth"), rate.alias("rate"), F.lit(currency).alias("currency"))
            return _let(_number(F.get(g, F.lit(5))), dollars)

        return F.transform(_matches(part, held, 6), match)

    def block(c: str) -> Column:
        body = F.regexp_extract(F.col("opened"), rf"(?s)(?:^|\n){c}\n(.*?)(?:\nTotal\b|\n(?:{'|'.join(_ORDER)})\n|\z)", 1)
        return F.when(F.contains("opened", F.lit(f"{c}\n")), body).otherwise("")

    by_currency = F.concat(*[rows(block(c), c) for c in _ORDER])
    dollars = rows(F.regexp_extract(text, r"(?s)Stocks\s*USD\s*(.*?)(?:Total|EUR|HKD|AUD|CAD|\z)", 1), "USD")
    anywhere = F.filter(rows(text, "USD"), lambda m: ~F.get(m["g"], F.lit(0)).isin("EUR", "HKD", "USD", "GBP", "JPY") & (_number(F.get(m["g"], F.lit(1)), QUANTITY) > 0))

    def full(m: Column) -> Column:
        number = lambda k, to=MONEY: _number(F.get(m["g"], F.lit(k - 1)), to)
        symbol = F.get(m["g"], F.lit(0))
        return _position(
            symbol=symbol, security_name=F.coalesce(F.element_at("names", symbol), symbol), security_type="STOCK", asset_class="EQUITY", quantity=number(2, QUANTITY), price=number(5, PRICE),
            market_value=m["own"], cost_basis=number(4), currency=m["currency"], market_value_usd=m["worth"], fx_rate_used=m["rate"],
        )

    return {
        "early": {"period": _groups(_found(text, span, 0), span, 2)},
        "statement_date": _day(F.get("period", F.lit(1)), "MMMM d, yyyy"),
        "statement_start_date": _day(F.get("period", F.lit(0)), "MMMM d, yyyy"),
        "base_currency": F.coalesce(_found(text, r"Base Currency\s+([A-Z]{3})"), F.lit("USD")),
        "total_value": fourth("Total"),
        "total_cash": fourth("Cash"),
        "total_securities": fourth("Stock"),
        "fx_rates": rates,
        "cash_by_currency": cash,
        "names": names,
        "opened": opened,
        "full": full,
        "held": lambda: _let(by_currency, lambda all: F.when(F.size(all) > 0, all).otherwise(_let(dollars, lambda d: F.when(F.size(d) > 0, d).otherwise(anywhere)))),
    }


_FORMS: dict[str, tuple[Callable, Callable]] = {
    "fidelity": (_by_pages, _fidelity), "schwab": (_one_account, _schwab), "ibkr": (_by_headers, _ibkr), "vanguard": (_one_account, _vanguard), "equatex": (_one_account, _equatex), "wealthfront": (_one_account, _wealthfront),
}
_COLUMNS = [
    "source_file", "account", "provider", "account_type", "account_number", "account_identifier", "statement_date", "statement_start_date", "base_currency", "total_value", "total_cash", "total_securities",
    "positions", "fx_rates", "cash_by_currency", "calculated_total", "reconciliation_diff", "is_reconciled",
]


def accounts(statements: DataFrame, of: str) -> DataFrame:
    """One row for each account of one provider's statements (source_file, text): what the statement says of it, its
    ``positions`` in order, their sum, and whether that is the reported total within the provider's tolerance.

    Amounts that a statement does not print are 0, dates null, unknown accounts ``Unknown``. A total of 0 is reconciled
    by a sum of 0 only. A null text makes an account of nothing.
    """
    split, read = _FORMS[of]
    cut = split(statements.select("source_file", reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), (_CUT, _AROUND), F.coalesce("text", F.lit(""))).alias("text")))
    said = read(cut)
    cut = cut.withColumns(said.pop("early", {}))
    kept = [F.col(c) for c in ("source_file", "account", "block", "several")]
    # what is held and worth is one column, so that totals need no names and classes of securities, and positions no second match
    held, full, is_cash, worth = said.pop("held"), said.pop("full", None), said.pop("is_cash", None), said.pop("worth", "worth")
    blank = {"fx_rates": F.lit(None).cast(f"map<string,{RATE}>"), "cash_by_currency": F.lit(None).cast(f"map<string,{MONEY}>"), "base_currency": F.lit("USD"), "account_type": account_type(F.col("block"), of), "number": F.col("number")}
    said = blank | said
    out = cut.select(*kept, _lines(F.col("block")).alias("lines"), *[c.alias(k) for k, c in said.items()])
    if isinstance(held, Column):  # said by the block alone
        out = cut.select(*kept, _lines(F.col("block")).alias("lines"), *[c.alias(k) for k, c in said.items()], held.alias("held"))
    else:
        out = out.withColumn("held", held())
    out = out.withColumn("positions", F.transform("held", full) if full else F.col("held"))
    total = F.aggregate(F.col(f"held.{worth}"), F.lit(0).cast("decimal(38,2)"), lambda acc, w: (acc + F.coalesce(w, F.lit(0))).cast("decimal(38,2)")).cast(MONEY)
    if of == "ibkr":
        each = F.transform(F.map_entries("cash_by_currency"), lambda e: (e["value"] * F.coalesce(F.element_at("fx_rates", e["key"]), F.lit(1).cast(RATE))).cast("decimal(38,8)"))
        in_cash = F.aggregate(each, F.lit(0).cast("decimal(38,8)"), lambda acc, x: (acc + x).cast("decimal(38,8)"))
        own = (total + in_cash).cast(MONEY)
        compared, tolerance, unknown = own, TOLERANCE_FOREIGN, "****0000"
    else:
        own, tolerance, unknown = total, TOLERANCE, "Unknown"
        compared = F.when(F.exists("held", is_cash), own).otherwise((own + F.col("total_cash")).cast(MONEY)) if is_cash else own
    out = out.withColumns({"provider": F.lit(of), "account_number": F.col("number"), "account_identifier": _masked(F.col("number"), unknown), "calculated_total": own, "compared": compared})
    diff = F.abs(F.col("total_value") - F.col("compared")).cast(MONEY)
    sound = F.when(F.col("total_value") == 0, F.col("compared") == 0).otherwise(diff / F.col("total_value") <= tolerance)
    return out.withColumns({"reconciliation_diff": diff, "is_reconciled": sound}).select(*_COLUMNS)


def positions(found: DataFrame) -> DataFrame:
    """The positions of ``accounts``, with the account's columns and row_index from 0."""
    # an outer generator: before an inner one Spark works the whole array out once more, to see whether it is empty
    each = found.select("source_file", "account", "account_identifier", "statement_date", F.posexplode_outer("positions").alias("row_index", "p")).where("row_index IS NOT NULL")
    return each.select("source_file", "account", "account_identifier", "statement_date", "row_index", "p.*")


def cash_balances(found: DataFrame) -> DataFrame:
    """Cash by currency, in the currency and in dollars at the statement's own rates (1 where it has none)."""
    each = found.select("source_file", "account", "account_identifier", "statement_date", "fx_rates", F.explode_outer("cash_by_currency").alias("currency", "amount")).where("currency IS NOT NULL")
    rate = F.coalesce(F.element_at("fx_rates", F.col("currency")), F.lit(1).cast(RATE))
    return each.select("source_file", "account", "account_identifier", "statement_date", "currency", "amount", F.round(F.col("amount") * rate, 2).cast(MONEY).alias("amount_usd"))


def rates(found: DataFrame) -> DataFrame:
    """The rates to dollars that statements hold."""
    return found.select("source_file", "account", "statement_date", F.explode_outer("fx_rates").alias("currency", "rate")).where("currency IS NOT NULL")
