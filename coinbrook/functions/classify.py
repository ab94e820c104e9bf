"""Classification of transactions by keywords, learned merchants and flags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories in the order in which they are tried, each with keywords that decide it. A ledger's
# full list comes as a parameter (see ``keyword_table``); these are the ones used if none is given.
KEYWORDS: list[tuple[str, list[str]]] = [
    ("Restaurants", ["RESTAURANT", "CAFE", "COFFEE", "PIZZA", "BURGER", "GRILL", "SUSHI", "BAR", "DINER", "BBQ"]),
    ("Groceries", ["WHOLE FOODS", "SAFEWAY", "GROCERY", "MARKET", "ALDI", "COSTCO", "FRESH"]),
    ("Gasoline/Fuel", ["SHELL", "CHEVRON", "BP ", "76", "FUEL", "GAS STATION"]),
    ("Automotive", ["AUTO", "CAR WASH", "TIRE", "PARKING", "GARAGE", "TOLL", "BUS", "TRAIN"]),
    ("Travel", ["AIRLINE", "HOTEL", "AIRBNB", "TRAVEL", "INN", "RENTAL CAR"]),
    ("Utilities", ["ELECTRIC", "UTILITY", "POWER", "ENERGY", "SEWER"]),
    ("Cable/Satellite", ["CABLE", "INTERNET", "FIBER"]),
    ("Telephone", ["PHONE", "WIRELESS", "MOBILE"]),
    ("Healthcare/Medical", ["PHARMACY", "DENTAL", "MEDICAL", "HOSPITAL", "HEALTH"]),
    ("Insurance", ["INSURANCE", "POLICY", "PREMIUM"]),
    ("Personal Care", ["GYM", "FITNESS", "SALON", "BARBER", "SPA"]),
    ("Entertainment", ["NETFLIX", "CINEMA", "MOVIE", "GAME", "MUSEUM", "ZOO"]),
    ("Dues & Subscriptions", ["SUBSCRIPTION", "MEMBERSHIP", "ANNUAL FEE"]),
    ("Home Improvement", ["HARDWARE", "LUMBER", "SOLAR"]),
    ("Home Maintenance", ["REPAIR", "CLEANING", "LAWN", "GARDEN"]),
    ("Pets/Pet Care", ["VET", "PET", "DOG", "CAT"]),
    ("Education", ["SCHOOL", "COLLEGE", "TUITION", "BOOKS"]),
    ("Electronics", ["ELECTRONICS", "COMPUTER", "TECH"]),
    ("Clothing/Shoes", ["CLOTHING", "SHOES", "FASHION"]),
    ("Charitable Giving", ["DONATION", "CHARITY"]),
    ("Gifts", ["GIFT", "FLOWERS"]),
    ("Hobbies", ["HOBBY", "CRAFT", "SPORTS"]),
    ("Online Services", ["PAYPAL", "ONLINE", "CLOUD", "WEB"]),
    ("Taxes", ["TAX PAYMENT", "IRS"]),
    ("ATM/Cash", ["ATM", "WITHDRAW"]),
    ("Groceries", ["BUTCHER", "SEAFOOD"]),
    ("Pets/Pet Care", ["CHEWY", "PET FOOD"]),
    ("Travel", ["CRUISE", "RESERVATIONS"]),
    ("General Merchandise", ["AMAZON", "TARGET", "WALMART", "DOLLAR"]),
]

# Words that decide the type.
PAYMENT = ["AUTOPAY", "THANK YOU"]
SALARY = ["SALARY", "PAYROLL", "DEPOSIT", "DIRECT DEP"]
TRANSFER = ["TRANSFER", "ZELLE", "VENMO", "CASHOUT"]
REFUND = ["REFUND", "RETURN", "REVERSAL", "MERCHANDISE/SERVICE RETURN"]
CREDIT = ["CREDIT", "REIMBURSEMENT", "CASHBACK"]
FEE = ["LATE FEE", "ANNUAL FEE", "OVERDRAFT", "INTEREST CHARGE", "MEMBERSHIP FEE"]


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words, as plain parts."""
    return text.rlike("|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words))


def keyword_table(rows: DataFrame) -> list[tuple[str, list[str]]]:
    """A cascade from a table (position, category, keyword): configuration, read on the driver."""
    blocks: dict[tuple, list[str]] = {}
    for r in rows.orderBy("position", "category", "keyword").collect():
        blocks.setdefault((r["position"], r["category"]), []).append(r["keyword"])
    return [(category, words) for (_, category), words in blocks.items()]


def _escaped(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def _tree(words: list[str]) -> str:
    """An expression that matches the longest of the words that begins here; words that begin alike share it."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    branches = "|".join(_escaped(head) + (_tree(rest) if any(rest) else "") for head, rest in sorted(heads.items()))
    return f"(?:{branches}){'?' if '' in words else ''}"


def keyword_category(text: Column, keywords: list[tuple[str, list[str]]] | None = None, default: str = "Other Expenses") -> Column:
    """The category of the first block that has a keyword in the text (upper case).

    One scan finds the longest keyword that begins at each place, overlapping ones too; a keyword that another begins
    with is found with it, so each stands for the least block among itself and those. The least of all that are found
    decides."""
    blocks = keywords or KEYWORDS
    if any(w == "" for _, words in blocks for w in words):  # it is in every text, so later blocks never decide
        at = next(i for i, (_, words) in enumerate(blocks) if "" in words)
        return keyword_category(text, blocks[:at], blocks[at][0]) if at else F.when(text.isNotNull(), blocks[0][0]).otherwise(default)
    least: dict[str, int] = {}
    for i, (_, words) in enumerate(blocks):
        for w in words:
            least.setdefault(w, i)
    if not least:
        return F.lit(default)
    stands = {w: min(least[w[:n]] for n in range(1, len(w) + 1) if w[:n] in least) for w in least}
    numbers = F.create_map(*[F.lit(x) for pair in sorted(stands.items()) for x in pair])
    found = F.regexp_extract_all(text, F.lit(f"(?=({_tree(sorted(stands))}))"), 1)
    first = F.array_min(F.transform(F.array_distinct(found), lambda w: F.element_at(numbers, w)))
    names = F.array(*[F.lit(category) for category, _ in blocks])
    return F.coalesce(F.get(names, first), F.lit(default))


def default_class(description: Column, amount: Column, keywords=None, after_failure: bool = False) -> tuple[Column, Column]:
    """(type, category) by words and sign alone. ``after_failure``: the variant used where another classifier
    failed, which takes PAYMENT as a payment and does not take DEPOSIT or MEMBERSHIP FEE."""
    d = F.upper(F.coalesce(description, F.lit("")))
    payment = has_any(d, [*PAYMENT, "PAYMENT"] if after_failure else PAYMENT)
    salary = has_any(d, [w for w in SALARY if not (after_failure and w == "DEPOSIT")])
    fee = has_any(d, [w for w in FEE if not (after_failure and w == "MEMBERSHIP FEE")])
    by_word = keyword_category(d, keywords)
    back = "Refunds & Reimbursements"
    refunded = F.when(has_any(d, REFUND + CREDIT), back).otherwise(F.when(by_word == "Other Expenses", back).otherwise(by_word))
    kind = F.when(payment, "TRANSFER").when(salary, "INCOME").when(has_any(d, TRANSFER), "TRANSFER").when((amount < 0) | has_any(d, REFUND), "INCOME").otherwise("EXPENSE")
    category = (
        F.when(payment, "Credit Card Payments")
        .when(salary, "Paychecks/Salary")
        .when(has_any(d, TRANSFER), "Transfers")
        .when(amount < 0, refunded)
        .when(has_any(d, REFUND), back)
        .when(fee, "Service Charges/Fees")
        .otherwise(by_word)
    )
    return kind, category


def learned(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    """Adds learned_category and learned_confidence of the user's merchant."""
    known = merchants.select("user_id", F.col("merchant_normalized").alias("merchant"), F.col("category").alias("learned_category"), F.col("confidence").alias("learned_confidence"))
    return tx.join(known, ["user_id", "merchant"], "left")


# Learned categories that stand for transfers.
TRANSFER_CATEGORIES = ["Transfers", "Credit Card Payments"]


def classified(tx: DataFrame, merchants: DataFrame, keywords=None) -> DataFrame:
    """Sets type, category, method, confidence and review flag where no rule matched (matched_rule_id null):
    the learned merchant first, then payment flag, credit flag with a negative amount, then words."""
    rows = learned(tx, merchants)
    none = F.lit(False)
    free = F.col("matched_rule_id").isNull()
    known = F.col("learned_category").isNotNull()
    payment = F.coalesce("is_payment", none) if "is_payment" in tx.columns else none
    credit = (F.coalesce("is_credit", none) if "is_credit" in tx.columns else none) & (F.col("amount") < 0)
    kind, category = default_class(F.col("description_raw"), F.col("amount"), keywords)
    by_merchant = F.when(F.col("learned_category").isin(*TRANSFER_CATEGORIES), "TRANSFER").when(F.col("amount") < 0, "INCOME").otherwise("EXPENSE")
    new = {
        "transaction_type": F.when(known, by_merchant).when(payment, "TRANSFER").when(credit, "INCOME").otherwise(kind),
        "category": F.when(known, F.col("learned_category")).when(payment, "Credit Card Payments").when(credit, "Refunds & Reimbursements").otherwise(category),
        "classification_method": F.when(known, "LEARNED").otherwise("DEFAULT"),
        "confidence": F.when(known, F.col("learned_confidence")).when(payment, 0.9).otherwise(0.7),
        "needs_review": none,
    }
    rows = rows.withColumns({c: F.when(free, v).otherwise(F.col(c)) for c, v in new.items()}).drop("learned_category", "learned_confidence")
    return rows.withColumns({"is_spend": F.col("transaction_type") == "EXPENSE", "is_income": F.col("transaction_type") == "INCOME"})


# Types an outside classifier may return, and what they count as.
OUTSIDE_TYPES = {"PAYMENT": "TRANSFER", "REFUND": "INCOME", "FEE_INTEREST": "EXPENSE"}


def validated(kind: Column, confidence: Column) -> tuple[Column, Column, Column]:
    """(type, confidence, needs_review) of an outside classifier's answer: types mapped or, if unknown,
    UNCATEGORIZED, if missing EXPENSE; confidence held to 0 to 1, 0.8 if missing; below 0.6, or uncategorized, it
    needs a review."""
    mapped = F.when(kind.isNull(), "EXPENSE").when(kind.isin("EXPENSE", "INCOME", "TRANSFER", "UNCATEGORIZED"), kind)
    for name, to in OUTSIDE_TYPES.items():
        mapped = mapped.when(kind == name, to)
    mapped = mapped.otherwise("UNCATEGORIZED")
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.8))))
    return mapped, held, (held < 0.6) | (mapped == "UNCATEGORIZED")


# What an answer may set.
OUTSIDE_FIELDS = ["category", "subcategory", "tags"]


def validated_answers(answers: DataFrame, keep: list[str] = ()) -> DataFrame:
    """An outside classifier's answers (transaction_type, confidence, and of OUTSIDE_FIELDS what there is) as they may
    be stored: types and confidence as in ``validated``, flags by the type, uncategorized ones in a category of their
    own; other columns than those and ``keep`` are dropped."""
    kind, confidence, review = validated(F.col("transaction_type"), F.col("confidence").cast("double"))
    fields = {c: F.col(c) for c in OUTSIDE_FIELDS if c in answers.columns}
    if "category" in fields:
        fields["category"] = F.when(kind == "UNCATEGORIZED", "Uncategorized").otherwise(F.col("category"))
    new = {"transaction_type": kind, **fields, "is_spend": kind == "EXPENSE", "is_income": kind == "INCOME", "confidence": confidence, "needs_review": review, "classification_method": F.lit("LLM")}
    return answers.select(*keep, *[v.alias(c) for c, v in new.items()])
