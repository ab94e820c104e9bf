"""Conversations formatted for training by Spark expressions alone.

A conversation becomes one text: a block for each run of turns of one role, ``### role: `` in front, ``</turn>`` and a
line break behind, ``</part>`` between the turns that were merged. Texts are escaped, so that none of these strings is
left in them: a backslash becomes ``\\b``, ``###`` becomes ``\\h``, ``</turn>`` ``\\t``, ``</part>`` ``\\p`` (and a colon in a
role ``\\c``). Every backslash then begins such a code, which makes reading back exact, turn by turn.

The loss mask is a list of spans, one for each turn of a role that is learned: where its escaped text begins and how long
it is, in code points and in bytes of UTF-8. Headers, ends and separators are never under it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# What marks turns, and the codes that stand for these strings in texts, in the order of their making.
HEAD, COLON, PART, END = "### ", ": ", "</part>", "</turn>\n"
CODES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("</part>", "\\p")]
ROLE_CODES = [*CODES, (":", "\\c")]
LEARNED = ("assistant",)


def escaped(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), codes, text)


def unescaped(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(codes), text)


def _header(role: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(COLON))


def format(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """One row for each conversation: ``id``, ``formatted``, and ``loss_spans``, an array of structs (start, length,
    byte_start, byte_length; from 0) in order.

    Turns are taken by ``turn``, null first, ties by role and text; repeated rows are turns of their own. Null roles and
    texts are empty ones; rows of a null id are one conversation. Turns of equal roles that follow each other share a
    block. A conversation is one value of a row and so at most 2 GB; work is linear in its length. Other columns are
    ignored, whatever their names. An empty table gives an empty one.
    """
    empty = F.lit("")
    raw = rows.select(
        F.col(id).alias("c"), F.col(turn).alias("n"), F.coalesce(F.col(role).cast("string"), empty).alias("plain"), F.coalesce(F.col(text).cast("string"), empty).alias("t")
    )
    own = raw.select("c", "n", escaped(F.col("plain"), ROLE_CODES).alias("r"), F.col("plain").isin(*learned).alias("y"), escaped(F.col("t")).alias("x"))
    # offsets are running sums; the window and the groups below share one shuffle, by conversation
    w = Window.partitionBy("c").orderBy("n", "r", "x")
    last = F.lag("r").over(w)
    front = F.when(last.isNull(), _header(F.col("r"))).when(last == F.col("r"), F.lit(PART)).otherwise(F.concat(F.lit(END), _header(F.col("r"))))
    own = own.withColumn("front", front)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = {k: (f("front") + f("x")).cast("long") for k, f in (("s", F.length), ("b", F.octet_length))}
    own = own.withColumns({k: F.sum(c).over(upto) for k, c in sizes.items()})
    own = own.select("c", F.struct("n", "r", "x", "s", "y", (F.col("s") - F.length("x")).alias("start"), F.length("x").cast("long").alias("length"), (F.col("b") - F.octet_length("x")).alias("byte_start"), F.octet_length("x").cast("long").alias("byte_length")).alias("one"))
    grouped = own.groupBy("c").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    firsts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["r"] != F.get("turns", i - 1)["r"]))
    grouped = grouped.withColumn("firsts", firsts)

    def block(first: Column, k: Column) -> Column:
        merged = F.slice("turns", first + 1, F.coalesce(F.get("firsts", k + 1), F.size("turns")) - first)
        return F.concat(_header(F.get("turns", first)["r"]), F.array_join(F.transform(merged, lambda t: t["x"]), PART), F.lit(END))

    spans = F.transform(F.filter("turns", lambda t: t["y"]), lambda t: F.struct(*[t[k].alias(k) for k in ("start", "length", "byte_start", "byte_length")]))
    return grouped.select(F.col("c").alias(id), F.array_join(F.transform("firsts", block), "").alias("formatted"), spans.alias("loss_spans"))


def turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as it was given: an array of structs (role, text)."""
    blocks = F.split(formatted, END, -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # behind the last end is nothing

    def read(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(len(HEAD) + 1)), COLON, 1)
        body = F.substr(b, F.length(role) + len(HEAD) + len(COLON) + 1)
        return F.transform(F.split(body, PART, -1), lambda x: F.struct(unescaped(role, ROLE_CODES).alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, read))


def under_mask(raw: Column, spans: Column) -> Column:
    """What the spans cover of ``raw`` (the formatted text as binary), unescaped, one after the other."""
    cover = F.transform(spans, lambda s: F.substring(raw, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string"))
    return F.array_join(F.transform(cover, lambda x: unescaped(x)), "")


#: Texts of this conversation hold what marks turns.
PROBE = "\\### Assistant: </turn> ok"


def op12_chat_format(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7 formatted, written, read back and taken apart again. Null texts are empty
    turns, ties are taken by role and text, an empty table leaves conversation -7 alone."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = written(format(rows.unionByName(probe)), "chat")
    read = out.select("conv_id", "formatted", F.col("formatted").cast("binary").alias("raw"), "loss_spans", turns(F.col("formatted")).alias("turns"))
    read = read.withColumn("loss", under_mask(F.col("raw"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(k)),
sized AS (
    SELECT *, length(replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), '</part>', '\p')) AS chars,
        length(replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), '</part>', '\p'), ':', '\c')) AS role_chars,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
    FROM rows)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars + CASE WHEN before = role THEN 7 ELSE role_chars + 6 + 8 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
