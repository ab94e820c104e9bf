"""Document fingerprints as invertible Bloom lookup sketches of hashed paragraphs, in Spark SQL only.

A paragraph is a line, or a piece of one: a line is also cut behind every word whose hash is a multiple of
CUT_WORDS, so pieces have that many words on average, at any length of text and line, and one changed word
changes a piece or two. A line without blanks is one piece.

A sketch has three tables of 2**bits cells; a digest adds a count, itself and a check hash (both by xor) to one
cell of each, by its hash modulo 2**bits. So a sketch folds to any smaller size without the text. A fingerprint is
the sketch of a text at the size that its own number of digests asks for.

Two fingerprints are folded to the smaller one's size and subtracted cell by cell; what both texts hold cancels.
Peeling then recovers the differing digests: a cell of count 1 or -1 whose check fits its digest holds just that
one, which is taken out of its other cells. The three tables take turns, so a digest is taken out once. Where cells
are left over the pair is tried again with sketches of twice the size of the larger fingerprint, then four times
that at each further attempt, until all are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released, written

#: Mean words of a piece of a line.
CUT_WORDS = 16
#: Turns of peeling (each of one table) before a pair counts as failed, and attempts before giving up.
TURNS, ATTEMPTS = 15, 12
#: Digests of texts in a task, whose cells are many times their own size, and the most tasks that are made of them;
#: beyond those tasks grow, and spill.
TASK_DIGESTS, MOST_TASKS = 40_000, 20_000
_KEY = ["did", "h"]


def paragraphs(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    words = F.transform(F.split(text, "\n"), lambda line: F.split(line, " "))  # bound here, split once for each line
    ends = F.transform(words, lambda w: F.struct(w.alias("w"), F.filter(
        F.sequence(F.lit(1), F.size(w)), lambda i: (i == F.size(w)) | (F.pmod(F.xxhash64(F.element_at(w, i)), F.lit(CUT_WORDS)) == 0)
    ).alias("e")))

    def piece(line: Column, end: Column, k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(line["e"][k - 1])
        return F.xxhash64(F.slice(line["w"], begin + 1, end - begin))

    return F.array_distinct(F.flatten(F.transform(ends, lambda line: F.transform(line["e"], lambda end, k: piece(line, end, k)))))


def _cell(digest: str, table: int) -> str:
    """The cell of a digest in one of the tables, in SQL."""
    return f"(pmod(xxhash64({digest}, {table}), shiftleft(1L, bits)) + {table} * shiftleft(1L, bits))"


def _bits(count: str) -> str:
    """Bits of a table for so many digests: three tables have 3.6 to 7.2 cells for each, so that two texts of one
    size that share nothing can mostly be peeled at once; where their sizes differ more they are tried again."""
    return f"cast(greatest(2, ceil(log2(greatest({count}, 1) * 1.2))) as int)"


def _cells(rows: DataFrame, key: list[str]) -> DataFrame:
    """Sketches of the digests in ``rows`` (key, bits, sign, d): their cells that are not empty."""
    spread = rows.select(*key, "bits", F.col("sign").alias("n"), "d", F.expr("xxhash64(d, -1L)").alias("check"), F.expr(f"explode(array({', '.join(_cell('d', t) for t in range(3))}))").alias("cell"))
    return _merged(spread, [*key, "bits", "cell"])


def _merged(cells: DataFrame, by: list[str]) -> DataFrame:
    summed = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("check").alias("check"))
    return summed.where("n <> 0 OR d <> 0 OR check <> 0")


def _sized(found: DataFrame) -> DataFrame:
    return found.withColumns({f"n_{c}": F.size(c) for c in ("own", "edited", "next")})


def sketches(found: DataFrame, sides: list[str], keep: list[str]) -> DataFrame:
    """(did, h, *keep, side, total, bits, cell, n, d, check): the sketches of the digests in the columns named, each
    at its own size. ``total`` is the number of its digests."""
    each = ", ".join(f"struct({k} AS side, {column} AS a)" for k, column in enumerate(sides))
    sets = found.select(*_KEY, *keep, F.expr(f"inline(array({each}))"))
    rows = sets.select(*_KEY, *keep, "side", F.size("a").alias("total"), F.expr(_bits("size(a)")).alias("bits"), F.lit(1).cast("long").alias("sign"), F.explode("a").alias("d"))
    return _cells(rows, [*_KEY, *keep, "side", "total"])


def subtracted(found: DataFrame) -> DataFrame:
    """(did, h, kind, bits, cell, n, d, check): the fingerprint of each text less that of its edited version (kind 0)
    and less that of the next document (kind 1), both folded to the smaller one's size."""
    sketched = sketches(_sized(found), ["own", "edited", "next"], ["n_own", "n_edited", "n_next"])
    # a fingerprint says its own size; the other's is carried along
    pairs = sketched.select(*_KEY, F.col("bits").alias("b"), F.col("cell").alias("c"), "d", "check", F.expr(
        "inline(CASE side WHEN 0 THEN array(struct(0 AS kind, n AS n, n_edited AS other), struct(1 AS kind, n AS n, n_next AS other))"
        " ELSE array(struct(side - 1 AS kind, -n AS n, n_own AS other)) END)"
    ))
    pairs = pairs.withColumn("bits", F.least("b", F.expr(_bits("other"))))
    folded = pairs.withColumn("cell", F.expr("pmod(c, shiftleft(1L, bits)) + (c div shiftleft(1L, b)) * shiftleft(1L, bits)"))
    return _merged(folded, [*_KEY, "kind", "bits", "cell"])


def _resketched(found: DataFrame, open_pairs: DataFrame, attempt: int) -> DataFrame:
    """The same for the pairs that failed, of sketches made anew at a larger size."""
    larger = f"{_bits('greatest(size(a), size(b))')} + {2 * attempt - 1}"
    sets = found.select(*_KEY, F.expr("inline(array(struct(0 AS kind, own AS a, edited AS b), struct(1 AS kind, own AS a, next AS b)))"))
    sets = sets.join(open_pairs.select(*_KEY, "kind"), [*_KEY, "kind"], "left_semi")
    signed = "inline(concat(transform(a, x -> struct(1L AS sign, x AS d)), transform(b, x -> struct(-1L AS sign, x AS d))))"
    return _cells(sets.select(*_KEY, "kind", F.expr(larger).alias("bits"), F.expr(signed)), [*_KEY, "kind"])


def peel(cells: DataFrame, key: list[str], turns: int = TURNS) -> DataFrame:
    """Recovers what subtracted sketches hold. One row per key that had any cell: the digests of the first text alone
    (``plus``) and of the second alone (``minus``), and whether any cell is left over (``failed``)."""
    state = cells.select(*key, "bits", "cell", F.lit(0).cast("long").alias("found"), "n", "d", "check")
    for turn in range(turns):
        table = turn % 3
        pure = f"(cell >= 0 AND abs(n) = 1 AND check = xxhash64(d, -1L) AND cell div shiftleft(1L, bits) = {table})"
        others = ", ".join(f"struct({_cell('d', t)} AS cell, 0L AS found, -n AS n, d AS d, check AS check)" for t in range(3) if t != table)
        # a recovered digest leaves its cell, stays as a row of its own and is taken out of its other two cells
        out = f"struct(-1L AS cell, d AS found, n AS n, d AS d, check AS check), {others}"
        same = "array(struct(cell AS cell, found AS found, n AS n, d AS d, check AS check))"
        state = _merged(state.select(*key, "bits", F.expr(f"inline(if({pure}, array({out}), {same}))")), [*key, "bits", "cell", "found"])
    only = lambda n: F.collect_list(F.when((F.col("cell") == -1) & (F.col("n") == n), F.col("d")))
    return state.groupBy(*key).agg(only(1).alias("plus"), only(-1).alias("minus"), F.max(F.col("cell") >= 0).alias("failed"))


def _ranges(keys: DataFrame, parts: int) -> list[tuple]:
    """The first and the last key (did, h) of each of up to ``parts`` ranges of about as many rows, in order."""
    ranged = keys.repartitionByRange(parts, *_KEY).groupBy(F.spark_partition_id().alias("part"))
    ends = ranged.agg(F.min(F.struct(*_KEY)).alias("first"), F.max(F.struct(*_KEY)).alias("last")).collect()  # one row per range
    return sorted((tuple(r["first"]), tuple(r["last"])) for r in ends)


def _in_order(docs: DataFrame, text: str, id: str) -> DataFrame:
    """(part, home, did, h, text): the rows dealt by ranges of their keys; the last key of each range is a guest (not
    at ``home``) in the next one, that of the last range in the first."""
    spark = docs.sparkSession
    did = F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63)))
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = docs.select(did.alias("did"), F.xxhash64(content).alias("h"), content.alias("text"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = _ranges(whole.select(*_KEY), parts)
    parts = max(1, len(ranges))
    key = "struct<did: long, h: long>"
    bounds = spark.createDataFrame([([r[0] for r in ranges], [r[1] for r in ranges])], f"firsts array<{key}>, lasts array<{key}>")
    placed = whole.crossJoin(F.broadcast(bounds)).withColumn("own", F.struct(*_KEY))
    placed = placed.withColumn("at", F.size(F.filter("firsts", lambda first: first <= F.col("own"))) - 1)
    places = F.expr(f"""inline(if(own = lasts[at], array(struct(at AS part, true AS home), struct(pmod(at + 1, {parts}) AS part, false AS home)), array(struct(at AS part, true AS home))))""")
    return placed.select(*_KEY, "text", places).repartitionById(parts, F.col("part"))


def versions(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """By key: ``copies`` (rows of the document), ``n_chars``, ``edited_sha256``, and the paragraph digests of the
    text (``own``), of its edited version (``edited``) and of the next document (``next``). The whole texts move
    once, in the order of their keys: the next document in descending order of the id is the row before."""
    dealt = _in_order(docs, text, id).withColumn("own", paragraphs(F.col("text")))
    order = Window.partitionBy("part").orderBy("home", *_KEY)
    before = F.lag(F.struct("home", *_KEY, "text", "own")).over(order)
    rows = dealt.withColumn("before", before).withColumn("copies", F.count("*").over(Window.partitionBy("part", "home", *_KEY)))
    again = F.coalesce((F.col("before.home") == F.col("home")) & (F.col("before.did") == F.col("did")) & (F.col("before.h") == F.col("h")), F.lit(False))
    both = rows.where(F.col("home") & ~again).withColumn("n_chars", F.length("text")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    both = both.withColumn("edit", F.concat(F.expr("left(text, n_chars - cut)"), F.expr("left(before.text, cut)")))
    return both.select(
        *_KEY, "copies", "n_chars", F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
        "own", paragraphs(F.col("edit")).alias("edited"), F.col("before.own").alias("next"),
    )


def _dealt(found: DataFrame) -> DataFrame:
    """The rows by key in tasks that hold about TASK_DIGESTS digests."""
    total = found.agg(F.sum(F.size("own"))).first()[0] or 0
    return found.repartition(min(MOST_TASKS, 1 + total // TASK_DIGESTS), *_KEY)


def differences(found: DataFrame) -> tuple[DataFrame, list[int]]:
    """(did, h, kind, plus, minus): the digests that peeling recovers, those of the text alone and those of the other
    alone, for each pair that differs; and how many pairs each attempt left over, none at the last."""
    key, done, left = [*_KEY, "kind"], [], []
    found = _dealt(found)
    cells = subtracted(found)
    for attempt in range(1, ATTEMPTS + 1):
        result = written(peel(cells, key), "peeled")
        released(found.sparkSession)
        done.append(result.where("NOT failed").drop("failed"))
        open_pairs = result.where("failed").select(*key)
        left.append(open_pairs.count())
        if not left[-1]:
            return reduce(DataFrame.union, done), left
        cells = _resketched(found, open_pairs, attempt)
    raise RuntimeError("sketches could not be peeled")


def serialised(found: DataFrame) -> DataFrame:
    """(did, h, fingerprint, edited_fingerprint): each text's own sketch as the number of its digests, the bits of a
    table, and its cells (number, count, digests, checks: 4, 4, 8 and 8 bytes) in Base64."""
    cells = sketches(found, ["own", "edited"], [])
    packed = F.concat(F.lpad(F.hex("cell"), 8, "0"), F.lpad(F.hex("n"), 8, "0"), F.lpad(F.hex("d"), 16, "0"), F.lpad(F.hex("check"), 16, "0"))
    made = cells.groupBy(*_KEY, "side", "total", "bits").agg(F.array_sort(F.collect_list(packed)).alias("cells"))
    text = F.concat_ws(".", "total", "bits", F.regexp_replace(F.base64(F.unhex(F.array_join("cells", ""))), "\\s", ""))
    made = made.select(*_KEY, "side", text.alias("f"))
    return made.groupBy(*_KEY).agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("fingerprint"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("edited_fingerprint"))


def compare(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text is the text with its last third replaced by as much of the start of the next document in
    descending order of the id (the one of the greatest id after the last). ``near_*`` is the Jaccard index of the
    paragraphs of two texts, from their fingerprints: how many digests each holds and how many peeling recovers
    from their difference. A null text counts as empty, and its one paragraph is empty. Null ids come last; rows
    of equal id follow each other by a hash of their texts; wholly equal rows are one document with as many rows.
    Very long texts have as many paragraphs as their words ask for. Other columns are ignored. An empty table gives
    none.
    """
    found = written(versions(docs, text, id), "paragraphs")
    released(docs.sparkSession)
    apart = differences(found)[0].select(*_KEY, "kind", (F.size("plus") + F.size("minus")).alias("apart"))
    apart = apart.groupBy(*_KEY).agg(F.max(F.when(F.col("kind") == 0, F.col("apart"))).alias("e"), F.max(F.when(F.col("kind") == 1, F.col("apart"))).alias("x"))
    out = _sized(found).join(serialised(_dealt(found)), _KEY).join(apart, _KEY, "left")

    def likeness(other: str, differing: str) -> Column:
        """The Jaccard index of two sets of digests, from their sizes and the number recovered by peeling."""
        both, apart = F.col("n_own") + F.col(other), F.coalesce(differing, F.lit(0))
        return (both - apart) / (both + apart)

    return out.select(
        F.when(F.col("did") != -(1 << 63), F.col("did")).alias(id), F.col("n_chars").cast("long"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("n_edited", "e").alias("near_edited"), likeness("n_next", "x").alias("near_next"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")


def op7_paragraph_sketches(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` against its edited text and the next row's. Null texts are empty; rows that repeat an id
    each get their row; null ids come last; an empty table gives an empty one."""
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
