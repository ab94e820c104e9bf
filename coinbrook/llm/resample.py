"""Resampling towards a target distribution by hashed word n-grams, whose CRCs are composed and not computed.

A feature is a run of words joined by one space; its bucket is its CRC-32 modulo ``buckets``. A word's CRC is computed
once; that of a run follows from those of its words alone: the CRC of ``a + b`` is the CRC of ``a`` moved over ``len(b)``
zero bytes, xor that of ``b``. Moving over bytes is linear over GF(2), a matrix of 32 x 32 bits for each length, so no
run of words is ever put together as a string.

Features are counted over all source and all target texts; a bucket's gain is the logarithm of how much likelier it is
in the target, a text's weight the sum of its features' gains. With Gumbel noise from the id added, the highest scores
are a draw without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of a text that are cut into words at once, and words that a task remembers the numbers of.
PIECE_BYTES, MEMORY = 2_000_000, 400_000
#: A bucket's gain, and the noise, are counted in thousandths.
UNIT = 1000


def _matrix_of(columns):
    """The operator that maps bit k to ``columns[k]``, as four tables of bytes."""
    import numpy as np

    v, out = np.arange(256), np.zeros((4, 256), np.uint32)
    for k in range(32):
        out[k >> 3] ^= np.where(v >> (k & 7) & 1, columns[k], 0).astype(np.uint32)
    return out


def _applied(tables, crc):
    import numpy as np

    return tables[0][crc & 255] ^ tables[1][crc >> np.uint32(8) & 255] ^ tables[2][crc >> np.uint32(16) & 255] ^ tables[3][crc >> np.uint32(24)]


class Shifts:
    """For each length the operator that moves a CRC-32 over so many zero bytes: a product of squares."""

    def __init__(self):
        import numpy as np

        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        one = np.concatenate([np.array([0xEDB88320], np.uint32), bits[:-1]])  # over one zero bit
        for _ in range(3):
            one = _applied(_matrix_of(one), one)
        self._columns, self._squares, self._made = bits, [one], {}

    def of(self, length: int):
        if length not in self._made:
            own, rest, k = self._columns, length, 0
            while rest:
                if k == len(self._squares):
                    self._squares.append(_applied(_matrix_of(self._squares[-1]), self._squares[-1]))
                if rest & 1:
                    own = _applied(_matrix_of(self._squares[k]), own)
                rest, k = rest >> 1, k + 1
            self._made[length] = _matrix_of(own)
        return self._made[length]

    def joined(self, left, right, lengths):
        """CRCs of ``a + b`` from those of a and of b, and the lengths of b."""
        import numpy as np

        out = right.copy()
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            out[at] ^= _applied(self.of(n), left[at])
        return out


class Features:
    """The buckets of texts; remembers words' CRCs between texts."""

    def __init__(self, longest: int, buckets: int):
        import zlib

        space = bytes(range(65, 91)), bytes(range(97, 123))
        keep = [b for b in range(256) if b >= 128 or bytes([b]).isalnum()]
        self._table = bytes(b if b in keep else 32 for b in range(256)).translate(bytes.maketrans(*space))
        self._longest, self._buckets, self._shifts, self._crc32 = longest, buckets, Shifts(), zlib.crc32
        self._space = zlib.crc32(b" ")
        self._number: dict[bytes, int] = {}
        self._crcs: list[int] = []
        self._sizes: list[int] = []

    def _words(self, raw: bytes) -> Iterator[list[bytes]]:
        """Words of a text, lower case, a bounded piece of it at a time."""
        at = 0
        while at < len(raw):
            piece = raw[at : at + PIECE_BYTES].translate(self._table)
            if at + len(piece) < len(raw):  # a word that goes on is left for the next piece
                end = piece.rfind(b" ") + 1
                while not end:
                    more = raw[at + len(piece) : at + len(piece) + PIECE_BYTES].translate(self._table)
                    piece, end = piece + more, len(piece) + more.find(b" ") + 1 if b" " in more else 0
                    if at + len(piece) >= len(raw):
                        end = end or len(piece)
                piece = piece[:end]
            at += len(piece)
            yield piece.split()

    def of(self, raw: bytes | None) -> Iterator[tuple]:
        """(words, buckets of the features that end in them) of each piece of a text."""
        import numpy as np

        crcs, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for words in self._words(raw or b""):
            if len(self._number) > MEMORY:
                self._number.clear()
                self._crcs.clear()
                self._sizes.clear()
            number = self._number
            for w in set(words).difference(number):
                number[w] = len(self._crcs)
                self._crcs.append(self._crc32(w))
                self._sizes.append(len(w))
            which = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            before = len(crcs)  # the last words of the piece before, whose features are counted already
            own = np.fromiter(map(self._crcs.__getitem__, which.tolist()), np.uint32, len(words))
            crcs = np.concatenate([crcs, own])
            sizes = np.concatenate([sizes, np.fromiter(map(self._sizes.__getitem__, which.tolist()), np.int64, len(words))])
            found, runs = [own], crcs
            if self._longest > 1:
                behind = self._shifts.joined(np.full(len(crcs), self._space, np.uint32), crcs, sizes)  # of " " + word
            for n in range(2, self._longest + 1):
                if len(crcs) < n:
                    break
                runs = self._shifts.joined(runs[: len(crcs) - n + 1], behind[n - 1 :], sizes[n - 1 :] + 1)
                found.append(runs[max(0, before - n + 1) :])
            yield len(words), (np.concatenate(found) % np.uint32(self._buckets)).astype(np.int64)
            kept = max(0, len(crcs) - self._longest + 1)
            crcs, sizes = crcs[kept:], sizes[kept:]


def _raw(rows: DataFrame, text: str):
    return F.encode(F.col(text).cast("string"), "UTF-8")


def bucket_counts(rows: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS):
    """How many features of all ``rows`` each bucket holds: a numpy array of ``buckets`` integers. Every task adds its
    texts up first, so what is shuffled grows with the tasks and buckets only."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        features, total = Features(longest, buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for raw in b.column(0):
                for _, found in features.of(raw.as_py()):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = rows.select(_raw(rows, text).alias("t")).where("t IS NOT NULL").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():  # one row for each bucket
        out[bucket] = n
    return out


def gains(source, target):
    """floor(1000 * ln of (target share / source share)) of each bucket, with one added to every count."""
    import numpy as np

    s, t = (x.astype(np.float64) for x in (source, target))
    n = len(source)
    return np.floor(UNIT * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(rows: DataFrame, gain, text: str = "text", longest: int = LONGEST, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``rows`` and behind them n_words, n_features and weight (longs) of the text; a null or
    empty text has none. ``gain``: an array of one integer for each bucket."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # eight bytes for each bucket

    def run(batches):
        import pyarrow as pa

        own = shared.value
        features = Features(longest, len(own))
        for b in batches:
            out = []
            for raw in b.column(b.num_columns - 1):
                words = n = weight = 0
                for more, found in features.of(raw.as_py()):
                    words, n, weight = words + more, n + len(found), weight + int(own[found].sum())
                out.append((words, n, weight))
            made = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, pa.int64()) for x in made)], names=[*b.schema.names[:-1], "w", "n", "g"])

    from pyspark.sql import types as T

    names = [f"k{i}" for i in range(len(keep))]
    fields = [T.StructField(k, rows.schema[c].dataType) for k, c in zip(names, keep)]
    src = rows.select(*[F.col(c).alias(k) for k, c in zip(names, keep)], _raw(rows, text).alias("t"))
    out = src.mapInArrow(run, T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in "wng")]))
    return out.toDF(*keep, "n_words", "n_features", "weight")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", id: str = "doc_id", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every row of ``docs``: ``id``, n_words, n_features, weight, score, and rank (1, 2, 3 ... from the highest score
    down; null if not drawn), all longs but the id. Of the rows of at least ``least_words`` words ``percent`` of a
    hundred are drawn, rounded down.

    Null and empty texts have no features and a weight of 0, and like all short texts are never drawn unless
    ``least_words`` is 0. Texts of any length are counted whole. Ties go to the smaller id, null ids last (their noise is
    that of an empty id), then to the lesser weight and number of features; repeated rows are rows of their own, with
    equal scores and ranks that follow each other. Without any target text gains come from the counts of ``docs``
    alone. Other columns are ignored, whatever their names. An empty table gives an empty one.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-float(UNIT)) * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    weighed = weigh(docs.select(F.col(id).alias("id"), F.col(text).alias("t")), gain, "t", longest, ("id",))
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel.cast("long")), "weights")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    # sorted over all tasks; a row's place is its place in its task behind the rows of the tasks before
    order = [F.desc("score"), F.asc_nulls_last("id"), "weight", "n_features"]
    placed = written(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranks")
    task = F.shiftright("at", 33)
    sizes = sorted(map(tuple, placed.groupBy(task.alias("task")).agg(F.count("*")).collect()))  # one row a task
    before, total = [], 0
    for k, n in sizes:
        before.append((k, total))
        total += n
    offsets = docs.sparkSession.createDataFrame(before, "task long, before long")
    ranked = placed.withColumn("task", task).join(F.broadcast(offsets), "task")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    columns = [F.col("id").alias(id), "n_words", "n_features", "weight", "score"]
    out = ranked.select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    rest = scored.where(F.col("n_words") < least_words)
    return out.union(rest.select(*columns, F.lit(None).cast("long")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """``documents`` resampled towards ``benchmark``: weight, score and rank of every row. Null texts have a weight of 0
    and are not drawn; rows of a null id come last among ties; an empty table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
lists AS (SELECT doc_id, len(words) AS n, words FROM split),
flat AS (SELECT doc_id, unnest(words) AS word FROM lists),
vocabulary AS (SELECT word, hex(encode(word)) AS hexed FROM (SELECT word FROM flat UNION SELECT word FROM wanted)),
hashed AS (
    SELECT word, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(0, len(hexed) // 2), lambda i: ('0x' || substring(hexed, 2 * i + 1, 2))::BIGINT)),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)),
        4294967295) % {BUCKETS} AS bucket
    FROM vocabulary),
s AS (SELECT bucket, count(*) AS s FROM flat JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
gains AS (
    SELECT bucket, floor({UNIT} * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM flat)::DOUBLE + {BUCKETS})
        / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT count(*) FROM wanted)::DOUBLE + {BUCKETS}))))::BIGINT AS gain
    FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM flat JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
    SELECT doc_id, n AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-{UNIT} * ln(-ln((('0x' || substring(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
    FROM lists LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, n_features >= {LEAST_WORDS} AS able, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
    CASE WHEN able AND place <= (SELECT count(*) FROM scored WHERE n_features >= {LEAST_WORDS}) * {PERCENT} // 100 THEN place END AS rank
FROM ranked
"""
