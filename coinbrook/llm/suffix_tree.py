"""Language-model scoring by a probabilistic suffix tree over words.

The symbols are the training words, one for all unknown words, and the end of the text. Contexts are the up to
three symbols before, a text's start among them. A context is kept as a state if it occurs often enough and its
next-symbol distribution diverges from its parent's (the context without its oldest symbol). A state gives its
repeated next symbols discounted probabilities and leaves the rest to its parent, in the end to the root, which
knows all words and gives unknown ones the mass of those seen once. Each symbol is scored from the longest
suffix of its history that is a state, so a text's score is a proper probability.

At scale: states and their next symbols are kept by absolute counts, so the tree grows with the corpus; it is a
table and is never gathered. Texts are cut into words once, in blocks of about sixteen million characters, by the
numbers that words have in their block; known words are then numbered by falling count, and each block gets the numbers
of its own. Contexts are counted depth by depth: how often one occurs is the count of the shorter one with its latest
symbol next, so only contexts frequent enough are counted. Each block then gets the rows of the tree that its own
contexts ask for. What is counted, asked for and answered goes between tasks in packed arrays, an array for each pair of
a task or block and a shard of keys, not row by row. What is broadcast: one row for each distinct count of a word (at
most the square root of twice the tokens), and Bloom filters of at most FILTER_BITS bits; what they let through is
settled by the shards.
"""

from __future__ import annotations

import math
import time
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, released, written

DEPTH = 3
#: Least occurrences of a context and of a next symbol in it.
LEAST_CONTEXT, LEAST_SYMBOL = 20, 2
#: Least gain in nats, over all its occurrences, by which a state's distribution must differ from its parent's.
MIN_GAIN = 20.0
#: What each explicit next symbol of a state leaves to the parent, in occurrences.
DISCOUNT = 0.5
BLOCK_CHARS = 16_000_000
FILTER_BITS = 1 << 28
#: A context is (recent, oldest): its latest two symbols, the latest above, and the third or 0.
_BITS = 32
#: Numbers of symbols: 0 stands for all unknown words, 1 for the start.
OTHER, START = 0, 1
#: Blocks are scored in so many rounds, each with a part of them, so that what they ask for never lies there all at once.
_ROUNDS = 2
#: Blocks that ask together, as most of what one asks for another does as well.
_GROUPED = 3
_GROUP_TOKENS = 150_000
_SLICE_WORDS = 8192
#: Keys that a task takes together, tokens counted in a shard, and rows of the tree in one.
_TAKEN_KEYS, _SHARD_TOKENS, _SHARD_ROWS = 2_000_000, 2_000_000, 500_000
_ADDED_KEYS = 250_000


def _tokens(text: str | None) -> list[bytes]:
    """The lower-cased words (A-Z only) and the end, an empty word."""
    return [*(text or "").encode().lower().split(), b""]


def _coded(docs: DataFrame, block_chars: int) -> DataFrame:
    """Texts (id, learn, block, symbols) by the numbers that words have in their block, and with no text the words of
    each block (block, word, local, learned): number, and count where ``learn`` is true. A block is what a task reads,
    up to so many characters."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["block", "id", "learn", "symbols", "word", "local", "learned"]
        block, chars, learned = TaskContext.get().partitionId() << 32, 0, np.zeros(0, np.int64)
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__

        def texts(b, sizes, numbers):
            nonlocal learned
            symbols, taught = np.array(numbers, np.int32), np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes)
            counts = np.bincount(symbols[taught], minlength=len(number))
            counts[: len(learned)] += learned
            learned = counts
            each = pa.array(_as_bytes(sizes, symbols), pa.binary())
            n = b.num_rows
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), b.column(2), b.column(0), each, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names)

        def words(id_type):
            own = list(number)
            for i in range(0, len(own), 20_000):
                part = own[i : i + 20_000]
                n = len(part)
                nothing = [pa.nulls(n, t) for t in (id_type, pa.bool_(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *nothing, pa.array(part, pa.binary()), pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(learned[i : i + n])], names=names)
            number.clear()

        last = None
        for b in batches:
            begin, sizes, numbers, last = 0, [], [], b.schema.field(2).type
            for i, t in enumerate(b.column(1).to_pylist()):
                own = _tokens(t)
                sizes.append(len(own))
                numbers.extend(map(number.__getitem__, own))
                chars += len(t or "")
                if len(numbers) > _GROUP_TOKENS or chars >= block_chars or i == b.num_rows - 1:
                    yield texts(b.slice(begin, i + 1 - begin), sizes, numbers)
                    begin, sizes, numbers = i + 1, [], []
                if chars >= block_chars:
                    yield from words(last)
                    block, chars, learned = block + 1, 0, np.zeros(0, np.int64)
        if number:
            yield from words(last)

    return docs.select("learn", "t", "id").mapInArrow(run, f"block long, id {id_type}, learn boolean, symbols binary, word binary, local int, learned long")


def _words(coded: DataFrame) -> DataFrame:
    return coded.where("word IS NOT NULL").groupBy("word").agg(F.sum("learned").alias("learned"))


def _word_table(docs: DataFrame) -> DataFrame:
    """(word, learned): every distinct word of ``t`` and the end, with its count where ``learn`` is true."""
    return _words(_coded(docs, BLOCK_CHARS))


def _as_bytes(sizes, symbols) -> list[bytes]:
    """The numbers of each text, seven bits a byte from the lowest on; the last byte of a number is below 128."""
    import numpy as np

    symbols = symbols.astype(np.uint32)
    width = np.ones(len(symbols), np.int64)
    for k in range(1, 5):
        width += symbols >= 1 << 7 * k
    ends = np.cumsum(width)
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(int(width.max(initial=0))):
        at = np.flatnonzero(width > k)
        out[(ends - width)[at] + k] = symbols[at] >> np.uint32(7 * k) & np.uint32(127) | np.where(width[at] > k + 1, 128, 0)
    return [x.tobytes() for x in np.split(out, ends[np.cumsum(sizes) - 1][:-1])]


def _encoded_groups(encoded):
    """Encoded texts in groups: (how many tokens each has, the number of every token)."""
    import numpy as np

    def group(held):
        raw = np.frombuffer(b"".join(held), np.uint8)
        last = raw < 128
        ends = np.flatnonzero(last)
        begin = np.append(0, ends[:-1] + 1)
        width = ends - begin + 1
        symbols = (raw[begin] & 127).astype(np.int64)
        for k in range(1, int(width.max())):
            at = np.flatnonzero(width > k)
            symbols[at] |= (raw[begin[at] + k] & 127).astype(np.int64) << 7 * k
        upto = np.cumsum([len(x) for x in held])
        return np.diff(np.searchsorted(ends, upto), prepend=0), symbols

    held, size = [], 0
    for e in encoded.to_pylist():
        held.append(e)
        size += len(e)
        if size > 2 * _GROUP_TOKENS:
            yield group(held)
            held, size = [], 0
    if held:
        yield group(held)


def _contexts(sizes, symbols, frequent: int):
    """For each depth: the tokens whose so many symbols before are all frequent (numbers up to ``frequent``),
    with ``recent`` and ``oldest``. Nothing stands before a start."""
    import numpy as np

    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(symbols)) - np.repeat(starts, sizes)
    usable, before = np.ones(len(symbols), bool), []
    for d in range(1, DEPTH + 1):
        own = np.full(len(symbols), START)
        own[d:] = symbols[:-d]
        own[place == d - 1] = START
        usable = usable & (place >= d - 1) & (own > OTHER) & (own <= frequent)
        before.append(own)
        at = np.flatnonzero(usable)
        recent = before[0][at] << _BITS
        if d > 1:
            recent |= before[1][at]
        yield at, recent, before[2][at] if d > 2 else np.zeros(len(at), np.int64)


def _numbered(words: DataFrame) -> DataFrame:
    """(word, learned, number): the known words, from 2 on by falling count."""
    parts = max(1, words.sparkSession.sparkContext.defaultParallelism)
    ranged = words.where("learned > 0").repartitionByRange(parts, F.desc("learned"), "word").withColumn("part", F.spark_partition_id())
    ranged = written(ranged.sortWithinPartitions(F.desc("learned"), "word").withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered-words")
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())  # one row per range
    if sum(n for _, n in sizes) >= (1 << 31) - 2:
        raise ValueError("more than 2**31 known words")
    begin, rows = 2, []
    for part, n in sizes:
        rows.append((part, begin))
        begin += n
    begins = words.sparkSession.createDataFrame(rows, "part int, begin long")
    return ranged.join(F.broadcast(begins), "part").select("word", "learned", (F.col("begin") + F.col("at")).cast("int").alias("number"))


@dataclass
class Counts:
    """By falling count: ``first`` number of the words of each count, and what the root gives such a word (ln);
    ``base``: the baseline (log10). Numbers below 2 are unknown words."""

    first: object
    learned: object
    root: object
    base: object
    unknown: float
    base_unknown: float

    @classmethod
    def of(cls, words: DataFrame, total: int, distinct: int, unknown: float, discount: float) -> Counts:
        import numpy as np

        rows = sorted(((r["learned"], r["count"]) for r in words.where("learned > 0").groupBy("learned").count().collect()), reverse=True)
        learned, n = np.array([x for x, _ in rows], float), np.array([x for _, x in rows], np.int64)
        base = lambda x: np.log10((x + 0.5) / (total + 0.5 * (distinct + 1)))
        return cls(2 + np.cumsum(n) - n, learned, np.log(np.maximum(learned - discount, 1e-300) / max(1, total)), base(learned), math.log(unknown), float(base(0)))

    def frequent(self, least: float) -> int:
        """The last number of a word learned so often, or the start's."""
        import numpy as np

        k = int((self.learned >= least).sum())
        return START if not k else int(self.first[k]) - 1 if k < len(self.first) else int(np.iinfo(np.int32).max)

    def _of(self, symbols, values, unknown):
        import numpy as np

        if not len(self.first):
            return np.full(len(symbols), unknown)
        return np.where(symbols > START, values[np.maximum(np.searchsorted(self.first, symbols, "right") - 1, 0)], unknown)

    def roots(self, symbols):
        return self._of(symbols, self.root, self.unknown)

    def bases(self, symbols):
        return self._of(symbols, self.base, self.base_unknown)


def _encoded(coded: DataFrame, numbered: DataFrame) -> DataFrame:
    """(id, learn, block, symbols): the numbers of each text's tokens, as ``_as_bytes`` has them."""
    texts = coded.where("word IS NULL").select("id", "learn", "block", "symbols")
    known = coded.where("word IS NOT NULL").select("block", "local", "word").join(numbered.select("word", "number"), "word").select(F.col("block").alias("of"), "local", "number")

    def encode(texts, values):
        import numpy as np
        import pyarrow as pa

        local = values.column("local").to_numpy()
        number = np.full(int(local.max(initial=0)) + 1, OTHER, np.int32)
        number[local] = values.column("number").to_numpy()
        out = []
        for sizes, symbols in _encoded_groups(texts.column("symbols")):
            beyond = int(symbols.max()) + 1 - len(number)  # the last words of a block may be unknown
            number = np.append(number, np.full(max(0, beyond), OTHER, np.int32))
            out.extend(_as_bytes(sizes, number[symbols]))
        return pa.table([texts.column("id"), texts.column("learn"), texts.column("block"), pa.array(out, pa.binary())], names=["id", "learn", "block", "symbols"])

    schema = f"id {coded.schema['id'].dataType.simpleString()}, learn boolean, block long, symbols binary"
    return texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(encode, schema)


def _mixed(recent, rest):
    import numpy as np

    x = recent.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ rest.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _place(recent, rest, n_words: int):
    """The word of a filter that a key belongs to, and its four bits there."""
    import numpy as np

    h = _mixed(recent, rest)
    mask = np.zeros(len(h), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
    return (h >> np.uint64(32)).astype(np.int64) & (n_words - 1), mask


def _filter(keys: DataFrame):
    """A Bloom filter of the keys (recent, rest), broadcast: no key is missed. Slices are made by executors."""
    import numpy as np

    n_words = 1 << max(10, math.ceil(math.log2(max(1, min(FILTER_BITS, 16 * keys.count())))) - 6)

    def placed(batches):
        import pyarrow as pa

        def slices(keys):
            where, mask = _place(*map(np.concatenate, zip(*keys)), n_words)
            order = np.argsort(where)
            where, mask = where[order], mask[order]
            first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
            where, mask = where[first], np.bitwise_or.reduceat(mask, first)
            cut = np.flatnonzero(np.diff(where // _SLICE_WORDS)) + 1
            at, masks = np.split((where % _SLICE_WORDS).astype(np.int16), cut), np.split(mask, cut)
            number = pa.array((where[np.append(0, cut)] // _SLICE_WORDS).astype(np.int32))
            return pa.RecordBatch.from_arrays([number, pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in masks], pa.binary())], names=["slice", "at", "mask"])

        held, size = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size > _TAKEN_KEYS:
                yield slices(held)
                held, size = [], 0
        if size:
            yield slices(held)

    def made(table):
        import pyarrow as pa

        words = np.zeros(_SLICE_WORDS, np.uint64)
        for at, mask in zip(table.column("at").to_pylist(), table.column("mask").to_pylist()):
            words[np.frombuffer(at, np.int16)] |= np.frombuffer(mask, np.uint64)  # each place once
        return pa.table([pa.array([table.column("slice")[0].as_py()], pa.int32()), pa.array([words.tobytes()], pa.binary())], names=["slice", "words"])

    found = keys.select("recent", "rest").mapInArrow(placed, "slice int, at binary, mask binary")
    whole = np.zeros(max(n_words, _SLICE_WORDS), np.uint64)
    for r in found.groupBy("slice").applyInArrow(made, "slice int, words binary").collect():
        whole[r["slice"] * _SLICE_WORDS : (r["slice"] + 1) * _SLICE_WORDS] = np.frombuffer(bytes(r["words"]), np.uint64)
    return keys.sparkSession.sparkContext.broadcast(whole[:n_words])


def _may_hold(words, recent, rest):
    where, mask = _place(recent, rest, len(words))
    return words[where] & mask == mask


def _marks(recent, rest):
    """Marks of keys by which they are sorted and dealt: above by context, below by the whole key."""
    import numpy as np

    return _mixed(recent, rest >> _BITS << _BITS) >> np.uint64(40) << np.uint64(40) | _mixed(recent, rest) >> np.uint64(24)


def _distinct(recent, rest, n):
    """Distinct keys in the order of their marks, with these and the sums of ``n``."""
    import numpy as np

    mark = _marks(recent, rest)
    order = np.argsort(mark)
    mark, recent, rest = mark[order], recent[order], rest[order]
    other = (recent[1:] != recent[:-1]) | (rest[1:] != rest[:-1])
    if (other & (mark[1:] == mark[:-1])).any():  # keys of equal marks may lie mixed
        again = np.lexsort((rest, recent, mark))
        order, mark, recent, rest = order[again], mark[again], recent[again], rest[again]
        other = (recent[1:] != recent[:-1]) | (rest[1:] != rest[:-1])
    first = np.flatnonzero(np.append(True, other))
    return mark[first], recent[first], rest[first], np.add.reduceat(n[order], first)


class Seen:
    """Distinct keys by a hash table, with how often each was added."""

    def __init__(self, keys: int):
        import numpy as np

        self.slots = np.full(1 << math.ceil(math.log2(2 * (keys + _ADDED_KEYS))), -1, np.int32)
        self.recent, self.rest, self.n = (np.empty(keys + _ADDED_KEYS, np.int64) for _ in range(3))
        self.size = 0

    def add(self, recent, rest) -> None:
        """At most _ADDED_KEYS more."""
        import numpy as np

        begin, m = self.size, len(recent)
        self.recent[begin : begin + m], self.rest[begin : begin + m] = recent, rest  # a key's own row until it is known to be new
        at = (_mixed(recent, rest) & np.uint64(len(self.slots) - 1)).astype(np.int64)
        row, left = np.empty(m, np.int32), np.arange(m, dtype=np.int32)
        while len(left):
            found = self.slots[at[left]]
            free = left[found < 0]
            self.slots[at[free]] = begin + free
            found = self.slots[at[left]]
            same = (self.recent[found] == recent[left]) & (self.rest[found] == rest[left])
            row[left[same]] = found[same]
            left = left[~same]
            at[left] = at[left] + 1 & len(self.slots) - 1
        new = np.flatnonzero(row == np.arange(begin, begin + m))
        number = np.empty(m, np.int32)
        number[new] = np.arange(begin, begin + len(new))
        self.slots[at[new]] = number[new]
        self.recent[begin : begin + len(new)], self.rest[begin : begin + len(new)] = recent[new], rest[new]
        again = row >= begin
        row[again] = number[row[again] - begin]
        self.size = begin + len(new)
        self.n[begin : self.size] = 0
        self.n[: self.size] += np.bincount(row, minlength=self.size)

    def taken(self):
        """The keys in the order of their marks, with these and their numbers; none is left."""
        import numpy as np

        recent, rest, n = (x[: self.size] for x in (self.recent, self.rest, self.n))
        mark = _marks(recent, rest)
        order = np.argsort(mark)
        self.slots.fill(-1)
        self.size = 0
        return mark[order], recent[order], rest[order], n[order]


def _adding(seen: Seen, recent, rest):
    """Adds keys; yields what ``seen`` held whenever it is full."""
    for i in range(0, len(recent), _ADDED_KEYS):
        seen.add(recent[i : i + _ADDED_KEYS], rest[i : i + _ADDED_KEYS])
        if seen.size > _TAKEN_KEYS // 2:
            yield seen.taken()


def _packed(*columns) -> bytes:
    """Columns of eight bytes, compressed: integers byte by byte of equal weight, others as they are."""
    import numpy as np
    import pyarrow as pa

    planes = [c.view(np.uint8).reshape(-1, 8).T.ravel() if c.dtype.kind == "i" else c.view(np.uint8) for c in map(np.ascontiguousarray, columns)]
    return pa.compress(np.concatenate(planes), "zstd", asbytes=True)


def _unpacked(packed, n: int, kinds: str = "ii"):
    """``n`` rows of columns, by the kinds of their types."""
    import numpy as np
    import pyarrow as pa

    raw = np.frombuffer(pa.decompress(packed, 8 * n * len(kinds), "zstd", asbytes=True), np.uint8).reshape(len(kinds), 8 * n)
    return [np.ascontiguousarray(x.reshape(8, n).T).view(np.int64).ravel() if k == "i" else x.view(np.float64) for x, k in zip(raw, kinds)]


def _together(table, kinds: str = "ii"):
    """The columns that packed rows of a table hold, one after the other."""
    import numpy as np

    sizes = table.column("n").to_numpy()
    out, at = [np.empty(int(sizes.sum()), np.int64 if k == "i" else float) for k in kinds], 0
    for packed, n in zip(table.column("rows"), sizes.tolist()):
        for own, c in zip(out, _unpacked(packed.as_buffer(), n, kinds)):
            own[at : at + n] = c
        at += n
    return out


_SHARDED = "shard int, block long, n int, rows binary"


def _shard(mark, shards: int):
    import numpy as np

    return ((mark >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int32)


def _sharded(mark, columns, shards: int, block: int = 0):
    """Packed rows for each shard; ``mark``: the rows' marks, in an order of shards."""
    import numpy as np
    import pyarrow as pa

    shard = _shard(mark, shards)
    cut = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
    rows = [_packed(*(c[i:j] for c in columns)) for i, j in zip(cut[:-1], cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]]), pa.array(np.full(len(rows), block)), pa.array(np.diff(cut).astype(np.int32)), pa.array(rows, pa.binary())], names=["shard", "block", "n", "rows"])


def _counted(encoded: DataFrame, depth: int, frequent: int, least_symbol: float, shards: int, among=None) -> DataFrame:
    """(recent, rest, n): how often a symbol followed a context of ``depth``, where it did often enough; ``rest``
    is the oldest symbol above and the next below. ``among``: a filter of the contexts that count."""

    def run(batches):
        seen = Seen(_TAKEN_KEYS // 2)
        for b in batches:
            for sizes, symbols in _encoded_groups(b.column(0)):
                at, recent, oldest = next(islice(_contexts(sizes, symbols, frequent), depth - 1, None))
                if among is not None:
                    may = _may_hold(among.value, recent, oldest << _BITS)
                    at, recent, oldest = at[may], recent[may], oldest[may]
                for mark, *own in _adding(seen, recent, oldest << _BITS | symbols[at]):
                    yield _sharded(mark, own, shards)
        if seen.size:
            mark, *own = seen.taken()
            yield _sharded(mark, own, shards)

    def added(table):
        import pyarrow as pa

        _, *own = _distinct(*_together(table, "iii"))
        enough = own[2] >= least_symbol
        return pa.table([pa.array(c[enough]) for c in own], names=["recent", "rest", "n"])

    found = encoded.where("learn").select("symbols").mapInArrow(run, _SHARDED)
    return found.groupBy("shard").applyInArrow(added, "recent long, rest long, n long")


_NEXT = "rest & 4294967295L"


def learn_table(encoded: DataFrame, counts: Counts, total: int, least_context: float, least_symbol: float, min_gain: float) -> DataFrame:
    """The tree as a table (recent, rest, value): for a state, with 0 as the next symbol, what symbols it does not
    hold get on top of the parent's probability (ln); for each of its next symbols the ln probability."""
    spark = encoded.sparkSession
    frequent = counts.frequent(least_context)
    shared = spark.sparkContext.broadcast(tuple(vars(counts).values()))

    @F.pandas_udf("double")
    def root(symbol):
        import numpy as np
        import pandas as pd

        return pd.Series(np.exp(Counts(*shared.value).roots(symbol.to_numpy())))

    @F.pandas_udf("double")
    def learned(symbol):
        import numpy as np
        import pandas as pd

        v = Counts(*shared.value)
        return pd.Series(v.learned[np.maximum(np.searchsorted(v.first, symbol.to_numpy(), "right") - 1, 0)])

    texts = encoded.where("learn").count()
    seen = lambda symbol: F.when(symbol == START, F.lit(float(texts))).otherwise(learned(symbol))
    made, entries, states, pairs = [], {}, {}, None
    for depth in range(1, DEPTH + 1):
        if depth == 1:
            among, totals = None, None
        else:  # a context occurs as often as its latest symbol follows the others
            latest = F.expr(_NEXT)
            again = pairs.where((F.col("n") >= least_context) & (latest <= frequent))
            older = F.shiftright("recent", _BITS)
            moved = (F.shiftleft(latest, _BITS).bitwiseOR(older)).alias("recent")
            third = F.expr("recent & 4294967295L") if depth == 3 else F.lit(0).cast("long")
            totals = written(again.select(moved, F.shiftleft(third, _BITS).alias("rest"), F.col("n").alias("total")), f"suffix-totals-{depth}")
            among = _filter(totals)
        before = pairs
        pairs = written(_counted(encoded, depth, frequent, least_symbol, math.ceil(total / _SHARD_TOKENS) or 1, among), f"suffix-counts-{depth}")
        released(spark)
        each = pairs.withColumns({"symbol": F.expr(_NEXT), "own": F.expr("rest & -4294967296L")})
        if depth == 1:
            each = each.withColumn("total", seen(F.shiftright("recent", _BITS))).where(F.col("total") >= least_context)
            each = each.withColumn("parents", root("symbol"))
        else:
            each = each.join(totals.select("recent", F.col("rest").alias("own"), "total"), ["recent", "own"])
            each = each.withColumn("parent", F.expr("recent & -4294967296L") if depth == 2 else F.col("recent"))
            shorter = before.select(F.col("recent").alias("parent"), F.col("rest").alias("symbol"), F.col("n").alias("pn"))  # with no oldest symbol
            each = each.join(shorter, ["parent", "symbol"])
            if depth == 2:
                each = each.withColumn("ptotal", seen(F.shiftright("parent", _BITS)))
            else:
                each = each.join(totals_before.select(F.col("recent").alias("parent"), F.col("total").alias("ptotal")), "parent")
            each = each.withColumn("parents", F.col("pn") / F.col("ptotal"))
        totals_before = totals
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("parents")))
        each = each.select("recent", "own", "symbol", "n", "total", "parents")
        each = written(each, f"suffix-gains-{depth}")
        kept = each.groupBy("recent", "own").agg(gain.alias("gain")).where(F.col("gain") >= min_gain).select("recent", "own")
        each = each.join(kept, ["recent", "own"], "left_semi").select("recent", "own", "symbol", ((F.col("n") - DISCOUNT) / F.col("total")).alias("p")).withColumn("up", root("symbol"))
        for d in range(1, depth):  # what the longest shorter state gives
            suffix = F.expr("recent & -4294967296L") if d == 1 else F.col("recent")
            each = each.withColumn("suffix", suffix)
            each = each.join(states[d].select(F.col("recent").alias("suffix"), F.col("value").alias("b")), "suffix", "left")
            each = each.join(entries[d].select(F.col("recent").alias("suffix"), "symbol", F.col("p").alias("q")), ["suffix", "symbol"], "left")
            each = each.withColumn("up", F.coalesce("q", F.exp("b") * F.col("up"), "up")).drop("suffix", "b", "q")
        entries[depth] = written(each, f"suffix-entries-{depth}")
        rest = (F.lit(1.0) - F.sum("p")) / F.greatest(F.lit(1.0) - F.sum("up"), F.lit(1e-12))
        released(spark)
        states[depth] = written(entries[depth].groupBy("recent", "own").agg(F.log(rest).alias("value")), f"suffix-states-{depth}")
        made.append(states[depth].select("recent", F.col("own").alias("rest"), "value"))
        made.append(entries[depth].select("recent", F.col("own").bitwiseOR(F.col("symbol")).alias("rest"), F.log("p").alias("value")))
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out


@dataclass
class Tree:
    """A part of the tree: sorted states (the root, 1, among them); for each the state of its longest proper
    suffix and what a symbol it does not hold gets on top of that one's probability (ln); and sorted (state
    number, symbol) entries with their ln probabilities. ``recent``: the distinct ones, whose place counts in
    a state's number from 1 on, above its oldest symbol. ``numbers``: word to number, where it was asked for."""

    recent: object
    contexts: object
    parent: object
    backoff: object
    entries: object
    lp: object
    numbers: dict | None = None

    @classmethod
    def of(cls, recent, rest, value, numbers: dict | None = None) -> Tree:
        """From rows of the table; with a state the rows of its suffixes that are states."""
        import numpy as np

        symbol, oldest = rest & (1 << _BITS) - 1, rest >> _BITS
        own = symbol == 0
        distinct = np.unique(recent[own])
        tree = cls(distinct, np.ones(1, np.int64), None, None, None, None, numbers)
        code, _ = tree.code(recent, oldest)
        tree.contexts, where = np.unique(np.append(code[own], 1), return_index=True)
        tree.backoff = np.append(value[own], 0.0)[where]
        first, third = np.append(recent[own], 0)[where], np.append(oldest[own], 0)[where]
        tree.parent = np.zeros(len(tree.contexts), np.int64)
        for r, deeper in ((first >> _BITS << _BITS, first & (1 << _BITS) - 1 > 0), (first, third > 0)):
            at = np.flatnonzero(deeper)
            state = tree.states(r[at], np.zeros(len(at), np.int64))
            tree.parent[at[state > 0]] = state[state > 0]
        state = tree.states(recent, oldest)
        of_state = np.flatnonzero(~own & (state > 0))
        entry = state[of_state] << _BITS | symbol[of_state]
        order = np.argsort(entry)
        # one beyond all, so that there always is an entry
        tree.entries, tree.lp = np.append(entry[order], np.iinfo(np.int64).max), np.append(value[of_state][order], 0.0)
        return tree

    def code(self, recent, oldest):
        import numpy as np

        if not len(self.recent):
            return np.zeros(len(recent), np.int64), np.zeros(len(recent), bool)
        where = np.minimum(np.searchsorted(self.recent, recent), len(self.recent) - 1)
        return where + 1 << _BITS | oldest, self.recent[where] == recent

    def states(self, recent, oldest):
        """The numbers of the states of contexts, 0 where there is none."""
        import numpy as np

        code, known = self.code(recent, oldest)
        where = np.minimum(np.searchsorted(self.contexts, code), len(self.contexts) - 1)
        return np.where(known & (self.contexts[where] == code), where, 0)

    def lookup(self, state, symbol, root):
        """ln probabilities of symbols from states; ``root``: what the root gives them."""
        import numpy as np

        out, rest, state = np.zeros(len(state)), np.arange(len(state)), state.copy()
        while True:
            done = self.contexts[state[rest]] == 1
            out[rest[done]] += root[rest[done]]
            rest = rest[~done]
            if not len(rest):
                return out
            code = state[rest] << _BITS | symbol[rest]
            where = np.minimum(np.searchsorted(self.entries, code), len(self.entries) - 1)
            hit = self.entries[where] == code
            out[rest[hit]] += self.lp[where[hit]]
            rest = rest[~hit]
            out[rest] += self.backoff[state[rest]]
            state[rest] = self.parent[state[rest]]


@dataclass
class Index:
    """Rows of the tree by a hash table of their keys: ``slots`` holds row numbers, -1 where there is none."""

    recent: object
    rest: object
    value: object
    slots: object

    @classmethod
    def of(cls, recent, rest, value) -> Index:
        import numpy as np

        slots = np.full(1 << max(4, math.ceil(math.log2(max(1, len(recent)))) + 1), -1, np.int32)
        left = np.arange(len(recent), dtype=np.int32)
        at = (_mixed(recent, rest) & np.uint64(len(slots) - 1)).astype(np.int64)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]
            lost = slots[at] != left  # the slot is another's
            left, at = left[lost], at[lost] + 1 & len(slots) - 1
        return cls(recent, rest, value, slots)

    def find(self, recent, rest):
        """The numbers of the rows of keys, -1 where there is none."""
        import numpy as np

        at = (_mixed(recent, rest) & np.uint64(len(self.slots) - 1)).astype(np.int64)
        out = self.slots[at]
        if not len(self.recent):
            return out
        left = np.flatnonzero((out >= 0) & ((self.recent[out] != recent) | (self.rest[out] != rest)))
        while len(left):
            at[left] = at[left] + 1 & len(self.slots) - 1
            row = self.slots[at[left]]
            out[left] = row
            left = left[(row >= 0) & ((self.recent[row] != recent[left]) | (self.rest[row] != rest[left]))]
        return out

    def scores(self, sizes, symbols, root, frequent: int):
        """ln probabilities of texts of so many tokens each: a state's own if it holds the symbol, else what it leaves of
        the next shorter one's."""
        import numpy as np

        for at, recent, oldest in _contexts(sizes, symbols, frequent):
            state = self.find(recent, oldest << _BITS)
            there = np.flatnonzero(state >= 0)
            at, recent, rest, state = at[there], recent[there], oldest[there] << _BITS | symbols[at[there]], state[there]
            entry = np.where(symbols[at] > OTHER, self.find(recent, rest), -1)
            root[at] = np.where(entry >= 0, self.value[entry], self.value[state] + root[at]) if len(at) else root[at]
        return np.add.reduceat(root, np.cumsum(sizes) - sizes)


def _least(total: int, context_share: float, symbol_share: float) -> tuple[float, float]:
    return max(LEAST_CONTEXT, context_share * total), max(LEAST_SYMBOL, symbol_share * total)


def learn_tree(src: DataFrame, words: DataFrame, total: int, unknown: float, discount: float, context_share: float, symbol_share: float, min_gain: float) -> Tree:
    """The whole tree in memory, to look into small ones."""
    import numpy as np

    numbered = written(_numbered(words), "numbers")
    counts = Counts.of(words, total, numbered.count(), unknown, discount)
    table = learn_table(written(_encoded(written(_coded(src, BLOCK_CHARS), "coded"), numbered), "encoded"), counts, total, *_least(total, context_share, symbol_share), min_gain).toPandas()
    numbers = {bytes(r["word"]): r["number"] for r in numbered.collect()}
    return Tree.of(table["recent"].to_numpy(np.int64), table["rest"].to_numpy(np.int64), table["value"].to_numpy(float), numbers)


def score(
    docs: DataFrame,
    learn: Column,
    text: str = "text",
    id: str = "doc_id",
    context_share: float = 0.0,
    symbol_share: float = 0.0,
    min_gain: float = MIN_GAIN,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (the
    unigram baseline) and ``score`` (log10 probability under the tree learned from the rows where ``learn``
    holds). A context or next symbol that counts less than its share of all training tokens is left out; by
    default LEAST_CONTEXT and LEAST_SYMBOL alone decide, so the tree grows with the corpus.

    A null or empty text is its end alone. Repeated rows and ids each keep their row and are learned from
    as often as they occur; a null condition counts as false. An empty table gives an empty result; without
    training rows every token is unknown, with probability one. Other columns are ignored.
    """
    src = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t"), F.coalesce(learn, F.lit(False)).alias("learn"))
    coded = written(_coded(src, block_chars), "coded")
    words = written(_words(coded), "words")
    seen = F.col("learned") > 0
    size = words.agg(F.sum("learned"), F.count(F.when(seen, 1)), F.count(F.when(F.col("learned") == 1, 1))).first()
    total, distinct, once = size[0] or 0, size[1], size[2]
    # unknown words together get the mass of the words seen once, taken in equal parts from all words
    unknown = (once or 0.5) / total if total else 1.0
    unknown = min(unknown, 0.5) if total else 1.0
    discount = unknown * total / distinct if distinct else 0.0
    counts = Counts.of(words, total, distinct, unknown, discount)
    encoded = written(_encoded(coded, _numbered(words)), "encoded")
    released(src.sparkSession)
    least_context, least_symbol = _least(total, context_share, symbol_share)
    table = written(learn_table(encoded, counts, total, least_context, least_symbol, min_gain), "suffix-tree")
    released(src.sparkSession)
    frequent = counts.frequent(least_context)
    may = _filter(table)
    shared = src.sparkSession.sparkContext.broadcast(tuple(vars(counts).values()))

    blocks = coded.where("local = 0").count()
    groups = max(1, math.ceil(blocks / _GROUPED))
    shards = max(1, math.ceil(table.count() / _SHARD_ROWS), groups)

    def asked(batches):
        import numpy as np
        import pyarrow as pa

        seen, last = Seen(_TAKEN_KEYS // 2), None
        for b in batches:
            blocks = b.column(0).to_numpy()
            for block in np.unique(blocks).tolist():
                if block != last and seen.size:
                    mark, *own, _ = seen.taken()
                    yield _sharded(mark, own, shards, last)
                last = block
                rows = b.column(1).take(pa.array(np.flatnonzero(blocks == block)))
                for sizes, symbols in _encoded_groups(rows):
                    for at, recent, oldest in _contexts(sizes, symbols, frequent):
                        own = _may_hold(may.value, recent, oldest << _BITS)
                        at, recent, oldest = at[own], recent[own], oldest[own]
                        rest = oldest << _BITS | symbols[at]
                        rest = np.where((symbols[at] > OTHER) & _may_hold(may.value, recent, rest), rest, oldest << _BITS)  # the state alone
                        for mark, *own, _ in _adding(seen, recent, rest):
                            yield _sharded(mark, own, shards, block)
        if seen.size:
            mark, *own, _ = seen.taken()
            yield _sharded(mark, own, shards, last)

    def dealt(batches):
        import numpy as np

        def parts(held):
            recent, rest, value = map(np.concatenate, zip(*held))
            mark = _marks(recent, rest)
            order = np.lexsort((rest, recent, _shard(mark, shards)))
            return _sharded(mark[order], [recent[order], rest[order], value[order]], shards)

        held, size = [], 0
        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            size += b.num_rows
            if size > _SHARD_ROWS:
                yield parts(held)
                held, size = [], 0
        if size:
            yield parts(held)

    def answered(asked, own):
        """For each block's keys the states of their contexts, each once, and what these have of the keys themselves."""
        import numpy as np
        import pyarrow as pa

        recent, rest, value = _together(own, "iif")
        order = np.lexsort((rest, recent))
        index = Index.of(recent[order], rest[order], value[order])
        found: dict[int, list] = {}
        for block, n, packed in zip(*(asked.column(c).to_pylist() for c in ("block", "n", "rows"))):
            recent, rest = _unpacked(packed, n)
            own = np.append(index.find(recent, rest), index.find(recent, rest >> _BITS << _BITS))
            found.setdefault(block, []).append(np.unique(own[own >= 0]))  # in the order of keys, which packs well
        found = {block: rows for block, parts in found.items() if len(rows := np.unique(np.concatenate(parts)))}
        packed = [_packed(index.recent[x], index.rest[x], index.value[x]) for x in found.values()]
        return pa.table([pa.array(list(found), pa.int64()), pa.array([len(x) for x in found.values()], pa.int32()), pa.array(packed, pa.binary())], names=["block", "n", "rows"])

    own = written(table.mapInArrow(dealt, _SHARDED), "suffix-shards")
    released(src.sparkSession)

    def add_up(texts, values):
        import numpy as np
        import pyarrow as pa

        own = Counts(*shared.value)
        tree = Index.of(*_together(values, "iif"))
        n, n_known, b, s = [], [], [], []
        for sizes, symbols in _encoded_groups(texts.column("symbols")):
            begin = np.cumsum(sizes) - sizes
            n.append(sizes)
            n_known.append(np.add.reduceat((symbols > OTHER).astype(np.int64), begin))
            b.append(np.add.reduceat(own.bases(symbols), begin))
            s.append(tree.scores(sizes, symbols, own.roots(symbols), frequent) / math.log(10))
        together = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        cols = [together(n, pa.int64()), together(n_known, pa.int64()), pa.array([total] * texts.num_rows, pa.int64()), together(b, pa.float64()), together(s, pa.float64())]
        return pa.table([texts.column("id"), *cols], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"id {docs.schema[id].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    found = []
    grouped = encoded.withColumn("block", F.expr(f"(shiftright(block, {_BITS}) + (block & 4294967295L)) % {groups}"))
    for k in range(rounds := min(_ROUNDS, groups)):
        texts = grouped.where(F.col("block") % rounds == k)
        keys = texts.select("block", "symbols").mapInArrow(asked, _SHARDED)  # a few tasks may ask for the same
        rows = keys.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(answered, "block long, n int, rows binary")
        found.append(written(texts.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(add_up, schema), "scores"))
        del texts, keys, rows
        for _ in range(2):  # the end of a query is told to listeners a little later, and holds its shuffles until then
            time.sleep(0.5)
            released(src.sparkSession)
    return reduce(DataFrame.union, found).withColumnRenamed("id", id)


def op1_suffix_tree(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` scored by a tree of those that are not held out. Null and empty texts are an end alone,
    texts of any length are scored whole, rows of a null id are learned from, repeated rows each get their row, an empty
    table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, ~held_out(5, 1))
    return out.select("doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
