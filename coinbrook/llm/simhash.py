"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four segments of 16 bits. Two fingerprints that differ in at most four
bits differ, by the pigeonhole principle, in one of two ways:

* at least two segments are equal: they meet under one of six keys of two whole segments;
* at least three segments differ, and then no segment differs in more than two bits: a vector one bit from
  both exists in every segment. Each segment, padded to 23 bits, and each of its neighbours at one bit is
  decoded to the nearest word of the perfect binary Golay code; the sets of codeword indices of two
  segments at distance two or less intersect. One index of each of the first three segments makes a key.

Rows that share a key are joined by sorting on it, and every link is verified on the whole fingerprint.

Four bits of 64 only reach texts that are nearly equal. ``without_similar`` reaches a similarity of 0.8, at which one bit
in 6.6 differs: fingerprints have 320 bits, in twelve segments of the code's own 23 bits, and a key is one index each of
the two segments of a pair, of segments and all their neighbours at one bit. Six pairs meet with 93 of 100 such
texts and nearly all that are more similar; two texts in 4000 meet by chance, and 128 other bits tell most of these
apart. What is linked is compared by its shingles, and only a text that is similar to one that stays goes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, released, written

MAX_BITS = 4
#: What similar documents are: words of a shingle, and the share of two texts' shingles that both have; texts are compared
#: if their first 128 bits differ in at most so many (19 on average at that similarity).
SIMILAR_WORDS, SIMILAR, SIMILAR_BITS = 5, 0.8, 34
#: 64-bit words of a wide fingerprint, bits of its segments, and pairs of segments.
WIDE, SEGMENT, PAIRS = 5, 23, 6
#: The generator polynomial of the [23,12,7] code.
_GOLAY = 0b101011100011


def _shingles(text: str | None, width: int) -> list[bytes]:
    import numpy as np

    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined] if words else []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist())]


def _majority(raw: bytes, size: int):
    """The bits that are set in more than half of the hashes of ``size`` bytes, as unsigned integers."""
    import numpy as np

    hashes = np.frombuffer(raw, np.uint8).reshape(-1, size)
    bits = np.zeros(8 * size, np.int64)
    for i in range(0, len(hashes), 65536):
        bits += np.unpackbits(hashes[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(hashes)).view(">u8")


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit SimHash of the shingles of ``width`` words; 0 for a text without words."""
    import xxhash

    return int(_majority(b"".join([xxhash.xxh64_digest(x, 42) for x in _shingles(text, width)]), 8)[0])


def _mixed(h):
    import numpy as np

    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def wide_fingerprint(text: str | None, width: int) -> tuple[int, ...]:
    """The SimHash of the shingles in WIDE words; zeros for a text without words. The first two words are the bits of a
    128-bit hash, the others of what it mixes into."""
    import numpy as np
    import xxhash

    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x, 42) for x in _shingles(text, width)]), ">u8").astype(np.uint64).reshape(-1, 2)
    if not len(raw):
        return (0,) * WIDE
    more = [_mixed(raw[:, k % 2] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(WIDE - 2)]
    every = np.concatenate([raw, np.stack(more, axis=1)], axis=1).astype(">u8")
    return tuple(int(x) for x in _majority(every.tobytes(), 8 * WIDE))


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(``id``, fp): the fingerprint as a signed long."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    out = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("fp", T.LongType())]))
    return out.withColumnRenamed("id", id)


def codeword_indices(memo: dict = {}):  # noqa: B006 - a memory that travels to executors with the function
    """For each word of 23 bits the index of the nearest codeword."""
    import numpy as np

    if memo:
        return memo["index"]
    info = np.arange(4096, dtype=np.int64)
    words = info << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, _GOLAY << (bit - 11), 0)
    words |= rest
    index = np.full(1 << 23, -1, np.int16)
    for weight in range(4):  # the balls of radius three fill the space exactly once
        for where in combinations(range(23), weight):
            index[words ^ sum(1 << b for b in where)] = info
    memo["index"] = index
    return index


def _neighbours(segment, bits: int):
    """The different codeword indices of each segment and its one-bit neighbours: a flat array, and where each segment's
    part of it begins."""
    import numpy as np

    flips = np.concatenate([[0], 1 << np.arange(bits)])
    near = codeword_indices()[segment[:, None] ^ flips].astype(np.int64)
    near.sort(axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    return near[first], np.concatenate([[0], np.cumsum(first.sum(axis=1))])


def golay_indices(memo: dict = {}):  # noqa: B006 - as above
    """``_neighbours`` of every segment of 16 bits."""
    import numpy as np

    if not memo:
        memo["table"] = _neighbours(np.arange(1 << 16, dtype=np.int64), 16)
    return memo["table"]


def _segments(fps):
    import numpy as np

    return [((fps >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]


def _indexed(segments):
    """Every choice of one index for each of the segments: (row numbers, keys of 12 bits a segment)."""
    import numpy as np

    flat, begin = golay_indices()
    row, key = np.arange(len(segments[0])), np.zeros(len(segments[0]), np.int64)
    for seg in segments:
        sizes = (begin[seg + 1] - begin[seg])[row]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        index = flat[np.repeat(begin[seg][row], sizes) + inside]
        row, key = np.repeat(row, sizes), np.repeat(key, sizes) << 12 | index
    return row, key


def keys_of(words):
    """The keys of fingerprints (rows of one uint64) that meet within four bits: (row numbers, keys)."""
    import numpy as np

    fps = words[:, 0]
    seg, every = _segments(fps), np.arange(len(fps))
    found = [(every, (n + 1) << 40 | seg[a] << 16 | seg[b]) for n, (a, b) in enumerate(combinations(range(4), 2))]
    return tuple(np.concatenate(x) for x in zip(*found, _indexed(seg[:3])))


def _wide_segments(words, count: int):
    """The first ``count`` segments of wide fingerprints given by their words."""
    import numpy as np

    bits = np.unpackbits(np.ascontiguousarray(words.astype(">u8")).view(np.uint8).reshape(len(words), -1), axis=1)[:, : count * SEGMENT]
    return bits.reshape(len(words), count, SEGMENT).astype(np.int64) @ (1 << np.arange(SEGMENT - 1, -1, -1))


def wide_keys_of(words):
    """The keys of wide fingerprints (rows of WIDE words): (row numbers, keys), one for each choice of an index of both
    segments of a pair."""
    import numpy as np

    seg, found = _wide_segments(words, 2 * PAIRS), []
    for n in range(PAIRS):
        row, key = np.arange(len(seg)), np.full(len(seg), n, np.int64)
        for k in (2 * n, 2 * n + 1):
            flat, begin = _neighbours(seg[:, k], SEGMENT)
            sizes = np.diff(begin)[row]
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            index = flat[np.repeat(begin[row], sizes) + inside]
            row, key = np.repeat(row, sizes), np.repeat(key, sizes) << 12 | index
        found.append((row, key))
    return tuple(np.concatenate(x) for x in zip(*found))


def wide_first(x, y, key):
    """Whether ``key`` is worth naming a link of ``x`` and ``y`` at, both given by their first two words: not if they
    share an earlier key of the pairs of segments that these words hold. There they are linked already, or through
    others that meet there."""
    import numpy as np

    shown = 2 * 64 // (2 * SEGMENT)
    sx, sy, family = _wide_segments(x, 2 * shown), _wide_segments(y, 2 * shown), key >> 24
    first = np.ones(len(x), bool)
    for n in range(shown):
        at = np.flatnonzero(first & (family >= n))
        if not len(at):
            break
        least = np.zeros(len(at), np.int64)
        shares = np.ones(len(at), bool)
        for k in (2 * n, 2 * n + 1):
            mine, other = ([flat[np.minimum(begin[:-1, None] + np.arange(SEGMENT + 1), begin[1:, None] - 1)] for flat, begin in [_neighbours(s[at, k], SEGMENT)]][0] for s in (sx, sy))
            common = (mine[:, :, None] == other[:, None, :]).any(axis=2)
            shares &= common.any(axis=1)
            least = least << 12 | np.where(common, mine, 4095).min(axis=1)
        first[at] = np.where(family[at] == n, (key[at] & 0xFFFFFF) == least, ~shares)
    return first


def linked(fps, bits: int):
    """Links that connect the rows of ``fps`` that are within ``bits`` of each other, one fewer than there are
    members, each between two such rows. Each round takes away all that is near, so a dense group costs few rounds."""
    import numpy as np

    left, out = fps[np.lexsort(fps.T[::-1])], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            own = queue.pop()
            near = np.bitwise_count(left ^ own).sum(axis=1) <= bits
            if near.any():
                found = left[near]
                out.append(np.concatenate([found, np.broadcast_to(own, found.shape)], axis=1))
                queue.extend(found)
                left = left[~near]
    return out


#: Rows of a key up to which all its pairs are looked at, as many at once as there are rows.
_FEW = 4


def _met(fps: DataFrame, keys, bits: int, first=None, carried: int = 1) -> DataFrame:
    """Links that connect the rows of ``fps`` (long columns, of which ``keys`` is given rows of words) that share a key
    and differ in at most ``bits`` bits of the first ``carried`` columns: these columns, with _a and _b behind the
    names. ``first`` tells which links are worth naming at a key."""
    names = fps.columns[:carried]
    width = carried

    def expand(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            every = [c.to_numpy() for c in b.columns]
            for i in range(0, b.num_rows, 2048):
                row, key = keys(np.stack([c[i : i + 2048].view(np.uint64) for c in every], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[i : i + 2048][row]) for c in every[:width])], names=["key", *names])

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        found = []

        def flush():
            pairs = np.unique(np.concatenate(found), axis=0).view(np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs.T], names=[*(f"{c}_a" for c in names), *(f"{c}_b" for c in names)])

        def runs(k, f):
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(edge, len(k)))
            few = np.repeat(size <= _FEW, size)
            for lag in range(1, min(_FEW, len(k))):
                at = np.flatnonzero(few[:-lag] & (k[:-lag] == k[lag:]))
                x, y = f[at], f[at + lag]
                close = np.bitwise_count(x ^ y).sum(axis=1) <= bits
                if close.any():
                    x, y, own = x[close], y[close], k[at[close]]
                    if first is not None:
                        keep = first(x, y, own)
                        x, y = x[keep], y[keep]
                    swap = (x[:, 0] > y[:, 0])[:, None]  # the same pair alike from every key
                    found.append(np.concatenate([np.where(swap, y, x), np.where(swap, x, y)], axis=1))
            for at, n in zip(edge[size > _FEW], size[size > _FEW]):
                for pairs in linked(f[at : at + n], bits):
                    if first is not None:
                        pairs = pairs[first(pairs[:, :width], pairs[:, width:], np.full(len(pairs), k[at]))]
                    found.append(pairs)

        parts = []
        for b in batches:
            if not b.num_rows:
                continue
            k, f = b.column(0).to_numpy(), np.stack([c.to_numpy().view(np.uint64) for c in b.columns[1:]], axis=1)
            last = np.searchsorted(k, k[-1])  # the last run may go on in the next batch
            if last == 0 and parts and parts[-1][0][-1] == k[-1]:
                parts.append((k, f))
                continue
            head = [*parts, (k[:last], f[:last])]
            parts = [(k[last:], f[last:])]
            whole = np.concatenate([x for x, _ in head])
            if len(whole):
                runs(whole, np.concatenate([x for _, x in head]))
            if sum(map(len, found)) > 500_000:
                yield flush()
        if parts:
            runs(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))
        if found:
            yield flush()

    # dealt anew, so that the keys of few rows are made by many tasks
    parallel = max(fps.sparkSession.sparkContext.defaultParallelism, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = fps.distinct().repartition(parallel, *fps.columns).mapInArrow(expand, ", ".join(f"{c} long" for c in ["key", *names]))
    met = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, ", ".join(f"{c}_{side} long" for side in "ab" for c in names))
    return met.distinct()


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) among the distinct values of the long column ``fp``: their components are those of all
    pairs that differ in at most ``bits`` (4 at most) bits."""
    if bits > MAX_BITS:
        raise ValueError(f"the keys find at most {MAX_BITS} differing bits")
    return _met(fps.select("fp"), keys_of, bits).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = MAX_BITS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fingerprint`` (16 hex digits), ``component_id`` (the least id of
    all documents reachable over links of at most ``bits`` differing bits, itself included).

    Null and empty texts have fingerprint zero and link like any other; texts of any length are taken whole.
    Repeated ids and rows each keep their row; a null id never becomes a component's id unless it has no other.
    Other columns are ignored. An empty table gives none.
    """
    fp = written(fingerprints(docs, width, text, id), "fingerprints")
    least = fp.groupBy("fp").agg(F.min(id).alias("lo"))
    comp = components(links(fp, bits))
    rooted = least.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("lo").alias("component_id")), "root").select("fp", "component_id")
    out = fp.join(named, "fp")
    return out.select(id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int = SIMILAR_WORDS):
    """The different shingles of a text as sorted hashes of 64 bits."""
    import numpy as np
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(x, 7) for x in _shingles(text, width)], np.uint64))


class Leaders:
    """Texts that stay, by their shingles, and whether another one is like any of them."""

    def __init__(self, least: float):
        import numpy as np

        self._least, self._sizes, self._new = least, [], []
        self._hashes, self._owners = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, shingles) -> None:
        self._new.append((len(self._sizes), shingles))
        self._sizes.append(len(shingles))
        if len(self._new) > 32 + len(self._sizes) // 8:  # sorted together now and then
            self._merge()

    def _merge(self) -> None:
        import numpy as np

        hashes = np.concatenate([self._hashes, *(x for _, x in self._new)])
        owners = np.concatenate([self._owners, *(np.full(len(x), k) for k, x in self._new)])
        order = np.argsort(hashes, kind="stable")
        self._hashes, self._owners, self._new = hashes[order], owners[order], []

    def like(self, shingles) -> bool:
        """Whether one of them has at least ``least`` of both texts' shingles in common with these; no shingles are like
        no shingles."""
        import numpy as np

        n = len(shingles)
        enough = lambda common, size: common >= self._least * (n + size - common)
        for _, x in self._new:
            if min(n, len(x)) >= self._least * max(n, len(x)):
                at = np.minimum(np.searchsorted(x, shingles), max(0, len(x) - 1))
                if enough(int((x[at] == shingles).sum()) if n and len(x) else 0, len(x)):
                    return True
        if len(self._sizes) == len(self._new):
            return False
        sizes = np.array(self._sizes)
        lo, hi = (np.searchsorted(self._hashes, shingles, side) for side in ("left", "right"))
        met = np.concatenate([[0], np.cumsum(hi - lo)])
        at = np.arange(met[-1]) - np.repeat(met[:-1] - lo, hi - lo)
        common = np.bincount(self._owners[at], minlength=len(sizes))
        own = np.ones(len(sizes), bool)
        own[[k for k, _ in self._new]] = False
        return bool((own & enough(common, sizes)).any())


#: Texts of a group that are settled one after the other in a round, at most, and their characters at most (but one
#: text in any case); and others that one task compares with those that stay.
HEAD_ROWS, HEAD_CHARS, COMPARED_ROWS = 1_024, 16_000_000, 5_000


def _settled(left: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Of rows (root, first, row, chars) with their ``texts`` (row, t): (row, state), 0 for one that stays, 1 for one that goes, 2 for one that is not
    settled yet. In each group the first texts are settled in order, each stays if it is like none that stays, and all
    others are compared with those; a large group is dealt to several tasks, each of which gets the first texts."""
    order = Window.partitionBy("root").orderBy("first")
    heads = left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= HEAD_ROWS)
    upto = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    heads = heads.withColumn("upto", upto).where((F.col("upto") <= HEAD_CHARS) | (F.col("place") == 1)).select("row", "place")
    sizes = left.groupBy("root").agg(F.ceil(F.count("*") / COMPARED_ROWS).cast("int").alias("deals"))
    placed = left.join(heads, "row", "left").join(sizes, "root")
    deal = F.when(F.col("place").isNotNull(), F.sequence(F.lit(0), F.col("deals") - 1)).otherwise(F.array(F.pmod(F.hash("row"), F.col("deals"))))
    each = placed.select("root", deal.alias("deal"), "place", "row").join(texts, "row").select("root", F.explode("deal").alias("deal"), "place", "row", "t")

    def run(batches):
        import pyarrow as pa

        group, leaders = None, None
        for b in batches:
            rows, states = [], []
            for root, deal, place, row, t in zip(*(c.to_pylist() for c in b.columns)):
                if (root, deal) != group:
                    group, leaders = (root, deal), Leaders(least)
                own = shingle_set(t, width)
                like = leaders.like(own)
                if place is not None and not like:
                    leaders.add(own)
                if place is None or deal == 0:
                    rows.append(row)
                    states.append(1 if like else 0 if place is not None else 2)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(states, pa.int32())], names=["row", "state"])

    ordered = each.repartition("root", "deal").sortWithinPartitions("root", "deal", F.asc_nulls_last("place"))
    return ordered.select("root", "deal", "place", "row", "t").mapInArrow(run, "row long, state int")


def without_similar(docs: DataFrame, width: int = SIMILAR_WORDS, least: float = SIMILAR, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not similar to an earlier row that stays: rows rank by id,
    and a row goes if it shares at least ``least`` of both texts' shingles of ``width`` words with one that stays and
    keys bring the two together (see above; equal sequences of words always meet).

    Rows without an id rank last. Every row is a document of its own, repeated rows and rows of equal id among
    them; of rows of equal id the one with the least hash of its text, then any, ranks first. All texts without words
    are equal; one stays. Texts of any length are taken whole. Columns may have any names. An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    names = [f"k{i}" for i in range(len(docs.columns))]
    words = [f"w{i}" for i in range(WIDE)]
    at, key = docs.columns.index(text), f"k{docs.columns.index(id)}"
    numbered = docs.toDF(*names).withColumn(names[at], F.col(names[at]).cast("string")).withColumn("row", F.monotonically_increasing_id())

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            texts = b.column(at).to_pylist()
            found = np.array([(*wide_fingerprint(t, width), *divmod(xxhash.xxh3_128_intdigest(b" ".join((t or "").encode().lower().split())), 1 << 64)) for t in texts], dtype=np.uint64).reshape(-1, WIDE + 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=[*b.schema.names, *words, "d0", "d1"])

    # texts and fingerprints are written together, so that a row keeps its number
    schema = T.StructType([*numbered.schema.fields, *(T.StructField(c, T.LongType()) for c in [*words, "d0", "d1"])])
    whole = written(numbered.mapInArrow(run, schema), "wide-fingerprints")
    chars = F.coalesce(F.length(names[at]), F.lit(0)).alias("chars")
    rank = F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("id"), F.xxhash64(names[at]).alias("h"), F.col("row"), chars)
    # of equal texts the first: the others go, since they are like whatever it is like
    classes = written(whole.groupBy("d0", "d1").agg(F.min(rank).alias("first"), *[F.first(c).alias(c) for c in words]), "different-texts")
    node = lambda side: F.xxhash64(f"w0{side}", f"w1{side}")
    met = _met(classes.select(*words), wide_keys_of, SIMILAR_BITS, wide_first, carried=2)
    comp = components(met.select(node("_a").alias("a"), node("_b").alias("b")))
    released(spark)
    rooted = classes.select("first", node("").alias("node")).join(comp, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    members = rooted.join(several, "root").select("root", "first", F.col("first.row").alias("row"), F.col("first.chars").alias("chars"))
    # only these texts are looked at again, in rounds that settle the first ones of every group
    left, texts = written(members, "linked"), whole.select("row", F.col(names[at]).alias("t"))
    gone = None
    while True:
        states = written(_settled(left, texts, width, least), "settled")
        out = states.where("state = 1").select("row")
        gone = out if gone is None else gone.union(out)
        if states.where("state = 2").isEmpty():
            break
        left = written(left.join(states.where("state = 2").select("row"), "row", "left_semi"), "linked")
    kept = classes.select("first.row").join(gone, "row", "left_anti")
    return whole.join(kept, "row", "left_semi").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def op6_simhash_golay(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``; null and empty texts have fingerprint zero."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
