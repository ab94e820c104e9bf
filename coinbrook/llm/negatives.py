"""Hard negatives by product quantisation with stored residual norms, exact in the end.

Vectors are of integers. Each is cut into subspaces, and in each the nearest codeword and the norm of what is left are
stored. For an anchor a table of its products with all codewords gives every row a score, and by Cauchy and Schwarz the
true product differs from it by no more than the sum of (norm of the anchor's part) x (norm of the row's residual). A
row whose upper bound is below what is sure to be reached, or whose lower bound is above a window, is left out; the
products of the others are worked out in integers. So the codebooks, which a bounded sample makes, decide how much is
worked out, never what comes out.

Anchors are taken in blocks of bounded size; each block is broadcast and held against all rows, once for the positives
and once for the negatives in the positives' windows. A task keeps a few rows for each anchor or window, and these are
ranked anew over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, written

POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Components in a subspace, codewords of each, rows that codebooks are made from (those of the least hashed ids).
PART, CODES, SAMPLE_ROWS, STEPS = 4, 256, 20_000, 12
#: Anchors in a block, which is broadcast; how many of them, and how many rows, meet at once.
BLOCK, ANCHORS_AT_ONCE, ROWS_AT_ONCE = 8192, 128, 4096
#: Above so many dimensions times squared components, products might not fit 63 bits.
_MOST = 1 << 62


@dataclass
class Codebooks:
    """``words``: (subspaces, codewords, PART) floats, of vectors padded with zeros to whole subspaces."""

    words: object

    @classmethod
    def of(cls, vectors, part: int = PART, codes: int = CODES, steps: int = STEPS, seed: int = 5) -> Codebooks:
        """k-means in each subspace from rows of ``vectors``, at most as many codewords as there are different parts."""
        import numpy as np

        cut = _cut(vectors.astype(np.float64), part)
        rng = np.random.default_rng(seed)
        out = np.zeros((cut.shape[1], codes, part))
        for m in range(cut.shape[1]):
            own = np.ascontiguousarray(cut[:, m])
            some = np.unique(own[rng.permutation(len(own))[: 8 * codes]], axis=0)
            words = some[rng.permutation(len(some))[:codes]]
            for _ in range(steps if len(words) == codes else 0):
                at = _nearest(own, words)
                sizes = np.bincount(at, minlength=len(words))
                sums = np.stack([np.bincount(at, own[:, k], len(words)) for k in range(part)], axis=1)
                words = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], words)
            out[m, : len(words)] = words  # the rest stay at the origin
        return cls(out)

    def encode(self, vectors):
        """(codes, norms of the residuals rounded up) of each row and subspace."""
        import numpy as np

        cut = _cut(vectors.astype(np.float64), self.words.shape[2])
        codes = np.stack([_nearest(cut[:, m], self.words[m]) for m in range(cut.shape[1])], axis=1)
        rest = cut - self.words[np.arange(cut.shape[1]), codes]
        norms = np.sqrt((rest * rest).sum(axis=2)) * (1 + 1e-6)
        return codes.astype(np.uint8), np.nextafter(norms.astype(np.float32), np.float32(np.inf))

    def bounds(self, anchors, codes, norms):
        """(lower, upper) bounds of the products of ``anchors`` (integers) with rows given by codes and norms."""
        import numpy as np

        cut = _cut(anchors.astype(np.float64), self.words.shape[2])
        tables = np.einsum("amd,mkd->mak", cut, self.words)
        score = np.zeros((len(anchors), len(codes)))
        for m in range(len(tables)):
            score += tables[m].take(codes[:, m], axis=1)
        parts = np.sqrt((cut * cut).sum(axis=2))
        off = parts @ norms.T.astype(np.float64)
        off += 1e-9 * (np.abs(tables).max(axis=2).sum(axis=0)[:, None] + off) + 1e-6  # what floating point may do
        return score - off, score + off


def _cut(vectors, part: int):
    import numpy as np

    padded = np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % part)))
    return padded.reshape(len(vectors), padded.shape[1] // part, part)


def _nearest(rows, words):
    import numpy as np

    half = (words * words).sum(axis=1) / 2
    return np.concatenate([(rows[i : i + 65536] @ words.T - half).argmax(axis=1) for i in range(0, len(rows), 65536)]) if len(rows) else np.zeros(0, np.int64)


def _first(group, score, id, most: int):
    """Of rows (group, score, id) the indices of the first ``most`` of each group, by score from above, then id."""
    import numpy as np

    order = np.lexsort([id, -score, group])
    g = group[order]
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(edge, np.diff(np.append(edge, len(g))))
    return order[place < most]


class Kept:
    """The first ``most`` rows of each of ``groups``, and the least score that still counts there."""

    def __init__(self, groups: int, most: int):
        import numpy as np

        self.most, self.least = most, np.full(groups, -np.inf)
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group, score, id) -> None:
        import numpy as np

        if not len(group):
            return
        group, score, id = (np.concatenate([a, b]) for a, b in ((self.group, group), (self.score, score), (self.id, id)))
        at = _first(group, score, id, self.most)
        self.group, self.score, self.id = group[at], score[at], id[at]
        last = np.flatnonzero(np.bincount(self.group, minlength=len(self.least)) == self.most)
        ends = np.searchsorted(self.group, last, "right") - 1
        self.least[last] = self.score[ends]


def _sure(lower, holds, most: int):
    """For each anchor a score that ``most`` rows are sure to reach, among those that ``holds`` marks."""
    import numpy as np

    low = np.where(holds, lower, -np.inf)
    return np.partition(low, low.shape[1] - most, axis=1)[:, low.shape[1] - most] if low.shape[1] >= most else np.full(len(low), -np.inf)


def positives_in(books: Codebooks, ids, labels, vectors, rows, kept: Kept) -> None:
    """Adds to ``kept`` the rows (id, label, vectors, codes, norms) of an anchor's label that may be among its first."""
    import numpy as np

    r_id, r_label, r_vec, codes, norms = rows
    for i in range(0, len(ids), ANCHORS_AT_ONCE):
        own = slice(i, i + ANCHORS_AT_ONCE)
        lower, upper = books.bounds(vectors[own], codes, norms)
        holds = (labels[own][:, None] == r_label) & (ids[own][:, None] != r_id)
        least = kept.least[own]
        if np.isinf(least).any():
            least = np.maximum(least, _sure(lower, holds, kept.most))
        a, r = np.nonzero(holds & (upper >= least[:, None]))
        kept.add(a + i, np.einsum("ij,ij->i", vectors[own][a], r_vec[r]), r_id[r])


def negatives_in(books: Codebooks, labels, vectors, windows, rows, kept: Kept) -> None:
    """Adds to ``kept`` (a group for each anchor and window) the rows of other labels that may be among the first of a
    window. ``windows``: (anchors, windows, 2) of the least and the greatest score that count; an empty one has the
    least above the greatest."""
    import numpy as np

    r_id, r_label, r_vec, codes, norms = rows
    n = windows.shape[1]
    for i in range(0, len(labels), ANCHORS_AT_ONCE):
        own = slice(i, i + ANCHORS_AT_ONCE)
        lower, upper = books.bounds(vectors[own], codes, norms)
        other = labels[own][:, None] != r_label
        for k in range(n):
            lo, hi = windows[own, k, 0].astype(np.float64), windows[own, k, 1].astype(np.float64)
            least = np.maximum(kept.least[i * n + k : (i + len(lo)) * n : n], lo)
            if (least == lo).any():
                least = np.maximum(least, _sure(lower, other & (upper <= hi[:, None]) & (lower >= lo[:, None]), kept.most))
            a, r = np.nonzero(other & (upper >= least[:, None]) & (lower <= hi[:, None]) & (lo <= hi)[:, None])
            score = np.einsum("ij,ij->i", vectors[own][a], r_vec[r])
            inside = (score >= windows[own, k, 0][a]) & (score <= windows[own, k, 1][a])
            kept.add((a[inside] + i) * n + k, score[inside], r_id[r[inside]])


def _integers(packed: list[bytes], dims: int):
    """Vectors, all stored in integers of one width."""
    import numpy as np

    return np.frombuffer(b"".join(packed), f"<i{len(packed[0]) // dims}").reshape(-1, dims).astype(np.int64)


def _unpacked(batch):
    """(id, label, vectors, codes, norms) of a batch of the index."""
    import numpy as np

    ids, labels, x, codes, norms, dims = batch.columns
    rest = [np.frombuffer(b"".join(c.to_pylist()), kind).reshape(len(ids), -1) for c, kind in ((codes, np.uint8), (norms, "<f4"))]
    return ids.to_numpy(), labels.to_numpy(), _integers(x.to_pylist(), dims[0].as_py()), *rest


def index(rows: DataFrame, id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> tuple[DataFrame, Codebooks | None]:
    """The rows that take part, written: id and label (longs), the vector floor(scale * x) in integers of two or eight
    bytes, codes, residual norms, dims; and the codebooks.

    Null ids and labels, null vectors and those with a null or non-finite component take no part, nor do vectors of
    another length than most have (of equally frequent lengths the greater counts). Of rows that share an id the one of
    the least label, then the least vector, counts. Integers whose products might not fit a long raise.
    """
    import numpy as np

    spark = rows.sparkSession
    x = F.col(vector).cast("array<double>")
    sound = ~F.exists(F.col("x"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    own = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x")).where("id IS NOT NULL AND label IS NOT NULL AND size(x) > 0").where(sound)
    own = own.groupBy("id").agg(F.min(F.struct("label", "x")).alias("one")).select("id", "one.label", "one.x")
    fit = F.exists("x", lambda v: F.abs(v) * scale > F.sqrt(F.lit(float(_MOST)) / F.size("x")))
    own = own.withColumn("x", F.when(fit, F.raise_error(F.lit("a vector is too long for its products"))).otherwise(F.transform("x", lambda v: F.floor(v * scale).cast("long"))))
    own = written(own, "vectors")
    sizes = own.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], "id long, label long, x binary, codes binary, norms binary, dims int"), None
    dims = sizes["dims"]
    own = own.where(F.size("x") == dims)
    sample = [r["x"] for r in own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("x").collect()]
    books = Codebooks.of(np.array(sample, np.int64))
    del sample
    shared = spark.sparkContext.broadcast(books.words)  # CODES x dims floats

    def run(batches):
        import pyarrow as pa

        books = Codebooks(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                part = b.slice(i, 8192)
                vectors = part.column(2).flatten().to_numpy().reshape(-1, dims)
                codes, norms = books.encode(vectors)
                small = (np.abs(vectors) < 1 << 15).all()
                packed = [pa.array([r.tobytes() for r in z], pa.binary()) for z in (vectors.astype("<i2" if small else "<i8"), codes, norms.astype("<f4"))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *packed, pa.array(np.full(part.num_rows, dims, np.int32))], names=["id", "label", "x", "codes", "norms", "dims"])

    made = own.mapInArrow(run, "id long, label long, x binary, codes binary, norms binary, dims int")
    return written(made, "quantised"), books


def _batches_of_one_width(batches):
    """Batches whose vectors are all of one width (groups of rows differ where some have large components)."""
    import numpy as np

    for b in batches:
        if not b.num_rows:
            continue
        width = np.array([len(v) for v in b.column(2).to_pylist()])
        edge = [0, *(np.flatnonzero(width[1:] != width[:-1]) + 1).tolist(), len(width)]
        for lo, hi in zip(edge, edge[1:]):
            for i in range(lo, hi, ROWS_AT_ONCE):
                yield b.slice(i, min(ROWS_AT_ONCE, hi - i))


def mine(rows: DataFrame, anchors: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """For every row that ``anchors`` (a condition on a column ``id``) admits and each of its first ``positives`` rows of
    the same label, the first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` hundredths of the
    positive's: anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    A score is the integer inner product of the vectors times 256, rounded down; higher ones come first, ties by the
    smaller id. Which rows take part: see ``index``. A window whose positive score is below zero is empty. Anchors
    without positives or negatives have no row. Other columns are ignored. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    table, books = index(rows, id, label, vector)
    asked = table.where(anchors)
    blocks = max(1, -(-asked.count() // block))
    if books is None:
        return spark.createDataFrame([], schema)
    out, path = None, fresh_path(spark, "negatives")
    for k in range(blocks):
        found = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).select("id", "label", "x", "dims").orderBy("id").collect()
        if found:
            _of_block(table, books, found, positives, negatives, low, high).write.parquet(f"{path}/{k}")
            part = spark.read.schema(schema).parquet(f"{path}/{k}")
            out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def _of_block(table: DataFrame, books: Codebooks, found: list, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    import numpy as np

    spark = table.sparkSession
    ids, labels = (np.array([r[k] for r in found], np.int64) for k in ("id", "label"))
    vectors = np.concatenate([_integers([bytes(r["x"])], r["dims"]) for r in found])
    shared = spark.sparkContext.broadcast((books.words, ids, labels, vectors))  # BLOCK anchors

    def near(batches):
        import pyarrow as pa

        words, ids, labels, vectors = shared.value
        kept = Kept(len(ids), positives)
        for b in _batches_of_one_width(batches):
            positives_in(Codebooks(words), ids, labels, vectors, _unpacked(b), kept)
        yield pa.RecordBatch.from_arrays([pa.array(kept.group), pa.array(kept.score), pa.array(kept.id)], names=["anchor", "score", "id"])

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = table.mapInArrow(near, "anchor long, score long, id long").withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives)
    windows, other = np.zeros((len(ids), positives, 2), np.int64), np.zeros((len(ids), positives), np.int64)
    windows[:, :, 0] = 1  # empty
    score = np.zeros((len(ids), positives), np.int64)
    for anchor, s, i, k in best.collect():  # at most BLOCK x positives rows
        windows[anchor, k - 1] = -(-low * s // 100), high * s // 100
        other[anchor, k - 1], score[anchor, k - 1] = i, s
    held = spark.sparkContext.broadcast((books.words, labels, vectors, windows, ids, other, score))

    def far(batches):
        import pyarrow as pa

        words, labels, vectors, windows, ids, other, score = held.value
        kept = Kept(len(labels) * windows.shape[1], negatives)
        for b in _batches_of_one_width(batches):
            negatives_in(Codebooks(words), labels, vectors, windows, _unpacked(b), kept)
        a, k = np.divmod(kept.group, windows.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], other[a, k], kept.id, score[a, k], kept.score)], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    each = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = table.mapInArrow(far, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long").withColumn("rank", F.row_number().over(each))
    return ranked.where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of ``embeddings`` whose id is divisible by 100; labels of ids divisible by 7 are moved
    by one. Rows with a null id, label, vector or component take no part; an empty table gives an empty one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", moved.alias("label"), "embedding")
    return mine(rows, F.col("id") % 100 == 0)


SQL = f"""
WITH rows AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.id AS anchor, r.id AS other, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM rows a JOIN rows r ON a.id <> r.id WHERE a.id % 100 = 0),
positives AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS k FROM pairs WHERE same) WHERE k <= {POSITIVES}),
ranked AS (
    SELECT p.anchor, p.other AS positive, n.other AS negative, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS rank
    FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, negative AS negative_id, positive_score, negative_score
FROM ranked WHERE rank <= {NEGATIVES}
"""
