"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its character n-grams (hashed into a table), a text the average of its
words, with a few neutral words added so that a word or two decide nothing; a two-way softmax over that vector
gives the score. As the whole bag is averaged, length alone moves no score. Vectors and softmax begin at random and are
trained jointly in numpy by proximal steps: an n-gram's vector is weighed by how rare the n-gram is and shrinks to zero
unless it helps, so most of the table empties and chance n-grams of the sample have no say. Misspelled words
that were never seen score through the n-grams they share with seen ones. To score, each n-gram's vector times the
difference of the softmax's rows is one number.

Texts become bags of n-grams on executors; the driver only sees the bags of the bounded labelled sample: at most
``2 * TRAIN_ROWS`` rows and TRAIN_ENTRIES entries of eight bytes, however long a text is.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import held_out, written

BUCKETS, DIM, NGRAMS = 1 << 17, 8, range(3, 7)
#: Neutral words added to each text.
NEUTRAL = 10
#: At most so many labelled documents of each class are learned from, those whose hashed id is least.
TRAIN_ROWS = 1500
#: And at most so many entries (an n-gram of a document) in all: then those of the least hashed ids of both classes.
TRAIN_ENTRIES = 16_000_000
#: Only n-grams of so many labelled documents get a vector; what shrinks vectors; steps of training.
LEAST_DOCS, SHRINK, STEPS = 5, 1e-4, 150
#: Spread of the vectors at the start; pull and decay of the softmax.
START, PULL, DECAY = 0.1, 0.1, 1e-3
THRESHOLD = 0.7
_EDGES = string.punctuation + "«»“”„’‘…–—¡¿"
_SLICE_CHARS = 500_000
_BATCH_ROWS = 128


@dataclass
class Model:
    """``weight``: for each n-gram bucket what it adds to the log-odds of the average; ``bias``: the log-odds of
    an empty text; ``prior``: the score of every text if there was nothing to learn from."""

    weight: object
    bias: float
    prior: float | None = None
    #: What was trained: a vector for each n-gram that has one, and the softmax's row of each class.
    vectors: object = None
    softmax: object = None


def grams(words):
    """Of an Arrow array of words, their ends marked: (word number, bucket) of every n-gram, by word."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    marked = pc.binary_join_element_wise(pa.scalar("<"), words, pa.scalar(">"), "")
    codes = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = pc.utf8_length(marked).to_numpy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters up to the word's end
    owners, buckets, h = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], codes
    for n in range(2, min(NGRAMS.stop, len(codes) + 1)):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in NGRAMS:
            at = np.flatnonzero(left[: len(h)] >= n)
            x = h[at] ^ np.uint64(n)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            owners.append(owner[at])
            buckets.append((x >> np.uint64(47)).astype(np.int64))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


def words_of(texts):
    """Of an Arrow array of strings: how many words each has, the distinct words (lower case, without the
    punctuation around them) and the number of every word among these."""
    import pyarrow.compute as pc

    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.utf8_trim_whitespace(pc.fill_null(texts, ""))))
    flat = pc.list_flatten(lists)
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    blank = pc.equal(pc.list_element(lists, 0), "")  # a blank text splits into one empty word
    counts = pc.if_else(blank, 0, pc.list_value_length(lists)).to_numpy(zero_copy_only=False)
    return counts, pc.utf8_trim(coded.dictionary, characters=_EDGES), coded.indices.to_numpy()


def bags(texts) -> Iterator[tuple]:
    """The average of each text: (buckets, their weights)."""
    import numpy as np

    counts, words, at = words_of(texts)
    owner, bucket = grams(words)
    size = np.bincount(owner, minlength=len(words))
    begin, end = np.cumsum(size) - size, 0
    for n in counts.tolist():
        word, often = np.unique(at[end : end + n], return_counts=True)
        end += n
        own = size[word]
        where = np.repeat(begin[word] - np.cumsum(own) + own, own) + np.arange(own.sum())
        found, which = np.unique(bucket[where], return_inverse=True)
        yield found.astype(np.int32), (np.bincount(which, np.repeat(often / np.maximum(own, 1), own), len(found)) / (n + NEUTRAL)).astype(np.float32)


def scores(texts, model: Model):
    """The scores of an Arrow array of strings."""
    import numpy as np

    if model.prior is not None:
        return np.full(len(texts), model.prior)
    counts, words, at = words_of(texts)
    owner, bucket = grams(words)
    size = np.bincount(owner, minlength=len(words))
    per_word = np.bincount(owner, model.weight[bucket], len(words)) / np.maximum(size, 1)
    added = np.concatenate([[0.0], np.cumsum(per_word[at])])
    ends = np.cumsum(counts)
    z = (added[ends] - added[ends - counts]) / (counts + NEUTRAL) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(found: list[tuple], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), steps: int = STEPS, shrink: float = SHRINK, least_docs: int = LEAST_DOCS, seed: int = 7, dim: int = DIM) -> Model:
    """Trains on the bags ``found``, which it takes out of the list; ``weights``: how much a document of class 0 and
    of class 1 counts."""
    import numpy as np

    y = np.array(labels, dtype=bool)
    if not y.any() or y.all():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, float(y.mean()) if len(y) else 0.0)
    share = np.where(y, weights[1], weights[0]) / np.where(y, weights[1], weights[0]).sum()
    docs, mean = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    for (bucket, value), s in zip(found, share):
        docs[bucket] += 1
        mean[bucket] += s * value
    used = np.flatnonzero(docs >= min(least_docs, len(y)))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    scale = 1 / np.sqrt(mean[used] + 1e-7)  # chance frequencies then vary alike
    centre = mean[used] * scale
    batches = []
    for i in range(0, len(y), _BATCH_ROWS):
        part, found[i : i + _BATCH_ROWS] = found[i : i + _BATCH_ROWS], [None] * len(found[i : i + _BATCH_ROWS])
        at = place[np.concatenate([b for b, _ in part])]
        row = np.repeat(np.arange(len(part), dtype=np.uint8), [len(b) for b, _ in part])
        kept = at >= 0
        batches.append((slice(i, i + len(part)), len(part), at[kept], row[kept], np.concatenate([v for _, v in part])[kept] * scale[at[kept]].astype(np.float32)))

    def averaged(u):
        return np.concatenate([np.bincount(row, value * u[at], n) for _, n, at, row, value in batches]) - centre @ u

    def embedded(v, live, held):
        """The average vector of each text; ``held`` keeps each batch's entries of the n-grams that ``live`` marks."""
        out, small = np.zeros((len(y), v.shape[1])), v.astype(np.float32)
        for k, (rows, n, at, row, value) in enumerate(batches):
            if k not in held:
                kept = np.flatnonzero(live[at])
                if len(kept) == len(at):
                    kept = slice(None)  # no copies
                edge = np.flatnonzero(np.concatenate([[True], row[kept][1:] != row[kept][:-1]])) if len(row[kept]) else np.zeros(0, np.int64)
                held[k] = at[kept], value[kept, None], edge, row[kept][edge].astype(np.int64) + rows.start
            which, weight, edge, text = held[k]
            if len(which):
                out[text] = np.add.reduceat(small[which] * weight, edge, axis=0)
        return out - centre @ v

    def gathered(dz):
        total = np.zeros(len(used))
        for rows, _, at, row, value in batches:
            total += np.bincount(at, value * dz[rows][row], len(used))
        return total - centre * dz.sum()

    rng = np.random.default_rng(seed)
    across = rng.normal(size=len(used))
    for _ in range(8):  # the greatest curvature, which bounds the steps
        across = gathered(share * averaged(across / max(1e-12, np.linalg.norm(across))))
    curve = max(1e-9, 0.25 * np.linalg.norm(across))
    vectors = rng.normal(0, START, (len(used), dim))
    softmax = rng.normal(0, 1 / np.sqrt(2 * dim), (2, dim))
    bias = np.log([max(share[~y].sum(), 1e-9), max(share[y].sum(), 1e-9)])
    ahead, pace, live, held = vectors, 1.0, np.ones(len(used), bool), {}
    for k in range(steps):
        now = (ahead != 0).any(axis=1)
        if (now & ~live).any() or k % 10 == 0:  # most n-grams soon have no vector
            live, held = now, {}
        texts = embedded(ahead, live, held)
        z = texts @ softmax.T + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        wrong = (p / p.sum(axis=1, keepdims=True) - np.stack([~y, y], axis=1)) * share[:, None]
        apart = softmax[1] - softmax[0]
        step = 1 / (curve * max(apart @ apart, 0.1))
        new = ahead - step * gathered(wrong[:, 1])[:, None] * apart  # both classes' errors, which are each other's opposite
        new *= np.maximum(0, 1 - step * shrink / np.maximum(np.linalg.norm(new, axis=1), 1e-12))[:, None]
        softmax = softmax - (wrong.T @ texts + DECAY * softmax) / (0.5 * max((share @ (texts * texts)).sum(), 1e-9) + DECAY) * PULL
        bias = bias - wrong.sum(axis=0)
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, vectors, pace = new + (pace - 1) / after * (new - vectors), new, after
    own = vectors @ (softmax[1] - softmax[0])
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = own * scale
    return Model(weight, float(bias[1] - bias[0] - centre @ own), vectors=vectors, softmax=softmax)


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", id: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Learns from the rows of ``docs`` whose ids ``learn`` (a condition on ``id``) admits and which ``labels``
    marks 0 or 1; where more than ``rows`` of a class are marked, from those of the least hashed ids, one row for
    each id (and, beyond TRAIN_ENTRIES, from those among them of the least hashed ids). An id marked both ways counts as 1. Each class counts as much as it makes up of all that is marked.
    Null texts count as empty; without rows of both classes every text scores the share of class 1."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & learn).groupBy(id).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(id), F.col(id)]
    picked = known.where("y = 0").orderBy(*order).limit(rows).union(known.where("y = 1").orderBy(*order).limit(rows))
    sample = docs.select(id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(picked), id)
    sample = sample.groupBy(id).agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo, hi in slices([len(t) for t in b.column(2).to_pylist()], _SLICE_CHARS):
                own = list(bags(b.column(2).slice(lo, hi - lo)))
                made = [pa.array([x.tobytes() for x, _ in own], pa.binary()), pa.array([v.tobytes() for _, v in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *made], names=["h", "y", "buckets", "values"])

    import numpy as np

    hashed = written(sample.select(F.xxhash64(id).alias("h"), "y", "t").mapInArrow(run, "h long, y int, buckets binary, values binary"), "bags")
    size, last = 0, None
    for h, n in sorted(map(tuple, hashed.select("h", F.octet_length("values") / 4).collect())):  # 2 * rows numbers
        size += n
        last = h if size <= TRAIN_ENTRIES or last is None else last
    # one partition after the other, so that the driver's JVM never holds them all
    found = sorted(map(tuple, (hashed if last is None else hashed.where(F.col("h") <= last)).toLocalIterator()), key=lambda r: (r[0], r[2], r[3]))
    y = [r[1] for r in found]
    weights = tuple(counts.get(k, 0) / max(1, y.count(k)) for k in (0, 1))
    own = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in found]
    del found
    return fit(own, y, weights)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the column ``to`` (0 to 1) added, or replaced if there is one; other columns don't matter.

    A null, empty or blank text scores as a text of neutral words. A text of any length is one bag, never cut.
    Rows are independent of each other, so repeated rows score alike; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.prior))  # one float per bucket: 512 KB

    def run(columns):
        import pyarrow as pa
        import pyarrow.compute as pc

        own = Model(*shared.value)
        for column in columns:
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            parts = [scores(column.slice(lo, hi - lo), own) for lo, hi in slices(sizes, _SLICE_CHARS)]
            yield pa.concat_arrays([pa.array(p, pa.float64()) for p in parts]) if parts else pa.array([], pa.float64())

    import pyarrow as pa

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(to, F.arrow_udf(run, T.DoubleType())(F.col(text).cast("string")))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` scored by a model of the labels that are not held out; null and empty texts
    score like neutral ones, rows of a null id are never held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score(docs, train(docs, labels, ~held_out(3, 1)))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
