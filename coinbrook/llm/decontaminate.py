"""Benchmark decontamination: a BM25 index of test items, searched with every passage by block-max WAND.

Items are the indexed documents, passages of the training texts the queries. An impact is a term's BM25
weight in an item divided by the item's score against itself, so one threshold holds for items of any
length. All items above it are retrieved, however many; each is then verified by the word n-grams of its
question and of its answer that the passage and its surroundings hold.

How many items have a term, how many items there are and how long they are is counted over all items, so scores
do not depend on how items are dealt to indexes. Items of like length share an index and its passages: these are long
enough, and begin often enough, that each item that stands somewhere in a text is whole in one, and no longer for items
of other lengths.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

K1, B, BLOCK = 0.9, 0.4, 16
#: A passage retrieves an item by this share of the item's own score, and leaks it if it holds at least these
#: shares of the n-grams of its question and of its answer.
MIN_SCORE, MIN_QUESTION, MIN_ANSWER = 0.6, 0.5, 0.5
QUESTION_GRAM, ANSWER_GRAM = 5, 3
#: Words between the beginnings of passages, at least; they have as many more than the longest item may have.
STRIDE = 32
#: Words of the shortest items' class at most; every further class has items of up to twice as many.
CLASS_WORDS = 64
#: Items in one range of the bounds that passages must reach before they are searched, and the most such bounds
#: in one index: with more terms and items, ranges are wider.
RANGE, RANGE_CELLS = 8, 16_000_000
#: Floats of bounds that are made at once.
REACH_CELLS = 4_000_000
#: Characters of test items in one index; more items make more indexes, each built, broadcast, searched and
#: released before the next.
SHARD_CHARS = 16_000_000
_EDGES = string.punctuation + "«»“”„’‘…–—¡¿"
_ENDS = 1 << 60


def term(word: str) -> str:
    return word.lower().strip(_EDGES)


def terms(text: str | None) -> list[str]:
    return [t for w in (text or "").split() if (t := term(w))]


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the answer is the last sentence or line, or the last third of a single one."""
    at = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text.strip())]
    if at:
        question, answer = terms(text.strip()[: at[-1]]), terms(text.strip()[at[-1] :])
        if question and answer:
            return question, answer
    words = terms(text)
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def class_of(words: int) -> int:
    return max(0, (max(1, words) - 1).bit_length() - (CLASS_WORDS - 1).bit_length())


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Statistics:
    """Of all items with words: how many there are, their mean number of words, and how many have each term (of those
    asked for)."""

    items: int
    mean: float
    df: dict

    @classmethod
    def of(cls, texts: list[str | None]) -> Statistics:
        found = [x for t in texts if (x := terms(t))]
        return cls(len(found), sum(map(len, found)) / max(1, len(found)), Counter(t for x in found for t in set(x)))


@dataclass
class Index:
    """``postings``: term -> (item numbers in ascending order, impacts, each block's last item number, each
    block's greatest impact, the greatest impact of all)."""

    ids: list = field(default_factory=list)
    questions: list = field(default_factory=list)
    answers: list = field(default_factory=list)
    postings: dict = field(default_factory=dict)
    stride: int = STRIDE
    passage: int = 2 * STRIDE
    #: term -> its row in ``ranges``, which has each term's greatest impact in each range of item numbers; the
    #: last row, of words that no item has, is zero.
    rows: dict = field(default_factory=dict)
    ranges: object = None

    @classmethod
    def of(cls, items: list[tuple[int, str | None]], every: Statistics | None = None) -> Index:
        """Items without words can't be found and are left out. ``every``: of all items, if these are some. Passages suit
        the longest of these items."""
        import numpy as np

        index, every = cls(), every or Statistics.of([t for _, t in items])
        bags = []
        for i, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            if bag := Counter(terms(text)):
                question, answer = parts(text)
                index.ids.append(i)
                index.questions.append((question, min(QUESTION_GRAM, len(question))))
                index.answers.append((answer, min(ANSWER_GRAM, len(answer))))
                bags.append(bag)
        lists: dict[str, list[tuple[int, float]]] = {}
        for k, bag in enumerate(bags):
            norm = K1 * (1 - B + B * sum(bag.values()) / every.mean)
            own = {t: math.log(1 + (every.items - every.df[t] + 0.5) / (every.df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in bag.items()}
            whole = sum(own.values())
            for t, w in own.items():
                lists.setdefault(t, []).append((k, w / whole))
        for t, found in lists.items():
            numbers, impacts = [k for k, _ in found], [w for _, w in found]
            at = range(0, len(found), BLOCK)
            index.postings[t] = (numbers, impacts, [numbers[min(i + BLOCK, len(found)) - 1] for i in at], [max(impacts[i : i + BLOCK]) for i in at], max(impacts))
        longest = CLASS_WORDS << class_of(max((sum(b.values()) for b in bags), default=0))
        index.stride = max(STRIDE, math.ceil(longest / 3))
        index.passage = index.stride + longest
        index.rows = {t: k for k, t in enumerate(lists)}
        wide = max(RANGE, math.ceil(len(bags) * (len(lists) + 1) / RANGE_CELLS))
        index.ranges = np.zeros((len(lists) + 1, max(1, math.ceil(len(bags) / wide))), np.float32)
        for k, found in enumerate(lists.values()):
            np.maximum.at(index.ranges[k], [i // wide for i, _ in found], [w for _, w in found])
        return index

    @classmethod
    def by_length(cls, items: list[tuple[int, str | None]], every: Statistics | None = None) -> list[Index]:
        """An index for each class of lengths that there are items of."""
        every, classes = every or Statistics.of([t for _, t in items]), {}
        for item in items:
            if n := len(terms(item[1])):
                classes.setdefault(class_of(n), []).append(item)
        return [cls.of(classes[k], every) for k in sorted(classes)]

    def row(self, word: str) -> int:
        return self.rows.get(term(word), len(self.rows))

    def within_reach(self, rows, starts, least: float):
        """Of the passages of a text that begin at ``starts`` those that might score ``least`` for an item:
        where the greatest impacts in some range of items, each term's counted once, add up to it."""
        import numpy as np

        order = np.argsort(rows, kind="stable")
        before = np.full(len(rows), -1)
        same = rows[order[1:]] == rows[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        out, ranges = [], self.ranges.shape[1]
        at_once = max(1, REACH_CELLS // (self.passage * ranges))
        block = max(1, REACH_CELLS // (at_once * ranges))
        for i in range(0, len(starts), at_once):
            begin = starts[i : i + at_once, None]
            bounds = np.zeros((len(begin), ranges), np.float32)
            for j in range(0, self.passage, block):
                at = begin + np.arange(j, min(j + block, self.passage))
                inside = at < len(rows)
                at = np.minimum(at, len(rows) - 1)
                counted = (inside & (before[at] < begin)).astype(np.float32)
                bounds += np.einsum("wpr,wp->wr", self.ranges[rows[at]], counted)
            out.append(begin[bounds.max(axis=1) >= least - 1e-4, 0])
        return np.concatenate(out)

    def search(self, query: set[str], least: float) -> list[tuple[int, float]]:
        """All (item number, score) of at least ``least``, by block-max WAND: an item is scored only if the
        greatest impacts of the terms at or before it, then those of their blocks, can reach the threshold."""
        least -= 1e-9
        cursors = [[0, self.postings[t]] for t in query if t in self.postings]
        out = []
        here = lambda c: c[1][0][c[0]] if c[0] < len(c[1][0]) else _ENDS
        while True:
            cursors = [c for c in cursors if c[0] < len(c[1][0])]
            cursors.sort(key=here)
            reach, pivot = 0.0, None
            for k, c in enumerate(cursors):
                reach += c[1][4]
                if reach >= least:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = here(cursors[pivot])
            while pivot + 1 < len(cursors) and here(cursors[pivot + 1]) == item:
                pivot += 1
            reach, block_end = 0.0, _ENDS
            for c in cursors[: pivot + 1]:
                ends = c[1][2]
                b = c[0] // BLOCK
                while b < len(ends) and ends[b] < item:
                    b += 1
                if b < len(ends):
                    reach += c[1][3][b]
                    block_end = min(block_end, ends[b])
            if reach < least:  # no item up to the end of these blocks, or before the next term's, can do it
                target = min(block_end + 1, here(cursors[pivot + 1]) if pivot + 1 < len(cursors) else _ENDS)
                _forward(cursors[: pivot + 1], max(target, item + 1))
            elif here(cursors[0]) == item:
                total = 0.0
                for c in cursors[: pivot + 1]:
                    total += c[1][1][c[0]]
                    c[0] += 1
                if total >= least:
                    out.append((item, total))
            else:
                _forward([c for c in cursors[:pivot] if here(c) < item], item)


def _forward(cursors: list, item: int) -> None:
    """Moves cursors to the first posting at ``item`` or behind, block by block."""
    for c in cursors:
        numbers, _, ends, _, _ = c[1]
        b = c[0] // BLOCK
        while b < len(ends) and ends[b] < item:
            b += 1
        at = max(c[0], b * BLOCK)
        while at < len(numbers) and numbers[at] < item:
            at += 1
        c[0] = at


def leaks(text: str | None, index: Index, rows: dict[str, int]) -> list[dict]:
    """What a text leaks: for each item its best passage. ``rows`` remembers words' rows."""
    import numpy as np

    words = (text or "").split()
    if not words:
        return []
    new = [w for w in set(words) if w not in rows]
    if len(rows) + len(new) > 300_000:
        rows.clear()
        new = list(set(words))
    for w in new:
        rows[w] = index.row(w)
    own = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
    step = index.stride
    best: dict[int, dict] = {}
    for a in index.within_reach(own, np.arange(0, max(1, len(words) - step), step), MIN_SCORE):
        b = min(a + index.passage, len(words))
        found = index.search({t for w in words[a:b] if (t := term(w))}, MIN_SCORE)
        if not found:
            continue
        around = [t for w in words[max(0, a - step) : b + step] if (t := term(w))]
        held: dict[int, set] = {}
        for item, score in found:
            shares = []
            for own, n in (index.questions[item], index.answers[item]):
                wanted = grams(own, n)
                if n not in held:
                    held[n] = grams(around, n) if len(around) >= n else set()
                shares.append(len(wanted & held[n]) / len(wanted) if wanted else 1.0)
            if shares[0] >= MIN_QUESTION and shares[1] >= MIN_ANSWER and (item not in best or score > best[item]["score"]):
                best[item] = {"item_id": index.ids[item], "score": score, "question_overlap": shares[0], "answer_overlap": shares[1], "start_word": int(a)}
    return [best[k] for k in sorted(best)]


def _statistics(items: DataFrame) -> tuple[DataFrame, Statistics]:
    """Of (id, t): a table (term, df), and the statistics without it."""

    def run(batches):
        import pyarrow as pa

        df, sizes = Counter(), []
        for b in batches:
            for t in b.column(1).to_pylist():
                if found := terms(t):
                    df.update(set(found))
                    sizes.append(len(found))
            if len(df) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(df)), pa.array(list(df.values()), pa.int64())], names=["term", "df"])
                df.clear()
        # under terms that no item has: how many items, how many words
        df_, extra = list(df.items()), [("", len(sizes)), (" ", sum(sizes))]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in df_ + extra]), pa.array([n for _, n in df_ + extra], pa.int64())], names=["term", "df"])

    found = written(items.mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")), "item-terms")
    own = {r["term"]: r for r in found.where("trim(term) = ''").collect()}  # two rows
    n = own[""]["df"] if own else 0
    return found.where("trim(term) <> ''").select("term", "df"), Statistics(n, own[" "]["df"] / n if n else 0.0, {})


def annotate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", to: str = "leaks") -> DataFrame:
    """``docs`` with the array column ``to`` (replaced if there is one) of leaked items: item_id, score,
    question_overlap, answer_overlap, start_word (of the best passage). Empty for null and empty texts, and if there
    are no items. Texts of any length are searched whole. Items of null text are ignored and rows that repeat an
    item count once; equal items of several ids are found each by its own; a text that repeats leaks each time.
    Other columns are kept, whatever their names. An empty table gives an empty one."""
    spark = docs.sparkSession
    own = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("t")).where("t IS NOT NULL").distinct()
    chars = own.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, math.ceil(chars / SHARD_CHARS))
    if shards == 1:
        found = Index.by_length([tuple(r) for r in own.collect()])  # SHARD_CHARS characters at most
        return docs.withColumn(to, _finder(spark, found)(F.col(text).cast("string")))
    own = written(own, "items")
    df, every = _statistics(own)
    names = [f"k{i}" for i in range(len(docs.columns))]
    whole = written(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "decontaminated")
    content = F.col(names[docs.columns.index(text)]).cast("string")
    found = None
    for shard in range(shards):
        some = own.where(F.pmod(F.xxhash64("id", "t"), F.lit(shards)) == shard)
        part = [tuple(r) for r in some.collect()]
        asked = spark.createDataFrame([(t,) for t in {x for _, t in part for x in terms(t)}], "term string")
        some = Index.by_length(part, Statistics(every.items, every.mean, dict(map(tuple, df.join(asked, "term").collect()))))
        part = written(whole.select("row", _finder(spark, some)(content).alias("leaks")).where("size(leaks) > 0"), "leaks")
        found = part if found is None else found.union(part)
    together = found.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    out = whole.join(together, "row", "left")
    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns) if c != to]
    return out.select(*kept, F.coalesce("leaks", F.array().cast(_LEAKS)).alias(to))


_LEAKS = "array<struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double, start_word: bigint>>"


def _finder(spark, indexes: list[Index]):
    import pandas as pd

    shared = spark.sparkContext.broadcast([tuple(vars(index).values()) for index in indexes])

    def run(columns):
        own = [(Index(*x), {}) for x in shared.value]
        for column in columns:
            yield pd.Series([sorted((x for index, rows in own for x in leaks(t, index, rows)), key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["score"])) for t in column.tolist()], dtype=object)

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, _LEAKS)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row for each item of ``benchmark`` that a row of ``documents`` leaks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return annotate(docs, items).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
