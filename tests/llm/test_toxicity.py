"""Toxicity against a computation word by word, unseen misspellings, held-out rows and odd inputs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coinbrook.llm import toxicity
from coinbrook.llm.common import held_out

SF = "/root/testdata/sf0.01"
_64 = (1 << 64) - 1


def bucket(gram):
    h = ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & _64
    h ^= len(gram)
    return ((h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _64) >> 47


def brute_score(text, model):
    words = (text or "").lower().split()
    total = 0.0
    for w in words:
        marked = f"<{w.strip(toxicity._EDGES)}>"
        grams = [marked[i : i + n] for n in (3, 4, 5, 6) for i in range(len(marked) - n + 1)]
        total += sum(float(model.weight[bucket(g)]) for g in grams) / max(1, len(grams))
    return 1 / (1 + math.exp(-(total / (len(words) + 10) + model.bias)))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.train(*tables, ~held_out(3, 1))


def test_against_brute_force(tables, model):
    docs = tables[0].where("n_chars < 5000")
    for r in toxicity.score(docs, model).collect():
        assert r["score"] == pytest.approx(brute_score(r["text"], model), rel=1e-4)


def test_held_out(spark):
    got = toxicity.op3_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r["toxic"]: r["share"] for r in got}
    assert share[1] > 0.8 and share[0] < 0.01


def test_learns_misspellings_and_length_alone_does_nothing(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(300)]
    text = lambda bad, n=30: " ".join([*rng.choice(words, n), *bad])
    bad = ["stupidity", "stupids", "xstupid"]
    x = [text([bad[i % 3]] * 2) for i in range(60)] + [text([]) for _ in range(200)]
    model = toxicity.fit(list(toxicity.bags(pa.array(x))), [1] * 60 + [0] * 200)
    got = toxicity.scores(pa.array([text(["stupidest"] * 2), text([]), text([], 50_000), "", None]), model)
    assert got[0] > 0.7 and (got[1:] < 0.3).all()


def test_vectors_and_softmax_are_trained_together():
    """Vectors of several dimensions, both rows of the softmax moved from where they began, and scores that depend on
    how many dimensions there are."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(200)]
    x = [" ".join([*rng.choice(words, 30), *(["grobian"] * (i % 3 == 0))]) for i in range(300)]
    y = [int(i % 3 == 0) for i in range(300)]
    made = {d: toxicity.fit(list(toxicity.bags(pa.array(x))), y, dim=d) for d in (1, toxicity.DIM)}
    rank = np.linalg.matrix_rank(made[toxicity.DIM].vectors, rtol=1e-5)
    assert rank == toxicity.DIM
    start = toxicity.fit(list(toxicity.bags(pa.array(x))), y, steps=0).softmax
    assert (np.abs(made[toxicity.DIM].softmax - start).max(axis=1) > 0.01).all()
    a, b = (toxicity.scores(pa.array(x), made[d]) for d in (1, toxicity.DIM))
    assert np.abs(a - b).max() > 1e-3 and ((b > 0.5) == np.array(y, bool)).all()
    own = made[toxicity.DIM]
    weights = own.vectors @ (own.softmax[1] - own.softmax[0])
    assert (own.weight != 0).sum() == (weights.astype(np.float32) != 0).sum()


def test_bags_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} other{i} " * 20) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda found, y, weights: seen.append((sum(len(b) for b, _ in found), len(y))))
    for most in (10**6, 500, 1):
        monkeypatch.setattr(toxicity, "TRAIN_ENTRIES", most)
        toxicity.train(docs, labels, F.lit(True))
    assert seen[0][1] == 40 and 2 < seen[1][1] < 40 and seen[1][0] <= 500 and seen[2][1] == 1


def test_odd_rows(spark):
    """Nulls, blanks, long texts, repeated ids and rows, columns with clashing names, empty tables."""
    odd = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "Null id here."), (4, "x " * 200_000), (5, " \n\t "), (6, "-- ... !"), (6, "héllo 日本 🙂")]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "t", "h", "y")})
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (9, None), (6, 5)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    got = toxicity.score(docs, model, to="p")
    assert got.columns == [*docs.columns, "p"] and got.count() == len(odd) and all(0 <= r["p"] <= 1 for r in got.collect())
    assert len({r["p"] for r in got.where("doc_id IN (2, 3, 5)").collect()}) == 1
    assert toxicity.score(docs, model).columns == docs.columns
    assert toxicity.train(docs, labels.where("toxic = 0"), F.lit(True)).prior == 0.0
    assert toxicity.train(docs.limit(0), labels.limit(0), F.lit(True)).prior == 0.0
    assert toxicity.score(docs.limit(0), model).count() == 0
