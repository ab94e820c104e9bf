"""Hard negatives: bounds that hold, and whole results against brute force, SQL and odd inputs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from coinbrook.llm import negatives

SF = "/root/testdata/sf0.001"


def brute(rows, anchors, positives=5, negatives=5, low=80, high=100):
    """rows: (id, label, integers)."""
    out = []
    for a, label, v in rows:
        if not anchors(a):
            continue
        scored = sorted((-int(np.dot(v, w)), i, own) for i, own, w in rows if i != a)
        for p, i, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(-s, j) for s, j, own in scored if own != label and low * -p <= 100 * -s <= high * -p][:negatives]
            out += [(a, i, k, j, -p, s) for k, (s, j) in enumerate(inside, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows, extra=()):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    return df.withColumns({c: F.lit(1) for c in extra})


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(negatives.SQL).fetchall())
    assert want and found(negatives.op11_hard_negatives(spark, SF)) == want


@pytest.mark.parametrize("part,codes", [(4, 256), (3, 4), (64, 2)])
def test_bounds_hold(part, codes):
    rng = np.random.default_rng(2)
    vectors, anchors = rng.integers(-300, 300, (400, 10)), rng.integers(-300, 300, (20, 10))
    books = negatives.Codebooks.of(vectors, part, codes)
    lower, upper = books.bounds(anchors, *books.encode(vectors))
    exact = anchors @ vectors.T
    assert (lower <= exact).all() and (exact <= upper).all()
    if part == 4:
        assert np.median(upper - lower) < np.abs(exact).std()  # and they tell something


def test_clusters_ties_and_many_batches(spark, monkeypatch):
    """Copies tie by id, windows fill at their edges, anchors come in several blocks and rows in several batches."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    x = (centres[rng.integers(0, 4, 600)] + rng.normal(scale=0.2, size=(600, 6))).astype(np.float32)
    x[100:300] = x[100]  # a third of all rows is one vector
    rows = [(int(i), int(i * 7 % 3), x[i].tolist()) for i in rng.permutation(600)]
    plain = [(i, k, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, k, v in rows]
    want = brute(plain, lambda i: i % 10 == 0)
    monkeypatch.setattr(negatives, "ANCHORS_AT_ONCE", 7)
    monkeypatch.setattr(negatives, "ROWS_AT_ONCE", 50)
    got = negatives.mine(table(spark, rows).repartition(3), F.col("id") % 10 == 0, block=9)
    assert found(got) == want and len({r[0] for r in want}) > 30
    other = negatives.mine(table(spark, rows), F.col("id") % 50 == 0, positives=2, negatives=9, low=95, high=99)
    assert found(other) == brute(plain, lambda i: i % 50 == 0, 2, 9, 95, 99)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0, 0.5]), (1, 1, [0.9, 0.1, 0.5]), (2, 2, [0.9, 0.0, 0.45]), (3, 2, [0.9, 0.0, 0.45]), (3, 2, [0.9, 0.0, 0.45]), (4, None, [1.0, 0.0, 0.5]), (5, 2, None), (6, 2, [0.9, None, 0.45]), (7, 2, [nan, 0.0, 0.45]),
            (8, 2, [inf, 0.0, 0.45]), (None, 2, [0.9, 0.0, 0.45]), (9, 2, [0.9, 0.0]), (10, 2, []), (200, 3, [-1.0, 0.0, 0.0]), (201, 3, [1.0, 0.0, 0.0]), (202, 1, [-0.5, 0.0, 0.0])]
    df = table(spark, rows, ("id", "x", "rank", "anchor", "codes", "n"))
    sound = {i: (i, k, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, k, v in rows if i in (0, 1, 2, 3, 200, 201, 202)}
    want = brute(list(sound.values()), lambda i: i % 100 == 0)
    assert want and found(negatives.mine(df, F.col("id") % 100 == 0)) == want  # 200 has a positive below zero: no window
    assert negatives.mine(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert negatives.mine(df, F.col("id") == 77).count() == 0
    assert negatives.mine(table(spark, [(0, 1, [1.0]), (1, 1, [1.0])]), F.lit(True)).count() == 0  # no negatives
    large = [(i, i % 2, [float((i + 1) * 100_000), 1.0]) for i in range(6)]
    plain = [(i, k, np.floor(256 * np.array(v)).astype(np.int64)) for i, k, v in large]
    assert found(negatives.mine(table(spark, large + [(9, 1, [0.5, 0.5])]), F.col("id") < 2, low=0)) == brute(plain + [(9, 1, np.array([128, 128]))], lambda i: i < 2, low=0)
    with pytest.raises(Exception, match="too long"):
        negatives.mine(table(spark, [(0, 1, [1e30, 0.0])]), F.lit(True)).count()
