"""Importance resampling: composed CRCs against zlib, whole results against plain Python and SQL, odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from coinbrook.llm import resample

SF = "/root/testdata/sf0.001"
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def buckets(text, longest=1, n=resample.BUCKETS):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, longest=1, least=20, percent=10, seed=2024):
    s, t = (Counter(b for x in texts for b in buckets(x, longest)) for texts in ([x for _, x in rows], target))
    source, wanted = (sum(c.values()) + resample.BUCKETS for c in (s, t))
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * source / ((s[b] + 1.0) * wanted))) for b in s}
    out = []
    for i, x in rows:
        found = buckets(x, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((i, len(words(x)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    drawn = len(able) * percent // 100
    ranked = [(*r, k if k <= drawn else None) for k, r in enumerate(able, 1)] + [(*r, None) for r in out if r[1] < least]
    return sorted(ranked, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_composed_crcs():
    shifts = resample.Shifts()
    import numpy as np

    parts = [b"a", b"", b"some words", "éß".encode(), b"x" * 70_000, b"0"]
    for a in parts:
        for b in parts:
            got = shifts.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
            assert int(got[0]) == zlib.crc32(a + b)


@pytest.mark.parametrize("piece", [resample.PIECE_BYTES, 7, 1])
@pytest.mark.parametrize("longest", [1, 2, 4])
def test_buckets_of_pieces(monkeypatch, piece, longest):
    monkeypatch.setattr(resample, "PIECE_BYTES", piece)
    monkeypatch.setattr(resample, "MEMORY", 3)
    features = resample.Features(longest, 1000)
    for text in ["The CAT, the dog-9 é日本 x", "", "   ", "one", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa b", "a b c d e f g h a b c", "...x...", "ÀÉ z"]:
        pieces = list(features.of(text.encode()))
        assert sum(n for n, _ in pieces) == len(words(text))
        assert sorted(int(b) for _, p in pieces for b in p) == sorted(buckets(text, longest, 1000)), text


def test_against_sql_and_python(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(resample.SQL)
    names = [d[0] for d in cursor.description]
    got = found(resample.op13_importance_resampling(spark, SF).select(*names))
    assert got == sorted(cursor.fetchall(), key=repr)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got == [(i, n, w, s, k) for i, _, n, w, s, k in brute(rows, target)]
    two = resample.resample(docs, spark.read.parquet(f"{SF}/benchmark.parquet"), longest=2, percent=33, least_words=50)
    assert found(two) == brute(rows, target, 2, 50, 33)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "null id here " * 9), (None, "null id here " * 9), (4, "x " * 30_000), (5, " \n\t "), (6, "héllo WÖRLD 日本語 🙂\n\nz"), (7, "a b c d e f"), (7, "f e d c b a " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "t", "at", "task", "n_words", "w", "score", "rank", "before")})
    target = spark.createDataFrame([("a b héllo",), (None,), ("",)], "text string").withColumn("doc_id", F.lit(1))
    assert found(resample.resample(df, target, percent=100, least_words=1)) == brute(rows, ["a b héllo"], 1, 1, 100)
    assert found(resample.resample(df, target.limit(0), percent=50, least_words=0)) == brute(rows, [], 1, 0, 50)
    assert resample.resample(df.limit(0), target).count() == 0
