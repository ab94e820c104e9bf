"""Quality rules against statistics worked out in plain Python, and the odd inputs."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from coinbrook.llm import rules
from coinbrook.llm.common import held_out

SF = "/root/testdata/sf0.001"


def plain(text):
    t = text or ""
    chars, words, lines = max(1, len(t)), t.split(" "), t.split("\n")
    n = len(words)
    return {
        "chars": len(t), "words": n, "lines": len(lines), "word_chars": chars / n, "line_words": n / len(lines), "upper": len(re.findall("[A-Z]", t)) / chars, "digits": len(re.findall("[0-9]", t)) / chars,
        "symbols": (chars - sum(c not in "|{}[]<>*&%$#@^~=_\\/+!" for c in t)) / chars, "bars": t.count("|") / n, "shouts": t.count("!") / n, "stops": t.count(".") / n, "commas": t.count(",") / n,
        "distinct_words": len(set(words)) / n, "distinct_lines": len(set(lines)) / len(lines),
    }


def test_statistics_and_scores_in_plain_python(spark):
    """Training rows, statistics and scores are worked out again from the texts; the fit is the same function."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    learn = [(r["doc_id"], r["quality"]) for r in labels.where(~held_out(5, 0)).where("quality IS NOT NULL").collect() if r["doc_id"] in texts]
    learn.sort(key=lambda x: order[x[0]])
    names = list(rules.statistics(F.col("text")))
    made = rules.fit(names, [[plain(texts[i])[k] for k in names] for i, _ in learn], [y for _, y in learn])
    got = {r["doc_id"]: r["score"] for r in rules.op4_rule_ensemble(spark, SF).collect()}
    for i, t in texts.items():
        own = plain(t)
        z = made.bias + sum(w for w, cs in made.rules if all((own[k] <= cut) == (side == "<=") for k, side, cut in cs))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)


def test_a_repeated_id_is_one_row(spark):
    """Rows that repeat a labelled id are learned from once; labels both ways count as 1."""
    rng = np.random.default_rng(1)
    rows = [(i, "junk ||| !!! " * (1 + i % 5) if i % 2 else "good words, and a full stop. " * (1 + i % 4)) for i in range(200)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(None, 1), (3, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    again = docs.unionByName(spark.createDataFrame([rows[i] for i in rng.integers(0, 200, 3000)], "doc_id long, text string"))
    one, other = rules.train(docs, labels, F.lit(True)), rules.train(again, labels, F.lit(True))
    assert one.rules and one == other


def test_clashing_columns_stay(spark):
    odd = [(1, None), (2, ""), (3, "x " * 100_000), (None, "words."), (1, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit("kept") for c in ("__score_chars", "__p_chars", "chars", "h", "y", "o")})
    r = rules.Rules(-0.5, [(1.5, [("chars", ">", 3.0)])])
    got = rules.score(docs, r, to="p")
    assert got.columns == [*docs.columns, "p"] and got.where("__p_chars = 'kept' AND __score_chars = 'kept'").count() == len(odd)
    assert rules.score(docs.withColumn("p", F.lit(9.0)), r, to="p").columns == [*docs.columns, "p"]
    assert rules.score(docs.limit(0), r).count() == 0
    assert rules.train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"), F.lit(True)).rules == []
