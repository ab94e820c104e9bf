"""The pipeline's stages, each against a plain computation on the stage's own input."""

import hashlib

import pytest

import corpus_pipeline
from coinbrook.llm import decontaminate, substring
from tests.llm.test_operators import ODD, brute_similar
from tests.llm.test_substring import brute_repeats

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = rows(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS
        after = rows(out)
        assert set(after) <= set(before)
        if name == "simhash_near_dedup":
            assert set(after) == brute_similar([(i, before[i]["text"]) for i in sorted(before)])
        elif name == "substring_dedup":
            texts = {i: r["text"] for i, r in before.items()}
            want = brute_repeats(texts)
            assert {i: r["text"] for i, r in after.items()} == {i: substring.without(t, want[i]) if want[i] else t for i, t in texts.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "decontamination":
            items = [decontaminate.terms(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            plain = {i: f" {' '.join(decontaminate.terms(r['text']))} " for i, r in before.items()}
            assert set(after) == {i for i, t in plain.items() if not any(f" {' '.join(x)} " in t for x in items)}
        docs, before = spark.createDataFrame(out.collect(), docs.schema), after
    last = rows(corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    assert {i: r["decoded_sha256"] for i, r in last.items()} == {i: hashlib.sha256(r["text"].encode()).hexdigest() for i, r in before.items()}


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame([(i, t, "en", None, None, 1) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score int")
    assert f(spark, docs, SF).count() >= 5
    assert f(spark, docs.limit(0), SF).count() == 0
