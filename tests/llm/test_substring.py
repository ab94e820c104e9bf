"""Repeated lines and passages, against a computation that goes through whole texts one after the other."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from coinbrook.llm import substring

SF = "/root/testdata/sf0.001"


def word_hash(word):
    h = 0
    for k, c in enumerate(word.lower()):
        h += ord(c) * pow(0x9E3779B97F4A7C15, k, 1 << 64)
    h %= 1 << 64
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return h ^ h >> 27


def pieces(words):
    """Lists of the words' numbers: each begins at a word with the least hash among three before and behind."""
    h, out = [word_hash(w) for w in words], []
    for k in range(len(words)):
        if k == 0 or (all(h[k] < x for x in h[max(0, k - 3) : k]) and all(h[k] <= x for x in h[k + 1 : k + 4])):
            out.append([])
        out[-1].append(k)
    return out


def brute_repeats(texts, run_words=20):
    """The spans that each text loses. ``texts``: id to text."""
    lines_of, pieces_of, out = {}, {}, {}
    for i in sorted(texts):
        spans, lines, small = [], set(), set()
        for m in re.finditer(r"[^\n]+", texts[i] or ""):
            found = [(w.group(), m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\S+", m.group())]
            if not found:
                continue
            line = " ".join(w for w, _, _ in found).lower()
            units = [(" ".join(found[k][0] for k in p).lower(), p) for p in (pieces([w for w, _, _ in found]) if len(found) > run_words else [])]
            if line in lines or line in lines_of or line in pieces_of:
                spans.append((found[0][1], found[-1][2]))
            else:
                run = []
                for text, p in [*units, (None, [])]:
                    if text is not None and (text in pieces_of or text in lines_of):
                        run += p
                    else:
                        if len(run) >= run_words:
                            spans.append((found[run[0]][1], found[run[-1]][2]))
                        run = []
            lines.add(line)
            small.update(text for text, _ in units)
        out[i] = spans
        lines_of.update(dict.fromkeys(lines, i))
        pieces_of.update(dict.fromkeys(small, i))
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_repeats(texts)
    for r in substring.dedup(docs).collect():
        assert [(s["start"], s["end"]) for s in r["removed"]] == want[r["doc_id"]]
        assert r["n_removed"] == sum(b - a for a, b in want[r["doc_id"]])
        gone = r["text"].split() if want[r["doc_id"]] else None
        if gone is None:
            assert r["text"] == texts[r["doc_id"]]
        else:  # the words outside the spans
            left, at = [], 0
            for a, b in want[r["doc_id"]]:
                left += texts[r["doc_id"]][at:a].split()
                at = b
            assert gone == left + texts[r["doc_id"]][at:].split()
    assert any(want.values())


def test_short_lines_go(spark):
    rows = [(1, "All rights reserved.\nOne"), (2, "Two\nall  RIGHTS reserved.\nThree\nThree"), (3, "\n  \nTwo lines\n")]
    got = {r["doc_id"]: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["text"] for i in (1, 2, 3)] == [rows[0][1], "Two\nThree\n", rows[2][1]]
    assert [(s["start"], s["end"]) for s in got[2]["removed"]] == [(4, 25), (32, 37)]


@pytest.mark.parametrize("size", [51, 60, 80])
def test_passages_inside_lines(spark, size):
    """At every offset of a passage in its line, all but its ends goes; words around it stay."""
    rng = np.random.default_rng(size)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passage = " ".join(word() for _ in range(size))
    rows = [(0, passage)] + [(i, " ".join(word() for _ in range(i)) + " " + passage + " " + " ".join(word() for _ in range(20))) for i in range(1, 60)]
    got = {r["doc_id"]: r["text"] for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == passage
    cut = 0
    for i, text in rows[1:]:
        kept, words = got[i].split(), text.split()
        cut += len(words) - len(kept) >= 20
        assert kept[:i] == words[:i] and kept[-20:] == words[-20:]
    assert cut == 59


def test_odd_rows(spark):
    """Nulls, empty, blank and long texts; repeated rows; a third of the rows without an id; clashing names."""
    odd = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "Null id here."), (None, "Null id here."), (4, "x " * 30_000), (5, " \n\t "), (6, "z\n" * 9)]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("t", "row", "rank", "units", "d", "removed", "k0", "places")})
    got = substring.dedup(docs)
    assert got.columns == [c for c in docs.columns if c != "removed"] + ["n_units", "n_removed", "removed"]
    rows = got.collect()
    assert len(rows) == len(odd) and sum(r["text"] is None for r in rows) == 1
    assert sum(r["text"] == "a b c d e f" for r in rows) == 2  # a repeated row is not removed in favour of itself
    assert sorted(r["text"] for r in rows if r["doc_id"] is None) == ["", "Null id here."]
    assert {r["doc_id"]: r["text"] for r in rows}[6] == "z\n" and {r["doc_id"]: r["text"] for r in rows}[4] == "x " * 30_000
    assert substring.dedup(docs.limit(0)).count() == 0


def test_digests_are_not_dealt_with_the_texts(spark):
    docs = spark.createDataFrame([(1, "a line\nanother"), (2, "a line\nown"), (3, None), (4, "")], "doc_id long, text string")
    out = substring.dedup(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "places" in plan and "d:bigint" not in plan
    assert {r["doc_id"]: (r["text"], r["n_units"]) for r in out.collect()} == {1: ("a line\nanother", 2), 2: ("own", 2), 3: (None, 0), 4: ("", 0)}


def test_units_do_not_depend_on_the_texts_beside(spark):
    """Places are found a second time among other texts; \u03a3 at a word's end and \u0130 must not move them."""
    rng = np.random.default_rng(3)
    text = " ".join("".join(rng.choice(list("ΑΒΓΔΕΣ"), 4)) + "Σ" for _ in range(400))
    counts, digests, own = substring.units([text, "İ x"])
    alone = substring.units([text])
    assert alone[1] == digests[: counts[0]] and all((a == b[: counts[0]]).all() for a, b in zip(alone[2], own))
    assert all((a == b).all() for a, b in zip(substring.units([text], hashed=False)[2], alone[2]))


def test_no_places_of_units_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b\nc\na b\n c"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["rank"]: r for r in substring._with_units(docs, ["doc_id"], "text", "doc_id", 20).collect()}
    assert [u is None for u in got[1]["units"]] == [False, False, True, True] and got[1]["again"] == [2, 3] and got[1]["n_units"] == 4
    assert set(got[1]["units"][0].asDict()) == {"d", "e"} and got[2]["units"] == got[3]["again"] == []
