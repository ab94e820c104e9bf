"""The operators against brute force, round trips and held-out rows, and the odd inputs that each must stand."""

import base64
import hashlib
import math
import os
import re
import struct
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from coinbrook.llm import bpe, common, decontaminate, iblt, pieces, records, rules, simhash, suffix_tree, warc

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (None, "Null id here."), (4, "x " * 30_000), (5, " \n\t "), (6, "héllo wörld 日本語 🙂\n\nz")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with what operators use."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "t", "h", "did", "rank", "digest", "word", "fp", "key", "leaks", "learn", "payload", "removed")})


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def spread(df, id="doc_id"):
    return {r[id]: r for r in df.collect()}


# --- components


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_links_to_the_same_few_nodes_are_thinned(spark, monkeypatch):
    """A dense group that is linked to many of its members anew costs rows by its members, not by its links."""
    rng = np.random.default_rng(3)
    names = rng.permutation(1 << 20)[:1_000].tolist()
    edges = [(a, b) for a in names[60:500] for b in names[:60]] + [(a, b) for a in names[560:] for b in names[500:560]] + [(5_000_000, 5_000_001), (7, None)]
    rows, mark = [], common._mark
    monkeypatch.setattr(common, "_mark", lambda e: rows.append(mark(e)) or rows[-1])
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: min(names[:500]) for k in names[:500]}, **{k: min(names[500:]) for k in names[500:]}, 5_000_000: 5_000_000, 5_000_001: 5_000_000}
    assert max(n for n, _ in rows) <= 4 * len(names) < len(edges) // 10


def test_thinned_takes_batches_and_types(spark, monkeypatch):
    monkeypatch.setattr(common, "_TAKEN_EDGES", 3)
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{i:02}": "n00" for i in range(41)}
    with pytest.raises(ValueError):
        common.thinned(spark.createDataFrame([(1, "x")], "a long, b string"))


# --- 1


def test_suffix_tree_counts_and_base(spark, docs, texts):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = Counter(t for i, x in texts.items() if not held(i) for t in suffix_tree._tokens(x))
    n, v = sum(train.values()), len(train)
    for i, r in spread(suffix_tree.op1_suffix_tree(spark, SF)).items():
        tokens = suffix_tree._tokens(texts[i])
        base = sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_suffix_tree_scores_by_hand(spark):
    """Each word has 1 200 of 4 830 tokens, the end 30. "red" has always been followed by "car", and "sky" 30 times
    by the end, so "red car" fails at its end and "red sky" at "sky", by as much."""
    rows = [(i, "red car blue sky " * 40) for i in range(30)] + [(100, "red car"), (101, "red sky"), (102, "red car blue sky"), (103, "red sky blue car")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {k: r["score"] for k, r in spread(suffix_tree.score(df, F.col("doc_id") < 100, context_share=0.01, symbol_share=0.001, min_gain=1.0)).items()}
    word, end, follows = (1200 - 0.1) / 4830, (30 - 0.1) / 4830, (1200 - 0.5) / 1200  # 0.1: an equal part of the mass of unknown words
    rest = (0.5 / 1200) / (1 - word)  # what a state of one next word gives to what the root holds besides
    assert got[100] == pytest.approx(math.log10(word * follows * rest * end))
    assert got[101] == pytest.approx(math.log10(word * rest * word * (30 - 0.5) / 1200))
    assert got[102] > got[103] + 5


def test_suffix_tree_states_are_distributions(spark, docs):
    src = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"), F.lit(True).alias("learn"))
    words = common.written(suffix_tree._word_table(src), "words")
    total, distinct = words.agg(F.sum("learned"), F.count("*")).first()
    unknown = 0.01
    discount = unknown * total / distinct
    tree = suffix_tree.learn_tree(src, words, total, unknown, discount, 1e-3, 1e-4, 1.0)
    counts = {bytes(r["word"]): r["learned"] for r in words.collect()}
    own = [(tree.numbers.get(w, suffix_tree.OTHER), math.log(max(n - discount, 1e-300) / total)) for w, n in counts.items()] + [(suffix_tree.OTHER, math.log(unknown))]
    symbol, root = np.array([s for s, _ in own]), np.array([p for _, p in own])
    assert len(tree.contexts) > 20 and tree.contexts.max() >= 1 << 28  # longer contexts are among the states
    for state in range(len(tree.contexts)):
        assert np.exp(tree.lookup(np.full(len(symbol), state), symbol, root)).sum() == pytest.approx(1, abs=1e-6)


def test_suffix_tree_odd(spark, odd):
    got = suffix_tree.score(odd, F.lit(True)).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r["score"]) for r in got)
    assert suffix_tree.score(odd.limit(0), F.lit(True)).count() == 0
    assert {r["n_known"] for r in suffix_tree.score(odd, F.lit(False)).collect()} == {0}


@pytest.mark.parametrize("block_chars", [suffix_tree.BLOCK_CHARS, 200_000])
def test_suffix_tree_keeps_rare_contexts_of_a_large_corpus(spark, block_chars):
    """40 occurrences make a state however many other tokens there are, here less than 1e-4 of all, unless the
    caller asks for such a share."""
    rows = [(i, "zeta omega") for i in range(40)] + [(100 + i, "x " * 30_000) for i in range(20)] + [(200, "zeta omega")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spread(suffix_tree.score(df, F.col("doc_id") < 200, block_chars=block_chars))[200]["score"]
    assert got == pytest.approx(math.log10(39.5 / 60 * (39.5 / 40) ** 2))
    cut = spread(suffix_tree.score(df, F.col("doc_id") < 200, context_share=1e-4, block_chars=block_chars))[200]["score"]
    assert cut < got - 2


def test_suffix_tree_sends_little_between_tasks(spark):
    """What is counted, asked for and answered goes packed, and texts are cut into words once, so that shuffles stay below
    four times the texts with many blocks as well (6.2 before that, 3.0 since)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    status = lambda: spark._jsc.sc().statusStore().executorList(False)
    sent = lambda: sum(status().apply(i).totalShuffleWrite() for i in range(status().size()))
    before = sent()
    got = suffix_tree.score(docs, F.lit(True), block_chars=200_000).count()
    assert got == docs.count()
    assert sent() - before < 4 * docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_suffix_tree_packs_and_finds():
    rng = np.random.default_rng(5)
    sizes, symbols = np.array([3, 1, 2_000]), np.append([0, 127, 128, (1 << 31) - 1], rng.integers(0, 1 << 24, 2_000))
    got = list(suffix_tree._encoded_groups(pa.array(suffix_tree._as_bytes(sizes, symbols), pa.binary())))
    assert [len(got), got[0][0].tolist(), got[0][1].tolist()] == [1, sizes.tolist(), symbols.tolist()]
    recent, rest, value = rng.integers(-1 << 62, 1 << 62, 500), rng.integers(0, 9, 500), rng.random(500)
    assert all((a == b).all() for a, b in zip(suffix_tree._unpacked(suffix_tree._packed(recent, rest, value), 500, "iif"), (recent, rest, value)))
    index = suffix_tree.Index.of(recent, rest, value)
    assert index.find(recent, rest).tolist() == list(range(500)) and (index.find(recent, rest + 10) == -1).all()
    assert (suffix_tree.Index.of(recent[:0], rest[:0], value[:0]).find(recent, rest) == -1).all()


@pytest.mark.parametrize("mixed", [suffix_tree._mixed, lambda recent, rest: np.zeros(len(recent), np.uint64)])
def test_suffix_tree_counts_keys_seen(monkeypatch, mixed):
    """Also where all keys meet in one place of the table, and over several fillings."""
    monkeypatch.setattr(suffix_tree, "_mixed", mixed)
    monkeypatch.setattr(suffix_tree, "_ADDED_KEYS", 50)
    monkeypatch.setattr(suffix_tree, "_TAKEN_KEYS", 60)
    rng = np.random.default_rng(2)
    recent, rest = rng.integers(-3, 6, 700), rng.integers(0, 7, 700)
    seen, got = suffix_tree.Seen(30), Counter()
    taken = [x for i in range(0, 700, 70) for x in suffix_tree._adding(seen, recent[i : i + 70], rest[i : i + 70])] + [seen.taken()]
    for mark, a, b, n in taken:
        assert (np.diff(mark.astype(object)) >= 0).all() and len(set(zip(a.tolist(), b.tolist()))) == len(a)
        got.update({(x, y): v for x, y, v in zip(a.tolist(), b.tolist(), n.tolist())})
    assert len(taken) > 3 and got == Counter(zip(recent.tolist(), rest.tolist()))


def test_suffix_tree_adds_up_keys_of_equal_marks(monkeypatch):
    """Marks only sort; keys are told apart by themselves."""
    monkeypatch.setattr(suffix_tree, "_mixed", lambda recent, rest: np.zeros(len(recent), np.uint64))
    recent, rest = np.array([1, 2, 1, 2, 1]), np.array([5, 5, 5, 6, 5])
    _, *got = suffix_tree._distinct(recent, rest, np.ones(5, np.int64))
    assert sorted(zip(*(x.tolist() for x in got))) == [(1, 5, 3), (2, 5, 1), (2, 6, 1)]
    index = suffix_tree.Index.of(recent[:2], rest[:2], np.zeros(2))
    assert index.find(np.array([2, 1, 3]), np.array([5, 5, 5])).tolist() == [1, 0, -1]


# --- 2


def test_archive_round_trip(spark, tmp_path):
    long = "é" * 200
    pages = spark.createDataFrame([(3, "u3", long), (1, "u\r\n1", long), (2, None, "short"), (5, "u5", "short"), (4, "u4", None), (7, "u7", ""), (None, "n", long), (1, "u\r\n1", long)], "page_id long, url string, html string")
    warc.write(pages.withColumn("digest", F.lit(1)), str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w"), rebuild=True).collect()
    kinds = sorted((r["id"] is None, r["id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds[:-1] == [(False, 1, "response", None, 400), (False, 1, "response", None, 400), (False, 2, "response", None, 5), (False, 3, "revisit", 1, 400), (False, 4, "response", None, 0), (False, 5, "response", None, 5), (False, 7, "response", None, 0)]
    assert kinds[-1][2:] == ("revisit", 1, 400)
    for r in got:
        assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        length = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert len(body) == length + 4 and head.startswith(b"WARC/1.1\r\n")
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 3
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_damaged_payload_fails(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), str(tmp_path / "w"))
    bad = spark.read.parquet(str(tmp_path / "w/payloads")).withColumn("payload", F.lit(b"y"))
    bad.write.parquet(str(tmp_path / "v/payloads"))
    os.rename(tmp_path / "w/headers", tmp_path / "v/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, str(tmp_path / "v")).collect()


# --- 4


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["predicted"], y[r["doc_id"]]) for r in rules.op4_rule_ensemble(spark, sf).where("held_out").collect() if r["doc_id"] in y]
    assert sum(a == b for a, b in got) / len(got) > 0.95


def test_quality_columns_equal_the_rules(spark, odd):
    r = rules.Rules(-0.5, [(1.5, [("upper", ">", 0.01)]), (-2.0, [("words", "<=", 4.0), ("chars", ">", 0.0)])])
    names = list(rules.statistics(F.col("text")))
    stats = odd.select(*[c.alias(n) for n, c in rules.statistics(F.col("text")).items()]).collect()
    want = sorted(1 / (1 + math.exp(-(r.bias + sum(w for w, cs in r.rules if all((s[n] <= c) == (side == "<=") for n, side, c in cs))))) for s in stats)
    assert sorted(x["score"] for x in rules.score(odd, r).collect()) == pytest.approx(want)
    assert rules.fit(names, [], []).rules == [] and 0 < rules.score(odd, rules.fit(names, [[0] * len(names)] * 3, [1, 1, 1])).first()["score"] < 1


# --- 6


def brute_components(near, ids):
    """The least id that each one reaches over the matrix of links."""
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(near[i]):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), 1 << 60), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def test_links_named_at_first_keys_connect_as_much(spark):
    """Chains of fingerprints, each a few bits from the one before, fall into the same components."""
    rng = np.random.default_rng(9)
    rows, names = [], [f"w{i}" for i in range(simhash.WIDE)]
    for _ in range(30):
        fp = [int(rng.integers(1 << 62)) for _ in names]
        for _ in range(30):
            rows.append(tuple(fp))
            for _ in range(int(rng.integers(1, 30))):
                fp[int(rng.integers(len(fp)))] ^= 1 << int(rng.integers(62))
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))
    got = []
    for first in (None, simhash.wide_first):
        met = simhash._met(df, simhash.wide_keys_of, simhash.SIMILAR_BITS, first, carried=2)
        edges = met.select(F.xxhash64("w0_a", "w1_a").alias("a"), F.xxhash64("w0_b", "w1_b").alias("b"))
        got.append(({tuple(r) for r in common.components(edges).collect()}, met.count()))
    assert got[0][0] == got[1][0] and len(got[0][0]) > 800 and got[1][1] <= got[0][1]


def brute_similar(rows, least=0.8, width=5):
    """Ids that stay, taken in order, if those go that share ``least`` of the shingles with one that stays."""
    kept = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        own = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        if not any(len(own & s) >= least * len(own | s) for _, s in kept):
            kept.append((i, own))
    return {i for i, _ in kept}


@pytest.mark.parametrize("how", ["words", "tail"])
@pytest.mark.parametrize("least,most", [(0.8, 0.82), (0.85, 0.87), (0.9, 0.95)])
def test_planted_copies_go(spark, how, least, most):
    """Copies with words changed here and there, or with another end, at or just above a similarity: at least nine of
    ten go, at all of these levels; copies just below it stay, all of them."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows, below = [], []
    for k in range(120):
        n = int(rng.integers(150, 500))
        words = [word() for _ in range(n)]
        lost = (n - 4) * (1 - (share := rng.uniform(least, most))) / (1 + share)  # shingles of each text that the other lacks
        if k % 4 == 3:  # just below 0.8
            lost = (n - 4) * 0.125
        other = list(words)
        for at in range(0, int(lost) // 5) if how == "words" else ():
            other[at * (n // max(1, int(lost) // 5)) + 4] = word()
        if how == "tail":
            other[n - int(lost) :] = [word() for _ in range(int(lost))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if k % 4 == 3 and brute_similar(rows[-2:]) == {2 * k, 2 * k + 1}:
            below.append(2 * k + 1)
    want = brute_similar(rows)
    got = {r["doc_id"] for r in simhash.without_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    planted = {2 * k + 1 for k in range(120)} - want
    assert len(below) > 20 and set(below) <= got and want <= got
    assert len(planted) > 80 and len(planted & got) <= 0.1 * len(planted)


@pytest.mark.parametrize("head,chars,compared", [(1024, 16_000_000, 5000), (1, 10**6, 2), (3, 10**6, 4), (100, 2500, 3)])
def test_only_what_is_like_a_kept_text_goes(spark, monkeypatch, head, chars, compared):
    """A chain, each like the one before: what is not like the first stays, whatever the rounds and tasks of a group.
    Odd rows keep their own kind."""
    for name, n in (("HEAD_ROWS", head), ("HEAD_CHARS", chars), ("COMPARED_ROWS", compared)):
        monkeypatch.setattr(simhash, name, n)
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[14 * k : 14 * k + 200])) for k in range(12)]  # neighbours share 182 of 210 shingles
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (0, "another text of the same id"), (0, rows[0][1]), (20, None), (21, " "), (22, "")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fp", "w0", "row", "root", "t", "k0")})
    kept = simhash.without_similar(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id < 20").collect())
    stays = brute_similar(rows)
    assert len(stays) >= 5 and {i for i, t in got if t.startswith("w")} == stays and (0, "another text of the same id") in got and len(got) == len(stays) + 1
    assert [r["doc_id"] for r in kept.where("doc_id >= 20 OR doc_id IS NULL").collect()] == [20]
    assert simhash.without_similar(df.limit(0)).count() == 0


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for bits in range(5):
        y = x.copy()
        for i in range(len(y)):
            for p in rng.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(p)
        sides = []
        for z in (x, y):
            found = [set() for _ in z]
            for r, k in zip(*simhash.keys_of(z[:, None])):
                found[r].add(int(k))
            sides.append(found)
        assert all(a & b for a, b in zip(*sides))


def test_simhash_against_brute_force(spark, docs, texts):
    rows = simhash.op6_simhash_golay(spark, SF).collect()
    ids = [r["doc_id"] for r in rows]
    for r in rows[:20]:
        words = texts[r["doc_id"]].encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        import xxhash

        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert r["fingerprint"] == f"{want:016x}"
    fps = np.array([int(r["fingerprint"], 16) for r in rows], dtype=np.uint64)
    assert [r["component_id"] for r in rows] == brute_components(np.bitwise_count(fps[:, None] ^ fps) <= 4, ids)


def test_simhash_odd(spark, odd):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    assert {c for i, f, c in got if f == "0" * 16} == {2}  # null, empty and blank texts link to each other
    assert [c for i, f, c in got if i is None] == [None]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# --- 7


def xxh(items):
    h = 42
    for x in items:
        h = xxhash.xxh64_intdigest(x.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def brute_paragraphs(text):
    """The digests of a text's paragraphs, cut word by word."""
    out = set()
    for line in text.split("\n"):
        piece = []
        for w in line.split(" "):
            piece.append(w)
            if xxh([w]) % iblt.CUT_WORDS == 0:
                out.add(xxh(piece))
                piece = []
        if piece:
            out.add(xxh(piece))
    return out


def decoded(fingerprint):
    """The digests that a fingerprint holds, peeled in plain Python; cells are found from where a digest lies."""
    total, bits, body = fingerprint.split(".")
    raw, cells = base64.b64decode(body), {}
    for at in range(0, len(raw), 24):
        cell, n, d, check = struct.unpack(">IIqQ", raw[at : at + 24])
        cells[cell] = [n, d, check]
    assert len({c >> int(bits) for c in cells}) == 3
    assert all(sum(v[0] for c, v in cells.items() if c >> int(bits) == t) == int(total) for t in range(3))
    return int(total), int(bits), cells


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_sketches(spark, docs, texts):
    """Likeness of fingerprints is the Jaccard index of paragraphs found without Spark."""
    got = spread(iblt.op7_paragraph_sketches(spark, SF))
    order = sorted(texts, reverse=True)
    sets = {i: brute_paragraphs(texts[i]) for i in order}
    for k, i in enumerate(order):
        t, other = texts[i], order[(k + 1) % len(order)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + texts[other][:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        changed = brute_paragraphs(edited)
        assert got[i]["near_edited"] == pytest.approx(jaccard(sets[i], changed))
        assert got[i]["near_next"] == pytest.approx(jaccard(sets[i], sets[other]))
        for fingerprint, held in ((got[i]["fingerprint"], sets[i]), (got[i]["edited_fingerprint"], changed)):
            total, bits, cells = decoded(fingerprint)
            assert total == len(held)
            for t3 in range(3):  # every digest lies in one cell of each table
                whole = 0
                for c, v in cells.items():
                    whole ^= v[1] if c >> bits == t3 else 0
                assert whole == reduce(lambda x, y: x ^ y, held, 0)
    by_text = {}
    for i in order:
        assert by_text.setdefault(texts[i], got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_texts_move_once_and_the_next_document_is_across_ranges(spark):
    """One shuffle of texts; repeated rows, null ids and equal ids at the ends of ranges keep their place in the order."""
    rows = [(i % 11 if i % 4 else None, f"{'w' * (i % 7)} {i // 2 * 2}\nand line {i % 5}" if i % 13 else None) for i in range(60)] + [(3, "same")] * 3 + [(10, "last")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = df.select(F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit(""))).collect()
    for few in (df, df.limit(1), df.where("text = 'same'")):
        keys = hashes if few is df else [tuple(r) for r in few.select(F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit(""))).collect()]
        order = sorted({tuple(k) for k in keys})
        got = {(r["did"], r["h"]): r for r in iblt.versions(few).collect()}
        assert len(got) == len(order) and sum(r["copies"] for r in got.values()) == len(keys)
        for k, (did, h, t) in enumerate(order):
            cut, r = len(t) // 3, got[did, h]
            edited = t[: len(t) - cut] + order[k - 1][2][:cut]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert (set(r["own"]), set(r["edited"]), set(r["next"])) == tuple(brute_paragraphs(x) for x in (t, edited, order[k - 1][2]))
    plan = iblt.versions(df)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan)) == 1


def test_fingerprints_subtract_and_are_retried_larger(spark, docs, texts):
    found = common.written(iblt.versions(docs), "paragraphs")
    rows, left = iblt.differences(found)
    assert left[0] > 0 and left[-1] == 0 and len(left) > 1  # some differences do not fit the smaller fingerprint
    sides = {(r["did"], r["h"]): (set(r["own"]), set(r["edited"]), set(r["next"])) for r in found.collect()}
    got = {(r["did"], r["h"], r["kind"]): (sorted(r["plus"]), sorted(r["minus"])) for r in rows.collect()}
    for (did, h), (own, edited, after) in sides.items():
        for kind, other in ((0, edited), (1, after)):
            assert got.get((did, h, kind), ([], [])) == (sorted(own - other), sorted(other - own))


def test_peeling_recovers_the_difference(spark):
    rng = np.random.default_rng(5)
    pick = lambda n: [int(x) for x in rng.integers(-(1 << 62), 1 << 62, n)]
    pairs = {k: (pick(a), pick(b), pick(c)) for k, (a, b, c) in {1: (30, 5, 7), 2: (0, 20, 0), 3: (100, 0, 0), 4: (0, 1, 1), 5: (10, 60, 60)}.items()}
    rows = [(k, 1, d) for k, (s, a, b) in pairs.items() for d in s + a] + [(k, -1, d) for k, (s, a, b) in pairs.items() for d in s + b]
    df = spark.createDataFrame(rows, "k int, sign long, d long").withColumn("bits", F.lit(9))
    got = {r["k"]: (sorted(r["plus"]), sorted(r["minus"]), r["failed"]) for r in iblt.peel(iblt._cells(df, ["k"]), ["k"]).collect()}
    assert got == {k: (sorted(a), sorted(b), False) for k, (s, a, b) in pairs.items() if a or b}
    small = df.withColumn("bits", F.lit(2))
    assert {r["k"] for r in iblt.peel(iblt._cells(small, ["k"]), ["k"]).where("failed").collect()} >= {5}


def test_an_early_word_changes_one_paragraph_of_a_long_line(spark):
    text = " ".join(f"w{k * 7919 % 5003}" for k in range(20_000))
    row = spark.createDataFrame([(text, "new " + text)], "a string, b string").select(iblt.paragraphs(F.col("a")).alias("a"), iblt.paragraphs(F.col("b")).alias("b")).first()
    a, b = set(row["a"]), set(row["b"])
    assert len(a) > 100 and len(a ^ b) <= 3


def test_sketches_odd(spark, odd):
    got = iblt.compare(odd).collect()
    assert len(got) == len(ODD) and sum(r["doc_id"] is None for r in got) == 1
    assert all(r["fingerprint"] for r in got)
    assert iblt.compare(odd.limit(0)).count() == 0
    one = iblt.compare(odd.where("doc_id = 6")).first()
    assert one["near_next"] == 1.0  # its next document is itself


# --- 8


def test_byte_bpe_is_exact(spark, docs, texts):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in spread(bpe.op8_byte_bpe(spark, SF)).items():
        ids = enc.encode_ordinary(texts[i])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())


def test_byte_bpe_odd_and_decoding(spark, odd):
    path = P.path("byte_bpe_50k.json")
    got = bpe.encode(odd, path, keep=["doc_id"], offsets=True)
    back = {r["doc_id"]: r for r in bpe.decode(got, path).collect()}
    for i, t in ODD:
        assert back[i]["text"] == (t or "")
        assert back[i]["n_tokens"] == len(back[i]["offsets"]) and list(back[i]["offsets"]) == sorted(back[i]["offsets"])
    assert bpe.encode(odd.limit(0), path).count() == 0


STRANGE = [" héllo  wörld\n x 日本語🙂", "", "a ", " a", "\n a b\n", "<|endoftext|> x<|endoftext|>", "It's I'M we'LL don't", "Σας ΣΑΣ İstanbul é ≠ x", "a\n\nb c\td", None, "x y z", "123 4567,89 a1b2 _x_ ...", "a b\x1cc\x85d e ª µ º ſ ŉ", "'s 't it.'s o'", "   ", "a\n\n\n b", "\r\n x"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_like_whole_texts(name, texts):
    import pyarrow as pa

    every = STRANGE + list(texts.values())
    if name.startswith("byte"):
        enc = pieces.ChunkEncoder(P.path(name), True, True)
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(every)]
    else:
        enc = pieces.WordEncoder(P.path(name))
        flat, sizes = enc.encode(pa.array(every, pa.string()))
        got = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert enc.apart and got == [enc.model.encode(t or "", add_special_tokens=False).ids for t in every]


# --- 9


def brute_bm25(items, query, least):
    bags = {i: Counter(decontaminate.terms(t)) for i, t in items}
    df = Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    out = {}
    for i, b in bags.items():
        size = sum(b.values())
        w = {t: math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * n * 1.9 / (n + 0.9 * (0.6 + 0.4 * size / mean)) for t, n in b.items()}
        s = sum(w[t] for t in w if t in query) / sum(w.values())
        if s >= least - 1e-9:
            out[i] = s
    return out


def test_block_max_wand_retrieves_all():
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(3, 12), p=(p := 1 / np.arange(1, 121)) / p.sum()))) for i in range(400)]
    index = decontaminate.Index.of(items)
    for least in (0.2, 0.5, 0.9):
        for _ in range(40):
            query = set(rng.choice(vocab, 25))
            got = {index.ids[k]: s for k, s in index.search(query, least)}
            assert got == pytest.approx(brute_bm25(items, query, least))


def test_bounds_lose_no_passage(monkeypatch):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(3, 12)))) for i in range(100)]
    for cells in (16_000_000, 900):  # the second leaves three ranges of items
        monkeypatch.setattr(decontaminate, "RANGE_CELLS", cells)
        index = decontaminate.Index.of(items)
        words = [*rng.choice([*vocab, "other"], 3000), *items[7][1].split()]
        rows = np.array([index.row(w) for w in words])
        starts = np.arange(0, len(words) - 32, 32)
        got = set(index.within_reach(rows, starts, 0.6).tolist())
        assert {a for a in starts.tolist() if brute_bm25(items, set(words[a : a + 64]), 0.6)} <= got
    assert index.ranges.shape[1] <= 4


def test_leaks_found_and_clean_left(spark, docs, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(decontaminate.terms(t))
    want = {(d, i) for d, t in texts.items() for i, x in items if f" {plain(x)} " in f" {plain(t)} "}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op9_decontaminate(spark, SF).collect()}
    assert want and got == want


def test_decontaminate_odd(spark, odd):
    items = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (1, "a b c d e f"), (4, "...")], "item_id long, text string")
    got = decontaminate.annotate(odd, items, to="found").collect()
    assert len(got) == len(ODD) and sum(bool(r["found"]) for r in got) == 2
    assert all(not r["found"] for r in decontaminate.annotate(odd, items.limit(0), to="found").collect())


def test_dealing_items_to_indexes_changes_no_score(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = lambda: {(r["doc_id"], *r["leak"]) for r in decontaminate.annotate(docs, items).select("doc_id", F.explode("leaks").alias("leak")).collect()}
    one = whole()
    chars = items.agg(F.sum(F.length("text"))).first()[0]
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", chars // 3)
    several = whole()
    assert {x[:2] for x in one} == {x[:2] for x in several}
    assert sorted(x[2] for x in one) == pytest.approx(sorted(x[2] for x in several))


def test_the_longest_item_is_whole_in_a_passage_wherever_it_stands():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((8, 40, 300, 20_000))]
    index = decontaminate.Index.of(items[:3])
    for k in (1, 2):
        for at in range(0, 130, 13):
            text = " ".join([*(word() for _ in range(at)), items[k][1], *(word() for _ in range(200))])
            assert [(x["item_id"], round(x["score"], 9)) for x in decontaminate.leaks(text, index, {})] == [(k, 1.0)]
    long = decontaminate.Index.of(items)
    assert [x["item_id"] for x in decontaminate.leaks(" ".join([*(word() for _ in range(50)), items[3][1]]), long, {})] == [3]


def test_a_long_item_changes_no_other_items_leaks(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    question, answer = [word() for _ in range(30)], [word() for _ in range(6)]
    items = [(1, f"{' '.join(question)}? {' '.join(answer)}"), (2, " ".join(word() for _ in range(100))), (3, " ".join(word() for _ in range(45)))]
    apart = " ".join([*question, *(word() for _ in range(6000)), *answer])
    near = " ".join([*(word() for _ in range(500)), items[1][1], *(word() for _ in range(70)), items[0][1], *(word() for _ in range(400))])
    docs = spark.createDataFrame([(1, apart), (2, near), (3, items[2][1])], "doc_id long, text string")
    found = lambda given: sorted((r["doc_id"], x["item_id"], x["start_word"]) for r in decontaminate.annotate(docs, spark.createDataFrame(given, "item_id long, text string")).collect() for x in r["leaks"] if x["item_id"] < 9)
    want = found(items)
    assert [x[:2] for x in want] == [(2, 1), (2, 2), (3, 3)]
    for n in (63, 64, 65, 128, 20_000):
        assert found([*items, (9, " ".join(word() for _ in range(n)))]) == want
    assert [decontaminate.class_of(n) for n in (0, 1, 64, 65, 128, 129, 20_000)] == [0, 0, 0, 1, 1, 2, 9]


# --- 10


def slow_masked(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    c ^= 0xFFFFFFFF
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums():
    parts = [os.urandom(n) for n in (0, 1, 63, 64, 65, 127, 128, 129, 1000, 5000)]
    assert records.masked_crc32c(parts).tolist() == [slow_masked(p) for p in parts]
    framed = b"".join(records.frames(parts))
    assert [r for _, rs in records.unframed(framed) for r in rs] == parts
    broken = bytearray(framed)
    broken[30] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(records.unframed(bytes(broken)))
    with pytest.raises(ValueError, match="cut off"):
        list(records.unframed(framed[:-3]))


def test_record_files(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got, start = spread(records.op10_record_files(spark, SF)), 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)


def test_record_files_odd(spark, odd, tmp_path):
    path = P.path("word_bpe_49k.json")
    index = records.write(odd, str(tmp_path / "r"), path, 1, shard_chars=20_000)
    assert index.count() == len(ODD) and index.select("shard").distinct().count() > 1
    whole = {(r["shard"], r["ordinal"]): np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in records.read(spark, str(tmp_path / "r")).collect()}
    for r in records.read_at(index.orderBy(F.rand(1)), str(tmp_path / "r")).collect():
        assert whole[(r["shard"], r["ordinal"])] == r["ids"]
    records.write(odd.limit(0), str(tmp_path / "e"), path, 1)
    assert records.read(spark, str(tmp_path / "e")).count() == 0
