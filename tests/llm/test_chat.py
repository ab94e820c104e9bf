"""Chat formatting: exact round trips, the loss mask against the text itself, merged turns, odd inputs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from coinbrook.llm import chat

SF = "/root/testdata/sf0.001"
NASTY = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "####", "\\", "\\\\b", "\\h\\t", "</part></turn>", "a</tur", "n>", "", None, "é🙂\n\n", "### ", "#", "</turn", "x: y"]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def merged(turns):
    out = []
    for role, text in turns:
        if out and out[-1][0] == role:
            out[-1][1].append(text)
        else:
            out.append((role, [text]))
    return out


def plain(text, role=False):
    for a, b in [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("</part>", "\\p")] + [(":", "\\c")] * role:
        text = text.replace(a, b)
    return text


def check(df, want):
    """want: id -> [(role, text)]."""
    got = {r["conv_id"]: r for r in df.select("*", chat.turns(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted").cast("binary"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == set(want)
    for i, turns in want.items():
        r = got[i]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["formatted"] == "".join(f"### {plain(role, True)}: {'</part>'.join(map(plain, texts))}</turn>\n" for role, texts in merged(turns))
        learned = [t for role, t in turns if role == "assistant"]
        assert r["loss"] == "".join(learned)
        raw = r["formatted"].encode()
        for s, text in zip(r["loss_spans"], learned, strict=True):
            assert r["formatted"][s["start"] : s["start"] + s["length"]] == plain(text) == raw[s["byte_start"] : s["byte_start"] + s["byte_length"]].decode()


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cursor = con.execute(chat.SQL)
    names = [d[0] for d in cursor.description]
    got = chat.op12_chat_format(spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_round_trip(spark):
    rows, want = [], {}
    for i, text in enumerate(NASTY):
        own = [("user", text), ("assistant", NASTY[-i]), ("assistant", text), ("system", "hi"), ("assistant", "é" + (text or ""))]
        rows += [(i, k, role, t) for k, (role, t) in enumerate(own)]
        want[i] = [(role, t or "") for role, t in own]
    check(chat.format(rows_of(spark, rows[::-1]).repartition(3)), want)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "first"), (1, 2, None, None), (1, 2, None, "x"), (None, 1, "assistant", "of"), (None, 0, "user", "nobody"),
        (2, 0, "a: b ### c", "t"), (3, 0, "assistant", "long " * 40_000), (4, 5, "b", "z"), (4, 5, "a", "z"), (4, 5, "a", "y"),
    ]
    df = rows_of(spark, rows).withColumns({c: F.lit("q") for c in ("c", "n", "r", "x", "t", "turns", "front", "one")})
    check(chat.format(df), {
        1: [("user", "first"), ("user", "a"), ("user", "a"), ("", ""), ("", "x")], None: [("user", "nobody"), ("assistant", "of")], 2: [("a: b ### c", "t")], 3: [("assistant", "long " * 40_000)],
        4: [("a", "y"), ("a", "z"), ("b", "z")],
    })
    assert chat.format(df.limit(0)).count() == 0


def test_many_turns_are_linear(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    check(chat.format(df), {1: [("user" if i % 3 == 0 else "assistant", f"t{i}") for i in range(n)]})


@pytest.mark.parametrize("learned", [(), ("user", "system")])
def test_other_roles_learned(spark, learned):
    df = rows_of(spark, [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")])
    (r,) = chat.format(df, learned=learned).select(chat.under_mask(F.col("formatted").cast("binary"), F.col("loss_spans"))).collect()
    assert r[0] == "".join(t for role, t in [("system", "s"), ("user", "u")] if role in learned)
