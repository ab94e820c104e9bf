"""Repeated lines and passages removed by hashing.

The units are whole lines, of any length, and the pieces of longer lines, cut at places that their own words
decide so that a passage is cut alike wherever it stands. Units are normalised (lower case, single spaces) and
hashed to 96 bits; each digest belongs to the earliest document that has it. Elsewhere a line goes if its digest
belongs to an earlier place; inside a line that stays, a run of pieces goes if all belong to earlier documents
and it has enough words to be a passage and no chance phrase.

Every text is hashed once, into a written table of texts and digests. Digests are pre-aggregated before they are
dealt, and what is joined with the repeated ones are numbers, not texts. Where a unit lies is not kept: texts that
lose something are cut into units once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import released, written

#: A piece begins at each word whose hash is the least among so many words before and behind it in the line, so
#: pieces have seven words on average and the words alone decide where they begin.
RADIUS = 3
#: Shortest run of repeated pieces inside a line that is removed, in words. Whole lines have no least length.
RUN_WORDS = 20
_BLANKS = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]  # fixed values: white space in Unicode
_UNIT = "struct<d: bigint, e: int>"
_SLICE_CHARS = 2_000_000


def _folded(text: str) -> str:
    """Lower case, character by character, where that keeps the number of characters. No character depends on those
    around it, so a text is cut alike whatever it is joined with."""
    low = text.replace("Σ", "σ").lower()  # the one letter whose lower case depends on its place
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _word_hashes(codes, starts, ends):
    """A hash of every word: its characters times powers of an odd number, modulo 2**64, then mixed."""
    import numpy as np

    with np.errstate(over="ignore"):
        longest = int((ends - starts).max(initial=0))
        powers = np.full(longest + 1, 0x9E3779B97F4A7C15, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        word = np.repeat(np.arange(len(starts)), ends - starts)
        own = np.arange(len(word)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
        total = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(codes[starts[word] + own].astype(np.uint64) * powers[own], out=total[1:])
        after = np.cumsum(ends - starts)
        x = total[after] - total[after - (ends - starts)]
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(27)


def units(texts: list[str], run_words: int = RUN_WORDS, hashed: bool = True) -> tuple[list[int], list[bytes], list]:
    """The units of texts: how many there are up to each text's end, their digests (12 bytes), and of all units
    first character, characters, words and whether it is a whole line. Units are ordered by their first
    character, a line before its pieces; lines of at most ``run_words`` words have no pieces, as no run of them
    could be long enough. Digests are left out unless ``hashed``."""
    import numpy as np
    import xxhash

    joined = "\n".join(texts)
    codes = np.frombuffer(_folded(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    blank = np.ones(len(codes) + 2, bool)
    blank[1:-1] = np.isin(codes, _BLANKS)
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    if not len(starts):
        return [0] * len(texts), [], [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
    line = np.cumsum(codes == 10)[starts]
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))  # of every line with words
    count = np.diff(np.append(first, len(starts)))
    h, least = _word_hashes(codes, starts, ends), np.ones(len(starts), bool)
    for d in range(1, RADIUS + 1):
        same = line[d:] == line[:-d]
        least[d:] &= ~same | (h[d:] < h[:-d])
        least[:-d] &= ~same | (h[:-d] <= h[d:])
    long = np.repeat(count > run_words, count)
    least[first] = True
    piece = np.flatnonzero(least & long)
    stop = np.minimum(np.append(piece[1:], len(starts)), np.repeat(first + count, count)[piece])
    a, b = np.concatenate([first, piece]), np.concatenate([first + count, stop])
    whole = np.arange(len(a)) < len(first)
    order = np.lexsort((~whole, a))
    a, b, whole = a[order], b[order], whole[order]
    at, end = starts[a], ends[b - 1]
    letters = np.concatenate([[0], np.cumsum(ends - starts)])
    odd = np.concatenate([[0], np.cumsum(blank[1:-1] & (codes != 32))])
    plain = (end - at == letters[b] - letters[a] + b - a - 1) & (odd[end] == odd[at])
    digests = []
    for i, j, p in zip(at.tolist(), end.tolist(), plain.tolist()) if hashed else ():
        u = joined[i:j] if p else " ".join(joined[i:j].split())
        digests.append(xxhash.xxh3_128_digest(u.lower().encode("utf-8", "surrogatepass"))[:12])
    text = np.searchsorted(begins, at, "right") - 1
    counts = np.cumsum(np.bincount(text, minlength=len(texts))).tolist()
    return counts, digests, [at - begins[text], end - at, b - a, whole]


def removed_spans(found: list[tuple[int, int, int, bool, bool]], repeated: set[int], run_words: int) -> list[tuple[int, int]]:
    """Character spans to remove. ``found``: (first character, characters, words, whole, seen before in the text)
    of each unit; ``repeated``: the places in it of those that belong to earlier documents."""
    out: list[tuple[int, int]] = []
    run: list[int] = []
    gone = 0  # end of the last line that goes whole

    def close():
        if run and sum(found[k][2] for k in run) >= run_words:
            out.append((found[run[0]][0], found[run[-1]][0] + found[run[-1]][1]))
        run.clear()

    for k, (at, size, _, whole, again) in enumerate(found):
        if whole:
            close()
            if again or k in repeated:
                gone = at + size
                out.append((at, gone))
        elif at >= gone and k in repeated:
            run.append(k)
        else:
            close()
    close()
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; blanks that a span leaves at both its sides become one, and a line of
    which nothing is left goes."""
    kept, at, last = [], 0, "\n"
    for a, b in spans:
        kept.append(text[at:a])
        last = kept[-1][-1:] or last
        if b < len(text) and (text[b] == " " and last in " \n" or text[b] == "\n" == last):
            b += 1
        at = b
    kept.append(text[at:])
    return "".join(kept)


def _with_units(docs: DataFrame, rest: list[str], text: str, id: str, run_words: int) -> DataFrame:
    """(k0.. , rank, row, t, units, n_units, again): written once, with a number for every row. Of units that are lines
    their text has before there is no digest, but their places in ``again``."""
    row = F.monotonically_increasing_id()
    rank = F.coalesce(F.col(id).cast("long"), F.lit(1 << 62) + row)
    src = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(rest)], rank.alias("rank"), row.alias("row"), F.col(text).cast("string").alias("t"))

    def hashed(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            every = b.column(b.num_columns - 1)
            for lo, hi in slices(pc.fill_null(pc.binary_length(every), 0).to_pylist(), _SLICE_CHARS):
                counts, digests, own = units([t or "" for t in every.slice(lo, hi - lo).to_pylist()], run_words)
                again, seen, end = [], set(), 0
                whole = own[3].tolist()
                for n in counts:  # lines that their text has before
                    for k in range(end, n):
                        again.append(whole[k] and digests[k] in seen)
                        if whole[k]:
                            seen.add(digests[k])
                    end = n
                    seen.clear()
                raw = np.frombuffer(b"".join(digests), np.dtype([("d", "<i8"), ("e", "<i4")]))
                gone = np.array(again, bool)
                where, ends = np.flatnonzero(gone), np.array([0, *counts])
                of_text = np.searchsorted(where, ends)
                columns = [pa.array(np.ascontiguousarray(raw["d"])), pa.array(np.ascontiguousarray(raw["e"]))]
                offsets = lambda x: pa.array(x.astype(np.int32))
                places = pa.array((where - np.repeat(ends[:-1], np.diff(of_text))).astype(np.int32))
                made = [
                    pa.ListArray.from_arrays(offsets(ends), pa.StructArray.from_arrays(columns, names=["d", "e"], mask=pa.array(gone))),
                    offsets(np.diff(ends)), pa.ListArray.from_arrays(offsets(of_text), places),
                ]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), *made], names=[*b.schema.names, "units", "n_units", "again"])

    own = [("units", T._parse_datatype_string(f"array<{_UNIT}>")), ("n_units", T.IntegerType()), ("again", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*src.schema.fields, *(T.StructField(*f) for f in own)])
    return written(src.mapInArrow(hashed, schema), "text-units")


def dedup(docs: DataFrame, text: str = "text", id: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with ``text`` replaced by what is kept, and three columns added: ``n_units``, ``n_removed``
    (characters) and ``removed`` (the removed spans, as offsets into the original text in code points).

    Documents rank by the integer column ``id`` (below 2**62), then, each for itself, the rows without an id;
    rows of equal id count as one document between each other, so a repeated row is not removed in favour of
    itself. Lines that a text has before go as well. A null text stays null, an empty one empty; a text of any
    length is treated whole. Other columns are kept, whatever their names; columns of the three names are
    replaced. The first occurrence of each unit always stays, so no content is lost from the whole. An empty
    table gives an empty one.
    """
    names = ["n_units", "n_removed", "removed"]
    rest = [c for c in docs.columns if c != text and c not in names]
    staged = _with_units(docs, rest, text, id, run_words)
    every = staged.select("row", "rank", F.posexplode("units").alias("place", "unit")).where("unit IS NOT NULL")
    every = every.select("row", "rank", "place", "unit.d", "unit.e")
    owners = every.groupBy("d", "e").agg(F.min("rank").alias("owner"), F.max("rank").alias("last")).where("owner < last").drop("last")
    owners = written(owners, "unit-owners")
    released(docs.sparkSession)  # what was dealt to find them, before the digests are dealt again to be joined with them
    later = every.join(owners, ["d", "e"]).where("rank > owner").groupBy("row").agg(F.collect_list("place").alias("places"))
    later = written(later, "repeated-units")
    released(docs.sparkSession)  # the digests' shuffles, before the texts are dealt

    dealt = staged.select(*[f"k{i}" for i in range(len(rest))], "t", "row", "n_units", "again")
    joined = dealt.join(later, "row", "left").select(*[f"k{i}" for i in range(len(rest))], "t", "n_units", "again", "places")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(rest)]
    fields += [T.StructField("t", T.StringType()), T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span))]

    def rebuilt(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            t, n_units, again, places = b.columns[-4:]
            found: dict[int, list[tuple[int, int]]] = {}
            touched = [k for k, (x, y) in enumerate(zip(pc.list_value_length(again).to_pylist(), places.is_valid().to_pylist())) if x or y]
            for lo, hi in slices(pc.fill_null(pc.binary_length(t), 0).take(pa.array(touched, pa.int64())).to_pylist(), _SLICE_CHARS):
                counts, _, own = units([t[k].as_py() for k in touched[lo:hi]], run_words, hashed=False)
                for k, begin, end in zip(touched[lo:hi], [0, *counts], counts):
                    before = set(again[k].as_py())
                    each = zip(*(x[begin:end].tolist() for x in own), (place in before for place in range(end - begin)))
                    found[k] = removed_spans(list(each), set(places[k].as_py() or ()), run_words)
            spans = [found.get(k, []) for k in range(b.num_rows)]
            texts = [without(x.as_py(), own) if own else x.as_py() for x, own in zip(t, spans)]
            removed = pa.array([sum(e - s for s, e in own) for own in spans], pa.int64())
            made = [pa.array(texts, pa.string()), n_units.cast(pa.int64()), removed, pa.array([[{"start": s, "end": e} for s, e in own] for own in spans], kind)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-4], *made], names=[f.name for f in fields])

    out = joined.mapInArrow(rebuilt, T.StructType(fields))
    back = {c: F.col(f"k{i}").alias(c) for i, c in enumerate(rest)} | {text: F.col("t").alias(text)}
    return out.select(*[back[c] for c in docs.columns if c in back], *names)


def op5_repeated_units(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` without the lines and passages that an earlier one has; every row stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "text", "n_units", "n_removed", "removed")
