"""Token ids as length-delimited binary records with a separate offset index.

A shard is a run of frames: length (uint64), masked CRC-32C of those eight bytes, the record, masked CRC-32C
of the record; all little-endian. A record is a flag (uint32: bit 0 says that the id is null, bit 1 that token ids
are four bytes wide and not two), the id (int64), then the token ids, as wide as the vocabulary needs. The index is a Parquet
table (shard, ordinal, id, offset, length, n_tokens), so a reader can visit records in any order.
"""

from __future__ import annotations

import math
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices, tokenizer_path
from .common import fresh_path, released, written
from .pieces import WordEncoder

#: Text characters that one shard holds about.
SHARD_CHARS = 16_000_000
#: Characters encoded and framed at once.
SLICE_CHARS = 200_000
_HEAD = 12


def _crc_tables(memo: dict = {}):  # noqa: B006 - a memory that travels to executors with the function
    """Byte table of CRC-32C (reflected polynomial 0x82F63B78), and four byte tables for each operator that
    moves a checksum over 2**k zero bytes."""
    import numpy as np

    if memo:
        return memo["tables"]
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    one = np.stack([np.where(np.arange(256) >= 0, (v := np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) >> np.uint32(8), 0).astype(np.uint32) ^ t[v & np.uint32(255)] for k in range(4)])
    shifts = [one]
    for _ in range(40):
        shifts.append(np.stack([_shift(shifts[-1][k], shifts[-1]) for k in range(4)]))
    memo["tables"] = t, shifts
    return memo["tables"]


def _shift(crc, tables):
    import numpy as np

    return tables[0][crc & 255] ^ tables[1][(crc >> np.uint32(8)) & 255] ^ tables[2][(crc >> np.uint32(16)) & 255] ^ tables[3][crc >> np.uint32(24)]


def _moved(crc, distance):
    """Every checksum moved over its own number of zero bytes."""
    import numpy as np

    _, shifts = _crc_tables()
    crc = crc.copy()
    for k in range(int(distance.max(initial=0)).bit_length()):
        at = np.flatnonzero((distance >> k) & 1)
        crc[at] = _shift(crc[at], shifts[k])
    return crc


def masked_crc32c(parts: list[bytes]):
    """The masked CRC-32C of each of ``parts``: rotated right by 15 bits, plus 0xA282EAD8. All are computed
    together, in blocks of 64 bytes: zeros in front do not change a checksum that starts from zero."""
    import numpy as np

    if not parts:
        return np.zeros(0, np.uint32)
    table, _ = _crc_tables()
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    blocks = np.maximum(1, -(-sizes // 64))
    data = np.frombuffer(b"".join(x for p, n in zip(parts, (blocks * 64 - sizes).tolist()) for x in (bytes(n), p)), np.uint8).reshape(-1, 64)
    columns = np.ascontiguousarray(data.T)
    raw = np.zeros(len(data), np.uint32)
    for k in range(64):
        raw = (raw >> np.uint32(8)) ^ table[raw.astype(np.uint8) ^ columns[k]]
    begin = np.cumsum(blocks) - blocks
    behind = np.repeat(begin + blocks, blocks) - np.arange(len(data)) - 1
    folded = np.bitwise_xor.reduceat(_moved(raw, behind * 64), begin)
    crc = folded ^ _moved(np.full(len(parts), 0xFFFFFFFF, np.uint32), sizes) ^ np.uint32(0xFFFFFFFF)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(records: list[bytes]) -> list[bytes]:
    lengths = [len(r).to_bytes(8, "little") for r in records]
    a, b = masked_crc32c(lengths), masked_crc32c(records)
    return [n + x.tobytes() + r + y.tobytes() for n, x, r, y in zip(lengths, a, records, b)]


def unframed(data: bytes, group: int = 4_000_000):
    """The records of a shard, in groups of about ``group`` bytes; a bad checksum or length raises."""
    at = 0
    while at < len(data):
        begin, spans = at, []
        while at < len(data) and at - begin < group:
            size = int.from_bytes(data[at : at + 8], "little")
            if at + 16 + size > len(data):
                raise ValueError(f"the record at byte {at} is cut off")
            spans.append((at, size))
            at += 16 + size
        records = [data[o + 12 : o + 12 + n] for o, n in spans]
        a, b = masked_crc32c([data[o : o + 8] for o, _ in spans]), masked_crc32c(records)
        for (o, n), x, y in zip(spans, a.tolist(), b.tolist()):
            if x != int.from_bytes(data[o + 8 : o + 12], "little") or y != int.from_bytes(data[o + 12 + n : o + 16 + n], "little"):
                raise ValueError(f"the record at byte {o} has a wrong checksum")
        yield [o for o, _ in spans], records


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", id: str = "doc_id", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Encodes ``text`` with the tokenizers file ``tokenizer`` (present on every executor), appends
    ``end_id``, and writes shards under ``path``/data in ascending order of the integer column ``id`` and the
    index under ``path``/index, which it returns.

    ``path`` is in a folder that all executors share. A shard is written under a name of its own and renamed
    when whole, so a task that runs again replaces it by the same bytes. Null and empty texts hold only the
    end id; null ids come first and are flagged; rows with equal ids stay, ordered by a hash of the text, over as
    many shards as they fill. Texts of any length are encoded whole; other columns are ignored. An empty table gives
    an empty index and no shard.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    chars = src.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, math.ceil(chars / shard_chars))
    files, base = _opened(path)
    files.create_dir(f"{base}/data", recursive=True)
    order = ["id", "h", "row"]
    src = src.select("id", "t", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("row"))
    spread = src.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("id", "t")

    def run(batches):
        import os

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        shard, out = f"shard-{TaskContext.get().partitionId():06d}.rec", None
        enc = WordEncoder(tokenizer)
        width = "<u2" if max(enc.model.get_vocab_size(), end_id + 1) <= 65536 else "<u4"
        offset = ordinal = 0
        for b in batches:
            ids, chars = b.column(0).to_pylist(), pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()
            for lo, hi in slices(chars, SLICE_CHARS):
                flat, sizes = enc.encode(b.column(1).slice(lo, hi - lo))
                sizes = sizes + 1
                ended = np.full(int(sizes.sum()), end_id, width)
                last = np.zeros(len(ended), bool)
                last[np.cumsum(sizes) - 1] = True
                ended[~last] = flat
                tokens = np.split(ended, np.cumsum(sizes)[:-1])
                framed = frames([((i is None) | (width == "<u4") << 1).to_bytes(4, "little") + (i or 0).to_bytes(8, "little", signed=True) + x.tobytes() for i, x in zip(ids[lo:hi], tokens)])
                if out is None:
                    files, base = _opened(path)
                    own = f"{base}/data/.{shard}.{TaskContext.get().taskAttemptId()}.{os.getpid()}"
                    out = files.open_output_stream(own)
                sizes = np.array([len(x) for x in framed], np.int64)
                out.write(b"".join(framed))
                n = len(framed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n), pa.array(np.arange(ordinal, ordinal + n)), pa.array(ids[lo:hi], pa.int64()), pa.array(offset + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([len(x) for x in tokens], pa.int64())],
                    names=["shard", "ordinal", "id", "offset", "length", "n_tokens"],
                )
                offset, ordinal = offset + int(sizes.sum()), ordinal + n
        if out is not None:
            out.close()
            files.move(own, f"{base}/data/{shard}")

    index = spread.mapInArrow(run, "shard string, ordinal long, id long, offset long, length long, n_tokens long")
    index.write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def _ids(record: bytes):
    import numpy as np

    return np.frombuffer(record, "<u4" if record[0] & 2 else "<u2", offset=_HEAD)


def read(spark, path: str) -> DataFrame:
    """The records of the shards under ``path``, each frame checked: (shard, ordinal, id, n_tokens,
    start_in_shard, ids_crc32 of the ids as unsigned 32-bit integers, ids)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                start = ordinal = 0
                for _, records in unframed(data.as_buffer().to_pybytes()):
                    ids = [_ids(r).astype("<u4").tobytes() for r in records]
                    n = np.array([len(x) // 4 for x in ids], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(ids)),
                            pa.array(np.arange(ordinal, ordinal + len(ids))),
                            pa.array([None if r[0] & 1 else int.from_bytes(r[4:12], "little", signed=True) for r in records], pa.int64()),
                            pa.array(n),
                            pa.array(start + np.cumsum(n) - n),
                            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        names=["shard", "ordinal", "id", "n_tokens", "start_in_shard", "ids_crc32", "ids"],
                    )
                    start, ordinal = start + int(n.sum()), ordinal + len(ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.rec").load(f"{path}/data")
    named = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("shard"), "content")
    return named.mapInArrow(run, "shard string, ordinal long, id long, n_tokens long, start_in_shard long, ids_crc32 long, ids binary")


def read_at(index: DataFrame, path: str) -> DataFrame:
    """Adds ``ids`` (array) to rows of the index, in whatever order they come, by reading each record at its
    own offset: for shuffled reads."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        files, base = _opened(path)
        opened = {}
        for b in batches:
            got = []
            for shard, offset, length in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("shard", "offset", "length"))):
                if shard not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[shard] = files.open_input_file(f"{base}/data/{shard}")
                f = opened[shard]
                f.seek(offset)
                ((_, records),) = unframed(f.read(length))
                got.append(_ids(records[0]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.int64()))], names=[*b.schema.names, "ids"])

    return index.mapInArrow(run, index.schema.simpleString()[7:-1].replace(":", " ") + ", ids array<bigint>")


def op10_record_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Writes ``documents`` as records and reads the files back; files that do not hold what the index says are an
    error."""
    path = fresh_path(spark, "records")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = write(docs, path, tokenizer or tokenizer_path("word_bpe_49k.json"), end_id=1)
    released(spark)
    records = written(read(spark, path).drop("ids"), "records-read")
    totals = records.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("n"))
    said = index.groupBy("shard").agg(F.count("*").alias("said_rows"), F.sum("n_tokens").alias("said"))
    wrong = totals.join(said, "shard", "full").where("NOT (rows <=> said_rows AND n <=> said)").limit(1).collect()
    if wrong:
        raise ValueError(f"shard {wrong[0]['shard']} does not hold what the index says")
    number = F.regexp_extract("shard", "[0-9]+", 0).cast("long")
    before = totals.select("shard", (F.sum("n").over(Window.orderBy(number)) - F.col("n")).alias("before"))  # one row per shard
    return records.join(before, "shard").select(F.col("id").alias("doc_id"), (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
