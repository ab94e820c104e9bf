"""Byte-level BPE encoding and decoding over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import ChunkEncoder

#: Rows of one Arrow batch are encoded in slices of so many characters, to bound a worker's memory.
SLICE_CHARS = 1_000_000


def byte_table(model) -> list[bytes]:
    """The bytes of every id. The vocabulary writes each byte as one printable character: bytes that print
    in Latin-1 as themselves, the others in order from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable}
    back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    vocab = model.get_vocab(with_added_tokens=False)
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return table


def slices(sizes: list[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive slices of about ``limit`` in all."""
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def char_starts(ids, table_lengths, raw: bytes):
    """The character offset at which each token begins; a token that begins inside a character split over
    tokens gets that character's offset."""
    import numpy as np

    begins = np.concatenate([[0], np.cumsum(table_lengths[ids])[:-1]]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.cumsum(lead)[begins] - 1 if len(ids) else begins


def encode(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    keep: list[str] | None = None,
    offsets: bool = False,
    digests: bool = False,
) -> DataFrame:
    """``keep`` columns plus ``ids`` (binary, little-endian uint32) or, with ``digests``, the SHA-256 of the
    ids written in decimal and joined by a space (``ids_sha256``), that of the decoded bytes
    (``decoded_sha256``), and ``n_tokens``. With ``offsets`` also ``offsets`` (array of the tokens' first
    characters, counted in code points).

    ``tokenizer`` is the path of a byte-level tokenizers file, present on every executor. Special tokens'
    strings are ordinary text. A null or empty text has no tokens. Rows are independent: duplicates, ties
    and other columns (not kept unless named) don't matter, and an empty table gives an empty table.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    src = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("t"))
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    fields += [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else [T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("offsets", T.ArrayType(T.IntegerType()))] if offsets else []

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = ChunkEncoder(tokenizer, keep_space=True, specials_as_text=True)
        table = byte_table(enc.model)
        lengths = np.array([len(x) for x in table])
        decimal = [str(i) for i in range(len(table))]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts]):
                part = texts[lo:hi]
                cols = {"n_tokens": []} | ({"ids_sha256": [], "decoded_sha256": []} if digests else {"ids": []}) | ({"offsets": []} if offsets else {})
                for t, raw in zip(part, enc.encode(part)):
                    ids = np.frombuffer(raw, "<u4")
                    cols["n_tokens"].append(len(ids))
                    if digests:
                        listed = ids.tolist()
                        cols["ids_sha256"].append(hashlib.sha256(" ".join(map(decimal.__getitem__, listed)).encode()).hexdigest())
                        cols["decoded_sha256"].append(hashlib.sha256(b"".join(map(table.__getitem__, listed))).hexdigest())
                    else:
                        cols["ids"].append(raw)
                    if offsets:
                        cols["offsets"].append(char_starts(ids, lengths, (t or "").encode()).astype(np.int32))
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                types = {"n_tokens": pa.int64(), "ids": pa.binary(), "offsets": pa.list_(pa.int32())}
                made = [pa.array(v, types.get(k, pa.string())) for k, v in cols.items()]
                yield pa.RecordBatch.from_arrays(kept + made, names=[f"k{i}" for i in range(len(keep))] + list(cols))

    out = src.mapInArrow(run, T.StructType(fields))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[f.name for f in fields[len(keep) :]])


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """Adds ``to``, the text of the binary column ``ids``. Bytes are joined before they are read as UTF-8, so
    a character split over tokens comes back whole; what is no UTF-8 becomes U+FFFD. Null ids give null."""

    def run(columns):
        import numpy as np
        import pandas as pd
        from tokenizers import Tokenizer

        table = byte_table(Tokenizer.from_file(tokenizer))
        for column in columns:
            yield pd.Series([None if b is None else b"".join(map(table.__getitem__, np.frombuffer(b, "<u4").tolist())).decode("utf-8", "replace") for b in column], dtype=object)

    import pandas as pd

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    back = F.pandas_udf(run, T.StringType())
    return encoded.withColumn(to, back(F.col(ids)))


def op8_byte_bpe(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), keep=["doc_id"], digests=True)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
