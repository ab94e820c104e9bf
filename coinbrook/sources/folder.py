"""Folders of statements: files that were imported before are dropped by their content, the others go to the parser of
their own bank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from . import statements

#: What reads the statements of a bank: (statements, year, month) -> transactions. Callers may add to it.
PARSERS: dict[str, Callable[[DataFrame, int, int], DataFrame]] = {name: (lambda s, y, m, n=name: statements.parse(s, n, y, m)) for name in statements.FORMS}
PARSERS["unknown"] = lambda s, y, m: statements.parse_generic(s, y)


def read(spark: SparkSession, path: str, known: DataFrame | None = None, pattern: str = "*") -> DataFrame:
    """(source_file, source_file_hash, text) of the files below ``path`` whose content is not among the hashes of ``known``
    (source_file_hash). Of files of equal content the one of the least path counts; empty files are left out. Text
    is UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    hashed = files.select(F.col("path").alias("source_file"), F.sha2("content", 256).alias("source_file_hash"))
    if known is not None:
        hashed = hashed.join(known.select("source_file_hash"), "source_file_hash", "left_anti")
    wanted = hashed.groupBy("source_file_hash").agg(F.min("source_file").alias("source_file"))
    # contents are read a second time, of the files that are left alone, rather than moved with their hashes
    texts = files.select(F.col("path").alias("source_file"), F.decode("content", "UTF-8").alias("text"))
    return texts.join(wanted, "source_file").select("source_file", "source_file_hash", "text")


def parse(found: DataFrame, as_of_year: int, as_of_month: int) -> DataFrame:
    """Transactions of statements (source_file, source_file_hash, text) of any bank: what the bank's parser returns, with
    the bank and the hash. The texts are dealt to their banks once, so each parser reads its own alone."""
    spark = found.sparkSession
    path = shared.folder(spark, "statements")
    found.withColumn("bank", statements.bank(F.col("text"))).write.partitionBy("bank").parquet(path)
    dealt = spark.read.schema("source_file string, source_file_hash string, text string, bank string").parquet(path)
    out = None
    for name, parser in PARSERS.items():
        own = dealt.where(F.col("bank") == name)
        one = parser(own.select("source_file", "text"), as_of_year, as_of_month).withColumn("bank", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.join(dealt.select("source_file", "source_file_hash"), "source_file")
