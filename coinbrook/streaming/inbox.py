"""Parsed rows that arrive as files, committed once each, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.dedup import import_key


def stream(spark: SparkSession, folder: str, schema: StructType, horizon: str = "30 days") -> DataFrame:
    """Rows of the Parquet files that appear in ``folder``, each dedup key once within the horizon of its
    ``ingested_at``; keys older than that leave the state, and the ledger's anti-join catches them."""
    rows = spark.readStream.schema(schema).parquet(folder)
    keyed = rows.withColumn("hash_dedup_key", import_key("account_id", "file_hash", "row_index"))
    return keyed.withWatermark("ingested_at", horizon).dropDuplicatesWithinWatermark(["hash_dedup_key"])


def run(spark: SparkSession, folder: str, schema: StructType, ledger: str, checkpoint: str, commit) -> None:
    """Commits all that is there: ``commit(rows, ledger rows)`` gives what is appended to the Parquet table
    ``ledger``. A batch that runs again after a failure appends only what is still missing."""

    def batch(rows: DataFrame, _: int) -> None:
        known = spark.read.parquet(ledger)
        commit(rows, known).write.mode("append").parquet(ledger)

    query = stream(spark, folder, schema).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_totals(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums and counts of events by window and type; works on streams and tables alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.sum("value").alias("total"), F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "total", "events")


def totals(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, width: str = "1 day", late: str = "2 days", files: int = 1) -> None:
    """Windowed totals of the Parquet files (of ``ts``, ``event_type`` and ``value``) in ``folder``, ``files`` of them a
    batch, kept up in the folder ``out``: every batch writes the windows that it changed into a part of its own number.
    A batch that runs again after a failure replaces its part, so it counts once. Rows later than ``late`` are left
    out, as the state of their windows is gone by then. Runs until all that is there is read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = windowed_totals(stream, width, late).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """The windows of ``out`` as the last batch left each."""
    parts = spark.read.parquet(out)
    row = F.struct("total", "events")
    return parts.groupBy("start", "event_type").agg(F.max_by(row, "batch").alias("row")).select("start", "event_type", "row.*")
