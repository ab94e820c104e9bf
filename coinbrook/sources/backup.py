"""Backups: the ledger's tables as JSON, one folder per table, and their restoration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

VERSION = "1.0"
#: Children after parents: (table, column that must be there, parent), and columns that become null instead.
PARENTS = {"transactions": ("account_id", "accounts"), "holdings_snapshots": ("account_id", "accounts"), "positions": ("snapshot_id", "holdings_snapshots")}
OPTIONAL = {"transactions": [("import_id", "import_records"), ("matched_rule_id", "rules")], "fx_rates": [("snapshot_id", "holdings_snapshots")], "import_records": [("account_id", "accounts")]}
ORDER = ["accounts", "rules", "merchant_categories", "import_records", "holdings_snapshots", "positions", "fx_rates", "transactions"]


def exported(table: DataFrame) -> DataFrame:
    """Values as a backup writes them: decimals as text, times in ISO form with a Z."""
    cols = []
    for f in table.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampNTZType | T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return table.select(*cols)


def write(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes every table as JSON lines under ``path``; returns the counts."""
    for name, table in tables.items():
        exported(table).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")
    return preview(tables)


def preview(tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, rows)."""
    out = None
    for name, table in sorted(tables.items()):
        one = table.agg(F.lit(name).alias("entity"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def _read_schema(schema: T.StructType) -> T.StructType:
    text = (T.DecimalType, T.TimestampNTZType, T.DateType)
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, text) else f.dataType) for f in schema.fields])


def read(spark: SparkSession, path: str, names: list[str] = ORDER) -> dict[str, DataFrame]:
    """The tables of a backup; values that can't be read become null."""
    out = {}
    for name in names:
        schema = schemas.TABLES[name]
        raw = spark.read.schema(_read_schema(schema)).json(f"{path}/{name}")
        cols = []
        for f in schema.fields:
            c = F.col(f.name)
            if isinstance(f.dataType, T.TimestampNTZType):
                c = F.regexp_replace(c, "Z$", "").try_cast("timestamp_ntz")
            elif isinstance(f.dataType, T.DecimalType | T.DateType):
                c = c.try_cast(f.dataType.simpleString())
            cols.append(c.alias(f.name))
        out[name] = raw.select(*cols)
    return out


def restore(current: dict[str, DataFrame], backup: dict[str, DataFrame], on_conflict: str = "skip") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after, report): rows whose id is there already are skipped, or with 'error' counted as errors;
    of backup rows that share an id the one that comes first as JSON counts; children without parent are errors; links to what is missing become null. The report has (entity, status,
    rows)."""
    if on_conflict not in ("skip", "error"):
        raise ValueError("on_conflict is skip or error")
    after, report = {}, None
    clash = "skipped" if on_conflict == "skip" else "errors"
    for name in [n for n in ORDER if n in backup]:
        given = backup[name]
        whole = F.struct(*given.columns)
        rows = given.groupBy("id").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
        known = current[name].select("id").withColumn("__known", F.lit(True))
        rows = rows.join(known, "id", "left")
        orphan = F.lit(False)
        if name in PARENTS and PARENTS[name][1] in after:
            column, parent = PARENTS[name]
            there = after[parent].select(F.col("id").alias(column), F.lit(True).alias("__parent"))
            rows = rows.join(there, column, "left")
            orphan = F.col("__parent").isNull()
        for column, parent in OPTIONAL.get(name, []):
            if parent in after:
                there = after[parent].select(F.col("id").alias("__link"))
                rows = rows.join(there, F.col(column) == F.col("__link"), "left").withColumn(column, F.col("__link")).drop("__link")
        status = F.when(F.col("__known"), clash).when(orphan, "errors").otherwise("created")
        rows = rows.withColumn("__status", status)
        one = rows.groupBy(F.lit(name).alias("entity"), F.col("__status").alias("status")).agg(F.count("*").alias("rows"))
        report = one if report is None else report.unionByName(one)
        created = rows.where("__status = 'created'").select(*current[name].columns)
        after[name] = current[name].unionByName(created)
    return {**current, **after}, report
