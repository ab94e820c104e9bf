"""Shared pieces: the cluster's shared folder, lineage cuts, and connected components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset a temporary folder is made, on a local master only.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.getCheckpointDir():
            return sc.getCheckpointDir()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="coinbrook-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: later jobs neither recompute it nor depend
    on any executor's disk."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)  # texts take two thirds of what they take by the default
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A small intermediate result, checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Shuffle files of steps that are written go when the driver collects its garbage; it does so now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _least_reached(u, v, n: int):
    """For each of ``n`` nodes the least number that edges between numbers ``u`` and ``v`` reach from it."""
    import numpy as np

    root = np.arange(n)
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return root
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


#: Edges that a task of ``thinned`` takes together.
_TAKEN_EDGES = 1_000_000


def thinned(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Fewer edges (a, b) with the same components: each task ties the nodes that its edges connect to the least of them.
    Edges are dealt by ``a``. Where many links name the same few nodes as ``b``, as a dense group does that is
    linked at every key anew, about an edge a node and task is left of them; there are never more than before."""
    kind = edges.schema[a].dataType
    if edges.schema[b].dataType != kind:
        raise ValueError("both ends of an edge are of one type")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def tied():
            nodes, at = np.unique(np.concatenate([x for pair in zip(*held) for x in pair]), return_inverse=True)
            root = _least_reached(at[:size], at[size:], len(nodes))
            other = np.flatnonzero(root != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], names=["a", "b"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size > _TAKEN_EDGES:
                yield tied()
                held, size = [], 0
        if size:
            yield tied()

    own = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    return own.repartition("a").mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """Connected components of an undirected graph given by ``edges``: rows (node, root), root the least
    node of the component. Nodes without edges have no row.

    Edges are thinned first. Then come alternating large-star and small-star steps: each node links its larger
    neighbours, then itself and its smaller neighbours, to the least one. Every step is a grouped minimum and one join;
    the number of rows never grows, and the number of rounds grows with the logarithm of a component's size.
    """
    cur = cut(thinned(edges, a, b).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(cur)
    for _ in range(rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        cur, before, mark = nxt, mark, _mark(nxt)
        if mark == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = cur.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def held_out(modulus: int, remainder: int, id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string")) % modulus == remainder, F.lit(False))
