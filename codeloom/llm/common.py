"""Scratch tables in the shared folder, and connected components, for all operators of this subpackage."""

from __future__ import annotations

import gc
import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.tables import shared_folder

#: What separates words everywhere in this subpackage, as a Java character class.
SPACE = r"\x20\x09-\x0D"


class Scratch:
    """Tables written below `spark.checkpoint.dir`, the folder that all executors share.

    A written table cuts the lineage and survives a lost executor.  Where the
    setting is absent a temporary folder takes its place, on local masters only.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/codeloom/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write df and return the written table."""
        path = self.path(name)
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.codeloom_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables returned by `save` that nothing reads any more, and the shuffle files of steps already written."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.codeloom_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        # Spark's cleaner removes the shuffle files of plans that nobody holds any more once the driver collects its garbage.
        gc.collect()
        jvm.System.gc()


def per_process(name: str, key: str, make):
    """An object that lives as long as the Python worker, made on first use; another key takes the place of the last."""
    store = sys.modules.setdefault("_codeloom_worker", types.ModuleType("_codeloom_worker"))
    if getattr(store, name, (None,))[0] != key:
        setattr(store, name, (None, None))
        setattr(store, name, (key, make()))
    return getattr(store, name)[1]


def release() -> None:
    """Objects of `per_process` leave a worker that earlier operators have used, and its memory goes back to the system."""
    import pyarrow as pa

    sys.modules.pop("_codeloom_worker", None)
    gc.collect()
    pa.default_memory_pool().release_unused()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, component) per node of an edge.

    `component` is the smallest node reachable, the node itself included.
    Loops and repeated edges are harmless; no edges give no rows.

    Each round points every node at the neighbour (or itself) of smallest
    random priority and contracts; priorities shrink any graph, paths and
    stars included, by a constant factor on average.  Minima and distinct
    aggregate before they shuffle, and the joins are plain sort-merge joins
    on written tables, whose hot keys Spark splits.
    """
    prio = lambda c: F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("id"))
    pair = edges.where("a <> b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    pair = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    pair = scratch.save(pair, "edges")
    levels = []
    while not pair.isEmpty():
        to = pair.groupBy("u").agg(F.min(prio("v")).alias("m")).select("u", F.least(prio("u"), F.col("m"))["id"].alias("to"))
        to = scratch.save(to, "to")
        levels.append(to)
        half = pair.join(to, "u").select(F.col("to").alias("a"), "v")
        both = half.join(to.withColumnRenamed("u", "v"), "v").select("a", F.col("to").alias("b"))
        smaller = scratch.save(both.where("a <> b").distinct().toDF("u", "v"), "contracted")
        scratch.drop(pair)
        pair = smaller
    if not levels:
        return pair.select(F.col("u").alias("node"), F.col("v").alias("component"))
    at = levels[0].toDF("node", "to")
    for level in levels[1:]:
        at = scratch.save(at.join(level.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to")), "roots")
    least = scratch.save(at.groupBy("to").agg(F.min("node").alias("component")), "least")
    return scratch.save(at.join(least, "to").select("node", "component"), "components")
