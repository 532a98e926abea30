"""Facts and relations as bucketed tables, for many queries of many sessions.

A store is a set of tables of the current database.  Statements and what belongs to
one lie in buckets of (program_id, stmt_no), relations in buckets of
(program_id, l), so that they meet without a shuffle.  Every save is a new
version; its row in `<store>_versions` is written last, so readers, who open
the latest version there, never see one that is half written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.facts import Facts
from codeloom.sources.tables import NAMES

#: What a table is in buckets of, besides program_id.
KEY = {"const": "value", "proc": "proc"}


def versions(spark: SparkSession, store: str) -> DataFrame:
    """(version, name, rows, buckets): the tables of every complete version."""
    if not spark.catalog.tableExists(f"{store}_versions"):
        return spark.createDataFrame([], "version long, name string, rows long, buckets int")
    return spark.table(f"{store}_versions")


def save(facts: Facts, store: str, relations: tuple[str, ...] = (), buckets: int = 64, folder: str | None = None) -> int:
    """The number of the new version of the store: all facts and these relations, below `folder` or else in the warehouse.

    Buckets should be as many as shuffle partitions of such a table.
    """
    spark = facts.stmt.sparkSession
    known = versions(spark, store).agg(F.max("version")).first()[0]
    # A save that was cut short has left tables without a row; their number is not used again.
    left = [int(t.rpartition("_v")[2]) for (t,) in spark.sql("SHOW TABLES").select("tableName").collect() if t.startswith(f"{store}_stmt_v".lower())]
    version = max([known or 0, *left]) + 1
    tables = {n: (getattr(facts, n), KEY.get(n, "stmt_no")) for n in NAMES} | {r: (facts.relation(r), "l") for r in relations}
    at = lambda writer, table: writer.option("path", f"{folder}/{table}") if folder else writer
    for name, (df, key) in tables.items():
        # Rows of a bucket come together first: a file for each bucket, not for each bucket and task.
        dealt = df.repartition(buckets, "program_id", key)
        writer = dealt.write.format("parquet").bucketBy(buckets, "program_id", key).sortBy("program_id", key)
        at(writer, f"{name}_v{version}").saveAsTable(f"{store}_{name}_v{version}")
    counts = [(version, name, spark.table(f"{store}_{name}_v{version}").count(), buckets) for name in tables]
    done = spark.createDataFrame(counts, "version long, name string, rows long, buckets int").coalesce(1)
    at(done.write.format("parquet").mode("append"), "versions").saveAsTable(f"{store}_versions")
    return version


def open_store(spark: SparkSession, store: str, version: int | None = None) -> Facts:
    """Facts of a version, the latest if none is named; the relations saved with it are read instead of made."""
    found = versions(spark, store)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    names = [r[0] for r in found.where(F.col("version") == version).select("name").collect()]
    if not names:
        raise ValueError(f"{store} has no version {version or ''}".rstrip())
    tables = {name: spark.table(f"{store}_{name}_v{version}") for name in names}
    facts = Facts.from_tables({name: tables.pop(name) for name in NAMES})
    facts.memo |= tables
    facts.stored |= tables
    return facts


def drop_before(spark: SparkSession, store: str, version: int) -> None:
    """Tables of versions before this one are dropped; no session should read them any more."""
    for old, name in versions(spark, store).where(F.col("version") < version).select("version", "name").collect():
        spark.sql(f"DROP TABLE IF EXISTS {store}_{name}_v{old}")
