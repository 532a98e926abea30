"""Written tables and what is planned on them."""

from __future__ import annotations

from codeloom.functions import tables
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter


def test_broadcasts_go_by_size_in_memory(spark, monkeypatch):
    """A table whose rows pack into a small file is not broadcast for that; a small one still is, and the session keeps its own factor."""
    rows = lambda n: spark.range(n).select(F.lit("events").alias("program_id"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("l"), F.lit("a name that all of them share").alias("r"))
    large, other, small = (tables.written(rows(n), "packed") for n in (200_000, 300_000, 10))
    plans, write, limit = [], DataFrameWriter.parquet, "spark.sql.autoBroadcastJoinThreshold"

    def spy(self, path):
        plans.append(self._df.select("*")._jdf.queryExecution().executedPlan().toString())
        return write(self, path)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    old = spark.conf.get(limit)
    # The large table takes about 14 MB in memory, and no more than this on disk.
    spark.conf.set(limit, str(2**20))
    try:
        for right in (large, small):
            tables.written(other.join(right, ["program_id", "l"], "left_semi"), "joined")
    finally:
        spark.conf.set(limit, old)
    assert "BroadcastHashJoin" not in plans[0] and "BroadcastHashJoin" in plans[1]
    assert spark.conf.get(tables.FACTOR) == "1.0"
    spark.conf.set(tables.FACTOR, "3.0")
    try:
        with tables.sizes_in_memory(spark):
            assert spark.conf.get(tables.FACTOR) == "3.0"
        assert spark.conf.get(tables.FACTOR) == "3.0"
    finally:
        spark.conf.unset(tables.FACTOR)
