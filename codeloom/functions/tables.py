"""Written tables that cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark takes the size of a file for that of its rows when it plans a broadcast.  Names and numbers of programs
#: pack so well that 10 MB of files, its default limit, were measured to be 336 MB in the driver.
FACTOR, TIMES = "spark.sql.sources.fileCompressionFactor", "32"


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, which all executors share; where it is unset a temporary folder, if Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="codeloom-")
    return base.rstrip("/")


@contextmanager
def sizes_in_memory(spark: SparkSession) -> Iterator[None]:
    """What is planned inside broadcasts tables by the size of their rows in memory; another factor of the session's own is left as it is."""
    own = float(spark.conf.get(FACTOR, "1.0")) != 1
    if not own:
        spark.conf.set(FACTOR, TIMES)
    try:
        yield
    finally:
        if not own:
            spark.conf.set(FACTOR, "1.0")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/codeloom/{name}-{uuid.uuid4().hex}"
    with sizes_in_memory(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
