"""Sets of numbered things, 64 numbers a row.

A set of each node l is rows (l, block, mask): the members are the numbers
64 * block + i for every bit i of the mask.  Numbers follow names, so what a
graph of calls leads to lies in few blocks, and unions are `bit_or`.  Numbers
tell programs apart by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.tables import written

SET = ["l", "block", "mask"]
BITS = 64


def numbered(nodes: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """(program_id, node, number) for nodes (program_id, node): in the order of program, length and text of a node, or in another."""
    text = F.col("node").cast("string")
    nodes = nodes.distinct().orderBy("program_id", *(order or [F.length(text), text]))
    return written(nodes.withColumn("number", F.monotonically_increasing_id()), "numbers")


def by_number(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """df with numbers in the place of nodes in some columns, without program_id; rows with other nodes are left out."""
    for c in columns:
        df = df.join(names.withColumnsRenamed({"node": c, "number": "_number"}), ["program_id", c]).withColumn(c, F.col("_number")).drop("_number")
    return df.drop("program_id")


def block(number: str) -> Column:
    return F.shiftright(number, 6)


def bit(number: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({number} & 63 as int))")


def has(place: str, mask: str = "mask") -> Column:
    return F.expr(f"shiftright({mask}, {place}) & 1 = 1")


def united(df: DataFrame) -> DataFrame:
    """One row for each l and block."""
    return df.groupBy("l", "block").agg(F.bit_or("mask").alias("mask"))


def of_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (l, r) of numbers as sets."""
    return united(pairs.select("l", block("r").alias("block"), bit("r").alias("mask")))


def members(df: DataFrame, column: str = "r") -> DataFrame:
    """df with a row for each member in the place of block and mask."""
    each = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1)))).where(has("_i"))
    return each.withColumn(column, F.col("block") * BITS + F.col("_i")).drop("block", "mask", "_i")


def through(pairs: DataFrame, then: DataFrame) -> DataFrame:
    """The sets `then` of all that a node is paired with in `pairs` (l, r); rows of a node may repeat."""
    return pairs.join(then.withColumnRenamed("l", "r"), "r").select(*SET)


def listed(names: DataFrame, *more: str) -> DataFrame:
    """(block, held): a row for each block, with place, name and columns `more` of what is in it."""
    return names.groupBy(block("number").alias("block")).agg(F.collect_list(F.struct(F.expr("cast(number & 63 as int)").alias("place"), "node", *more)).alias("held"))


def named(sets: DataFrame, names: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Sets as pairs (program_id, l, r) of names (of those in `of` for r, if it is given); nothing is shuffled once the pairs are made."""
    rows = sets.join(listed(of or names), "block").withColumnRenamed("l", "number").join(names.withColumnRenamed("node", "l"), "number")
    rows = rows.select("program_id", "l", "mask", F.explode("held").alias("_r")).where(has("_r.place"))
    return rows.select("program_id", "l", F.col("_r.node").alias("r"))
