"""Transitive closures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.tables import written
from codeloom.operators import sets

PAIR = ["program_id", "l", "r"]


def _onward(df: DataFrame) -> DataFrame:
    return df.select("program_id", F.col("l").alias("r"), F.col("r").alias("to"))


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs that a pair of `first` and one of `second` make."""
    return first.join(_onward(second), ["program_id", "r"]).select("program_id", "l", F.col("to").alias("r"))


def closure(edges: DataFrame, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All pairs (program_id, l, r) connected by one edge or more, for graphs of any size; cycles are allowed.

    Semi-naive path doubling: new pairs meet all known ones at either end, so
    the rounds are logarithmic in the longest path.  New pairs are written;
    known ones are never written again.  `derive` makes further edges from
    new pairs.
    """
    known = delta = written(edges.select(*PAIR).distinct(), "closure")
    while not delta.isEmpty():
        found = _then(delta, known).unionByName(_then(known, delta))
        if derive:
            found = found.unionByName(derive(delta))
        delta = written(found.distinct().join(known, PAIR, "left_anti"), "delta")
        known = known.unionByName(delta)
    return known


def closure_acyclic(edges: DataFrame) -> DataFrame:
    """The same for sparse graphs without cycles, which it fits better.

    What a node leads to is a set of 64 numbers a row (`codeloom.operators.sets`); pairs of names come of
    these at the end, each once, and are never shuffled.  With cycles the
    steps would not run out, and every round would meet every set again.
    """
    edges = edges.select(*PAIR)
    ends = lambda c: edges.select("program_id", F.col(c).alias("node"))
    names = sets.numbered(ends("l").unionByName(ends("r")))
    pairs = sets.by_number(edges, names, "l", "r")
    return sets.named(gathered(pairs, sets.of_pairs(pairs)), names)


def gathered(edges: DataFrame, own: DataFrame, name: str = "gathered") -> DataFrame:
    """The sets `own` of each node and of all that edges (l, r) of numbers lead to from it, for graphs without cycles.

    After round i these are the sets at the ends of walks of fewer than 2**i
    edges, and `steps` the ends of those of just 2**i; so a set is met once
    for each place 2**i edges before it, and rounds are logarithmic in the
    longest path.
    """
    known = written(sets.united(own), "delta")
    steps = written(sets.of_pairs(edges), "closure")
    while True:
        step = sets.members(steps)
        # `had` is what was known before.
        both = known.withColumn("had", F.col("mask")).unionByName(sets.through(step, known).withColumn("had", F.lit(0).cast("long")))
        both = written(both.groupBy("l", "block").agg(F.bit_or("mask").alias("mask"), F.bit_or("had").alias("had")), name)
        known = both.select(*sets.SET)
        if both.where("mask <> had").isEmpty():
            return known
        steps = written(sets.united(sets.through(step, steps)), "step")


def reached(edges: DataFrame, seeds: DataFrame, steps: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """(program_id, node): the seeds (program_id, node), and what edges (program_id, l, r) lead to from them.

    A frontier goes `steps` edges on in one job; no pair of a start and an end
    is made, and edges that no seed leads to are never followed.  Columns
    `carried` go along with the seeds: (program_id, node, *carried).
    """
    columns = ["program_id", "node", *carried]
    onward = edges.select("program_id", F.col("l").alias("node"), F.col("r").alias("to"))
    known = front = written(seeds.select(*columns).distinct(), "reached")
    while True:
        found = None
        for i in range(steps):
            front = front.join(onward, ["program_id", "node"]).select("program_id", F.col("to").alias("node"), *carried).distinct()
            here = front.withColumn("step", F.lit(i))
            found = here if found is None else found.unionByName(here)
        delta = written(found.groupBy(*columns).agg(F.min("step").alias("step")).join(known, columns, "left_anti"), "reached")
        # What came with an earlier step has been followed.
        front = delta.where(F.col("step") == steps - 1).select(*columns)
        known = known.unionByName(delta.select(*columns))
        if front.isEmpty():
            return known


def reached_pairs(edges: DataFrame, seeds: DataFrame, steps: int = 4) -> DataFrame:
    """Pairs (program_id, l, r) of the closure whose start is a seed (program_id, node), and no others."""
    onward = edges.select("program_id", F.col("l").alias("r"), F.col("r").alias("to"))
    go = lambda df: df.join(onward, ["program_id", "r"]).select("program_id", "l", F.col("to").alias("r")).distinct()
    seeds = seeds.select("program_id", F.col("node").alias("l")).distinct()
    known, front = None, edges.join(seeds, ["program_id", "l"], "left_semi").select(*PAIR).distinct()
    while True:
        found = front.withColumn("step", F.lit(0))
        for i in range(1, steps):
            front = go(front)
            found = found.unionByName(front.withColumn("step", F.lit(i)))
        found = found.groupBy(*PAIR).agg(F.min("step").alias("step"))
        delta = written(found.join(known, PAIR, "left_anti") if known is not None else found, "from-seeds")
        known = delta.select(*PAIR) if known is None else known.unionByName(delta.select(*PAIR))
        front = delta.where(F.col("step") == steps - 1)
        if front.isEmpty():
            return known
        front = go(front)


def turned(pairs: DataFrame) -> DataFrame:
    return pairs.select("program_id", F.col("r").alias("l"), F.col("l").alias("r"))


def closure_by_components(edges: DataFrame) -> DataFrame:
    """The closure of graphs with dense cycles, each taken together as soon as it shows.

    After round i there are the walks of up to 2**i edges.  Where two nodes
    reach each other, the larger one takes the name of the smallest it does so
    with, and walks between names are walks again; so a loop becomes one node
    when half its length is walked, instead of every pair in it being met once
    for every node between.  What is left has no cycles; its pairs, and those
    inside a component, come from members at the end.
    """
    edges = written(edges.select(*PAIR).distinct(), "edges")
    known = delta = edges.where("l <> r")
    names: list[DataFrame] = []
    while True:
        walks = written(known.unionByName(_then(delta, known)).unionByName(_then(known, delta)).where("l <> r").distinct(), "walks")
        mutual = walks.join(turned(walks), PAIR).groupBy("program_id", "l").agg(F.min("r").alias("to"))
        name = written(mutual.where("to < l"), "names")
        if not name.isEmpty():
            names.append(name)
            walks = written(renamed(walks, name), "walks")
            # A name walks on from any of its nodes, so that all of its pairs are new.
            known = delta = walks
            continue
        delta = written(walks.join(known, PAIR, "left_anti"), "delta")
        known = walks
        if delta.isEmpty():
            break
    ends = edges.select("program_id", F.col("l").alias("node")).unionByName(edges.select("program_id", F.col("r").alias("node"))).distinct()
    member = ends.withColumn("name", F.col("node"))
    for n in names:
        n = n.select("program_id", F.col("l").alias("name"), "to")
        member = member.join(n, ["program_id", "name"], "left").select("program_id", "node", F.coalesce("to", "name").alias("name"))
    member = written(member, "members")
    of = lambda column: member.select("program_id", F.col("node").alias(f"{column}_node"), F.col("name").alias(column))
    size = member.groupBy("program_id", "name").agg(F.count("*").alias("n"))
    own = size.where("n > 1").select("program_id", F.col("name").alias("l"), F.col("name").alias("r"))
    between = known.unionByName(own).join(of("l"), ["program_id", "l"]).join(of("r"), ["program_id", "r"]).select("program_id", F.col("l_node").alias("l"), F.col("r_node").alias("r"))
    return between.unionByName(edges.where("l = r")).distinct()


def renamed(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs with the names of their ends, those of one name left out."""
    out = pairs
    for c in ("l", "r"):
        out = out.join(names.select("program_id", F.col("l").alias(c), F.col("to").alias("name")), ["program_id", c], "left").withColumn(c, F.coalesce("name", c)).drop("name")
    return out.select(*PAIR).where("l <> r").distinct()
