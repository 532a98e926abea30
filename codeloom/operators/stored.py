"""A stored transitive closure that takes edges in and out.

An added edge (u, v) makes pairs of what reaches u and what v reaches.  Taking
an edge out deletes first whatever may have run over it and derives again what
other edges still give.  Either way only what an update touches is derived;
the stored pairs are joined, never made again.  Where a batch is so large that
its edges meet more starts and ends than there are pairs, the closure of what
leads to it is derived anew instead, in logarithmically many rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.tables import written
from codeloom.operators.closure import PAIR, closure, closure_by_components


def _and_itself(pairs: DataFrame, ends: DataFrame, column: str) -> DataFrame:
    """Pairs with those of `ends` (program_id, column) to themselves."""
    other = "r" if column == "l" else "l"
    return pairs.select(*PAIR).unionByName(ends.select("program_id", column, F.col(column).alias(other)).distinct()).distinct()


def _around(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of what reaches the start of an edge, or is it, and what its end reaches, or is it; edges are (u, v)."""
    starts, ends = edges.select("program_id", F.col("u").alias("r")), edges.select("program_id", F.col("v").alias("l"))
    up = _and_itself(pairs.join(starts.distinct(), ["program_id", "r"], "left_semi"), starts, "r").select("program_id", F.col("l").alias("x"), F.col("r").alias("u"))
    down = _and_itself(pairs.join(ends.distinct(), ["program_id", "l"], "left_semi"), ends, "l").select("program_id", F.col("l").alias("v"), F.col("r").alias("y"))
    return up.join(edges, ["program_id", "u"]).join(down, ["program_id", "v"]).select("program_id", F.col("x").alias("l"), F.col("y").alias("r")).distinct()


def _starts_and_ends(edges: DataFrame, pairs: DataFrame) -> int:
    """How many rows `_around` meets for edges (program_id, l, r): for each, what reaches its start times what its end reaches, both included."""
    u, v = edges.select("program_id", F.col("l").alias("r")).distinct(), edges.select("program_id", F.col("r").alias("l")).distinct()
    up = pairs.join(u, ["program_id", "r"], "left_semi").groupBy("program_id", F.col("r").alias("l")).agg(F.count("*").alias("up"))
    down = pairs.join(v, ["program_id", "l"], "left_semi").groupBy("program_id", F.col("l").alias("r")).agg(F.count("*").alias("down"))
    met = edges.join(up, ["program_id", "l"], "left").join(down, ["program_id", "r"], "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1
    return int(met.agg(F.sum(of("up") * of("down"))).first()[0] or 0)


@dataclass
class StoredClosure:
    """edges and pairs: (program_id, l, r), written tables.

    Null ends are no nodes: such edges are left out.  Edges that are there
    already, or to be removed and not there, change nothing.  `derive` makes
    closures of edges; closure_acyclic fits graphs without cycles better.
    """

    edges: DataFrame
    pairs: DataFrame
    derive: Callable[[DataFrame], DataFrame] = closure_by_components

    @classmethod
    def of(cls, edges: DataFrame, derive: Callable[[DataFrame], DataFrame] = closure_by_components) -> StoredClosure:
        edges = written(edges.select(*PAIR).dropna().distinct(), "stored-edges")
        return cls(edges, written(derive(edges), "stored-pairs"), derive)

    def _anew(self, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs, before and now, of the nodes that lead to a changed edge; self.edges are those of now, self.pairs still those of before.

        Paths run over edges of such nodes to the first node that is none, and
        from there the pairs stay as they are.
        """
        starts = changed.select("program_id", "l").distinct()
        leading = self.pairs.join(starts.withColumnRenamed("l", "r"), ["program_id", "r"], "left_semi").select("program_id", "l")
        touched = written(starts.unionByName(leading).distinct(), "touched")
        kept = written(self.pairs.join(touched, ["program_id", "l"], "left_anti").select(*PAIR), "stored-pairs")
        before = self.pairs.join(touched, ["program_id", "l"], "left_semi").select(*PAIR)
        own = self.derive(self.edges.join(touched, ["program_id", "l"], "left_semi").select(*PAIR))
        beyond = own.join(kept.select("program_id", F.col("l").alias("r"), F.col("r").alias("to")), ["program_id", "r"]).select("program_id", "l", F.col("to").alias("r"))
        now = written(own.unionByName(beyond).distinct(), "anew")
        self.pairs = kept.unionByName(now)
        return before, now

    def add(self, edges: DataFrame) -> DataFrame:
        """Take edges in; returns the pairs that are new."""
        new = written(edges.select(*PAIR).dropna().distinct().join(self.edges, PAIR, "left_anti"), "new-edges")
        self.edges = self.edges.unionByName(new)
        if _starts_and_ends(new, self.pairs) > self.pairs.count():
            before, now = self._anew(new)
            return now.join(before, PAIR, "left_anti")
        # Several new edges may follow each other, with old pairs between: their own closure says from where to where.
        from_ends = new.select("program_id", F.col("r").alias("l")).distinct()
        to_starts = new.select("program_id", F.col("l").alias("r")).distinct()
        bridges = self.pairs.join(from_ends, ["program_id", "l"], "left_semi").join(to_starts, ["program_id", "r"], "left_semi").select(*PAIR)
        linked = closure(new.unionByName(bridges))
        runs = linked.join(new.select("program_id", "l").distinct(), ["program_id", "l"], "left_semi").join(new.select("program_id", "r").distinct(), ["program_id", "r"], "left_semi")
        runs = written(runs.select("program_id", F.col("l").alias("u"), F.col("r").alias("v")).distinct(), "runs")
        delta = written(_around(runs, self.pairs).join(self.pairs, PAIR, "left_anti"), "new-pairs")
        self.pairs = self.pairs.unionByName(delta)
        return delta

    def remove(self, edges: DataFrame) -> DataFrame:
        """Take edges out; returns the pairs that are gone."""
        old = written(edges.select(*PAIR).dropna().distinct().join(self.edges, PAIR, "left_semi"), "old-edges")
        self.edges = written(self.edges.join(old, PAIR, "left_anti"), "stored-edges")
        if _starts_and_ends(old, self.pairs) > self.pairs.count():
            before, now = self._anew(old)
            return before.join(now, PAIR, "left_anti")
        doubtful = written(_around(old.select("program_id", F.col("l").alias("u"), F.col("r").alias("v")), self.pairs), "doubtful")
        kept = written(self.pairs.join(doubtful, PAIR, "left_anti"), "stored-pairs")
        # A doubtful pair is right if an edge, or an edge and a pair known to be right, gives it.
        step = self.edges.select("program_id", "l", F.col("r").alias("via"))
        first = doubtful.select("program_id", "l").distinct()
        step = written(step.join(first, ["program_id", "l"], "left_semi"), "steps")
        via = lambda known: step.join(known.select("program_id", F.col("l").alias("via"), "r"), ["program_id", "via"]).select(*PAIR)
        delta = written(self.edges.join(doubtful, PAIR, "left_semi").unionByName(via(kept).join(doubtful, PAIR, "left_semi")).distinct(), "again")
        again = delta
        while not delta.isEmpty():
            delta = written(via(delta).join(doubtful, PAIR, "left_semi").distinct().join(again, PAIR, "left_anti"), "again")
            again = again.unionByName(delta)
        self.pairs = kept.unionByName(again)
        return doubtful.join(again, PAIR, "left_anti")

    def save(self, path: str) -> None:
        """Write both tables below a path, as they are now."""
        self.edges.write.parquet(f"{path}/edges")
        self.pairs.write.parquet(f"{path}/pairs")

    @classmethod
    def open(cls, spark: SparkSession, path: str, derive: Callable[[DataFrame], DataFrame] = closure_by_components) -> StoredClosure:
        return cls(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/pairs"), derive)
