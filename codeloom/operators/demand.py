"""Relations for bound arguments only: what no binding leads to is not derived.

A binding is a table (program_id, node) of the statements, procedures or
variables that an argument may be.  Relations inside procedures are derived
from the facts of the procedures that hold the bindings, and of their callees
where calls matter; relations across calls also from those of their callers; values across calls
are then followed from the bindings alone.
Calls* and what procedures use or modify follow the call graph from the
bindings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.tables import written
from codeloom.operators import across, relations
from codeloom.operators.closure import reached, reached_pairs, turned
from codeloom.plans.facts import Facts

#: Relations that pay for it: those that loops or joins of all pairs make.
INSIDE = ("affects", "affects_t")
ACROSS = ("next_bip", "next_bip_t", "affects_bip", "affects_bip_t")
FLOWS = ("affects_bip", "affects_bip_t")
NAMES = ("calls_t", "uses_p", "modifies_p")
BOUND = (*INSIDE, *ACROSS, *NAMES)


def _calls(f: Facts, seeds: DataFrame, side: str) -> DataFrame:
    edges = f.relation("calls")
    return reached_pairs(edges, seeds) if side == "l" else turned(reached_pairs(turned(edges), seeds))


def _by_procedure(f: Facts, name: str, seeds: DataFrame, side: str) -> DataFrame:
    direct = f.use_direct if name == "uses_p" else f.mod_direct
    if side == "r":
        direct = direct.join(seeds.withColumnRenamed("node", "var"), ["program_id", "var"], "left_semi")
    own = direct.join(f.stmt.select("program_id", "stmt_no", "proc"), ["program_id", "stmt_no"]).select("program_id", F.col("proc").alias("l"), F.col("var").alias("r")).distinct()
    if side == "r":
        # Callers of what touches the variable: nodes (procedure, variable), so that none is met twice.
        up = f.relation("calls").select("program_id", F.col("l").alias("caller"), F.col("r").alias("callee"))
        known = front = written(own, "touching")
        while not front.isEmpty():
            found = front.join(up.withColumnRenamed("callee", "l"), ["program_id", "l"]).select("program_id", F.col("caller").alias("l"), "r").distinct()
            front = written(found.join(known, ["program_id", "l", "r"], "left_anti"), "touching")
            known = known.unionByName(front)
        return known
    below = _calls(f, seeds, "l").unionByName(seeds.select("program_id", F.col("node").alias("l"), F.col("node").alias("r")))
    return below.withColumnRenamed("r", "proc").join(own.withColumnsRenamed({"l": "proc", "r": "var"}), ["program_id", "proc"]).select("program_id", "l", F.col("var").alias("r")).distinct()


def bound(f: Facts, name: str, seeds: DataFrame, side: str) -> DataFrame:
    """The rows of a relation whose argument `side` (l or r) is a seed (program_id, node)."""
    seeds = written(seeds.select("program_id", "node").distinct(), "seeds")
    if name == "calls_t":
        return _calls(f, seeds, side)
    if name in NAMES:
        return _by_procedure(f, name, seeds, side)
    procs = f.stmt.join(seeds.withColumnRenamed("node", "stmt_no"), ["program_id", "stmt_no"], "left_semi").select("program_id", F.col("proc").alias("node")).distinct()
    calls = f.relation("calls")
    around = reached(turned(calls), procs) if name in ACROSS else procs
    some = f.within(reached(calls, around).withColumnRenamed("node", "proc"), None if name in ACROSS else procs.withColumnRenamed("node", "proc"))
    if name in FLOWS:
        direct = across.steps(some)
        return across.bound(some, direct if name == "affects_bip" else across.chains(some, direct), seeds, side)
    return getattr(relations, name)(some).join(seeds.withColumnRenamed("node", side), ["program_id", side], "left_semi").select("program_id", "l", "r")
