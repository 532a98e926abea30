"""Values that flow across calls: AffectsBip and its closure, by summaries of procedures.

Where a value is, is a node (no, proc, var): a statement that sets var (an
assignment, or a call whose callee may), or the start or end of a procedure,
with no = START or END.  `Steps` are what a node leads to inside its
procedure.  A path returns to callers first and enters callees then; what it
enters and leaves again is a step of the caller.  So both relations are joins
of steps with closures over (procedure, variable) alone, and nothing is made
for a procedure that no value gets to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.tables import written
from codeloom.operators import flow, sets
from codeloom.operators.closure import closure, gathered, reached, turned
from codeloom.plans.facts import Facts

START, END = -1, -2


def node(no: Column | int, proc: Column | str, var: Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(no).cast("long").alias("no"), as_column(proc).alias("proc"), var.alias("var"))


@dataclass
class Steps:
    """What nodes x lead to inside their procedure.

    assigns   (program_id, x, r)          an assignment that uses the value
    enters    (program_id, x, site, to)   the start of the callee of a call
    ends      (program_id, x, to)         the end of the procedure
    """

    assigns: DataFrame
    enters: DataFrame
    ends: DataFrame


def steps(f: Facts) -> Steps:
    """Steps of unchanged values.

    Statements of a callee kill, a call itself does not: it is passed where
    some path through its callee keeps the variable.
    """
    calls = f.relation("full_calls").select("program_id", "stmt_no", "callee")
    of_callee = lambda relation: calls.join(f.table(relation).withColumnsRenamed({"l": "callee", "r": "var"}), ["program_id", "callee"])
    killed = flow.kills(f, f.mod_direct, across=True)
    setters = flow.assigned(f).unionByName(of_callee("modifies_p").select("program_id", "stmt_no", "var"))
    users = flow.used(f).unionByName(of_callee("uses_p").select("program_id", "stmt_no", "var"))
    pairs, ends, starts = flow.meetings(f, setters, users, killed)
    at = calls.select("program_id", F.col("stmt_no").alias("r"), "callee")
    here = pairs.select("program_id", node(F.col("l"), "", F.col("var")).alias("x"), "r", "var")
    begin = starts.select("program_id", node(START, F.col("proc"), F.col("var")).alias("x"), F.col("stmt_no").alias("r"), "var")
    leads = written(here.unionByName(begin).join(at, ["program_id", "r"], "left"), "leads")
    # Of the starts only those that a value gets to from somewhere.
    enters = leads.where("callee is not null").select("program_id", "x", F.col("r").alias("site"), node(START, F.col("callee"), F.col("var")).alias("to"))
    seeds = enters.where(F.col("x.no") >= 0).select("program_id", F.col("to").alias("node"))
    inner = enters.where(F.col("x.no") == START).select("program_id", F.col("x").alias("l"), F.col("to").alias("r"))
    live = reached(inner, seeds).withColumnRenamed("node", "x")
    kept = lambda df: df.where(F.col("x.no") >= 0).unionByName(df.where(F.col("x.no") == START).join(live, ["program_id", "x"], "left_semi").select(df.columns))
    return Steps(
        assigns=written(kept(leads.where("callee is null").select("program_id", "x", "r")), "assigns"),
        enters=written(kept(enters), "enters"),
        ends=written(ends.select("program_id", node(F.col("stmt_no"), "", F.col("var")).alias("x"), node(END, F.col("proc"), F.col("var")).alias("to")).distinct(), "ends"),
    )


def chains(f: Facts, direct: Steps) -> Steps:
    """Steps of values that assignments on the way may turn into others.

    An assignment that uses a value leads to what it sets.  Where the start
    of a procedure leads to its end, with another variable perhaps, what
    enters it leads to the call with that variable: such summaries come with
    the closure, from its new pairs.
    """
    sets = flow.assigned(f).withColumnRenamed("stmt_no", "r")
    onward = direct.assigns.join(sets, ["program_id", "r"]).select("program_id", F.col("x").alias("l"), node(F.col("r"), "", F.col("var")).alias("r"))
    out = direct.ends.select("program_id", F.col("x").alias("r"), F.col("to.var").alias("var"))
    into = direct.enters.select("program_id", "x", "site", F.col("to").alias("l"))

    def summaries(new: DataFrame) -> DataFrame:
        through = new.where(F.col("l.no") == START).join(out, ["program_id", "r"]).select("program_id", "l", "var").distinct()
        return through.join(into, ["program_id", "l"]).select("program_id", F.col("x").alias("l"), node(F.col("site"), "", F.col("var")).alias("r"))

    led = written(closure(onward, summaries), "chains").withColumnsRenamed({"l": "from", "r": "x"})
    further = lambda df: df.unionByName(led.join(df, ["program_id", "x"]).select("program_id", F.col("from").alias("x"), *df.columns[2:])).distinct()
    return Steps(assigns=written(further(direct.assigns), "assigns"), enters=written(further(direct.enters), "enters"), ends=written(further(direct.ends), "ends"))


def _returns(f: Facts, ends: DataFrame) -> DataFrame:
    """(program_id, to, x): the calls that the ends of procedures `to` return to, with the value."""
    sites = f.relation("full_calls").select("program_id", F.col("callee").alias("proc"), "stmt_no")
    ends = ends.select("program_id", "to").distinct()
    return ends.withColumn("proc", F.col("to.proc")).join(sites, ["program_id", "proc"]).select("program_id", "to", node(F.col("stmt_no"), "", F.col("to.var")).alias("x"))


def bound(f: Facts, s: Steps, seeds: DataFrame, side: str) -> DataFrame:
    """The pairs whose assignment `side` (l or r) is a seed (program_id, node), by following steps from the seeds alone.

    A value first returns, from call to call, then enters, from start to
    start.  Each phase is a search that carries the seed along, so nothing is
    made for other ends; from a seed r both are followed backwards.
    """
    up = s.ends.join(_returns(f, s.ends).withColumnRenamed("x", "site"), ["program_id", "to"]).select("program_id", F.col("x").alias("l"), F.col("site").alias("r"))
    up = written(up.distinct(), "up")
    inner = written(s.enters.where(F.col("x.no") == START).select("program_id", F.col("x").alias("l"), F.col("to").alias("r")).distinct(), "inner")
    seeds = seeds.select("program_id", F.col("node").alias(side))
    sources = flow.assigned(f).select("program_id", F.col("stmt_no").alias("l"), node(F.col("stmt_no"), "", F.col("var")).alias("x"))
    if side == "l":
        at = reached(up, seeds.join(sources, ["program_id", "l"]).select("program_id", F.col("x").alias("node"), "l"), carried=("l",)).withColumnRenamed("node", "x")
        begun = at.join(s.enters, ["program_id", "x"]).select("program_id", F.col("to").alias("node"), "l")
        below = reached(inner, begun, carried=("l",)).withColumnRenamed("node", "x")
        return at.unionByName(below).join(s.assigns, ["program_id", "x"]).select("program_id", "l", "r").distinct()
    used = written(s.assigns.join(seeds, ["program_id", "r"]).select("program_id", F.col("x").alias("node"), "r"), "uses")
    starts = reached(turned(inner), used.where(F.col("node.no") == START), carried=("r",)).withColumnRenamed("node", "to")
    entered = s.enters.where(F.col("x.no") != START).join(starts, ["program_id", "to"]).select("program_id", F.col("x").alias("node"), "r")
    at = reached(turned(up), used.where(F.col("node.no") != START).unionByName(entered), carried=("r",)).withColumnRenamed("node", "x")
    return at.join(sources, ["program_id", "x"]).select("program_id", "l", "r").distinct()


def between_assignments(f: Facts, s: Steps) -> DataFrame:
    """Pairs of assignments on a path that returns to callers any number of times, then enters callees any number of times.

    Starts, ends and statements have sets of the assignments that they lead
    to; pairs come of them at the end, and none of a start and an end is made.
    """
    nodes = s.assigns.select("program_id", "x").unionByName(s.enters.select("program_id", "x")).unionByName(s.ends.select("program_id", "x")).withColumnRenamed("x", "node")
    nodes = nodes.unionByName(s.enters.select("program_id", F.col("to").alias("node"))).unionByName(s.ends.select("program_id", F.col("to").alias("node")))
    # Next to each other: what has one variable, by the names of procedures.
    nodes = sets.numbered(nodes, [F.col("node.var"), F.length("node.proc"), F.col("node.proc"), F.col("node.no")])
    at = f.stmt.select("program_id", "stmt_no", "proc", "ord").join(f.use_direct.groupBy("program_id", "stmt_no").agg(F.min("var").alias("var")), ["program_id", "stmt_no"])
    users = s.assigns.select("program_id", F.col("r").alias("stmt_no")).distinct().join(at, ["program_id", "stmt_no"])
    order = [F.col("node.var"), F.length("node.proc"), F.col("node.proc"), F.col("node.ord")]
    users = sets.numbered(users.select("program_id", F.struct("var", "proc", "ord", "stmt_no").alias("node")), order).withColumn("node", F.col("node.stmt_no"))
    starts = F.col("x.no") == START
    numbers = lambda df, l, r: sets.by_number(df.select("program_id", l, r), nodes, l, r).select(F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    used = nodes.withColumnsRenamed({"node": "x", "number": "l"}).join(s.assigns, ["program_id", "x"])
    used = written(sets.by_number(used.select("program_id", "l", "r", (F.col("x.no") == START).alias("start")), users, "r"), "uses")
    uses = lambda start: sets.of_pairs(used.where(F.col("start") == start))
    # From a start: its own assignments and those of the starts below it.
    below = gathered(numbers(s.enters.where(starts), "x", "to"), uses(True), "below")
    # From a statement, without a return.
    into = numbers(s.enters.where(~starts), "x", "to")
    onward = written(sets.united(uses(False).unionByName(sets.through(into, below))), "returned")
    # From an end: to the calls that it returns to, and on from there.
    back = written(numbers(_returns(f, s.ends), "to", "x").distinct(), "back")
    leaves = written(numbers(s.ends, "x", "to"), "leaves")
    up = back.withColumnRenamed("r", "x").withColumnRenamed("l", "end").join(leaves.withColumnsRenamed({"l": "x", "r": "to"}), "x").select(F.col("end").alias("l"), F.col("to").alias("r"))
    behind = gathered(up, sets.through(back, onward), "behind")
    # From the assignments.
    sources = flow.assigned(f).select("program_id", "stmt_no", node(F.col("stmt_no"), "", F.col("var")).alias("node"))
    sources = nodes.join(sources, ["program_id", "node"]).select("program_id", F.col("stmt_no").alias("node"), "number")
    found = sets.united(onward.unionByName(sets.through(leaves, behind)).join(sources.select(F.col("number").alias("l")), "l", "left_semi"))
    return sets.named(found, sources, users)
