"""Values along control flow, by nesting instead of by steps.

A list of statements has a segment for each variable between two kills of it.
A value set in a list reaches what comes later in its segment; from the last
segment it goes on behind the container of the list (and, for a loop, to the
body again).  What the first segment of a list uses, the container uses.  So
both sides climb one level of nesting a round, and meet by equality of list,
variable and segment: no task holds a procedure, and the rounds do not depend
on the number of statements.  Lists longer than a cell are cut into pieces for
their kills, and long segments into pairs of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import runs
from codeloom.functions.runs import in_order, running
from codeloom.functions.tables import written
from codeloom.plans.facts import Facts

#: Order at one position: what a statement uses, what it kills, what it passes on.
USED, KILLED, SET = 0, 1, 2
LIST = ["program_id", "proc", "block_id", "var"]


def _places(f: Facts) -> DataFrame:
    return f.stmt.select("program_id", "stmt_no", "proc", "block_id", "pos", "parent_no", "branch")


def kills(f: Facts, direct: DataFrame, across: bool) -> DataFrame:
    """(program_id, stmt_no, var): no path through the statement keeps var; `direct` lists those of single statements.

    An `if` kills what both branches kill, a loop nothing, as it may be
    passed.  With `across`, a call kills what each path through its callee does.
    """
    columns = ["program_id", "stmt_no", "var"]
    ifs = f.stmt.where("type = 'if'").select("program_id", F.col("stmt_no").alias("parent_no"))
    sites = f.call_edge.select("program_id", "stmt_no", F.col("callee").alias("proc"))
    at = _places(f)
    known = delta = written(direct.select(*columns).distinct(), "kills")
    while not delta.isEmpty():
        # Lists that gained a kill, with all branches of their `if` that have one.
        touched = delta.join(at, ["program_id", "stmt_no"]).join(ifs, ["program_id", "parent_no"]).select("program_id", "parent_no", "var").distinct()
        arms = known.join(at, ["program_id", "stmt_no"]).join(touched, ["program_id", "parent_no", "var"])
        new = arms.groupBy("program_id", F.col("parent_no").alias("stmt_no"), "var").agg(F.countDistinct("branch").alias("n")).where("n = 2").select(*columns)
        if across:
            top = delta.join(at.where("parent_no is null"), ["program_id", "stmt_no"]).select("program_id", "proc", "var").distinct()
            new = new.unionByName(top.join(sites, ["program_id", "proc"]).select(*columns))
        delta = written(new.distinct().join(known, columns, "left_anti"), "kills")
        known = known.unionByName(delta)
    return written(known, "kills")


def _climb(f: Facts, nodes: DataFrame, killed: DataFrame) -> DataFrame:
    """Where values of nodes (program_id, stmt_no, var, tag) are set or used: a row for each list they get to.

    LIST with node (the statement they come from), tag, pos, seg, parent_no, `inner`, the loop they came out of last,
    and `open`: on to the container.
    """
    at = _places(f).drop("branch")
    w = Window.partitionBy(*LIST)
    is_kill = F.when(F.col("tag") == KILLED, 1).otherwise(0)
    none = F.lit(None).cast("long")
    loops = f.stmt.where("type = 'while'").select("program_id", F.col("stmt_no").alias("parent_no"), F.col("stmt_no").alias("out_of"))
    marks = killed.join(at, ["program_id", "stmt_no"]).withColumns({"node": none, "tag": F.lit(KILLED), "inner": none})
    marks = written(marks, "marks")
    level, out = nodes.select("program_id", F.col("stmt_no").alias("node"), "stmt_no", "var", "tag").distinct().withColumn("inner", none), None
    while True:
        rows = level.join(at, ["program_id", "stmt_no"]).unionByName(marks)
        if f.piece is None:
            rows = rows.withColumns({"seg": F.sum(is_kill).over(w.orderBy("pos", "tag").rowsBetween(Window.unboundedPreceding, 0)), "kills": F.sum(is_kill).over(w)})
        else:
            # Some list is long: its kills are counted in pieces, then over the pieces.
            rows = written(rows.withColumns({"piece": f.piece, "place": F.struct("pos", "tag")}), "in-pieces")
            total = rows.groupBy(*LIST).agg(F.sum(is_kill).alias("kills"))
            rows = running(rows, LIST, "place", sums={"seg": is_kill}, piece="piece").join(total, LIST)
        rows = rows.withColumn("open", F.col("seg") == F.when(F.col("tag") == SET, F.col("kills")).otherwise(0))
        rows = written(rows.where(F.col("tag") != KILLED).select(*LIST, "node", "tag", "pos", "seg", "parent_no", "inner", "open"), "climb")
        out = rows if out is None else out.unionByName(rows)
        level = rows.where("open and parent_no is not null").join(loops, ["program_id", "parent_no"], "left")
        level = level.select("program_id", "node", F.col("parent_no").alias("stmt_no"), "var", "tag", F.coalesce("out_of", "inner").alias("inner"))
        if level.isEmpty():
            return out


def _met(*sides: tuple[DataFrame, DataFrame, list[str]]) -> int:
    """How many pairs the rows of two tables with equal keys are at most."""
    size = 0
    for a, b, keys in sides:
        counts = a.groupBy(*keys).agg(F.count("*").alias("n")).join(b.groupBy(*keys).agg(F.count("*").alias("m")), keys)
        size += counts.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    return int(size)


def _circling(f: Facts, rows: DataFrame) -> DataFrame:
    """Rows of `_climb` with `circles`: whether what they are about gets to the body of the nearest loop around their list, and out of it."""
    loops = f.stmt.where("type = 'while'").select("program_id", F.col("stmt_no").alias("parent_no"), "depth")
    inside = f.relation("parent_t").withColumnRenamed("l", "parent_no").join(loops, ["program_id", "parent_no"])
    branching = f.stmt.where("type = 'if'").select("program_id", F.col("stmt_no").alias("r"))
    nearest = inside.join(branching, ["program_id", "r"], "left_semi").groupBy("program_id", F.col("r").alias("parent_no")).agg(F.max_by("parent_no", "depth").alias("loop"))
    nearest = nearest.unionByName(loops.select("program_id", "parent_no", F.col("parent_no").alias("loop")))
    gone = rows.where("open").join(loops, ["program_id", "parent_no"], "left_semi").select("program_id", "node", "var", "tag", F.col("parent_no").alias("loop"), F.lit(True).alias("out"))
    rows = rows.join(nearest, ["program_id", "parent_no"], "left").join(gone, ["program_id", "node", "var", "tag", "loop"], "left")
    return rows.withColumn("circles", F.coalesce("out", F.lit(False))).drop("loop", "out")


def dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two tables with equal keys, those of a key dealt to tasks in lots of about CELL rows of the left side."""
    lots = left.groupBy(*keys).agg(F.ceil(F.count("*") / runs.CELL).alias("_lots"))
    left = left.join(lots, keys).withColumn("_lot", F.pmod(F.xxhash64("l"), F.col("_lots"))).drop("_lots")
    right = right.join(lots, keys).withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lots") - 1))).drop("_lots")
    # Few rows may make many pairs, so tasks are not joined by the size of what they read.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df: df.repartition(tasks, *keys, "_lot")
    return deal(left).join(deal(right).hint("merge"), [*keys, "_lot"]).drop("_lot")


def meetings(f: Facts, setters: DataFrame, users: DataFrame, killed: DataFrame, among: tuple[DataFrame, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Which statement may pass a value to which, inside procedures; which reach their procedure's end; which its start reaches.

    setters, users: (program_id, stmt_no, var).  Gives pairs
    (program_id, l, r, var) and twice (program_id, stmt_no, proc, var).
    With `among`, only pairs in that table (program_id, l, r) are asked for;
    if they are fewer than those that may meet, they are tested instead.

    Each pair comes once, from the one list in which its statements, or what
    holds them, have two places, or else from the innermost loop around both
    that the value goes round; so large results need not be made distinct.
    """
    columns = ["program_id", "stmt_no", "var"]
    both = _climb(f, setters.select(*columns).withColumn("tag", F.lit(SET)).unionByName(users.select(*columns).withColumn("tag", F.lit(USED))), killed)
    both = written(_circling(f, both), "circling")
    ups, downs = both.where(F.col("tag") == SET), both.where(F.col("tag") == USED)
    a = ups.select(*LIST, "seg", F.col("node").alias("l"), F.col("pos").alias("pos_l"), F.col("circles").alias("circles_l"))
    b = downs.select(*LIST, "seg", F.col("node").alias("r"), F.col("pos").alias("pos_r"), F.col("circles").alias("circles_r"))
    loops = f.stmt.where("type = 'while'").select("program_id", F.col("stmt_no").alias("parent_no"))
    onward = ups.where("open").join(loops, ["program_id", "parent_no"]).select("program_id", "parent_no", "var", F.col("node").alias("l"), F.col("inner").alias("inner_l"))
    again = downs.where("open").select("program_id", "parent_no", "var", F.col("node").alias("r"), F.col("inner").alias("inner_r"))
    segment, loop = [*LIST, "seg"], ["program_id", "parent_no", "var"]
    first, once = "pos_l < pos_r and not (circles_l and circles_r)", "inner_l is null or inner_r is null or inner_l <> inner_r"
    if among and among[1] < _met((a, b, segment), (onward, again, loop)):
        pairs = written(among[0].select("program_id", "l", "r").distinct(), "asked-for")
        a, onward = (x.join(pairs, ["program_id", "l"]) for x in (a, onward))
        ahead = a.join(b, [*segment, "r"]).where(first).select("program_id", "l", "r", "var")
        around = onward.join(again, [*loop, "r"]).where(once).select("program_id", "l", "r", "var")
    else:
        cut = f.piece is not None
        ahead = in_order(a.where("not circles_l"), b, segment, cut=cut).unionByName(in_order(a.where("circles_l"), b.where("not circles_r"), segment, cut=cut)).select("program_id", "l", "r", "var")
        around = dealt(onward, again, loop).where(once).select("program_id", "l", "r", "var")
    edge = lambda df: df.where("open and parent_no is null").select("program_id", F.col("node").alias("stmt_no"), "proc", "var")
    return ahead.unionByName(around), edge(ups), edge(downs)


def assigned(f: Facts) -> DataFrame:
    return f.focused(f.stmt.where("type = 'assign' and lhs_var is not null")).select("program_id", "stmt_no", F.col("lhs_var").alias("var"))


def used(f: Facts) -> DataFrame:
    uses = f.use_direct.join(f.focused(f.stmt.where("type = 'assign'")).select("program_id", "stmt_no"), ["program_id", "stmt_no"])
    return uses.select("program_id", "stmt_no", "var").distinct()
