"""Event logs read as programs: a user is a procedure, an event a statement.

signup reads, click assigns, view prints, error opens a loop whose body lasts
until the user's next error, purchase calls (k below 10) or assigns, where k
is the number in `props`.  Variables are v0 to v19.  A call leads to the user
2**(k mod 8) further on, if there is one, so calls never recur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.tables import written
from codeloom.plans.facts import Facts

PROGRAM = "events"


def from_events(events: DataFrame) -> Facts:
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("int")
    kind = (
        F.when(F.col("event_type") == "signup", "read")
        .when(F.col("event_type") == "view", "print")
        .when(F.col("event_type") == "error", "while")
        .when((F.col("event_type") == "purchase") & (F.col("k") < 10), "call")
        .otherwise("assign")
    )
    e = events.where("event_id is not null and user_id is not null").select("event_id", "user_id", "ts", "event_type", k.alias("k")).withColumn("type", kind)
    users = e.select("user_id").distinct().select(F.col("user_id").alias("target"))
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    upto = by_user.rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("type") == "while", F.col("event_id"))
    s = e.withColumn("ord", F.row_number().over(by_user).cast("long")).withColumn("loop", F.last(header, ignorenulls=True).over(upto))
    in_loop = Window.partitionBy("user_id", "loop")
    s = s.withColumn("last_ord", F.when(F.col("type") == "while", F.max("ord").over(in_loop)).otherwise(F.col("ord")))
    s = s.withColumn("parent_no", F.when(F.col("type") != "while", F.col("loop")))
    var = F.concat(F.lit("v"), (F.col("k") % 20).cast("string"))
    used = F.concat(F.lit("v"), ((F.col("k") * 7 + 3) % 20).cast("string"))
    s = s.withColumn("target", F.when(F.col("type") == "call", F.expr("user_id + shiftleft(1L, k % 8)"))).join(users.withColumn("there", F.lit(True)), "target", "left")
    s = written(s, "event-statements")
    p = F.lit(PROGRAM).alias("program_id")
    proc = F.col("user_id").cast("string")
    stmt = s.select(
        p, F.col("event_id").alias("stmt_no"), "type", proc.alias("proc"), F.coalesce(F.concat(F.lit("w"), F.col("parent_no").cast("string")), F.concat(F.lit("p"), proc)).alias("block_id"),
        F.col("ord").alias("pos"), "ord", "last_ord", "parent_no", F.when(F.col("parent_no").isNotNull(), "body").alias("branch"), F.when(F.col("parent_no").isNotNull(), 1).otherwise(0).alias("depth"),
        F.when(F.col("type") == "assign", var).alias("lhs_var"), F.when(F.col("type").isin("read", "print"), var).alias("io_var"),
        F.when(F.col("there"), F.col("target").cast("string")).alias("callee"),
        F.when(F.col("type") == "assign", F.concat(F.lit("(("), used, F.lit(")+("), F.col("k").cast("string"), F.lit("))"))).alias("expr_canon"),
    )
    of = lambda types, v: s.where(F.col("type").isin(*types) & F.col("k").isNotNull()).select(p, F.col("event_id").alias("stmt_no"), v.alias("var"))
    return Facts(
        stmt=stmt,
        use_direct=of(["assign"], used).unionByName(of(["print", "while"], var)),
        mod_direct=of(["assign", "read"], var),
        cond_var=of(["while"], var),
        const=e.where("k is not null").select(p, F.col("k").cast("string").alias("value")).distinct(),
        proc=users.select(p, F.col("target").cast("string").alias("proc")),
    )
