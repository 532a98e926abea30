"""Orders read as a program: regions, nations and customers nest, orders are plain statements.

A region is a procedure whose one statement is a loop; a nation is a loop in
it, a customer an `if` in that, and an order stands in the customer's then
branch if its key is even, else in the else branch.  Orders assign (status
F), print (O) or read.  A statement's number is 4 * key + 0 to 3 for region,
nation, customer and order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.tables import written
from codeloom.plans.facts import Facts

PROGRAM = "orders"


def _before(by: Window, size: Column) -> Column:
    """Sum of the sizes ahead in a window."""
    return F.coalesce(F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def from_orders(region: DataFrame, nation: DataFrame, customer: DataFrame, orders: DataFrame) -> Facts:
    """Places in pre-order come from counts of the level below, so no task holds more than one customer's orders or one nation's customers.

    Rows whose key, or that of what they belong to, is null or unknown are left out.
    """
    number = lambda key, level: F.col(key).cast("long") * 4 + level
    null = lambda kind: F.lit(None).cast(kind)
    r = region.select("r_regionkey", "r_name")
    n = nation.select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")).join(r, "r_regionkey")
    c = customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(n, "n_nationkey")
    o = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "then").otherwise("else").alias("branch"))
    counts = o.groupBy("c_custkey").agg(F.count("*").alias("n_orders"))
    c = c.join(counts, "c_custkey", "left").withColumn("size", F.coalesce("n_orders", F.lit(0)) + 1)
    in_nation = Window.partitionBy("n_nationkey").orderBy("c_custkey")
    c = c.withColumns({"ahead": _before(in_nation, F.col("size")), "pos": F.row_number().over(in_nation).cast("long")})
    c = written(c, "order-customers")
    sizes = c.groupBy("n_nationkey").agg(F.sum("size").alias("inside"))
    in_region = Window.partitionBy("r_regionkey").orderBy("n_nationkey")
    n = n.join(sizes, "n_nationkey", "left").withColumn("size", F.coalesce("inside", F.lit(0)) + 1)
    # A region is the first statement of its procedure.
    n = n.withColumns({"ord": _before(in_region, F.col("size")) + 2, "pos": F.row_number().over(in_region).cast("long")})
    n = written(n, "order-nations")
    c = c.join(n.select("n_nationkey", F.col("ord").alias("n_ord")), "n_nationkey").withColumn("ord", F.col("n_ord") + F.col("ahead") + 1)
    in_customer = Window.partitionBy("c_custkey").orderBy(F.col("branch").desc(), "o_orderkey")
    in_branch = Window.partitionBy("c_custkey", "branch").orderBy("o_orderkey")
    o = o.where("o_orderkey is not null").withColumns({"place": F.row_number().over(in_customer), "pos": F.row_number().over(in_branch).cast("long")})
    o = o.join(c.select("c_custkey", "r_name", F.col("ord").alias("c_ord")), "c_custkey").withColumn("ord", F.col("c_ord") + F.col("place"))
    r = r.join(n.groupBy("r_regionkey").agg(F.sum("size").alias("inside")), "r_regionkey", "left")

    def rows(df: DataFrame, key: str, level: int, kind: Column, block: Column, parent: Column, branch: Column, last: Column, lhs: Column, io: Column, expr: Column) -> DataFrame:
        return df.select(
            F.lit(PROGRAM).alias("program_id"), number(key, level).alias("stmt_no"), kind.alias("type"), F.col("r_name").alias("proc"), block.alias("block_id"), F.col("pos").cast("long").alias("pos"),
            F.col("ord").cast("long").alias("ord"), last.cast("long").alias("last_ord"), parent.alias("parent_no"), branch.alias("branch"), F.lit(level).alias("depth"),
            lhs.alias("lhs_var"), io.alias("io_var"), null("string").alias("callee"), expr.alias("expr_canon"),
        )

    block = lambda tag, key: F.concat(F.lit(tag), F.col(key).cast("string"))
    text = null("string")
    var = lambda key: F.concat(F.lit("v"), (F.col(key) % 20).cast("string"))
    kind = F.when(F.col("o_orderstatus") == "F", "assign").when(F.col("o_orderstatus") == "O", "print").otherwise("read")
    own, used = var("o_orderkey"), F.concat(F.lit("v"), ((F.col("o_orderkey") * 7 + 3) % 20).cast("string"))
    expr = F.concat(F.lit("(("), used, F.lit(")+("), (F.col("o_orderkey") % 50).cast("string"), F.lit("))"))
    stmt = rows(r.withColumns({"pos": F.lit(1), "ord": F.lit(1)}), "r_regionkey", 0, F.lit("while"), block("r", "r_regionkey"), null("long"), text, F.coalesce("inside", F.lit(0)) + 1, text, text, text)
    stmt = stmt.unionByName(rows(n, "n_nationkey", 1, F.lit("while"), block("n", "r_regionkey"), number("r_regionkey", 0), F.lit("body"), F.col("ord") + F.col("size") - 1, text, text, text))
    stmt = stmt.unionByName(rows(c, "c_custkey", 2, F.lit("if"), block("c", "n_nationkey"), number("n_nationkey", 1), F.lit("body"), F.col("ord") + F.col("size") - 1, text, text, text))
    stmt = stmt.unionByName(rows(
        o, "o_orderkey", 3, kind, F.concat(F.substring("branch", 1, 1), F.col("c_custkey").cast("string")), number("c_custkey", 2), F.col("branch"), F.col("ord"),
        F.when(kind == "assign", own), F.when(kind != "assign", own), F.when(kind == "assign", expr),
    ))
    stmt = written(stmt, "order-statements")
    tested = lambda df, key, level: df.select(F.lit(PROGRAM).alias("program_id"), number(key, level).alias("stmt_no"), var(key).alias("var"))
    cond = tested(r, "r_regionkey", 0).unionByName(tested(n, "n_nationkey", 1)).unionByName(tested(c, "c_custkey", 2))
    plain = o.select(F.lit(PROGRAM).alias("program_id"), number("o_orderkey", 3).alias("stmt_no"), kind.alias("type"), own.alias("own"), used.alias("used"), (F.col("o_orderkey") % 50).cast("string").alias("value"))
    return Facts(
        stmt=stmt,
        use_direct=cond.unionByName(plain.where("type <> 'read'").select("program_id", "stmt_no", F.when(F.col("type") == "assign", F.col("used")).otherwise(F.col("own")).alias("var"))),
        mod_direct=plain.where("type <> 'print'").select("program_id", "stmt_no", F.col("own").alias("var")),
        cond_var=cond,
        const=plain.where("type = 'assign'").select("program_id", "value").distinct(),
        proc=r.select(F.lit(PROGRAM).alias("program_id"), F.col("r_name").alias("proc")),
    )
