"""Program texts written from an event log, to be parsed like any others.

Eight users of neighbouring numbers are a program and each of them a procedure,
named v0 to v39 so that procedures and variables share names.  Events mean what
they do in `codeloom.sources.events`, but a call of a user in another program,
or of none, prints instead.  All users together may also be one large program.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.tables import shared_folder

#: Users of a program, and number of names for their procedures.
USERS, NAMES = 8, 40


def procedure_name(user: Column) -> Column:
    return F.concat(F.lit("v"), (user % NAMES).cast("string"))


def _statements(events: DataFrame, called_name, same_program: bool) -> DataFrame:
    """(user_id, ord, loops, line): a line for each event in the order of its user."""
    k = F.coalesce(F.regexp_extract("props", "[0-9]+", 0).try_cast("int"), F.lit(0))
    e = events.where("event_id is not null and user_id is not null").select("event_id", "user_id", "ts", "event_type", k.alias("k"))
    users = e.select(F.col("user_id").alias("target")).distinct().withColumn("there", F.lit(True))
    e = e.withColumn("target", F.expr("user_id + shiftleft(1L, k % 8)")).join(users, "target", "left")
    near = F.floor(F.col("target") / USERS) == F.floor(F.col("user_id") / USERS)
    called = F.coalesce(F.col("there"), F.lit(False)) & (near if same_program else F.lit(True))
    var = lambda x: F.concat(F.lit("v"), (x % 20).cast("string"))
    own, number = var(F.col("k")), F.col("k").cast("string")
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    loops = F.sum((F.col("event_type") == "error").cast("int")).over(by_user.rowsBetween(Window.unboundedPreceding, 0))
    line = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("read "), own, F.lit(";")))
        .when(F.col("event_type") == "error", F.concat(F.when(F.col("loops") > 1, "} ").otherwise(""), F.lit("while ("), own, F.lit(" > "), number, F.lit(") {")))
        .when((F.col("event_type") == "purchase") & (F.col("k") < 10) & called, F.concat(F.lit("call "), called_name(F.col("target")), F.lit(";")))
        .when((F.col("event_type") == "view") | ((F.col("event_type") == "purchase") & (F.col("k") < 10)), F.concat(F.lit("print "), own, F.lit(";")))
        .otherwise(F.concat(own, F.lit(" = "), var(F.col("k") * 7 + 3), F.lit(" + "), number, F.lit(";")))
    )
    return e.withColumns({"loops": loops, "ord": F.row_number().over(by_user)}).select("user_id", "ord", "loops", line.alias("line"))


def one_program(events: DataFrame) -> DataFrame:
    """(user_id, ord, line): one program of all users, each a procedure named u and its number, which call each other wherever they are."""
    lines = _statements(events, lambda user: F.concat(F.lit("u"), user.cast("string")), same_program=False)
    around = lines.groupBy("user_id").agg(F.max("ord").alias("last"), F.max("loops").alias("loops"))
    first = around.select("user_id", F.lit(0).alias("ord"), F.concat(F.lit("procedure u"), F.col("user_id").cast("string"), F.lit(" {")).alias("line"))
    last = around.select("user_id", (F.col("last") + 1).alias("ord"), F.when(F.col("loops") > 0, "} }").otherwise("}").alias("line"))
    return lines.select("user_id", "ord", "line").unionByName(first).unionByName(last)


def written_program(events: DataFrame) -> str:
    """Folder of the one program of all events, written as a text in parts that follow each other; a part may end anywhere."""
    path = f"{shared_folder(events.sparkSession)}/codeloom/program-{uuid.uuid4().hex}/text"
    one_program(events).orderBy("user_id", "ord").select("line").write.text(path)
    return path


def program_texts(events: DataFrame) -> DataFrame:
    """(program_id, source): a row for each program.  Rows without an id or user are left out; events without a number have 0."""
    program = F.floor(F.col("user_id") / USERS).cast("long")
    lines = _statements(events, procedure_name, same_program=True)
    in_order = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "line"))), lambda x: x["line"]), "\n")
    body = lines.groupBy("user_id").agg(in_order("ord").alias("body"), F.max("loops").alias("loops"))
    text = F.concat(F.lit("procedure "), procedure_name(F.col("user_id")), F.lit(" {\n"), F.col("body"), F.when(F.col("loops") > 0, " }").otherwise(""), F.lit("\n}"))
    procedures = body.select(program.cast("string").alias("program_id"), "user_id", text.alias("line"))
    return procedures.groupBy("program_id").agg(in_order("user_id").alias("source"))


#: What is done to a text of number n, by n % 8, and what is then wrong with it.
FAULTS = {
    1: ("", ["braces do not match"]),
    2: ("procedure twice { } procedure twice { }", ["procedure declared twice"]),
    3: ("procedure extra { call nobody; }", ["undeclared procedure called"]),
    4: ("procedure la { call lb; } procedure lb { call la; }", ["recursive call"]),
    5: ("procedure odd { x = 1 ^ 2; }", ["unknown character", "no expression"]),
    6: ("procedure odd { x = 1 }", ["no statement"]),
    7: ("procedure odd { while (x) { x = 01; } }", ["no condition", "no expression"]),
}


def faulty_texts(texts: DataFrame) -> DataFrame:
    """Texts of which seven in eight are made wrong: number 1 loses its last brace, others get another procedure."""
    n, source = F.col("program_id").cast("long") % 8, F.col("source")
    for k, (more, _) in FAULTS.items():
        source = F.when(n == k, F.concat(F.col("source"), F.lit("\n" + more)) if more else F.expr("substring(source, 1, length(source) - 1)")).otherwise(source)
    return texts.select("program_id", source.alias("source"))
