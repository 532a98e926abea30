"""Program text as facts, by Spark's own string and window functions.

A text is cut behind every `;`, `{` and `}` into segments, each a statement or
the head of a container at most, with the tokens that one regular expression
finds in it.  Running sums over segments number the statements and the depth of
braces, and the last open brace or loop header at a depth is the block or
container of what follows.  Only expressions pass through a small Python
helper, for their canonical form.

A program is a row (program_id, source), or, however large, rows of lines
(program_id, piece, line, source), whose pieces have a bounded number of
lines and ascend with them.  What runs along a program of lines runs inside
pieces first, then over a row for each piece, so no task holds the program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.expressions import canonical_column, is_condition_column
from codeloom.functions.runs import neighbours, running
from codeloom.functions.tables import written
from codeloom.operators.closure import closure
from codeloom.plans.facts import Facts

TOKEN = r"([A-Za-z][A-Za-z0-9]*|[0-9]+|&&|\|\||[<>=!]=|[-+*/%<>=!(){};])"
NAME = r"^[A-Za-z][A-Za-z0-9]*$"
HEADERS = ("while", "if")
#: Lines of a piece, and segments of one.
LINES = 4096


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """One program per file: (program_id, source)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("program_id"), F.col("value").alias("source"))


def read_lines(spark: SparkSession, path: str, folders: bool = False, lines: int = LINES) -> DataFrame:
    """Programs by lines: one per file, or with `folders` one per folder, whose files are in order of length of name, then name.

    Files may be split between tasks, as Spark likes; only a line has to fit into one.
    Pieces are numbered, so that no row carries the name of its file from step to step.
    """
    name, row = F.col("_metadata.file_path"), F.monotonically_increasing_id()
    folder = F.regexp_replace(name, "/[^/]*$", "") if folders else name
    at = [F.length(name).alias("length"), name.alias("file"), F.col("_metadata.file_block_start").alias("start")]
    t = spark.read.text(path).select(folder.alias("program_id"), F.struct(*at, F.floor(row / lines).alias("part")).alias("piece"), row.alias("line"), F.col("value").alias("source"))
    t = written(t, "lines")
    number = F.row_number().over(Window.partitionBy("program_id").orderBy("piece")).cast("long")
    numbers = written(t.select("program_id", "piece").distinct().withColumn("number", number), "pieces")
    return t.join(numbers, ["program_id", "piece"]).select("program_id", F.col("number").alias("piece"), "line", "source")


def _piece(t: DataFrame) -> str | None:
    return "piece" if "piece" in t.columns else None


def _cut(programs: DataFrame) -> DataFrame:
    """(program_id, g, toks), and piece for lines: the tokens of every segment that has some, numbered in order.  No token goes over the end of a line, a segment may."""
    parts = F.split("source", "(?<=[;{}])")
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1)).alias("toks")
    if _piece(programs) is None:
        return programs.select("program_id", F.posexplode(parts).alias("g", "text")).select("program_id", F.col("g").cast("long").alias("g"), tokens).where(F.size("toks") > 0)
    marks = F.size(F.regexp_extract_all("source", F.lit("([;{}])"), F.lit(1))).cast("long")
    t = running(programs, ["program_id"], "line", sums={"upto": marks}, piece="piece")
    t = t.select("program_id", "line", (F.col("upto") - marks).alias("before"), F.posexplode(parts).alias("k", "text"))
    t = t.select("program_id", "line", (F.col("before") + F.col("k")).alias("g"), tokens).where(F.size("toks") > 0)
    t = t.withColumn("piece", F.floor(F.col("g") / LINES)).repartition("program_id", "piece").groupBy("program_id", "piece", "g")
    return t.agg(F.flatten(F.array_sort(F.collect_list(F.struct("line", "toks")))["toks"]).alias("toks"))


def _segments(programs: DataFrame) -> DataFrame:
    """(program_id, g, toks, end, prev, next, depth, kind, no, proc), and piece for lines: every segment, and what starts there.

    `end` is the `;`, `{` or `}` that ends the segment, null at the end of a
    text; `prev` and `next` are those of its neighbours, or `else` for an
    `else {`.  `depth` counts the braces open before it, so statements of a
    procedure's own list are at depth 1.
    """
    t = _cut(programs)
    piece = _piece(t)
    last = F.element_at("toks", -1)
    t = t.withColumn("end", F.when(last.isin(";", "{", "}"), last))
    t = t.withColumns({"sign": F.when(F.concat_ws(" ", "toks") == "else {", "else").otherwise(F.coalesce("end", F.lit(""))), "step": _step(F.col("end"))})
    t = cut = written(t, "segments") if piece else t
    t = neighbours(t, ["program_id"], "g", "sign", piece)
    t = running(t, ["program_id"], "g", sums={"depth": F.col("step")}, piece=piece, table=cut)
    t = t.withColumn("depth", (F.col("depth") - F.col("step")).cast("int"))
    first, second = F.get("toks", F.lit(0)), F.get("toks", F.lit(1))
    # After a `}` an `else {` continues an if; `else = 1;` is a statement, for no word is reserved.
    begins = first.rlike(NAME) & ~((F.col("sign") == "else") & F.coalesce(F.col("prev") == "}", F.lit(False)))
    kind = (
        F.when(begins & (F.col("depth") == 0) & (first == "procedure"), "procedure")
        .when(begins & (second == "="), "assign")
        .when(begins & first.isin("read", "print", "call", "while", "if"), first)
        .when(begins, "error")
    )
    t = t.select("program_id", *([piece] if piece else []), "g", "toks", "end", "prev", "next", "depth", kind.alias("kind"))
    t = written(t, "kinds") if piece else t
    starts = F.when(F.col("kind").isNotNull() & (F.col("kind") != "procedure"), 1).otherwise(0)
    return running(t, ["program_id"], "g", sums={"no": starts}, lasts={"proc": F.when(F.col("kind") == "procedure", second)}, piece=piece)


def _step(end: Column) -> Column:
    return F.when(end == "{", 1).when(end == "}", -1).otherwise(0)


def _opened_by() -> Column:
    """The token before the `{` that ends a segment."""
    before = F.when(F.col("prev") == "else", "{").otherwise(F.col("prev"))
    return F.when(F.col("end") == "{", F.when(F.size("toks") > 1, F.element_at("toks", -2)).otherwise(before))


#: What may stand between two of `;`, `{` and `}`, tokens set apart by blanks.
_ID = "[A-Za-z][A-Za-z0-9]*"
ASSIGNMENT, SIMPLE = rf"^{_ID} = (.*) ;$", rf"^(read|print|call) {_ID} ;$"
LOOP, BRANCH = r"^while \( (.+) \) \{$", r"^if \( (.+) \) then \{$"


def parse_errors(programs: DataFrame, facts: Facts | None = None) -> DataFrame:
    """(program_id, message) of programs that break a rule: characters, braces, statements, expressions, conditions, branches, names, calls, recursion."""
    t = written(_segments(programs), "parsed")
    piece = _piece(t)
    rest = programs.where(F.trim(F.regexp_replace(F.regexp_replace("source", TOKEN, " "), r"\s+", " ")) != "").select("program_id", F.lit("unknown character").alias("message")).distinct()
    empty = programs.groupBy("program_id").agg(F.max(F.regexp_like("source", F.lit(r"\S"))).alias("any"))
    none = empty.where(~F.col("any")).select("program_id", F.lit("no procedure").alias("message"))
    say = lambda df, text: df.select("program_id", F.lit(text).alias("message")).distinct()
    out = rest.unionByName(none)
    closed = F.col("depth") - F.when(F.col("end") == "}", 1).otherwise(0)
    out = out.unionByName(say(t.groupBy("program_id").agg(F.sum(_step(F.col("end"))).alias("open"), F.min(closed).alias("low")).where("open <> 0 or low < 0"), "braces do not match"))
    # Each segment is one of the forms of its depth, and its expression or condition is one.
    inside = F.when(F.col("text").rlike(ASSIGNMENT), "assign").when(F.col("text").rlike(SIMPLE) | F.col("text").isin("}", "else {"), "fine").when(F.col("text").rlike(LOOP), "while").when(F.col("text").rlike(BRANCH), "if")
    s = t.select("program_id", F.when(F.size("toks") == 1, closed).otherwise(F.col("depth")).alias("depth"), F.concat_ws(" ", "toks").alias("text")).withColumn("form", F.when(F.col("depth") > 0, inside).when(F.col("text").rlike(rf"^procedure {_ID} \{{$"), "fine"))
    # Too many closing braces are an error already.
    s = written(s.where("depth > 0 or text <> '}'"), "forms")
    out = out.unionByName(say(s.where("form is null"), "no statement"))
    right = s.where("form = 'assign'").select("program_id", canonical_column(F.regexp_extract("text", ASSIGNMENT, 1)).alias("e"))
    out = out.unionByName(say(right.where("e is null"), "no expression"))
    test = F.when(F.col("form") == "while", F.regexp_extract("text", LOOP, 1)).otherwise(F.regexp_extract("text", BRANCH, 1))
    out = out.unionByName(say(s.where("form in ('while', 'if')").select("program_id", is_condition_column(test).alias("ok")).where("not ok"), "no condition"))
    # What a closing brace closes: the last one opened at its depth.
    braces = t.where("end in ('{', '}')").select("program_id", *([piece] if piece else []), "g", "end", "next", F.when(F.col("end") == "{", F.col("depth") + 1).otherwise(F.col("depth")).alias("level"), _opened_by().alias("by"))
    braces = running(braces, ["program_id", "level"], "g", lasts={"opened_by": F.col("by")}, piece=piece)
    closing = braces.where("end = '}' and level > 1").withColumn("goes_on", F.col("next") == "else")
    bad = closing.where("(opened_by = 'then') <> coalesce(goes_on, false)")
    # An `else` that follows no closing brace.
    begun = t.where((F.concat_ws(" ", "toks") == "else {") & (F.col("depth") > 0) & F.col("prev").isin("{", ";", "else"))
    out = out.unionByName(say(bad.select("program_id").unionByName(begun.select("program_id")), "then and else do not match"))
    out = out.unionByName(say(t.where("kind = 'procedure'").groupBy("program_id", F.get("toks", F.lit(1))).count().where("count > 1"), "procedure declared twice"))
    facts = facts or from_programs(programs)
    calls = facts.call_edge
    out = out.unionByName(say(calls.join(facts.proc, (calls["program_id"] == facts.proc["program_id"]) & (calls["callee"] == facts.proc["proc"]), "left_anti"), "undeclared procedure called"))
    loops = closure(calls.select("program_id", F.col("caller").alias("l"), F.col("callee").alias("r"))).where("l = r")
    return out.unionByName(say(loops, "recursive call")).distinct()


def from_programs(programs: DataFrame) -> Facts:
    """Facts of programs, whole or by lines.  See `parse_errors` for those that are none."""
    t = written(_segments(programs), "parsed")
    piece, cut = _piece(t), [c for c in ("piece",) if c in t.columns]
    first, second = F.get("toks", F.lit(0)), F.get("toks", F.lit(1))
    # What a statement consists of: the segment without its end.
    held = F.size("toks") - F.when(F.col("end").isNotNull(), 1).otherwise(0)
    head = F.col("kind").isNotNull() & ~F.col("kind").isin("procedure", "error") & (F.col("depth") > 0)
    # Last open brace, and last header, of a depth: at its own depth a segment asks for them and may close, one deeper it opens.
    expr = F.when(F.col("kind") == "assign", F.concat_ws(" ", F.slice("toks", F.lit(3), F.greatest(held - 2, F.lit(0)))))
    own = t.where(head | (F.col("end") == "}")).select(
        "program_id", *cut, "g", F.col("depth").alias("level"), F.when(head, F.col("no")).alias("stmt_no"), F.when(F.col("end") == "}", F.col("no")).alias("last_no"),
        F.when(head, F.struct("kind", "proc", first.alias("tok"), second.alias("next"), expr.alias("expr"))).alias("is"),
    )
    header = head & F.col("kind").isin(*HEADERS)
    opens = t.where(header | (F.col("end") == "{")).select(
        "program_id", *cut, "g", (F.col("depth") + 1).alias("level"), F.when(F.col("end") == "{", F.col("g")).alias("opened"), _opened_by().alias("by"), F.when(header, F.col("no")).alias("above")
    )
    both = running(own.unionByName(opens, allowMissingColumns=True), ["program_id", "level"], "g", lasts={"block": F.col("opened"), "opened_by": F.col("by"), "parent_no": F.when(F.col("level") > 1, F.col("above"))}, piece=piece)
    both = written(both.where("stmt_no is not null or last_no is not null").select("program_id", "stmt_no", "last_no", "is", "level", "block", "opened_by", "parent_no"), "held")
    # The last statement before the last brace that closes a container.
    ends = both.where("last_no is not null and parent_no is not null").groupBy("program_id", F.col("parent_no").alias("stmt_no")).agg(F.max("last_no").alias("end_no"))

    s = both.where("stmt_no is not null").select("program_id", "stmt_no", "is.*", "block", "opened_by", "parent_no", (F.col("level") - 1).alias("depth"))
    if piece:
        s = s.join(s.groupBy("program_id", "proc").agg(F.min("stmt_no").alias("first_no")), ["program_id", "proc"])
    else:
        s = s.withColumn("first_no", F.min("stmt_no").over(Window.partitionBy("program_id", "proc")))
    s = s.withColumn("ord", (F.col("stmt_no") - F.col("first_no") + 1).cast("long"))
    s = s.join(ends, ["program_id", "stmt_no"], "left")
    branch = F.when(F.col("depth") == 0, None).when(F.col("opened_by").isin("then", "else"), F.col("opened_by")).otherwise("body")
    stmt = s.select(
        "program_id", "stmt_no", F.col("kind").alias("type"), "proc", F.col("block").cast("string").alias("block_id"), F.col("ord").alias("pos"), "ord",
        (F.col("ord") + F.coalesce("end_no", "stmt_no") - F.col("stmt_no")).alias("last_ord"), "parent_no", branch.alias("branch"), "depth",
        F.when(F.col("kind") == "assign", F.col("tok")).alias("lhs_var"), F.when(F.col("kind").isin("read", "print"), F.col("next")).alias("io_var"),
        F.when(F.col("kind") == "call", F.col("next")).alias("callee"), canonical_column("expr").alias("expr_canon"),
    )
    stmt = written(stmt, "stmt")
    # `then` closes an if's condition: it stands between `)` and `{`, and no variable can.
    then = (F.col("end") == "{") & (F.element_at("toks", -2) == "then")
    words = F.slice("toks", F.lit(2), F.greatest(held - 1 - F.when(then & (held > 1), 1).otherwise(0), F.lit(0)))
    each = lambda types, form, name: t.where(F.col("kind").isin(*types)).select("program_id", "no", F.explode(F.array_distinct(F.filter(words, lambda w: w.rlike(form)))).alias(name))
    variable = lambda types: each(types, NAME, "var").withColumn("stmt_no", F.col("no").cast("long")).select("program_id", "stmt_no", "var")
    names = stmt.where("lhs_var is not null or type = 'read'").select("program_id", "stmt_no", F.coalesce("lhs_var", "io_var").alias("var"))
    return Facts(
        stmt=stmt,
        use_direct=written(variable(["assign", "print", *HEADERS]), "uses"),
        mod_direct=names,
        cond_var=variable(HEADERS),
        const=each(["assign", *HEADERS], "^[0-9]", "value").select("program_id", "value").distinct(),
        proc=t.where("kind = 'procedure'").select("program_id", second.alias("proc")).distinct(),
    )
