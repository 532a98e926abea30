"""Conjunctive queries over program facts, built in Python and run as one Spark plan.

    q = Query(facts, s="stmt", v="variable", a="assign")
    q.such_that("Modifies", "a", "v").pattern("a", "v", part="x + 1").with_("s.stmt#", "a.stmt#").select("s", "v")

A clause is a table of bindings, a column for each synonym; equal attributes
of two synonyms are two, which bind them to the value.  Clauses that
share synonyms join on them (`codeloom.operators.joins`); groups that share
none join on the program, and groups that no selected synonym is in only
decide which programs qualify.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.expressions import canonical
from codeloom.functions.tables import written
from codeloom.operators import demand, joins, relations
from codeloom.plans.facts import Facts

STATEMENTS = ("read", "print", "call", "while", "if", "assign")
ENTITIES = ("stmt", "prog_line", *STATEMENTS, "variable", "constant", "procedure")
#: Relation names to the functions that compute them.
RELATIONS = {
    "Follows": "follows", "Follows*": "follows_t", "Parent": "parent", "Parent*": "parent_t", "Calls": "calls", "Calls*": "calls_t", "Next": "next", "Next*": "next_t",
    "Affects": "affects", "Affects*": "affects_t", "NextBip": "next_bip", "NextBip*": "next_bip_t", "AffectsBip": "affects_bip", "AffectsBip*": "affects_bip_t", "Uses": "uses", "Modifies": "modifies",
}
#: Statements that neither hold nor call others, and the tables of their variables.
SIMPLE = ("assign", "read", "print")
#: Relations with few pairs for each statement, whose joins may bring the arguments of Affects together.
NEAR = ("Parent", "Parent*", "Follows", "Next")
OWN = {"uses_s": "use_direct", "modifies_s": "mod_direct"}
#: A BOOLEAN looks for its first witness in growing parts of a domain: ends of the parts, of 64.
SLICES = (1, 8, 64)
#: Which entities have which attribute.
ATTRIBUTES = {
    "stmt#": ("stmt", *STATEMENTS),
    "value": ("constant",),
    "procName": ("procedure", "call"),
    "varName": ("variable", "read", "print"),
}


class SemanticError(ValueError):
    """A query that is well formed but means nothing; its answer is empty, or FALSE."""


@dataclass(frozen=True)
class Name:
    """A quoted name in a clause, as against a synonym."""

    text: str


def name(text: str) -> Name:
    return Name(text)


@dataclass
class Query:
    facts: Facts
    synonyms: dict[str, str] = field(default_factory=dict)
    clauses: list[tuple] = field(default_factory=list)

    def __init__(self, facts: Facts, **synonyms: str):
        self.facts, self.synonyms, self.clauses = facts, dict(synonyms), []
        for s, e in synonyms.items():
            if e not in ENTITIES:
                raise SemanticError(f"no entity {e} for {s}")

    def such_that(self, relation: str, left, right) -> Query:
        """A relation between synonyms, numbers, `name(...)`s and "_"."""
        if relation not in RELATIONS:
            raise SemanticError(f"no relation {relation}")
        self._add(("relation", relation, left, right))
        return self

    def pattern(self, synonym: str, variable="_", exact: str | None = None, part: str | None = None) -> Query:
        """An assignment's left side and (part of its) right side, or a variable in the condition of a while or if."""
        self._add(("pattern", synonym, variable, exact, part))
        return self

    def with_(self, left, right) -> Query:
        """Equal attributes, numbers and names: `"s.stmt#"`, `"n"` for a prog_line n, 5, name("x")."""
        self._add(("with", left, right))
        return self

    def _add(self, clause: tuple) -> None:
        if clause not in self.clauses:
            self.clauses.append(clause)

    # What clauses mean.

    def _entity(self, synonym: str) -> str:
        if synonym not in self.synonyms:
            raise SemanticError(f"{synonym} is not declared")
        return self.synonyms[synonym]

    def domain(self, synonym: str) -> DataFrame:
        """(program_id, synonym): everything that a synonym may stand for."""
        return entity(self.facts, self._entity(synonym)).withColumnRenamed("x", synonym)

    def _kinds(self, relation: str, left, right) -> str:
        """The function that computes a relation, if arguments of these kinds may stand in it."""
        f = RELATIONS[relation]
        kind_of = lambda x: self._entity(x) if isinstance(x, str) and x != "_" else None
        variables = relation in ("Uses", "Modifies")
        if variables:
            if left == "_":
                raise SemanticError("the first argument must tell statements from procedures")
            f += "_p" if isinstance(left, Name) or kind_of(left) == "procedure" else "_s"
        procedures = relation.startswith("Calls")
        if procedures and left == right and kind_of(left):
            raise SemanticError("a procedure never calls itself")
        wants = [("procedure",) if procedures or variables and f.endswith("_p") else ("stmt", "prog_line", *STATEMENTS)] * 2
        if variables:
            wants[1] = ("variable",)
        if relation.startswith("Affects"):
            wants = [("stmt", "prog_line", "assign")] * 2
        for x, want in zip((left, right), wants):
            if isinstance(x, int) and "stmt" not in want or isinstance(x, Name) and "stmt" in want or kind_of(x) and kind_of(x) not in want:
                raise SemanticError(f"{x} can't be an argument of {relation}")
        return f

    def _near(self, left, right) -> tuple[DataFrame, int] | None:
        """Pairs (program_id, l, r) of two synonyms that each stand in a relation to a third, the fewest of such a synonym, and how many they are at most."""
        sides: dict[str, list[dict[str, tuple]]] = {}
        for k, relation, *args in [c for c in self.clauses if c[0] == "relation" and c[1] in NEAR]:
            for mine, third in (args, args[::-1]):
                if mine in (left, right) and third not in (left, right, "_") and third in self.synonyms:
                    sides.setdefault(third, [{}, {}])[mine == right].setdefault(relation, (relation, *args))
        found = None
        for third, (a, b) in sides.items():
            if a and b:
                x, y = (self._relation(*next(iter(t.values()))) for t in (a, b))
                by = lambda t, n: t.groupBy("program_id", third).agg(F.count("*").cast("double").alias(n))  # noqa: E731, B023
                size = int(by(x, "n").join(by(y, "m"), ["program_id", third]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0)
                if found is None or size < found[1]:
                    found = x.join(y, ["program_id", third]).select("program_id", F.col(left).alias("l"), F.col(right).alias("r")), size
        return found

    def _relation(self, relation: str, left, right, known: DataFrame | None = None) -> DataFrame:
        """Bindings of a relation.  Where an argument is bound, by a literal or by the bindings `known` so far, relations that loops make are derived for these alone."""
        f = self._kinds(relation, left, right)
        kind_of = lambda x: self._entity(x) if isinstance(x, str) and x != "_" else None
        t = None
        if f in OWN and kind_of(left) in SIMPLE:
            # What holds and calls nothing has the variables of its own text.
            t = getattr(self.facts, OWN[f]).select("program_id", F.col("stmt_no").alias("l"), F.col("var").alias("r"))
        if f in demand.BOUND:
            literal = next(((c, x) for c, x in (("l", left), ("r", right)) if not isinstance(x, str)), None)
            joined = next(((c, x) for c, x in (("l", left), ("r", right)) if known is not None and x in known.columns), None)
            if literal:
                value = literal[1].text if isinstance(literal[1], Name) else int(literal[1])
                t = demand.bound(self.facts, f, self.programs().withColumn("node", F.lit(value).cast("string" if isinstance(value, str) else "long")), literal[0])
            elif joined:
                t = demand.bound(self.facts, f, known.select("program_id", F.col(joined[1]).alias("node")), joined[0])
        if t is None and f == "affects" and kind_of(left) and kind_of(right) and left != right and "affects" not in self.facts.memo:
            near = self._near(left, right)
            t = relations.affects(self.facts, near) if near else None
        if t is None and f == "next_t" and kind_of(left) and left == right:
            t = self.facts.relation("next_t_self")
        if t is None:
            t = self.facts.relation(f)
        for column, x in (("l", left), ("r", right)):
            if isinstance(x, int):
                t = t.where(F.col(column) == x)
            elif isinstance(x, Name):
                t = t.where(F.col(column) == x.text)
            elif x != "_" and kind_of(x) in STATEMENTS:
                t = t.join(entity(self.facts, kind_of(x)).withColumnRenamed("x", column), ["program_id", column], "left_semi")
        return self._bind(t, left, right)

    def _waits(self, relation: str, left, right) -> bool:
        """Whether a relation had better wait for the bindings of a synonym."""
        if relation in ("Uses", "Modifies"):
            return False
        return RELATIONS[relation] in demand.BOUND and isinstance(left, str) and isinstance(right, str) and left != right and (left != "_" or right != "_")

    def _checks(self) -> list[int]:
        """Clauses of starred relations whose synonyms other clauses bring together: they test rows, so their pairs are never made."""
        able = lambda c: c[0] == "relation" and RELATIONS[c[1]] in relations.TESTS and c[2] != c[3] and all(isinstance(x, str) and x != "_" for x in c[2:])
        groups: list[set[str]] = []

        def bring(synonyms: set[str]) -> None:
            nonlocal groups
            near = [g for g in groups if g & synonyms]
            groups = [g for g in groups if g not in near] + [synonyms.union(*near)]

        for kind, *args in self.clauses:
            if not able((kind, *args)):
                bring({x.partition(".")[0] for x in args[kind == "relation" :] if isinstance(x, str) and x.partition(".")[0] in self.synonyms})
        found = []
        for i, c in enumerate(self.clauses):
            if able(c):
                if any(set(c[2:]) <= g for g in groups):
                    found.append(i)
                else:
                    bring(set(c[2:]))
        return found

    def _chooses(self, clause: tuple) -> bool:
        """Whether a clause takes part of a domain: it has a literal, or compares attributes."""
        kind, *args = clause
        return kind == "with" or any(isinstance(x, (int, Name)) for x in args) or kind == "pattern" and (args[2] is not None or args[3] is not None)

    def _narrow(self, near: list[DataFrame], synonyms: tuple) -> DataFrame | None:
        """Bindings of the first synonym that the tables leave at most an eighth of its domain; None if there is none."""
        for s in synonyms:
            held = [t.select("program_id", s) for t in near if s in t.columns]
            if held:
                both = held[0].distinct()
                for t in held[1:]:
                    both = both.join(t, ["program_id", s], "left_semi")
                both = written(both, "bindings")
                if both.count() * 8 <= self.domain(s).count():
                    return both
        return None

    def _bind(self, t: DataFrame, left, right) -> DataFrame:
        """Columns l and r as bindings of what stands for them."""
        syn = lambda x: isinstance(x, str) and x != "_"
        if syn(left) and left == right:
            t = t.where("l = r").select("program_id", F.col("l").alias(left))
        else:
            t = t.select("program_id", *[F.col(c).alias(x) for c, x in (("l", left), ("r", right)) if syn(x)])
        return t.distinct()

    def _pattern(self, synonym: str, variable, exact: str | None, part: str | None) -> DataFrame:
        kind = self._entity(synonym)
        if isinstance(variable, str) and variable != "_" and self._entity(variable) != "variable":
            raise SemanticError(f"{variable} is no variable")
        if kind == "assign":
            t = self.facts.stmt.where("type = 'assign'").select("program_id", F.col("stmt_no").alias("l"), F.col("lhs_var").alias("r"), "expr_canon")
            for text, test in ((exact, lambda c: F.col("expr_canon") == c), (part, lambda c: F.col("expr_canon").contains(c))):
                if text is not None:
                    form = canonical(text)
                    if form is None:
                        raise SemanticError(f"{text!r} is no expression")
                    t = t.where(test(form))
        elif kind in ("while", "if"):
            if exact is not None or part is not None:
                raise SemanticError("conditions have no pattern but their variables")
            t = self.facts.cond_var.select("program_id", F.col("stmt_no").alias("l"), F.col("var").alias("r"))
            t = t.join(entity(self.facts, kind).withColumnRenamed("x", "l"), ["program_id", "l"], "left_semi")
        else:
            raise SemanticError(f"a {kind} has no pattern")
        if isinstance(variable, Name):
            t = t.where(F.col("r") == variable.text)
        return self._bind(t, synonym, variable)

    def _reference(self, x) -> tuple[str, str | None, DataFrame | None]:
        """Kind (number or name), synonym, and table (program_id, synonym, v) of one side of a with-clause."""
        if isinstance(x, int):
            return "number", None, None
        if isinstance(x, Name):
            return "name", None, None
        synonym, _, attribute = x.partition(".")
        kind = self._entity(synonym)
        if not attribute:
            if kind != "prog_line":
                raise SemanticError(f"{synonym} needs an attribute")
        elif attribute not in ATTRIBUTES or kind not in ATTRIBUTES[attribute]:
            raise SemanticError(f"a {kind} has no {attribute}")
        return "name" if attribute in ("procName", "varName") else "number", synonym, self.attribute(synonym, attribute, "v")

    def attribute(self, synonym: str, attribute: str, column: str) -> DataFrame:
        """(program_id, synonym, column): the attribute of everything in the synonym's domain, as text."""
        kind = self._entity(synonym)
        if kind in ("call", "read", "print") and attribute != "stmt#":
            of = "callee" if kind == "call" else "io_var"
            return self.facts.stmt.where(F.col("type") == kind).where(F.col(of).isNotNull()).select("program_id", F.col("stmt_no").alias(synonym), F.col(of).alias(column))
        return self.domain(synonym).withColumn(column, F.col(synonym).cast("string"))

    def _with(self, left, right) -> list[DataFrame]:
        """Bindings of the synonyms; of two, each with the value, which is a synonym named after the clause, so that pairs of equal values are made only where other clauses bring them together."""
        (kind, a, ta), (other, b, tb) = self._reference(left), self._reference(right)
        if kind != other:
            raise SemanticError(f"{left} and {right} can't be equal")
        text = lambda x: x.text if isinstance(x, Name) else str(x)
        if ta is None and tb is None:
            return [self.programs().where(F.lit(text(left) == text(right)))]
        if ta is None or tb is None:
            table, s, literal = (tb, b, left) if ta is None else (ta, a, right)
            return [table.where(F.col("v") == text(literal)).select("program_id", s).distinct()]
        if a == b:
            return [ta.join(tb.withColumnRenamed("v", "v2"), ["program_id", a]).where("v = v2").select("program_id", a).distinct()]
        met = lambda t, other: t.join(other.select("program_id", "v"), ["program_id", "v"], "left_semi").withColumnRenamed("v", f"{left}~{right}".replace(".", "~"))
        return [met(ta, tb), met(tb, ta)]

    def programs(self) -> DataFrame:
        return self.facts.proc.select("program_id").distinct()

    # Answers.

    def _bindings(self, wanted: set[str], part: DataFrame | None = None, shown: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:
        """All programs with a binding for every clause, and what `shown` makes of the bindings of the wanted synonyms, group by group; `part` (program_id, synonym) leaves some of a domain."""
        made: dict[int, list[DataFrame]] = {} if part is None else {-1: [part]}
        late, checks = [], self._checks()
        for i, (kind, *args) in enumerate(self.clauses):
            if i in checks:
                self._kinds(*args)
            elif kind == "relation" and self._waits(*args):
                late.append(i)
            else:
                t = getattr(self, f"_{kind}")(*args)
                made[i] = t if isinstance(t, list) else [t]
        # A relation that loops make takes the bindings of clauses that choose some: of those first that are bound already.
        while late:
            chosen = [t for i, ts in made.items() if i < 0 or self._chooses(self.clauses[i]) for t in ts]
            meets = lambda i: [t for t in chosen if set(self.clauses[i][2:]) & set(t.columns)]  # noqa: E731, B023
            i = next((i for i in late if meets(i)), late[0])
            late.remove(i)
            made[i] = [self._relation(*self.clauses[i][1:], known=self._narrow(meets(i), self.clauses[i][2:]))]
        # In the order of the clauses, which the joins keep where there is nothing to choose between them.
        tables = [t for i in sorted(made) for t in made[i]]
        tables += [self.domain(s) for s in sorted(wanted) if not any(s in t.columns for t in tables)]
        groups: list[list[DataFrame]] = []
        for t in tables:
            mine = set(t.columns) - {"program_id"}
            near = [g for g in groups if any(mine & set(x.columns) for x in g)]
            groups = [g for g in groups if g not in near] + [[t, *[x for g in near for x in g]]]
        kept, tests = [], []
        for g in groups:
            here = set().union(*[t.columns for t in g]) - {"program_id"}
            later = [self.clauses[i] for i in checks if self.clauses[i][2] in here]
            joined = joins.natural(g, (wanted & here).union(*[c[2:] for c in later]))
            for _, relation, left, right in later:
                joined = relations.tested(self.facts, RELATIONS[relation], joined, left, right)
            keep = [c for c in joined.columns if c in wanted]
            joined = joined.select("program_id", *keep).distinct()
            if keep:
                kept.append(shown(joined))
            else:
                tests.append(joined)
        # With one group that is selected from there is nothing to join it with; of the others only a row for each program counts.
        out = kept[0] if kept else self.programs()
        for t in kept[1:]:
            out = joins.product(out, t)
        for t in tests:
            out = out.join(t, "program_id", "left_semi")
        return out

    def select(self, *elements: str) -> DataFrame:
        """program_id and a column for each element, a synonym or `synonym.attribute`; distinct. Elements may repeat."""
        split = [e.partition(".")[::2] for e in elements]
        for e, (s, a) in zip(elements, split):
            if a and (a not in ATTRIBUTES or self._entity(s) not in ATTRIBUTES[a]):
                raise SemanticError(f"{e} does not exist")
            self._entity(s)
        labels = self.labels(elements)

        def shown(t: DataFrame) -> DataFrame:
            """Elements of a group, distinct before it meets others: products of distinct rows are distinct."""
            columns = []
            for label, (s, a) in zip(labels, split):
                column = s
                if s in t.columns and a in ("procName", "varName") and self._entity(s) in ("call", "read", "print"):
                    column = f"{s}__{a}"
                    if column not in t.columns:
                        t = t.join(self.attribute(s, a, column), ["program_id", s])
                if s in t.columns:
                    columns.append(F.col(column).alias(label))
            return t.select("program_id", *columns).distinct()

        return self._bindings({s for s, _ in split}, shown=shown).select("program_id", *labels)

    def boolean(self) -> DataFrame:
        """(program_id, holds) for every program."""
        true = self._witnessed().select("program_id").distinct().withColumn("found", F.lit(True))
        return self.programs().join(true, "program_id", "left").select("program_id", F.coalesce("found", F.lit(False)).alias("holds"))

    def _witnessed(self) -> DataFrame:
        """Programs with a binding for every clause.

        Where a relation that loops make is in the way, with no literal that
        seeds it, a synonym of it is bound to a growing part of its domain,
        by procedures, so that the relation is derived for that part alone;
        programs in which a part has a witness are done.
        """
        waiting = [c for c in self.clauses if c[0] == "relation" and self._waits(*c[1:])]
        pivots = [x for c in waiting for x in c[2:] if x in self.synonyms]
        if not pivots or any(self._chooses(c) for c in self.clauses):
            return self._bindings(set())
        pivot = pivots[0]
        kind = self._entity(pivot)
        if kind == "procedure":
            domain = self.domain(pivot).withColumn("within", F.col(pivot))
        else:
            domain = self.facts.stmt.where(F.lit(kind not in STATEMENTS) | (F.col("type") == kind)).select("program_id", F.col("stmt_no").alias(pivot), F.col("proc").alias("within"))
        dealt = domain.withColumn("part", F.pmod(F.xxhash64("program_id", "within"), F.lit(SLICES[-1])))
        undecided, found, begin = self.programs(), None, 0
        for end in SLICES:
            some = dealt.where((F.col("part") >= begin) & (F.col("part") < end)).join(undecided, "program_id", "left_semi").select("program_id", pivot)
            true = written(self._bindings(set(), written(some, "slice")).select("program_id").distinct(), "witnesses")
            found, begin = true if found is None else found.unionByName(true), end
            undecided = written(undecided.join(true, "program_id", "left_anti"), "undecided")
            if undecided.isEmpty():
                break
        return found

    def answer(self, clauses: Callable[[Query], Query], *elements: str) -> DataFrame:
        """The answer with further clauses, which may mean nothing: as text, without program_id; without elements `holds`.

        A semantic error, in them or here, gives no row, or one that is FALSE.
        """
        spark = self.facts.stmt.sparkSession
        try:
            q = clauses(self)
            rows = q.select(*elements) if elements else q.boolean()
            return rows.select(*[F.col(c).cast("string") if elements else F.col(c) for c in rows.columns[1:]])
        except SemanticError:
            if not elements:
                return spark.range(1).select(F.lit(False).alias("holds"))
            labels = self.labels(elements)
            return spark.range(0).select(*[F.lit("").alias(x) for x in labels])

    @staticmethod
    def labels(elements: tuple[str, ...]) -> list[str]:
        """Column names of a result: `a.procName` becomes a_procName, and repeated elements are numbered."""
        seen, out = {}, []
        for e in elements:
            seen[e] = seen.get(e, 0) + 1
            out.append(e.replace(".", "_").replace("#", "_no") + (f"_{seen[e]}" if seen[e] > 1 else ""))
        return out

    def answers(self, *elements: str) -> list[str]:
        """Answers of a small result as text, tuples joined by blanks; without elements TRUE or FALSE. Semantic errors give none, or FALSE."""
        try:
            if not elements:
                return ["TRUE" if self.boolean().where("holds").limit(1).count() else "FALSE"]
            rows = self.select(*elements)
            line = F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns[1:]])
            return sorted({r[0] for r in rows.select(line).distinct().collect()})
        except SemanticError:
            return [] if elements else ["FALSE"]


def entity(facts: Facts, kind: str) -> DataFrame:
    """(program_id, x): all things of a kind."""
    if kind in ("stmt", "prog_line"):
        return facts.stmt.select("program_id", F.col("stmt_no").alias("x"))
    if kind in STATEMENTS:
        return facts.stmt.where(F.col("type") == kind).select("program_id", F.col("stmt_no").alias("x"))
    table, column = {"variable": (facts.var, "var"), "constant": (facts.const, "value"), "procedure": (facts.proc, "proc")}[kind]
    return table.select("program_id", F.col(column).alias("x"))
