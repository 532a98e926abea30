"""The fact tables that relations and queries read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import runs
from codeloom.functions.tables import written

#: Columns of `stmt`.  Within a procedure `ord` numbers statements in pre-order and `last_ord` is that of the last descendant.
STMT = "program_id string, stmt_no long, type string, proc string, block_id string, pos long, ord long, last_ord long, parent_no long, branch string, depth int, lhs_var string, io_var string, callee string, expr_canon string"


@dataclass
class Facts:
    """Base tables of a corpus of programs.

    stmt      see STMT
    use_direct, mod_direct, cond_var   (program_id, stmt_no, var)
    const     (program_id, value)
    proc      (program_id, proc)
    """

    stmt: DataFrame
    use_direct: DataFrame
    mod_direct: DataFrame
    cond_var: DataFrame
    const: DataFrame
    proc: DataFrame
    #: Procedures (program_id, proc) whose values Affects follows; None: all.
    focus: DataFrame | None = None
    memo: dict[str, DataFrame] = field(default_factory=dict)
    stored: dict[str, DataFrame] = field(default_factory=dict)
    #: Last position in any list, once it is known.
    longest: int | None = None

    def relation(self, name: str) -> DataFrame:
        """A relation of `codeloom.operators.relations` by name, planned once."""
        from codeloom.operators import relations

        if name not in self.memo:
            self.memo[name] = getattr(relations, name)(self)
        return self.memo[name]

    def table(self, name: str) -> DataFrame:
        """A relation that others build on, written once."""
        if name not in self.stored:
            self.stored[name] = self.memo[name] = written(self.relation(name), name)
        return self.stored[name]

    @property
    def piece(self) -> Column | None:
        """Which part of its list a statement is in, if some procedure is longer than a part; else None, and a task may take a list whole."""
        if self.longest is None:
            self.longest = self.stmt.agg(F.max("pos")).first()[0] or 0
        return F.floor(F.col("pos") / runs.CELL) if self.longest >= runs.CELL else None

    def within(self, procs: DataFrame, focus: DataFrame | None = None) -> Facts:
        """The facts of some procedures (program_id, proc) alone."""
        stmt = written(self.stmt.join(procs, ["program_id", "proc"], "left_semi").select(self.stmt.columns), "within")
        of = lambda df: df.join(stmt.select("program_id", "stmt_no"), ["program_id", "stmt_no"], "left_semi")
        return Facts(stmt, of(self.use_direct), of(self.mod_direct), of(self.cond_var), self.const, procs, focus)

    def focused(self, stmt: DataFrame) -> DataFrame:
        """Statements of the procedures in focus."""
        return stmt if self.focus is None else stmt.join(self.focus, ["program_id", "proc"], "left_semi")

    @property
    def var(self) -> DataFrame:
        each = [self.use_direct, self.mod_direct, self.cond_var]
        return each[0].select("program_id", "var").unionByName(each[1].select("program_id", "var")).unionByName(each[2].select("program_id", "var")).distinct()

    @property
    def call_edge(self) -> DataFrame:
        return self.stmt.where("type = 'call' and callee is not null").select("program_id", "stmt_no", F.col("proc").alias("caller"), "callee")

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame]) -> Facts:
        return cls(**{k: tables[k] for k in ("stmt", "use_direct", "mod_direct", "cond_var", "const", "proc")})
