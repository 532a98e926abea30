"""An index of subtrees: many expression patterns met by one join.

Every subtree of every right side has a hash made of the hashes of its parts,
so an expression costs its own length and not the sum of its subtrees'.
Patterns are hashed alike and meet the index by equality; a comparison of the
texts then tells clashes of hashes apart.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from codeloom.functions.expressions import canonical_column
from codeloom.plans.facts import Facts


def subtree_hashes(form: str) -> list[int]:
    """Hashes of all subtrees of a canonical expression, the whole one last; equal ones once."""
    open_parts: list[list[bytes]] = [[]]
    found: dict[int, None] = {}
    word = ""
    for c in form:
        if c in "()":
            if word:
                open_parts[-1].append(word.encode())
                word = ""
            if c == "(":
                open_parts.append([])
            else:
                digest = hashlib.blake2b(b"\x00".join(open_parts.pop()), digest_size=8).digest()
                found.pop(key := int.from_bytes(digest, "little", signed=True), None)
                found[key] = None
                open_parts[-1].append(digest)
        else:
            word += c
    return list(found)


@F.pandas_udf(ArrayType(LongType()))
def _hashes(forms: pd.Series) -> pd.Series:
    return forms.map(subtree_hashes, na_action="ignore")


def index(f: Facts) -> DataFrame:
    """(program_id, stmt_no, lhs_var, expr_canon, hash, whole): a row for each subtree of an assignment's right side."""
    rows = f.stmt.where("type = 'assign' and expr_canon is not null").select("program_id", "stmt_no", "lhs_var", "expr_canon", _hashes("expr_canon").alias("hashes"))
    each = rows.select("program_id", "stmt_no", "lhs_var", "expr_canon", F.posexplode("hashes").alias("i", "hash"), F.size("hashes").alias("n"))
    return each.select("program_id", "stmt_no", "lhs_var", "expr_canon", "hash", (F.col("i") == F.col("n") - 1).alias("whole"))


def matches(subtrees: DataFrame, patterns: DataFrame, exact: bool = False) -> DataFrame:
    """(pattern, program_id, stmt_no, lhs_var): assignments whose right side has, or with `exact` is, an expression.

    `patterns` has a column `pattern` of texts; those that are no expression,
    and null ones, match nothing.  Repeated patterns count once.
    """
    p = patterns.select("pattern").distinct().withColumn("form", canonical_column("pattern")).where("form is not null")
    p = p.withColumn("hash", F.element_at(_hashes("form"), -1))
    met = subtrees.where("whole").join(p, "hash").where("expr_canon = form") if exact else subtrees.join(p, "hash").where(F.contains("expr_canon", "form"))
    return met.select("pattern", "program_id", "stmt_no", "lhs_var")
