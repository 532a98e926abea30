"""Canonical form of arithmetic expressions: every node, leaves included, in parentheses.

Two expressions are equal if their forms are equal, and one is a subtree of
another if its form is contained in the other's.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

TOKEN = re.compile(r"[A-Za-z][A-Za-z0-9]*|[0-9]+|[-+*/%()]")
RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2}


def canonical(text: str | None) -> str | None:
    """`a + b*c` becomes `((a)+((b)*(c)))`; None if the text is no expression."""
    if text is None or TOKEN.sub("", text).strip():
        return None
    out: list[str] = []
    ops: list[str] = []

    def reduce() -> None:
        right, left = out.pop(), out.pop()
        out.append(f"({left}{ops.pop()}{right})")

    operand = True  # whether an operand is due
    try:
        for t in TOKEN.findall(text):
            if t == "(":
                if not operand:
                    return None
                ops.append(t)
            elif t == ")":
                if operand:
                    return None
                while ops[-1] != "(":
                    reduce()
                ops.pop()
            elif t in RANK:
                if operand:
                    return None
                while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[t]:
                    reduce()
                ops.append(t)
                operand = True
            else:
                if not operand or t[0].isdigit() and len(t) > 1 and t[0] == "0":
                    return None
                out.append(f"({t})")
                operand = False
        while ops:
            reduce()
    except IndexError:
        return None
    return out[0] if len(out) == 1 and not operand and "((" not in ops else None


@F.pandas_udf(StringType())
def canonical_column(text: pd.Series) -> pd.Series:
    return text.map(canonical, na_action="ignore")


RELATIONS = ("<", "<=", ">", ">=", "==", "!=")


def is_condition(text: str) -> bool:
    """Whether tokens, set apart by blanks, make a condition: a comparison, `! ( c )`, or `( c ) && ( c )` or the same with `||`."""
    todo = [text.split(" ")]
    while todo:
        tokens = todo.pop()
        depth, ends, links, comparisons = 0, [], [], []
        for i, t in enumerate(tokens):
            depth += (t == "(") - (t == ")")
            if depth < 0:
                return False
            if depth == 0:
                if t == ")":
                    ends.append(i)
                elif t in ("&&", "||"):
                    links.append(i)
                elif t in RELATIONS:
                    comparisons.append(i)
        last = len(tokens) - 1
        if depth:
            return False
        if tokens[0] == "!":
            if tokens[1:2] != ["("] or ends != [last]:
                return False
            todo.append(tokens[2:last])
        elif links:
            (k, *more), sides = links, [tokens[: links[0]], tokens[links[0] + 1 :]]
            if more or ends != [k - 1, last] or any(side[:1] != ["("] for side in sides):
                return False
            todo += [side[1:-1] for side in sides]
        elif len(comparisons) != 1 or any(canonical(" ".join(side)) is None for side in (tokens[: comparisons[0]], tokens[comparisons[0] + 1 :])):
            return False
    return True


@F.pandas_udf(BooleanType())
def is_condition_column(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t is not None and is_condition(t)).astype(bool)
