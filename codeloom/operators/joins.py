"""Natural joins of many tables of bindings, with middle results bounded by what goes in and what comes out.

A table is an edge between the one or two synonyms that it binds.  Edges that
hang on the rest by one synonym are taken off first, each after a semi-join
has left in the rest only what it meets; so a group without cycles ends as one
table, every row of which is part of an answer, and what is selected from the
edges taken off is joined to it again, outwards.  Synonyms that nobody asks
for never meet anything but a semi-join.

What is left has cycles.  There a join of two tables may be quadratic where
the third leaves little, so rows take on one synonym at a time: all tables
that bind it to synonyms of the row count what they would add, the one that
adds least for this row does, and the others test it.  For a triangle that
keeps the rows within the bound for its size, n to the power 1.5.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.tables import written

KEY = "program_id"
#: A table that adds at most so many rows to any row needs no comparison with others.
FEW = 8
#: Rows and bytes of a table that a product broadcasts, and rows of a part of the other side beyond that.
BROADCAST_ROWS, BROADCAST_BYTES, PART = 100_000, 16 << 20, 1_000_000
#: Rows that one task makes of a product with a broadcast side.
MADE = 10_000_000


def _synonyms(t: DataFrame) -> frozenset[str]:
    return frozenset(t.columns) - {KEY}


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [KEY, *sorted(_synonyms(a) & _synonyms(b))]


def _met(t: DataFrame, other: DataFrame) -> DataFrame:
    return t.join(other, _shared(t, other), "left_semi")


def _only(t: DataFrame, synonyms: set[str]) -> DataFrame:
    keep = [c for c in t.columns if c == KEY or c in synonyms]
    return t if len(keep) == len(t.columns) else t.select(*keep).distinct()


def natural(tables: list[DataFrame], wanted: set[str]) -> DataFrame:
    """program_id and the wanted synonyms of the natural join of tables (program_id, one or two synonyms each) that hang together; distinct.

    Rows with a null in a shared synonym meet nothing.  Repeated rows count once.
    """
    edges: dict[frozenset[str], DataFrame] = {}
    for t in tables:
        c = _synonyms(t)
        if len(tables) > 1 and not 1 <= len(c) <= 2:
            raise ValueError(f"one or two synonyms a table, not {sorted(c)}")
        edges[c] = _met(edges[c], t) if c in edges else t
    hung: list[DataFrame] = []
    needed = set(wanted)
    while len(edges) > 1:
        single = next((c for c in edges if len(c) == 1), None)
        if single:
            t = edges.pop(single)
            near = next(c for c in edges if single <= c)
            edges[near] = _met(edges[near], t)
            continue
        ends = [s for s in sorted(frozenset().union(*edges)) if sum(s in c for c in edges) == 1]
        if not ends:
            break
        end = min(ends, key=lambda s: s in needed)
        c = next(c for c in edges if end in c)
        t = edges.pop(c)
        if end in needed:
            t = written(t, "hung")
            hung.append(t)
            needed |= c
        edges[c - {end}] = _only(t, c - {end})
    out = _only(next(iter(edges.values())) if len(edges) == 1 else _around(edges, needed), needed)
    while hung:
        t = hung.pop()
        out = _only(out.join(t, _shared(out, t)), wanted.union(*[_synonyms(h) for h in hung]))
    return _only(out, wanted).distinct()


def _around(edges: dict[frozenset[str], DataFrame], needed: set[str]) -> DataFrame:
    """The join of edges in cycles, the needed synonyms of it."""
    edges = {c: written(t, "edges") for c, t in edges.items()}
    sizes = {c: t.count() for c, t in edges.items()}
    rows = edges.pop(min(edges, key=sizes.get))
    while edges:
        bound = _synonyms(rows)
        ways: dict[str, list[frozenset[str]]] = {}
        for c in edges:
            if len(c & bound) == 1:
                ways.setdefault(next(iter(c - bound)), []).append(c)
        new = max(sorted(ways), key=lambda s: len(ways[s]))
        rows = _extended(rows, [edges.pop(c) for c in ways[new]])
        rows = _only(rows, needed.union(*edges))
    return rows


def _extended(rows: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Rows with one synonym more, which every table binds to one that the rows have."""
    if len(tables) == 1:
        return rows.join(tables[0], _shared(rows, tables[0]))
    degrees = []
    for i, t in enumerate(tables):
        degrees.append(t.groupBy(*_shared(rows, t)).agg(F.count("*").alias(f"_adds{i}")))
        if (degrees[i].agg(F.max(f"_adds{i}")).first()[0] or 0) <= FEW:
            parts = {i: rows}
            break
    else:
        counts = [d.columns[-1] for d in degrees]
        for d in degrees:
            rows = rows.join(d, _shared(rows, d))
        way = F.array_position(F.array(*counts), F.least(*counts)) - 1
        rows = written(rows.withColumn("_way", way).drop(*counts), "ways")
        parts = {i: rows.where(F.col("_way") == i).drop("_way") for i in range(len(tables))}
    out = None
    for i, part in parts.items():
        part = part.join(tables[i], _shared(part, tables[i]))
        for other in tables[:i] + tables[i + 1 :]:
            part = _met(part, other)
        out = part if out is None else out.unionByName(part)
    return out


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both for each program.  A side whose measured size is small is broadcast; else the larger one is dealt into parts, and each has the smaller one."""
    sides = [written(t, "side") for t in (left, right)]
    measured = [t.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in t.columns]))), F.lit(0))).first() for t in sides]
    k = 0 if measured[0][0] <= measured[1][0] else 1
    small, large = sides[k], sides[1 - k]
    if measured[k][0] <= BROADCAST_ROWS and measured[k][1] <= BROADCAST_BYTES:
        tasks = math.ceil(measured[0][0] * measured[1][0] / MADE)
        return (large.repartition(tasks, *large.columns) if tasks > 1 else large).join(F.broadcast(small), KEY)
    parts = math.ceil(measured[1 - k][0] / PART)
    dealt = large.withColumn("_part", F.pmod(F.xxhash64(*large.columns), F.lit(parts)))
    repeated = small.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.join(repeated, [KEY, "_part"]).drop("_part")
