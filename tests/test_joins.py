"""Natural joins, products and first witnesses, against brute force and by the rows they make."""

from __future__ import annotations

import itertools
import random

import pytest
from codeloom.functions import tables
from codeloom.operators import closure, flow, joins
from codeloom.plans.query import Query
from codeloom.sources.programs import from_programs
from pyspark.sql import functions as F
from small_programs import ALPHA


def brute(made: list[tuple[tuple, set]], wanted: list[str]) -> set:
    """Rows (program, wanted...) of all ways to choose a row of each table that agree; null agrees with nothing."""
    rows = [{}]
    for names, values in made:
        out = []
        for r in rows:
            for p, *v in values:
                new = dict(zip(("program_id", *names), (p, *v)))
                if all(k not in r or (r[k] is not None and r[k] == x) for k, x in new.items()):
                    out.append(r | new)
        rows = out
    return {tuple(r[c] for c in ("program_id", *wanted)) for r in rows}


SHAPES = ["ab", "ab bc", "ab bc ca", "ab bc cd da", "ab bc ca cd de", "ab ab b", "ab bc cd ac bd ad", "ab ac ad a", "ab bc ca cd de ec e", "a ab b bc"]


@pytest.mark.parametrize("few", [0, 8])
def test_shapes_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW", few)
    rng = random.Random(17 + few)
    for shape in SHAPES if few == 0 else ["ab bc ca cd de"]:
        made = []
        for names in shape.split():
            values = [("pq"[rng.randrange(2)], *[None if rng.random() < 0.1 else rng.randrange(4) for _ in names]) for _ in range(rng.choice([6, 14]))]
            made.append((tuple(names), values))
        frames = [spark.createDataFrame(v, "program_id string, " + ", ".join(f"{n} long" for n in names)) for names, v in made]
        every = sorted(set(shape) - {" "})
        for wanted in ([], every[-1:], every) if " " in shape else (every[:1],):
            got = [tuple(r) for r in joins.natural(frames, set(wanted)).select("program_id", *wanted).collect()]
            assert len(got) == len(set(got)) and set(got) == brute(made, wanted), (shape, wanted)


def test_empty_tables(spark):
    t = lambda names, rows: spark.createDataFrame(rows, "program_id string, " + ", ".join(f"{n} long" for n in names))
    full = [t(n, [("p", 1, 1)]) for n in ("ab", "bc", "ca")]
    assert joins.natural(full, {"a"}).count() == 1
    for i in range(3):
        some = [t(x.columns[1:], []) if k == i else x for k, x in enumerate(full)]
        assert joins.natural(some, {"a"}).count() == 0
    with pytest.raises(ValueError):
        joins.natural([t("abc", [("p", 1, 1, 1)]), t("cd", [("p", 1, 1)])], {"a"})


def test_hubs_make_no_quadratic_rows(spark, monkeypatch):
    """Three tables, each a hub that everything has an edge to and from: two of them alone join to n * n rows."""
    n = 400
    edges = spark.range(1, n).selectExpr("'p' AS program_id", "id AS x", "0L AS y").unionAll(spark.range(1, n).selectExpr("'p'", "0L", "id"))
    edges = edges.unionAll(spark.createDataFrame([("p", 0, 0)], "program_id string, x long, y long"))
    frames = [edges.toDF("program_id", *names) for names in ("ab", "bc", "ca")]
    assert frames[0].join(frames[1], ["program_id", "b"]).count() > n * n
    made = []
    real = joins._met

    def counted(t, other):
        made.append(t.count())
        return real(t, other)

    monkeypatch.setattr(joins, "_met", counted)
    # (0, 0, x) and its turns, and (0, 0, 0).
    assert joins.natural(frames, {"a", "b", "c"}).count() == 3 * (n - 1) + 1
    assert sum(made) < 8 * n


def test_what_is_not_asked_for_only_meets_semi_joins(spark, monkeypatch):
    n = 400
    left = spark.range(n).selectExpr("'p' AS program_id", "id AS r", "0L AS v")
    right = spark.range(n).selectExpr("'p' AS program_id", "id AS p", "0L AS v")
    held = spark.range(n).selectExpr("'p' AS program_id", "id AS p", "id % 7 AS w")
    out = joins.natural([left, right, held], {"r"})
    assert out.count() == n
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "Inner" not in plan


@pytest.mark.parametrize("rows", [0, 100_000])
def test_product(spark, monkeypatch, rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(joins, "PART", 7)
    a = [("pq"[i % 2], i, None if i == 3 else f"x{i}") for i in range(50)]
    b = [("pr"[i % 2], i) for i in range(20)]
    got = joins.product(spark.createDataFrame(a, "program_id string, a long, n string"), spark.createDataFrame(b, "program_id string, b long"))
    want = sorted((p, i, n, j) for (p, i, n), (q, j) in itertools.product(a, b) if p == q)
    assert sorted(tuple(r) for r in got.select("program_id", "a", "n", "b").collect()) == want
    none = spark.createDataFrame([], "program_id string, b long")
    assert joins.product(spark.createDataFrame(a, "program_id string, a long, n string"), none).count() == 0


def test_first_witness(spark, monkeypatch):
    """The first slice of a program of like procedures has a witness; a program without any is searched whole."""
    same = "".join(f"procedure p{i} {{ x = y; while (x > 1) {{ y = x + z; z = y; }} x = z; }}\n" for i in range(80))
    lacks = "".join(f"procedure p{i} {{ x = y; y = 1; }}\n" for i in range(80))
    rows = []

    def counted(df, name):
        out = tables.written(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(closure, "written", counted)
    ask = lambda f: Query(f, a="assign", b="assign").such_that("Affects*", "a", "b").such_that("Follows", "a", "b")
    edges = lambda: [n for name, n in rows if name == "edges"]
    f = from_programs(spark.createDataFrame([("same", same)], "program_id string, source string"))
    assert [tuple(r) for r in ask(f).boolean().collect()] == [("same", True)]
    first = edges()
    rows.clear()
    f = from_programs(spark.createDataFrame([("same", same), ("lacks", lacks)], "program_id string, source string"))
    assert {tuple(r) for r in ask(f).boolean().collect()} == {("same", True), ("lacks", False)}
    assert ask(f).select("a").select("program_id").distinct().collect() == [("same",)]
    assert sum(first) * 4 < f.relation("affects").where(F.col("program_id") == "same").count()


def test_equal_attributes_make_no_pairs_of_equal_values(spark, monkeypatch):
    """Prints that follow reads of the same variable: all of n reads and n prints have one variable, and only neighbours are asked for."""
    n = 60
    f = from_programs(spark.createDataFrame([("one", f"procedure a {{ {'read x; print x; ' * n} }}")], "program_id string, source string"))
    rows = []

    def counted(df, name):
        out = tables.written(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(joins, "written", counted)
    q = Query(f, r="read", p="print", v="variable").such_that("Follows", "r", "p").with_("r.varName", "p.varName")
    out = q.select("r", "p", "r.varName", "v")
    assert sorted(tuple(r) for r in out.collect()) == [("one", 2 * i + 1, 2 * i + 2, "x", "x") for i in range(n)]
    assert rows and max(rows) == n
    assert not [1 for i in range(2) if [r for r in q._with("r.varName", "p.varName")][i].count() != n]
    bound = Query(f, r="read", p="print").with_("r.varName", "p.varName").select("r", "p")
    assert bound.count() == n * n


def test_products_of_attributes_are_not_made_distinct_afterwards(spark, monkeypatch):
    """Groups are distinct in what is selected of them, so the product that many rows come from is the last step, in parts."""
    monkeypatch.setattr(joins, "MADE", 8)
    source = f"procedure a {{ {'read x; read y; ' * 6} }}"
    f = from_programs(spark.createDataFrame([("one", source)], "program_id string, source string"))
    out = Query(f, r="read", s="stmt").such_that("Follows", "_", "s").select("r.varName", "s")
    assert sorted(tuple(r) for r in out.collect()) == sorted(("one", v, i) for v in "xy" for i in range(2, 13))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") if "Aggregate" in plan else True
    assert "RepartitionByExpression" in plan


def test_affects_among_near_statements(spark, monkeypatch):
    """Loops of many branches: each sets and uses one variable, so Affects has all pairs of them, and only those in one `if` are asked for."""
    n = 8
    source = "procedure a { while (z > 0) { " + "".join(f"if (z > {i}) then {{ x = y; y = x; }} else {{ w = x; }} " for i in range(n)) + "} }"
    f = lambda: from_programs(spark.createDataFrame([("one", source)], "program_id string, source string"))
    made = []

    def counted(df, name):
        out = tables.written(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(flow, "written", counted)
    ask = lambda f: Query(f, a="assign", b="assign", i="if").such_that("Affects", "a", "b").such_that("Parent", "i", "a").such_that("Parent*", "i", "b").select("a", "b")
    got = sorted(tuple(r) for r in ask(f()).collect())
    every = f().relation("affects")
    inside = lambda c: (F.col(c) - 2) / 4
    want = sorted(tuple(r) for r in every.where(F.floor(inside("l")) == F.floor(inside("r"))).collect())
    assert got == want and len(want) < every.count() / 4
    assert [c for name, c in made if name == "asked-for"] == [9 * n]


def test_next_t_of_a_synonym_with_itself_makes_no_pairs(spark):
    """The rows are those of the whole relation with l = r, which is not planned for them."""
    empty = "procedure a { while (x > 1) { } y = 1; while (y > 1) { if (x > 1) then { while (z > 1) { z = 1; } } else { x = 2; } } z = 3; }"
    f = from_programs(spark.createDataFrame([("p", empty), ("q", ALPHA)], "program_id string, source string"))
    found = Query(f, n="prog_line").such_that("Next*", "n", "n").select("n")
    loops = Query(f, w="while").such_that("Next*", "w", "w").select("w")
    assert "next_t" not in f.memo
    whole = {(r.program_id, r.l) for r in f.relation("next_t").where("l = r").collect()}
    assert {(r.program_id, r.n) for r in found.collect()} == whole == {("p", n) for n in (3, 4, 5, 6, 7)} | {("q", n) for n in (2, 3, 4, 5, 6, 7)}
    assert {(r.program_id, r.w) for r in loops.collect()} == {("p", 3), ("p", 5), ("q", 2)}
