"""What is kept as sets of numbers: closures and what is made of them, with few rows and each pair once."""

from __future__ import annotations

import random

from codeloom.functions import tables
from codeloom.operators import across, closure, relations, sets
from codeloom.operators.closure import closure_acyclic
from codeloom.sources.programs import from_programs
from small_programs import ALPHA
from test_programs import make_program


def test_a_closure_writes_sets_instead_of_pairs(spark, monkeypatch):
    """A chain of 200 names has 19,900 pairs, which were written round by round."""
    written = []

    def counted(df, name):
        out = tables.written(df, name)
        written.append(out.count())
        return out

    for module in (sets, closure):
        monkeypatch.setattr(module, "written", counted)
    edges = spark.createDataFrame([("a", f"u{i}", f"u{i + 1}") for i in range(199)] + [("b", "u7", "u3")], "program_id string, l string, r string")
    got = [tuple(r) for r in closure_acyclic(edges).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {("a", f"u{i}", f"u{j}") for i in range(200) for j in range(i + 1, 200)} | {("b", "u7", "u3")}
    assert sum(written) < 19_900 / 2


def test_values_across_calls_make_no_pairs_of_starts(spark, monkeypatch):
    """A value that 150 procedures hand down and use: 11,175 pairs of starts were written."""
    last = 149
    source = "procedure p0 { c = d; e = c; call p1; }" + "".join(f"procedure p{i} {{ e = c; {f'call p{i + 1};' if i < last else ''} }}" for i in range(1, last + 1))
    f = from_programs(spark.createDataFrame([("a", source)], "program_id string, source string"))
    steps = across.steps(f)
    written = []

    def counted(df, name):
        out = tables.written(df, name)
        written.append(out.count())
        return out

    for module in (across, sets, closure):
        monkeypatch.setattr(module, "written", counted)
    users = f.stmt.where("type = 'assign' and stmt_no > 1").select("stmt_no").collect()
    assert sorted((r["l"], r["r"]) for r in across.between_assignments(f, steps).collect()) == sorted((1, r[0]) for r in users)
    assert sum(written) < 11_175 * 0.7


def test_pairs_of_affects_come_once_by_themselves(spark):
    """Pairs that met in several loops were shuffled to be made distinct; lists of loops and branches, four deep, give each once."""
    rng = random.Random(17)
    f = from_programs(spark.createDataFrame([(str(i), make_program(rng)[0]) for i in range(12)] + [("alpha", ALPHA)], "program_id string, source string"))
    found = f.relation("affects")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) > 50


def test_next_across_calls_writes_blocks_instead_of_pairs(spark, monkeypatch):
    """Ten procedures of 21 statements and a call each: 2,205 pairs inside procedures were written, and those behind calls."""
    body = " ".join(f"x = x + {i};" for i in range(20))
    source = "".join(f"procedure p{i} {{ {f'call p{i + 1};' if i < 9 else 'y = x;'} {body} }}" for i in range(10))
    f = from_programs(spark.createDataFrame([("a", source)], "program_id string, source string"))
    f.relation("labels"), f.relation("full_calls")
    written = []

    def counted(df, name):
        out = tables.written(df, name)
        written.append(out.count())
        return out

    for module in (relations, sets, closure):
        monkeypatch.setattr(module, "written", counted)
    got = [tuple(r) for r in f.relation("next_bip_t").collect()]
    # From one of p(i): to what comes later in it, from its call to all of the procedures below, and behind calls to the last twenty of each above.
    want = {("a", 21 * i + k, 21 * i + m) for i in range(10) for k in range(1, 22) for m in range(k + 1, 22)}
    want |= {("a", 21 * i + 1, 21 * j + m) for i in range(10) for j in range(i + 1, 10) for m in range(1, 22)}
    want |= {("a", 21 * i + k, 21 * j + m) for i in range(10) for j in range(i) for k in range(1, 22) for m in range(2, 22)}
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(written) < 2_205
