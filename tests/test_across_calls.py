"""Relations across calls and the flow of values, against brute force over call chains of small random programs."""

from __future__ import annotations

import random

import duckdb
import pytest
from codeloom.functions.tables import written
from codeloom.operators import across, closure, demand
from codeloom.plans import registry
from codeloom.sources.programs import from_programs
from small_programs import _LITERAL, ALPHA
from test_programs import make_program


def rows(f, relation):
    return {(r["program_id"], r["l"], r["r"]) for r in f.relation(relation).collect()}


def facts(spark, sources):
    return from_programs(spark.createDataFrame([(str(i), s) for i, s in enumerate(sources)], "program_id string, source string"))


def expanded(edges, info):
    """Edges between nodes (call chain, statement), by cloning each procedure for each chain of calls."""
    first, after = {}, {}
    for n in sorted(info):
        first.setdefault(info[n][0], n)
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    called = {i[4] for i in info.values() if i[4] is not None}
    todo = [((), p) for p in first if p not in called]
    out = {}

    def goes(chain, n):
        """Where control is after statement n, whose own steps are done."""
        found = {(chain, m) for m in after.get(n, ())}
        ends = n in leaves and chain
        return found | (goes(chain[:-1], chain[-1]) if ends else set())

    leaves = {n for n in info if not after.get(n) or (info[n][1] == "while" and all(inside(info, edges, n, m) for m in after[n]))}
    while todo:
        chain, proc = todo.pop()
        for n, i in info.items():
            if i[0] != proc:
                continue
            if i[4] is not None:
                out[chain, n] = {(chain + (n,), first[i[4]])}
                todo.append((chain + (n,), i[4]))
            else:
                out[chain, n] = goes(chain, n)
    return out


def inside(info, edges, loop, m):
    """Whether m is the first statement of the loop's body: numbers are given in order of the text, so that is the next one, and it leads back."""
    if m != loop + 1:
        return False
    seen, todo = {m}, [m]
    while todo:
        for a, b in edges:
            if a == todo[-1] and b == loop:
                return True
        n = todo.pop()
        for a, b in edges:
            if a == n and b > loop and b not in seen:
                seen.add(b)
                todo.append(b)
    return False


def reach(after, starts, stop=lambda n: False):
    seen, todo = set(), list(starts)
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            if not stop(n):
                todo += after.get(n, ())
    return seen


def brute(edges, info):
    after = expanded(edges, info)
    affects = {}
    for a in after:
        if info[a[1]][1] == "assign":
            (v,) = info[a[1]][2]
            affects[a] = {b for b in reach(after, after[a], lambda n: v in info[n[1]][2]) if info[b[1]][1] == "assign" and v in info[b[1]][3]}
    pairs = lambda found: {(a[1], b[1]) for a, bs in found.items() for b in bs}
    close = lambda g: {a: reach(g, g[a]) for a in g}
    return {"next_bip": pairs(after), "next_bip_t": pairs(close(after)), "affects_bip": pairs(affects), "affects_bip_t": pairs(close(affects))}


@pytest.fixture(scope="module")
def programs(spark):
    rng = random.Random(11)
    made = [make_program(rng) for _ in range(20)]
    f = facts(spark, [p[0] for p in made])
    return f, [brute(edges, info) for _, edges, info in made]


@pytest.mark.parametrize("relation", list(_LITERAL))
def test_random_programs(programs, relation):
    f, want = programs
    assert rows(f, relation) == {(str(i), *pair) for i, w in enumerate(want) for pair in w[relation]}


@pytest.mark.parametrize("relation", list(_LITERAL))
def test_alpha(spark, relation):
    assert rows(facts(spark, [ALPHA]), relation) == {("0", *pair) for pair in _LITERAL[relation]}


def test_more_chains_than_a_million(spark):
    """Each of 21 procedures calls the next one twice, so the last is at the end of 2**21 chains."""
    last = 21
    source = "".join(f"procedure p{i} {{ call p{i + 1}; call p{i + 1}; }}" for i in range(last)) + f"procedure p{last} {{ x = x; }}"
    f = facts(spark, [source])
    n = 2 * last + 1
    assert len(rows(f, "next_bip")) > n
    assert rows(f, "affects_bip") == rows(f, "affects_bip_t") == {("0", n, n)}
    got = rows(f, "next_bip_t")
    assert {("0", 1, m) for m in range(2, n + 1)} <= got and ("0", n, n) in got


@pytest.mark.parametrize("key", ["events_next_bip", "events_next_bip_t"])
def test_events_against_sql(spark, key):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = {tuple(r) for r in con.sql(f"SELECT l, r FROM ({registry.oracle_sql()[key]})").fetchall()}
    got = [(r["l"], r["r"]) for r in registry.queries()[key](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("relation", ["affects", "affects_t"])
def test_no_task_holds_a_procedure(spark, relation):
    plan = facts(spark, [ALPHA]).relation(relation)._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("relation", ["affects_bip", "affects_bip_t"])
def test_bound_values_are_followed_from_the_bindings(spark, monkeypatch, relation):
    """Pairs of starts with all below them and of ends with all above, whose number is quadratic, are not made for a binding."""
    ladder = "".join(f"procedure p{i} {{ a = a + {i}; c = d; {f'call p{i + 1}; ' if i < 3 else ''}e = c; }}\n" for i in range(4))
    f = facts(spark, [ladder])
    every = rows(f, relation)
    monkeypatch.setattr(across, "between_assignments", None)
    for side in ("l", "r"):
        seeds = spark.createDataFrame([("0", 5)], "program_id string, node long")
        got = {tuple(r) for r in demand.bound(f, relation, seeds, side).select("program_id", "l", "r").collect()}
        assert got == {r for r in every if r[1 if side == "l" else 2] == 5} and got


def test_pairs_across_calls_are_made_of_numbers(spark, monkeypatch):
    f = facts(spark, ["procedure a { x = 1; call b; call b; y = x; } procedure b { call c; z = x; } procedure c { x = y + 1; call d; } procedure d { y = x; }"])
    s = across.steps(f)
    made = {}

    def kept(df, name):
        made[name] = dict(df.dtypes)
        return written(df, name)

    for module in (across, closure):
        monkeypatch.setattr(module, "written", kept)
    assert across.between_assignments(f, s).count() > 3
    assert {"closure", "below", "returned", "behind"} <= set(made)
    for name in ("closure", "delta", "below", "returned", "behind"):
        assert not any(kind.startswith("struct") for kind in made[name].values()), name
