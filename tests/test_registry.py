"""Every query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import functools

import duckdb
import pytest
from codeloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("events", "region", "nation", "customer", "orders")
KEYS = [*registry.NESTED, *registry.ONE, "store_next", "cycle_of_three", "cycle_of_four", "tree_of_clauses", "tree_outwards", "product_of_groups", "affects_t_exists", "source_affects_t_exists", *registry.INVALID, "source_errors", "source_cross_kind", "affects_bip", "events_affects_bip_t", "affects_t_from", "next_t_tested", "calls_t_removed", "pattern_table", "scan_variable", "follows_t", "parent_t", "uses_s", "modifies_p", "next_t", "affects", "with_attr_attr", "select_tuple", "group_cartesian", "empty_group", "with_literals", "pattern_partial"]


@pytest.fixture(scope="module", autouse=True)
def shared_facts():
    """Queries of this module read the tables once and share what relations they make."""
    patch = pytest.MonkeyPatch()
    for name in ("events_facts", "orders_facts", "one_program_facts"):
        patch.setattr(registry, name, functools.cache(getattr(registry, name)))
    yield
    patch.undo()


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, key):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = registry.queries()[key](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(registry.oracle_sql()[key])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == want


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
