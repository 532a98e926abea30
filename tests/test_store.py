"""Stores of facts: versions, and joins without shuffles."""

from __future__ import annotations

import uuid

import pytest
from codeloom.plans.query import Query
from codeloom.sources import store
from codeloom.sources.programs import from_programs
from pyspark.sql import functions as F
from small_programs import ALPHA


def facts_of(spark, *sources):
    return from_programs(spark.createDataFrame(list(enumerate(sources)), "program_id string, source string"))


@pytest.fixture
def name(spark):
    found = f"store{uuid.uuid4().hex[:8]}"
    yield found
    for t in spark.catalog.listTables():
        if t.name.startswith(found):
            spark.sql(f"DROP TABLE {t.name}")


def test_versions_are_whole_or_unseen(spark, name):
    with pytest.raises(ValueError):
        store.open_store(spark, name)
    small = "procedure a { x = 1; }"
    assert store.save(facts_of(spark, small), name, buckets=2) == 1
    facts = facts_of(spark, ALPHA, small)
    assert store.save(facts, name, ("next", "affects"), buckets=2) == 2
    # A third that stopped after its first table.
    facts.stmt.write.saveAsTable(f"{name}_stmt_v3")
    assert store.open_store(spark, name, 1).stmt.count() == 1
    latest = store.open_store(spark, name)
    assert latest.stmt.count() == facts.stmt.count()
    for relation in ("next", "affects"):
        assert sorted(map(tuple, latest.relation(relation).collect())) == sorted(map(tuple, facts.relation(relation).select("program_id", "l", "r").collect()))
    for relation in ("uses_s", "parent_t"):
        assert sorted(map(tuple, latest.relation(relation).collect())) == sorted(map(tuple, facts.relation(relation).collect()))
    assert store.save(facts, name, buckets=2) == 4
    store.drop_before(spark, name, 4)
    assert not spark.catalog.tableExists(f"{name}_stmt_v1") and store.open_store(spark, name).stmt.count() == facts.stmt.count()


def test_queries_of_a_store_do_not_shuffle(spark, name):
    store.save(facts_of(spark, *[ALPHA] * 6), name, ("next", "affects"), buckets=4)
    facts = store.open_store(spark, name)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = Query(facts, a="assign", b="stmt")._relation("Affects", "a", "b")
        joined = facts.relation("next").withColumnRenamed("l", "stmt_no").join(facts.stmt, ["program_id", "stmt_no"])
        for df in (found, joined):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan, plan
        assert joined.count() == facts.relation("next").count()
        rows = found.select("program_id", "a", "b").where(F.col("program_id") == "3")
        assert sorted((a, b) for _, a, b in rows.collect()) == sorted((r.l, r.r) for r in facts.relation("affects").where("program_id = '3'").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
