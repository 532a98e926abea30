"""Fact tables as Parquet: written once, queried by many sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from codeloom.plans.facts import Facts

NAMES = ("stmt", "use_direct", "mod_direct", "cond_var", "const", "proc")


def write_facts(facts: Facts, path: str, relations: tuple[str, ...] = ()) -> None:
    """Base tables below path, and with `relations` those relations, computed once for all later queries."""
    for name in NAMES:
        getattr(facts, name).write.mode("overwrite").parquet(f"{path}/{name}")
    for name in relations:
        facts.relation(name).write.mode("overwrite").parquet(f"{path}/relation-{name}")


def read_facts(spark: SparkSession, path: str, relations: tuple[str, ...] = ()) -> Facts:
    """Facts from tables that `write_facts`, or anything else, has written; `relations` are read instead of computed."""
    facts = Facts.from_tables({name: spark.read.parquet(f"{path}/{name}") for name in NAMES})
    facts.memo |= {name: spark.read.parquet(f"{path}/relation-{name}") for name in relations}
    return facts
