"""Additive changes of a store's tables: a history of applied steps, and a plan of those that are not."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .commit import TABLES, Store
from .tables import Tables

HISTORY = {"schema_history": "version int, table_name string, column_name string, kind string"}


class Step(NamedTuple):
    """A column that a table gets; existing files keep their form and read as null there."""

    version: int
    table_name: str
    column_name: str
    kind: str


def _history(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root, HISTORY, lambda name: None)


def migration_plan(spark: SparkSession, root: str, steps: list[Step]) -> DataFrame:
    """The steps that the store below ``root`` has not had, in order."""
    wanted = spark.createDataFrame([tuple(s) for s in steps], HISTORY["schema_history"])
    return wanted.join(_history(spark, root).read("schema_history").select("version"), "version", "left_anti").orderBy("version")


def migrate(spark: SparkSession, root: str, steps: list[Step], mapped: dict[str, dict[str, str]] | None = None) -> tuple[Store, int]:
    """(the store with all applied columns, how many steps were new).

    Columns are added at the end; a step on an unknown table, on a column that is there, or out of order with
    what was applied is an error before anything is written.  ``mapped`` as in ``Tables``.
    """
    history = _history(spark, root)
    applied = [Step(*r) for r in history.read("schema_history").orderBy("version").collect()]  # a row for each step
    new = [Step(*r) for r in migration_plan(spark, root, steps).collect()]
    if applied and new and new[0].version < applied[-1].version:
        raise ValueError(f"step {new[0].version} comes after {applied[-1].version} was applied")
    schemas = dict(TABLES)
    for s in [*applied, *new]:
        if s.table_name not in schemas:
            raise ValueError(f"step {s.version}: no table {s.table_name}")
        if s.column_name.lower() in (c.split()[0].lower() for c in schemas[s.table_name].split(", ")):
            raise ValueError(f"step {s.version}: {s.table_name} has a column {s.column_name}")
        schemas[s.table_name] += f", {s.column_name} {s.kind}"
    if new:
        history.append("schema_history", spark.createDataFrame([tuple(s) for s in new], HISTORY["schema_history"]).coalesce(1))
    return Store(spark, root, schemas, mapped), len(new)

