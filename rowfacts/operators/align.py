"""Values of records with different fields, brought to one order of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_union(records: DataFrame, order: list[str], fields: str = "fields", most: int = 10_000) -> list[str]:
    """The names of all fields in order of first appearance: by ``order``, then by place in the record.

    What reaches the driver is one row for each name; over ``most`` of them are an error.
    """
    said = records.select(*order, F.posexplode(fields).alias("_place", "_field"))
    first = said.groupBy(F.col("_field.name").alias("name")).agg(F.min(F.struct(*order, "_place")).alias("at")).orderBy("at", "name").limit(most + 1)
    names = [r.name for r in first.collect()]
    if len(names) > most:
        raise ValueError(f"over {most} different columns")
    return names


def aligned(records: DataFrame, order: list[str], fields: str = "fields", names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(``records`` with ``values``, their values in the order of ``names``; the names).  A field that a record lacks is null.

    Without ``names`` they are the union of all records' fields.  Names are unique in a record.
    """
    names = column_union(records, order, fields) if names is None else names
    listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    by_name = records.withColumn("_by_name", F.map_from_entries(fields))
    return by_name.withColumn("values", F.transform(listed, lambda n: F.try_element_at("_by_name", n))).drop("_by_name"), names
