"""Figures of a read, gathered while its rows pass and without a second scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(records: DataFrame, name: str = "read", after: int = 0) -> tuple[DataFrame, Observation]:
    """(the records behind ``after``, their figures): ``observation.get`` has them once an action has run over all rows.

    skipped: records up to ``after``; emitted: the others; bad: those with an error; blank: those
    without a value that has a character other than spaces; replaced: characters U+FFFD in values; characters: of all values.
    """
    mine = F.col("ordinal") > after
    values = F.transform("fields", lambda f: F.coalesce(f["value"], F.lit("")))
    joined = F.array_join(values, "")
    blank = F.col("error").isNull() & (F.length(F.trim(joined)) == 0)
    replaced = F.length(joined) - F.length(F.replace(joined, F.lit("�"), F.lit("")))
    observation = Observation(name)
    total = lambda c: F.coalesce(F.sum(F.when(mine, c)), F.lit(0)).cast("long")
    figures = [F.count_if(~mine).alias("skipped"), F.count_if(mine).alias("emitted"), F.count_if(mine & F.col("error").isNotNull()).alias("bad"), F.count_if(mine & blank).alias("blank"), total(replaced).alias("replaced"), total(F.length(joined)).alias("characters")]
    return records.observe(observation, *figures).where(mine), observation
