"""Audits over stored rows: counts, duplicates, order, gaps and canonical hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conditional_counts(df: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def dense_ordinals(df: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """Rows, distinct ordinals, first and last, and whether they are exactly 1..n."""
    n, d, lo, hi = F.count("*"), F.count_distinct(ordinal), F.min(ordinal), F.max(ordinal)
    return df.groupBy(*by).agg(n.alias("n"), d.alias("n_distinct"), lo.alias("first"), hi.alias("last"), ((n == d) & (lo == 1) & (hi == n)).alias("dense"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def order_inversions(df: DataFrame, by: list[str], order: list[str], id_col: str) -> DataFrame:
    """How often an id is smaller than the one before it, within each group."""
    before = F.lag(id_col).over(Window.partitionBy(*by).orderBy(*order))
    return df.select(*by, (F.col(id_col) < before).alias("back")).groupBy(*by).agg(F.count_if("back").alias("inversions"))


#: Values of an order column that one task looks at in a row, so that a group of any size is split.
RANGE = 1 << 16


def error_streaks(df: DataFrame, by: list[str], order: str, is_bad: Column, least: int = 20, width: int = RANGE) -> DataFrame:
    """Runs of at least ``least`` bad rows in a row, by a whole-number ``order``.

    Gaps and islands are found within ranges of ``width`` values; runs that touch the edge of their range
    are then joined with their neighbours, so that a group is never ordered in one task.
    """
    span = F.floor(F.col(order) / width)
    rows = df.select(*by, F.col(order).alias("_at"), span.alias("_span"), is_bad.alias("_bad"))
    within = Window.partitionBy(*by, "_span").orderBy("_at")
    good = F.when(F.col("_bad"), 0).otherwise(1)
    marked = rows.withColumns({"_before": F.sum(good).over(within), "_all": F.sum(good).over(Window.partitionBy(*by, "_span"))})
    runs = marked.where("_bad").groupBy(*by, "_span", "_before", "_all").agg(F.min("_at").alias("start"), F.max("_at").alias("end"), F.count("*").alias("length"))
    runs = runs.withColumns({"_left": F.col("_before") == 0, "_right": F.col("_before") == F.col("_all")})
    # Ranges of a group in order: as many rows as it has ranges.
    spans = rows.select(*by, "_span").distinct().withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("_span")))
    edge = matched_on(runs.where("_left OR _right"), spans, [*by, "_span"])
    along = Window.partitionBy(*by).orderBy("start")
    follows = F.col("_left") & F.lag("_right").over(along) & (F.lag("_nth").over(along) == F.col("_nth") - 1)
    chained = edge.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(along))
    joined = chained.groupBy(*by, "_chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("length")).drop("_chain")
    return runs.where("NOT (_left OR _right)").select(*by, "start", "end", "length").unionByName(joined.select(*by, "start", "end", "length")).where(F.col("length") >= least)


def matched_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys where null equals null."""
    renamed = right.withColumnsRenamed({k: f"_{k}_" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    return left.join(renamed, on).drop(*[f"_{k}_" for k in keys])


def contiguous_checkpoint(df: DataFrame, by: list[str], ordinal: str, width: int = RANGE) -> DataFrame:
    """The last ordinal up to which none is missing from 1 on; 0 if 1 is missing.

    Full ranges of ``width`` ordinals are told by their counts, and only the first one that isn't full is
    looked at row by row.
    """
    known = df.select(*by, F.col(ordinal).cast("long").alias("_at")).distinct()
    groups = known.select(*by).distinct()
    ranged = known.where("_at >= 1").withColumn("_range", F.floor((F.col("_at") - 1) / width))
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("_range")) - 1)
    full = (F.col("_range") == F.col("_nth")) & (F.col("_n") == width)
    first = counts.groupBy(*by).agg(F.coalesce(F.min(F.when(~full, F.col("_nth"))), F.max("_nth") + 1).cast("long").alias("_range"))
    inside = matched_on(ranged, first, [*by, "_range"]).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_at")) + F.col("_range") * width)
    held = inside.groupBy(*by).agg(F.max(F.when(F.col("_at") == F.col("_k"), F.col("_at"))).alias("_held"))
    every = first.select(*by, (F.col("_range") * width).alias("_base"))
    bases = groups.alias("g")
    for other in (every, held):
        renamed = other.withColumnsRenamed({k: f"_{k}_" for k in by})
        on = F.lit(True)
        for k in by:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}_"))
        bases = bases.join(renamed, on, "left").drop(*[f"_{k}_" for k in by])
    return bases.select(*by, F.coalesce("_held", "_base", F.lit(0)).cast("long").alias("confirmed"))


def first_of_groups(df: DataFrame, by: list[str], order: list[Column], value: Column, most: int) -> DataFrame:
    """(by, first, n): the first ``most`` values of each group in order, and its number of rows; only ``most`` rows of a task and group move."""
    ranked = df.select(*by, value.alias("_v"), F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("_k")).where(F.col("_k") <= most)
    first = ranked.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"]).alias("first"))
    return matched_on(first, df.groupBy(*by).agg(F.count("*").alias("n")), by)


def ordered_list(column: Column, order: list[Column], separator: str = "|") -> Column:
    """Values of a group joined in the given order."""
    items = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], column.alias("v"))))
    return F.array_join(F.transform(items, lambda s: s["v"]), separator)


def canonical_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row that does not depend on the order of rows: their number and the folded hashes of each.

    The sum of hash halves is associative, so it combines partially and no group is gathered.
    """
    row = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    halves = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(2)]
    return df.select(*[h.alias(f"h{i}") for i, h in enumerate(halves)]).agg(F.count("*").alias("n"), *[F.sum(f"h{i}").cast("string").alias(f"hash{i}") for i in range(2)])


def majority(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group with its count and share; ties go to the larger value."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", value))
    return counts.groupBy(*by).agg(best.alias("b"), F.sum("n").alias("total")).select(*by, F.col(f"b.{value}").alias("majority"), F.col("b.n").alias("n"), (F.col("b.n") / F.col("total")).alias("share"))


def golden_comparison(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Matched, missing and extra rows by key with recall and precision."""
    e, f = expected.select(*keys).distinct().withColumn("e", F.lit(1)), found.select(*keys).distinct().withColumn("f", F.lit(1))
    both = e.join(f, keys, "full_outer").agg(F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("matched"), F.count_if(F.col("f").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"))
    return both.withColumns({"recall": F.try_divide("matched", F.col("matched") + F.col("missing")), "precision": F.try_divide("matched", F.col("matched") + F.col("extra"))})
