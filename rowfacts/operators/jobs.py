"""Jobs, their files and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def job_rollup(jobs: DataFrame, files: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Every job with the number of its files and sums over them, 0 where it has none.

    The files are summed before the join, so jobs of very many files combine early.
    """
    totals = files.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("files"), *[F.sum(c).alias(n) for n, c in sums.items()])
    joined = jobs.join(totals, jobs[key] == totals["_k"], "left").drop("_k")
    return joined.withColumns({"files": F.coalesce("files", F.lit(0).cast("long"))} | {n: F.coalesce(F.col(n), F.lit(0).cast(totals.schema[n].dataType)) for n in sums})


def with_progress(files: DataFrame, progress: DataFrame, keys: list[str]) -> DataFrame:
    return files.join(progress, keys, "left")


def merged_progress(log: DataFrame, keys: list[str], confirmed: str, counters: list[str]) -> DataFrame:
    """Progress from a commit log: counters add up, the confirmed ordinal only grows."""
    return log.groupBy(*keys).agg(F.max(confirmed).alias(confirmed), *[F.sum(c).alias(c) for c in counters])


def stale_jobs(jobs: DataFrame, files: DataFrame, key: str, running: Column, started: str, touched: str, now: Column, minutes: int = 30) -> DataFrame:
    """Running jobs that are old and have no file touched lately."""
    edge = now - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    recent = files.where(F.col(touched) > edge).select(key).distinct()
    return jobs.where(running & (F.col(started) < edge)).join(recent, key, "left_anti")


def resume_plan(planned: DataFrame, present: DataFrame, key: str, version: list[str], completed: Column) -> DataFrame:
    """What to do with each planned file: skip completed ones, mark missing and changed ones, go on with the rest."""
    now = present.select(F.col(key).alias("_k"), *[F.col(v).alias(f"_{v}") for v in version])
    same = F.lit(True)
    for v in version:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    action = F.when(completed, "completed").when(F.col("_k").isNull(), "missing").when(~same, "changed").otherwise("resume")
    return planned.join(now, planned[key] == now["_k"], "left").withColumn("action", action).select(*planned.columns, "action")


def new_versions(found: DataFrame, registered: DataFrame, keys: list[str]) -> DataFrame:
    """Sources whose (path, content) is not registered yet."""
    return found.dropDuplicates(keys).join(registered, keys, "left_anti")


def estimate(structures: DataFrame, by: list[str], size: str, sample_bytes: str, sample_records: str, sample_tokens: str, rows_per_request: int) -> DataFrame:
    """Records, tokens and requests that files will take, from averages of their samples."""
    per_record = F.sum(sample_bytes) / F.sum(sample_records)
    records = F.ceil(F.sum(size) / per_record)
    return structures.groupBy(*by).agg(records.alias("records"), F.ceil(records * F.sum(sample_tokens) / F.sum(sample_records)).alias("tokens"), F.ceil(records / F.lit(rows_per_request)).alias("requests"))


def schema_issues(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Differences of (table_name, column_name, data_type, nullable) rows: missing ones block, others warn."""
    keys = ["table_name", "column_name"]
    a = actual.select(*keys, F.col("data_type").alias("found_type"), F.col("nullable").alias("found_nullable"))
    issue = (
        F.when(F.col("found_type").isNull(), "missing column")
        .when(F.col("data_type").isNull(), "unknown column")
        .when(F.col("data_type") != F.col("found_type"), "other type")
        .when(F.col("nullable") != F.col("found_nullable"), "other nullability")
    )
    joined = expected.join(a, keys, "full_outer").withColumn("issue", issue).where("issue IS NOT NULL")
    return joined.select(*keys, "issue", F.when(F.col("issue").isin("missing column", "other type"), "blocking").otherwise("warning").alias("level"))
