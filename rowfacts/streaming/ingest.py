"""Incremental ingest with exactly-once effect, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.records import file_code
from ..operators.commit import Store
from ..sources.datasource import NAME, options, register
from ..sources.records import finished
from ..sources.structure import Structure


def ingest_stream(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str, name: str = "ingest", files_per_batch: int = 100) -> StreamingQuery:
    """Commits every new file of records once: the batch id is the commit id, so a replayed batch changes nothing."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        store.commit(f"{name}-{batch_id}", transform(batch))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit).start()


def ingest_files(spark: SparkSession, path: str, s: Structure, transform: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str, extraction_version: str = "v1", name: str = "files", files_per_batch: int = 100) -> int:
    """Commits the records of all new and changed files of a folder, and returns how many batches were new.

    A file's id is the code of its path and content, so a changed file is a new version beside the old
    one.  The batches are planned from a log in the checkpoint folder and their commits are idempotent: a run that
    was killed goes on where it stopped and ends like one that was not.
    """
    register(spark)
    done = []

    def commit(batch: DataFrame, batch_id: int) -> None:
        coded = finished(batch).withColumns({"file_id": file_code(F.col("file_id"), F.col("content_hash")), "extraction_version": F.lit(extraction_version)})
        store.commit(f"{name}-{batch_id}", transform(coded))
        done.append(batch_id)

    stream = spark.readStream.format(NAME).options(**options(s)).option("log", f"{checkpoint.rstrip('/')}/sources-seen").option("filesPerBatch", files_per_batch).load(path)
    query = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(commit).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return len(done)


def tumbling(events: DataFrame, ts: str, width: str, by: list[str], late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates of fixed windows; with ``late`` a watermark for streams."""
    source = events.withWatermark(ts, late) if late else events
    return source.groupBy(F.window(ts, width).alias("w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("window_start"), *by, *aggregates)


def sliding(events: DataFrame, ts: str, width: str, step: str, by: list[str], **aggregates: Column) -> DataFrame:
    return events.groupBy(F.window(ts, width, step).alias("w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("window_start"), *by, *aggregates)


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates of sessions that end after ``gap`` without an event."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("session_start"), *by, *aggregates)
