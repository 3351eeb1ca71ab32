"""JSON-lines logs: the newest entries, and which files have outlived their retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, level string, event string, message string, duration_ms long, count long"


def latest(spark: SparkSession, path: str, most: int, levels: tuple[str, ...] = ()) -> DataFrame:
    """The newest entries; lines that are no JSON are passed over."""
    entries = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return (entries.where(F.col("level").isin(*levels)) if levels else entries).orderBy(F.desc("ts")).limit(most)


def expired(files: DataFrame, modified: str, now: Column, days: int) -> DataFrame:
    return files.where(F.col(modified) < now - F.expr(f"INTERVAL {int(days)} DAYS"))
