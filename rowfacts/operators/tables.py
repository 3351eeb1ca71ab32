"""Parquet tables below one folder: buckets, versions that are swapped whole, and rewrites of single buckets.

A version of a table is a folder of its own, and counts from the moment that Spark has marked it
as complete: a rewrite that dies leaves readers with the version before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Tables with declared schemas; ``bucket_of`` gives the folder number of a table's rows, or null for small tables.

    ``mapped`` names columns that lie in the files under another name: table -> {logical name: name in the files}.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], bucket_of, mapped: dict[str, dict[str, str]] | None = None):
        self.spark, self.root, self.schemas, self.bucket_of, self.mapped = spark, root.rstrip("/"), schemas, bucket_of, mapped or {}

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs().exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs().delete(self._path(path), True)

    def version(self, name: str) -> int:
        """The newest complete version of a table; 0 is the one that was never rewritten."""
        found = self._fs().globStatus(self._path(f"{self.root}/{name}@*/_SUCCESS")) or []
        return max((int(str(f.getPath().getParent().getName()).rpartition("@")[2]) for f in found), default=0)

    def folder(self, name: str, version: int | None = None) -> str:
        v = self.version(name) if version is None else version
        return f"{self.root}/{name}@{v}" if v else f"{self.root}/{name}"

    def _columns(self, name: str) -> list[tuple[str, str]]:
        return [(c.split()[0], c.split()[1]) for c in self.schemas[name].split(", ")]

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or only some of its buckets; a table not written yet is empty.

        Columns that older files lack are null: files are read by the declared schema.
        """
        bucket, names = self.bucket_of(name), self.mapped.get(name, {})
        schema = ", ".join(f"{names.get(c, c)} {kind}" for c, kind in self._columns(name)) + (", bucket int" if bucket is not None else "")
        folder = self.folder(name)
        if not self.exists(folder):
            return self.spark.createDataFrame([], self.schemas[name])
        found = self.spark.read.schema(schema).parquet(folder)
        if buckets is not None and bucket is not None:
            found = found.where(F.col("bucket").isin(buckets))
        return found.select(*[F.col(names.get(c, c)).alias(c) for c, _ in self._columns(name)])

    def _write(self, name: str, rows: DataFrame, folder: str, mode: str, **options: str) -> None:
        names, bucket = self.mapped.get(name, {}), self.bucket_of(name)
        placed = "bucket" in rows.columns  # rows come from files of one bucket each
        rows = rows.select(*[F.col(c).cast(kind) for c, kind in self._columns(name)], *["bucket"] * placed)
        if bucket is not None and not placed:
            rows = rows.withColumn("bucket", bucket)
        rows = rows.withColumnsRenamed(names)
        if bucket is None:
            rows.write.mode(mode).options(**options).parquet(folder)
        else:
            # Rebalancing makes few files of a folder and splits the rows of a large source.
            rows = rows if placed else rows.hint("rebalance", "bucket")
            rows.write.mode(mode).options(**options).partitionBy("bucket").parquet(folder)

    def append(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, self.folder(name), "append")

    def swap(self, name: str, rows: DataFrame) -> None:
        """Makes ``rows`` the whole table at one stroke; older versions stay for readers that have begun, until ``vacuum``."""
        new = self.version(name) + 1
        self._write(name, rows, self.folder(name, new), "overwrite")

    def vacuum(self, name: str) -> None:
        """Deletes all versions of a table but the current one."""
        now = self.folder(name)
        old = [str(f.getPath()) for f in self._fs().globStatus(self._path(f"{self.root}/{name}@*")) or []]
        for path in [f"{self.root}/{name}", *old]:
            if self._path(path).getName() != self._path(now).getName() and self.exists(path):
                self.delete(path)

    def rewrite(self, name: str, buckets: list[int], kept: Column) -> None:
        """Rewrites some buckets of a table with the rows that are ``kept`` alone; a bucket left without rows goes."""
        folder = self.folder(name)
        if not self.exists(folder) or not buckets:
            return
        names = self.mapped.get(name, {})
        rows = self.spark.read.schema(", ".join(f"{names.get(c, c)} {kind}" for c, kind in self._columns(name)) + ", bucket int").parquet(folder).where(F.col("bucket").isin(buckets))
        rows = rows.select(*[F.col(names.get(c, c)).alias(c) for c, _ in self._columns(name)], "bucket")
        left = {r[0] for r in rows.where(kept).select("bucket").distinct().collect()}
        self._write(name, rows.where(kept), folder, "overwrite", partitionOverwriteMode="dynamic")
        for b in set(buckets) - left:
            self.delete(f"{folder}/bucket={b}")
