"""Shared helpers: where intermediate tables go, unique row keys, free column names, shipping code."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that tasks can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="llm-"), "llm_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for name in sorted(os.listdir(_PACKAGE)):
            if name.endswith(".py"):
                archive.write(os.path.join(_PACKAGE, name), f"llm/{name}")
    sc.addPyFile(target)
    sc._llm_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on one machine a temporary one."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        known = getattr(sc, "_llm_shared", None)
        if known is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = known or tempfile.mkdtemp(prefix="spark-")
        sc._llm_shared = known
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(known)
    return known


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a narrow intermediate result with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a wide intermediate result as a table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: Iterable[str], base: str) -> str:
    """``base``, or ``base_1``, ``base_2`` ... : a column name that does not clash (case-insensitively)."""
    names = {x.lower() for x in taken}
    name, k = base, 0
    while name.lower() in names:
        k += 1
        name = f"{base}_{k}"
    return name


def free_names(taken: Iterable[str], names: Iterable[str]) -> list[str]:
    """``names`` in order, each one free as in ``free_name``."""
    used, out = list(taken), []
    for name in names:
        out.append(free_name(used, name))
        used.append(out[-1])
    return out


def col(name: str):
    """A column by its exact name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: a unique, non-null long that sorts as ``id_col`` does.

    It equals ``id_col`` where that is unique and not null.  Otherwise all rows are numbered in the
    order (id nulls first, text nulls first), so repeated rows stay apart, and the numbering is
    frozen in a stored table because later passes read it again.
    """
    key = free_name(docs.columns, "doc_key")
    ids = docs.select(col(id_col).cast("long").alias("id"))
    clash = ids.groupBy("id").count().where("count > 1 OR id IS NULL").limit(1)
    if not clash.collect():
        return docs.withColumn(key, col(id_col).cast("long")), key
    ordered = docs.sort(col(id_col).cast("long").asc_nulls_first(), col(text_col).asc_nulls_first())
    return stored(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def keyed(docs: DataFrame, id_col: str, text_col: str, unique: bool = False) -> DataFrame:
    """(doc_key, doc_id, text): the two columns of ``docs`` with the key of ``with_key``.

    With ``unique`` the caller knows that the ids are a key, so they are not counted again.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    if unique:
        return rows.select(F.col("doc_id").alias("doc_key"), "doc_id", "text")
    return with_key(rows, "doc_id", "text")[0].select("doc_key", "doc_id", "text")


_caches: dict[str, Callable[[], None]] = {}


def register_cache(name: str, clear: Callable[[], None]) -> None:
    """Names what a worker process keeps between tasks of one operator, and how to drop it."""
    _caches[name] = clear


def drop_caches(keep: str | None) -> None:
    """Drops what other operators' tasks have left in this process, so that stages don't add up in memory.

    Freed memory goes back to the system: the executor's other workers and its JVM share one limit.
    """
    for name, clear in _caches.items():
        if name != keep:
            clear()
    release_memory()


def release_memory() -> None:
    """Gives memory that this process holds free back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, cache: str | None = None) -> DataFrame:
    """``df.mapInArrow`` whose tasks drop all caches of their worker but ``cache``."""
    ship(df.sparkSession)

    def run(batches):
        drop_caches(cache)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def batch(columns: Sequence[tuple[str, object]]) -> pa.RecordBatch:
    """A record batch from (name, numpy or Arrow array) pairs; unsigned 64-bit values keep their bits as longs."""
    arrays, names = [], []
    for name, values in columns:
        if not isinstance(values, (pa.Array, pa.ChunkedArray)):
            if getattr(values, "dtype", None) is not None and values.dtype.name == "uint64":
                values = values.view("int64")
            values = pa.array(values)
        arrays.append(values)
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def ints(lists_at, values) -> pa.ListArray:
    """list<int> rows from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(lists_at, pa.int32()), pa.array(values, pa.int32()))
