"""Order-dependent planning of request batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import CHUNK_OVERHEAD, RECORD_OVERHEAD, record_bytes


def greedy_batches(df: DataFrame, by: list[str], order: str, weight: Column, max_rows: int, max_weight: int) -> DataFrame:
    """Number of each row's batch: rows in order fill a batch until a row or weight limit would break.

    A group's rows pass one task in order; the task keeps only the open batch, so groups may have any
    size.  A row over the weight limit is its own batch; an unknown weight leaves the row limit alone
    to close its batch.
    """
    keys = [f"_key{i}" for i in range(len(by))]
    items = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(order).alias("_at"), weight.cast("long").alias("_weight"))
    placed = (items.repartition(*keys) if keys else items.coalesce(1)).sortWithinPartitions(*keys, "_at", "_weight")
    names = [*by, order, "batch"]
    schema = ", ".join(f"`{n}` {t}" for n, (_, t) in zip(names, [*items.dtypes[:-1], ("batch", "int")], strict=True))

    def run(batches):
        group, batch, n, total = None, 0, 0, 0
        for b in batches:
            columns = [[v if v == v else "NaN" for v in c.to_pylist()] for c in b.columns[: len(keys)]]
            out = []
            for key, w in zip(zip(*columns, strict=True) if columns else [()] * b.num_rows, b.column(b.num_columns - 1).to_pylist(), strict=True):
                if key != group:
                    group, batch, n, total = key, 0, 0, 0
                both = None if w is None or total is None else total + w
                if n and (n + 1 > max_rows or both is not None and both > max_weight):
                    batch, n, total = batch + 1, 1, w
                else:
                    n, total = n + 1, both
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.int32())], names=names)

    return placed.mapInArrow(run, schema)


def chunked(records: DataFrame, max_rows: int, max_bytes: int = 16 << 20) -> DataFrame:
    """(file_id, ordinal, batch): records in order fill chunks of at most ``max_bytes`` of JSON; errors count by their message."""
    size = F.when(F.col("error").isNull(), record_bytes(F.col("fields"))).otherwise(RECORD_OVERHEAD + 3 * F.length("error.message"))
    return greedy_batches(records, ["file_id"], "ordinal", size, max_rows, max_bytes - CHUNK_OVERHEAD)


def calibrated(ratios: Column) -> Column:
    """Running estimate of actual over estimated tokens: each ratio kept in 0.5..3, weight 1/n but at least 0.05."""
    start = F.struct(F.lit(0).alias("n"), F.lit(1.0).alias("v"))

    def step(s: Column, r: Column) -> Column:
        n = s["n"] + 1
        w = F.greatest(F.lit(0.05), F.lit(1.0) / n)
        return F.struct(n.alias("n"), (s["v"] + w * (F.least(F.greatest(r, F.lit(0.5)), F.lit(3.0)) - s["v"])).alias("v"))

    return F.aggregate(ratios, start, step, lambda s: s["v"])


def backoff_seconds(attempt: int, jitter: float, base: float = 1.0, most: float = 60.0, retry_after: float | None = None) -> float:
    """Pause before a retry: the server's wish, or doubling steps with full jitter."""
    return retry_after if retry_after is not None else min(most, base * 2 ** (attempt - 1)) * jitter
