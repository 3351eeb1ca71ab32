"""Whitening of embeddings with a weighted covariance of distinct vectors.

Entries become whole numbers, equal vectors are grouped with their counts, and each distinct vector
is fitted with its count or with one as its weight: exact sums first, then products of centred
vectors, block by block.  What reaches the driver is a matrix of the dimensions, whatever the number
of rows.  Each distinct vector is whitened once and joined back to its rows by a digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, col, map_arrow, ship, stored

#: Entries are floor(UNITS * c).
UNITS = 256
#: Rows of one product: bounds the memory of a task to BLOCK times the dimensions.
BLOCK = 4096
#: An eigenvalue below this share of the trace counts as zero.
LEAST_SHARE = 1e-13


def _quantise(batches):
    """(id, x as bytes of longs, digest) of the rows whose vector has only finite entries."""
    for b in batches:
        ids, lists = b.column(0), b.column(1)
        lists = lists.cast(pa.large_list(pa.float64()))
        lengths = np.asarray(lists.value_lengths().fill_null(-1)).astype(np.int64)
        values = lists.flatten()  # null lists have no entries here
        at = np.r_[0, np.cumsum(np.maximum(lengths, 0))]
        entries = np.asarray(values.fill_null(np.nan), dtype=np.float64)
        bad = np.r_[0, np.cumsum(~np.isfinite(entries))]
        good = np.flatnonzero((lengths >= 0) & (bad[at[1:]] == bad[at[:-1]]))
        scaled = np.clip(np.floor(np.where(np.isfinite(entries), entries, 0) * UNITS), -(2.0**62), 2.0**62).astype("<i8")
        packed = [scaled[at[i] : at[i + 1]].tobytes() for i in good.tolist()]
        digests = [hashlib.sha256(x).digest() for x in packed]
        yield batch([("row_id", ids.take(pa.array(good))), ("x", pa.array(packed, pa.binary())), ("digest", pa.array(digests, pa.binary()))])


def _blocks(batches, size: int):
    """(matrix of longs, weights) of at most BLOCK rows each."""
    for b in batches:
        for r in range(0, b.num_rows, BLOCK):
            part = b.slice(r, BLOCK)
            x = np.frombuffer(b"".join(part.column(0).to_pylist()), "<i8").reshape(part.num_rows, size)
            yield part, x, np.asarray(part.column(1))


def _sums(size: int):
    def run(batches):
        total, n = np.zeros(size, object), 0
        for _, x, weight in _blocks(batches, size):
            n += int(weight.sum())
            fits = int(np.abs(x).max(initial=0)) * int(weight.max(initial=0)) * max(len(x), 1) < 2**62
            total = total + ((x * weight[:, None]).sum(axis=0).astype(object) if fits else (x.astype(object) * weight.astype(object)[:, None]).sum(axis=0))
        yield batch([("cell", np.arange(size + 1, dtype=np.int32)), ("value", pa.array([str(v) for v in [n, *total.tolist()]]))])

    return run


def _products(size: int, mean: np.ndarray):
    """Upper triangle of the weighted products of centred rows, summed over the task."""

    def run(batches):
        total = np.zeros((size, size))
        for _, x, weight in _blocks(batches, size):
            centred = x - mean
            total += (centred * weight[:, None]).T @ centred
        i, j = np.triu_indices(size)
        yield batch([("i", i.astype(np.int32)), ("j", j.astype(np.int32)), ("value", total[i, j])])

    return run


def _gram(parts: DataFrame, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.value
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, weights: str = "one") -> DataFrame:
    """One row for each kept row and component: id, component, n, deviation, whitened, explained, identity_error.

    A row is kept if its vector is neither null nor has a null or non-finite entry, and has as many
    entries as most kept rows (ties: more entries; vectors without entries never count).  ``x`` is floor(256 c) as a long
    (saturated at 2^62).  ``weights`` is "one" or "count": what each distinct vector weighs in the fit;
    n and S are the sums of the weights and of the weighted vectors.  Covariances have divisor n and
    are centred before multiplying.  Components are numbered from 1 by falling eigenvalue, with their
    largest entry positive, the same for all rows; there are at most as many as dimensions.  ``deviation`` is the exact sum of
    (n x - S)^2 as decimal(38,0).  ``whitened`` is null where the eigenvalue is zero, as in a fit
    of one distinct vector; ``identity_error`` is the largest absolute entry of the covariance of the
    other whitened components minus the identity, measured on the whitened vectors, 0 if none is left, and
    ``explained`` is the eigenvalue's share of the trace, 0 if that is zero.  Repeated and null ids are
    separate rows.  Other columns are not read.  An empty table gives an empty result.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights {weights!r}: one or count")
    spark = vectors.sparkSession
    ship(spark)
    name = vectors.schema[id_col].name
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = map_arrow(vectors.select(col(id_col).alias("row_id"), col(vector_col).alias("v")), _quantise, f"row_id {kind}, x binary, digest binary")
    # Equal vectors meet by their bytes and combine before they move; a hot vector is one row of a task.
    distinct = stored(rows.groupBy("digest", "x").count(), "distinct-vectors")
    sizes = distinct.where("octet_length(x) > 0").groupBy(F.octet_length("x").alias("bytes")).agg(F.sum("count").alias("rows"))
    most = sizes.orderBy(F.desc("rows"), F.desc("bytes")).first()
    out = f"`{name}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if most is None:
        return spark.createDataFrame([], out)
    size = most.bytes // 8
    fit = distinct.where(F.octet_length("x") == most.bytes).select("x", (F.lit(1).cast("long") if weights == "one" else F.col("count")).alias("weight"), "digest")

    sums = map_arrow(fit, _sums(size), "cell int, value string").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    exact = [int(r.value) for r in sums.orderBy("cell").collect()]  # size + 1 numbers
    n, total = exact[0], exact[1:]
    mean = np.array([s / n for s in total])
    covariance = _gram(map_arrow(fit, _products(size, mean), "i int, j int, value double"), size) / n
    values, axes = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    top = min(components, size)
    values, axes = values[::-1][:top], axes[:, ::-1][:, :top]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
    live = values > LEAST_SHARE * max(trace, 0)
    project = axes / np.sqrt(np.where(live, values, 1.0))

    def whitened(batches):
        for part, x, _ in _blocks(batches, size):
            w = (x - mean) @ project
            if size * (int(np.abs(x).max(initial=0)) * n + max(map(abs, total))) ** 2 < 2**62:
                deviation = [str(v) for v in ((n * x - np.array(total)) ** 2).sum(axis=1).tolist()]
            else:
                centred = n * x.astype(object) - np.array(total, object)
                deviation = [str(v) for v in (centred * centred).sum(axis=1).tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * top), pa.array(w.ravel()))
            yield batch([("digest", part.column(2)), ("deviation", pa.array(deviation)), ("w", lists), ("weight", part.column(1))])

    made = stored(map_arrow(fit, whitened, "digest binary, deviation string, w array<double>, weight long"), "whitened")

    def products_of_whitened(batches):
        grams = np.zeros((top, top))
        for b in batches:
            w = np.asarray(b.column(0).flatten()).reshape(b.num_rows, top)
            w = w - centre
            grams += (w * np.asarray(b.column(1))[:, None]).T @ w
        i, j = np.triu_indices(top)
        yield batch([("i", i.astype(np.int32)), ("j", j.astype(np.int32)), ("value", grams[i, j])])

    centre = np.array(made.select(*[(F.sum(F.col("w")[k] * F.col("weight")) / n).alias(f"c{k}") for k in range(top)]).first())
    identity = _gram(map_arrow(made.select("w", "weight"), products_of_whitened, "i int, j int, value double"), top) / n - np.eye(top)
    identity = identity[np.ix_(live, live)]
    error = float(np.abs(identity).max(initial=0.0))
    explained = [float(v / trace) if trace > 0 else 0.0 for v in np.maximum(values, 0)]

    facts = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.lit(explained[k]).alias("explained"), F.lit(bool(live[k])).alias("live")) for k in range(top)])
    joined = rows.select("row_id", "digest").join(made.select("digest", "deviation", "w"), "digest")
    each = joined.select("row_id", "deviation", "w", F.explode(facts).alias("f"))
    return each.select(
        col("row_id").alias(name), "f.component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        F.when(F.col("f.live"), F.col("w")[F.col("f.component") - 1]).alias("whitened"), "f.explained", F.lit(error).alias("identity_error"),
    )
