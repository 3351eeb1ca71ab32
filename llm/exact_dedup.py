"""Exact deduplication with a two-pass Bloom filter.

Pass 1 hashes every normalised text and marks, in a Bloom filter of bounded size, the bits that two
or more rows hit.  Pass 2 splits the rows: those whose bits are all marked are possibly repeated and
shuffle by their SHA-256; all others pass straight through as groups of one.  A false positive only
shuffles a row more; equality is decided by the SHA-256 alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import hits, repeated_plane
from .common import batch, checkpoint, col, free_name, keyed, map_arrow, stored, with_key

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _digests(batches):
    for b in batches:
        texts = b.column(2).cast(pa.large_binary()).fill_null(b"")
        hashed = [hashlib.sha256(t.as_buffer().to_pybytes().translate(_LOWER)).digest() for t in texts]
        key = np.frombuffer(b"".join(hashed), np.uint64)[::4] if hashed else np.zeros(0, np.uint64)
        yield batch([("doc_key", b.column(0)), ("doc_id", b.column(1)), ("key", key), ("sha", pa.array(hashed, pa.binary()))])


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unique: bool = False) -> DataFrame:
    """(doc_key, doc_id, keep_id, group_size, kept, sha): one row for each row of ``docs``.

    Texts are equal if identical after lower-casing A-Z; null counts as the empty text.  Of equal
    texts the row with the largest id stays; rows of equal or null ids are ordered as ``keyed`` says
    (nulls lowest), and of fully equal rows one stays.  Other columns are not read.  An empty table
    gives an empty result.  ``unique`` as in ``common.keyed``.
    """
    schema = "doc_key long, doc_id long, key long, sha binary"
    hashed = stored(map_arrow(keyed(docs, id_col, text_col, unique), _digests, schema), "digests")
    plane, bits = repeated_plane(hashed, hashed.count())
    seen = docs.sparkSession.sparkContext.broadcast(plane)

    def flag(batches):
        for b in batches:
            key = np.asarray(b.column(1)).view(np.uint64)
            yield batch([("doc_key", b.column(0)), ("doc_id", b.column(2)), ("sha", b.column(3)), ("maybe", hits(key, seen.value, bits))])

    rows = map_arrow(hashed.select("doc_key", "key", "doc_id", "sha"), flag, "doc_key long, doc_id long, sha binary, maybe boolean")
    maybe = rows.where("maybe").drop("maybe")
    # Copies combine before the shuffle; the checkpoint lets adaptive execution split a hot group in the join.
    groups = checkpoint(
        maybe.groupBy(F.col("sha").alias("group_sha"))
        .agg(F.max(F.struct("doc_key", "doc_id")).alias("last"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    joined = maybe.join(groups, maybe.sha == groups.group_sha, "left").select(
        "doc_key",
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("last.doc_key") == F.col("doc_key"), F.lit(True)).alias("kept"),
        "sha",
    )
    alone = rows.where("NOT maybe").select(
        "doc_key", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return alone.unionByName(joined)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    rows, key = with_key(docs, id_col, text_col)
    dropped = text_groups(rows, key, text_col, unique=True).where("NOT kept").select("doc_key")
    gone = free_name(rows.columns, "gone_key")
    return rows.join(dropped.withColumnRenamed("doc_key", gone), col(key) == F.col(gone), "left_anti").drop(key)
