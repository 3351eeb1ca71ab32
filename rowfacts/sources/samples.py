"""Samples of files: the first lines of each, with what its first bytes say about encoding, kind and line ends."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .folders import walk
from .records import _open
from .sniff import CODECS, MARKS, WIDE, binary_kind, byte_order_mark, canonical_encoding, control_share, looks_binary, sniff

# Sizes of a sample.
SAMPLE_LINES, SAMPLE_BYTES, MOST_LINES, MOST_BYTES = 5, 1 << 16, 1000, 1 << 24
_BREAK = "\r\n|\r|\n"

def _occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("long")


def prefix_text(head: bytes, encoding: str, whole: bool) -> str:
    """The text of a file's first bytes without its byte order mark; a character that the end of the bytes cuts in two is left out.

    Wrong bytes become U+FFFD.
    """
    mark = next((len(data) for data, name in MARKS if head.startswith(data) and name.removesuffix("-sig") == encoding.removesuffix("-sig")), 0)
    codec = CODECS[encoding].removesuffix("-sig").removesuffix("_sig")
    return codecs.getincrementaldecoder(codec)("replace").decode(head[mark:], whole)


def _with_text(batches):
    """Adds the text of each head that has an encoding."""
    for b in batches:
        columns = [b.column(n).to_pylist() for n in ("head", "encoding", "whole", "shown")]
        texts = [prefix_text(h, e, w) if s else None for h, e, w, s in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "_text"])


def sample_files(spark: SparkSession, path: str, most_lines: int = SAMPLE_LINES, most_bytes: int = SAMPLE_BYTES, encoding: str | None = None) -> DataFrame:
    """A row for each file at ``path``: what a sample of its first lines and bytes says.

    file_id, length, is_empty, binary_kind, encoding, encoding_source, confidence, bom, lines (the
    first ``most_lines``, cut at CR LF, LF or CR), bytes_read, whole (the bytes are all of the file),
    truncated (the bytes end before the lines do), truncated_line (the place of the line that they cut,
    from 0), fewer_lines (the file has fewer lines than asked for), line_terminator (crlf, lf, cr, mixed,
    or null without any) and replacement_count.  Empty and binary files have no lines and no encoding.
    A given ``encoding`` is used instead of the one told.
    """
    if not (1 <= most_lines <= MOST_LINES and 1024 <= most_bytes <= MOST_BYTES):
        raise ValueError(f"a sample has 1 to {MOST_LINES} lines and 1024 to {MOST_BYTES} bytes")

    def read(batches):
        for b in batches:
            heads = []
            for file in b.column(0).to_pylist():
                with _open(file) as f:
                    heads.append(f.read(most_bytes + 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([h[:most_bytes] for h in heads], pa.binary()), pa.array([len(h) <= most_bytes for h in heads], pa.bool_())], names=["file_id", "length", "head", "whole"])

    found = walk(spark, path)[0].select(F.col("path").alias("file_id"), "length")
    heads = found.mapInArrow(read, "file_id string, length long, head binary, whole boolean")
    h, whole = F.col("head"), F.col("whole")
    if encoding is None:
        told = sniff(heads, "head", "whole").withColumnRenamed("source", "encoding_source")
    else:
        given = F.lit(encoding)
        known = canonical_encoding(given)
        latin = F.decode(h, "ISO-8859-1")
        kind = F.coalesce(binary_kind(h), F.when(~known.isin(*WIDE) & looks_binary(control_share(latin), latin), "unknown_binary"))
        told = heads.withColumn("binary_kind", kind).withColumns({"encoding": F.coalesce(known, F.raise_error(F.concat(F.lit("unknown encoding "), given)).cast("string")), "confidence": F.lit(1.0), "encoding_source": F.lit("override")})
    told = told.withColumn("bom", byte_order_mark(h))
    mark_size = F.coalesce(F.create_map(*[F.lit(x) for data, name in MARKS for x in (name, len(data))])[F.col("bom")], F.lit(0))
    told = told.withColumns({"is_empty": whole & (F.length(h) == mark_size), "bytes_read": F.length(h).cast("long")})
    told = told.withColumn("shown", ~F.col("is_empty") & F.col("binary_kind").isNull())
    cut = told.mapInArrow(_with_text, StructType([*told.schema, StructField("_text", StringType())])).withColumn("_parts", F.split("_text", _BREAK))
    shown = F.col("shown")
    n = F.size("_parts")
    rest = F.length(F.element_at("_parts", -1)) > 0
    full = n > most_lines  # so many line ends
    lines = F.when(full, F.slice("_parts", 1, most_lines)).when(rest, F.col("_parts")).otherwise(F.slice("_parts", F.lit(1), F.greatest(n - 1, F.lit(0))))
    crlf = _occurrences(F.col("_text"), "\r\n")
    # A last CR may be the first half of a line end that the bytes cut.
    half = F.when(~whole & F.endswith("_text", F.lit("\r")), 1).otherwise(0)
    cut = cut.withColumns({"_crlf": crlf, "_cr": _occurrences(F.col("_text"), "\r") - crlf - half, "_lf": _occurrences(F.col("_text"), "\n") - crlf})
    kinds = F.filter(F.array(*[F.when(F.col(f"_{k}") > 0, k) for k in ("crlf", "lf", "cr")]), lambda k: k.isNotNull())
    return cut.select(
        "file_id", "length", "is_empty", F.when(~F.col("is_empty"), F.col("binary_kind")).alias("binary_kind"), F.when(shown, F.col("encoding")).alias("encoding"), F.when(shown, F.col("encoding_source")).alias("encoding_source"),
        F.when(shown, F.col("confidence")).otherwise(0.0).alias("confidence"), "bom", F.when(shown, lines).otherwise(F.array().cast("array<string>")).alias("lines"), "bytes_read", "whole",
        (shown & ~full & ~whole).alias("truncated"), F.when(shown & ~full & rest & ~whole, n - 1).alias("truncated_line"), (whole & (F.col("is_empty") | shown & (F.size(lines) < most_lines))).alias("fewer_lines"),
        F.when(F.size(kinds) == 1, kinds[0]).when(F.size(kinds) > 1, "mixed").alias("line_terminator"), F.coalesce(_occurrences(F.col("_text"), "�"), F.lit(0)).alias("replacement_count"),
    )
