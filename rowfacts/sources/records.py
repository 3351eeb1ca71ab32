"""Record readers: every record of a file with its ordinal, line span, ordered string fields and error.

Formats of one record a line (JSON Lines, fixed width, delimited without quote and escape) are split by
Spark; line numbers and ordinals come from counts of blocks, and fixed-width and delimited lines are cut
by built-in functions.  A file of quoted fields, XML, a JSON array
or UTF-16/32 is one task that reads a file handle, as a record's start depends on all before it; of these
only lines in UTF-16/32 are held whole.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from collections.abc import Iterator
from dataclasses import replace
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.records import CHUNK_OVERHEAD, record_bytes, record_hash
from .folders import hint_reason, kind_hint, walk
from .sniff import CODECS, HEAD_BYTES, WIDE, decode, sniff
from .structure import Structure, unique_names

LONGEST = 16 << 20
csv.field_size_limit(LONGEST)


class Record(NamedTuple):
    line: int | None
    end_line: int | None
    fields: list[tuple[str, str | None]]
    error: tuple[str, str] | None = None


class _Lines:
    """Lines for the csv reader, counted."""

    def __init__(self, text: str | io.TextIOBase):
        self.lines, self.at = io.StringIO(re.sub(r"\r\n?", "\n", text), newline="") if isinstance(text, str) else text, 0

    def __iter__(self):
        return self

    def __next__(self) -> str:
        self.at += 1
        line = next(self.lines).replace("\0", "�")
        return line.removeprefix("\ufeff") if self.at == 1 else line


def _csv_settings(s: Structure) -> dict:
    quoting = {"quotechar": s.quote} if s.quote else {"quoting": csv.QUOTE_NONE}
    return {"delimiter": s.delimiter, "escapechar": s.escape, "strict": True} | quoting


def _csv_record(row: list[str], names: list[str], shown: list[str], start: int, end: int) -> Record:
    if len(row) > len(names):
        return Record(start, end, [], ("field_count_mismatch", f"{len(row)} fields, {len(names)} expected"))
    if len(row) < len(names):
        return Record(start, end, [], ("short_record", f"{len(row)} fields, {len(names)} expected"))
    if shown and [x.strip().casefold() for x in row] == shown:
        return Record(start, end, [], ("structure_changed", "the header occurs again"))
    return Record(start, end, list(zip(names, row, strict=True)))


def delimited(text: str | io.TextIOBase, s: Structure) -> Iterator[Record]:
    """Quoted fields may span lines; blank lines are no records; wrong field counts and quotes are errors."""
    lines = _Lines(text)
    for _ in range(s.skip_rows):
        next(lines, None)
    reader = csv.reader(lines, **_csv_settings(s))
    header = next(reader, []) if s.has_header else []
    names = unique_names(list(s.columns) or header)
    shown = [h.strip().casefold() for h in header]
    while True:
        start = lines.at + 1
        try:
            row = next(reader)
        except StopIteration:
            return
        except csv.Error as e:
            open_ = "unexpected end" in str(e)
            yield Record(start, lines.at - open_, [], ("decode_error", "unclosed quote" if open_ else "wrong use of quotes"))
            continue
        if not row or len(row) == 1 and not row[0].strip() and lines.at == start:
            continue
        if not names:
            names = unique_names([None] * len(row))
        yield _csv_record(row, names, shown, start, lines.at)


def cut(line: str, widths: tuple[int, ...]) -> list[str]:
    """Columns of a fixed-width line; the last one is open to the right."""
    out, at = [], 0
    for i, w in enumerate(widths):
        out.append(line[at : None if i == len(widths) - 1 else at + w].strip(" \t"))
        at += w
    return out


def fixed_width(text: str, s: Structure) -> Iterator[Record]:
    lines = re.split(r"\r\n|\r|\n", text)
    if lines and not lines[-1]:
        lines.pop()
    first = s.skip_rows + s.has_header
    header = cut(lines[s.skip_rows], s.widths) if s.has_header and len(lines) > s.skip_rows else []
    names = unique_names(list(s.columns) or header or [None] * len(s.widths))
    for n, line in enumerate(lines[first:], first + 1):
        values = cut(line, s.widths)
        if any(values):
            yield Record(n, n, list(zip(names, values, strict=True)))


class _Number(str):
    """A JSON number by its source text."""


def flatten(value: dict, prefix: str = "") -> list[tuple[str, str | None]]:
    """Nested objects as ``a.b``, arrays as compact JSON, numbers as written; clashing keys get (2), (3)."""
    out: list[tuple[str, str | None]] = []

    def show(v) -> str | None:
        if v is None:
            return None
        if isinstance(v, bool):
            return "true" if v else "false"
        return str(v) if isinstance(v, str) else compact(v)

    def walk(v: dict, at: str) -> None:
        for k, x in v.items():
            name = f"{at}.{k}" if at else k
            if isinstance(x, dict) and x:
                walk(x, name)
            else:
                out.append((name, show(x)))

    walk(value, prefix)
    own, taken, named = {name for name, _ in out}, set(), []
    for name, v in out:
        shown, k = name, 1
        while shown in taken or k > 1 and shown in own:
            k += 1
            shown = f"{name} ({k})"
        taken.add(shown)
        named.append((shown, v))
    return named


def compact(v) -> str:
    if isinstance(v, _Number):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{compact(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(compact, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


_JSON = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_Number)


def json_line(line: str, n: int) -> Record:
    try:
        value = _JSON.decode(line.strip())
    except ValueError as e:
        return Record(n, n, [], ("invalid_json", str(e)))
    return Record(n, n, flatten(value)) if isinstance(value, dict) else Record(n, n, [], ("not_an_object", "the line is no JSON object"))


def jsonl(text: str, s: Structure) -> Iterator[Record]:
    for n, line in enumerate(re.split(r"\r\n|\n", text), 1):
        if n > s.skip_rows and line.strip():
            yield json_line(line, n)


#: Characters read at a time, and how near to a buffer's end an error may come from what is not read yet.
READ_CHARS, EDGE_CHARS = 1 << 18, 16


class _Buffer:
    """The unread end of a text, extended from its handle as far as one element needs."""

    def __init__(self, source: io.TextIOBase):
        self.source, self.text, self.at, self.ended, self.line, self.counted = source, "", 0, False, 1, 0

    def more(self) -> bool:
        """Reads on, at least as much as is held, so that a long element is tried a logarithmic number of times."""
        kept = self.text[self.at :]
        self._count(self.at)
        part = self.source.read(max(READ_CHARS, len(kept)))
        self.text, self.at, self.counted, self.ended = kept + part, 0, 0, not part
        return not self.ended

    def _count(self, to: int) -> None:
        self.line += self.text.count("\n", self.counted, to)
        self.counted = to

    def skip(self, signs: str) -> str:
        """The next character that is none of ``signs``, not yet taken; empty at the end."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in signs:
                    return self.text[self.at]
                self.at += 1
            if not self.more():
                return ""

    def element(self, longest: int):
        """(value, first line, last line) of the element that begins here; ValueError where it is broken or too long."""
        while True:
            try:
                value, end = _JSON.raw_decode(self.text, self.at)
            except ValueError as e:
                cut_off = e.msg.startswith(("Unterminated string", "Invalid \\")) or e.pos >= len(self.text) - EDGE_CHARS
                if cut_off and not self.ended and len(self.text) - self.at <= longest and self.more():
                    continue
                raise
            if end == len(self.text) and not self.ended and self.more():
                continue  # a number may go on
            self._count(self.at)
            first = self.line
            self._count(end)
            self.at = end
            return value, first, self.line


def json_array(text: str | io.TextIOBase, s: Structure, after: int = 0, longest: int = LONGEST) -> Iterator[Record]:
    """Objects of one array; the first broken element ends the file.  No more than an element and a block is held.

    The first ``after`` records are passed over: read, but not flattened or yielded.
    """
    buffer = _Buffer(io.StringIO(text, newline="") if isinstance(text, str) else text)
    if buffer.skip(" \t\r\n\ufeff") != "[":
        yield Record(None, None, [], ("invalid_json", "the file is no JSON array"))
        return
    buffer.at += 1
    n = 0
    while buffer.skip(" \t\r\n,") not in ("", "]"):
        try:
            value, first, last = buffer.element(longest)
        except ValueError as e:
            buffer._count(buffer.at)
            yield Record(buffer.line, buffer.line, [], ("invalid_json", str(e)))
            return
        n += 1
        if n > after:
            yield Record(first, last, flatten(value)) if isinstance(value, dict) else Record(first, last, [], ("not_an_object", "the element is no object"))


def _declares_entities(source: io.BufferedIOBase) -> bool:
    """Whether an entity is declared before the first element, where alone that may be."""
    from xml.parsers import expat

    found: list[bool] = []
    reader = expat.ParserCreate()
    reader.EntityDeclHandler = lambda *_: found.append(True)
    reader.StartElementHandler = lambda *_: found.append(False)
    while not found and (part := source.read(1 << 16)):
        try:
            reader.Parse(part)
        except expat.ExpatError:
            break
    return bool(found and found[0])


def xml(content: bytes | io.BufferedIOBase, s: Structure, after: int = 0) -> Iterator[Record]:
    """Elements at the record path, matched by local names or by namespace URI; entities are refused.

    What is done with leaves its parent, so that memory holds one record and the path to it.  The first
    ``after`` records are passed over.
    """
    from xml.etree import ElementTree

    source = io.BytesIO(content) if isinstance(content, bytes) else content
    if _declares_entities(source):
        yield Record(None, None, [], ("forbidden_entity", "entity declarations are not read"))
        return
    source.seek(0)
    absolute = s.record_path.startswith("/")
    path = []
    for part in s.record_path.strip("/").split("/"):
        prefix, _, local = part.strip().rpartition(":")
        path.append((s.namespaces.get(prefix) if prefix else None, local))

    def same(tag: str, want: tuple[str | None, str]) -> bool:
        uri, _, local = tag.rpartition("}")
        return local == want[1] and (want[0] is None or uri[1:] == want[0])

    def fields(e, at: str, out: list) -> None:
        for k, v in e.attrib.items():
            out.append((f"{at}@{k.rpartition('}')[2]}", v))
        text = (e.text or "").strip()
        seen: dict[str, int] = {}
        for x in e:
            name = x.tag.rpartition("}")[2]
            seen[name] = seen.get(name, 0) + 1
            here = f"{at}{name}" + (f"[{seen[name]}]" if seen[name] > 1 else "")
            if len(x) or x.attrib:
                fields(x, here + "/", out)
            else:
                out.append((here, x.text or ""))
        if text:
            out.append((f"{at}#text" if at.endswith("/") or not at else at, text))

    stack, above, inside, n = [], [], 0, 0
    try:
        for event, e in ElementTree.iterparse(source, events=("start", "end")):
            if event == "start":
                stack.append(e.tag)
                above.append(e)
            hit = len(stack) >= len(path) and (not absolute or len(stack) == len(path)) and all(same(t, w) for t, w in zip(stack[-len(path) :], path, strict=True))
            if event == "start":
                inside += hit
                continue
            stack.pop()
            above.pop()
            inside -= hit
            if hit and not inside:  # a match within a record belongs to it
                n += 1
                if n > after:
                    out: list = []
                    fields(e, "", out)
                    yield Record(None, None, out)
            if not inside and above:
                above[-1].remove(e)
    except ElementTree.ParseError as e:
        yield Record(None, None, [], ("invalid_xml", str(e)))


def parse(content: bytes, s: Structure) -> Iterator[Record]:
    """Records of whole content; UTF-8 where the structure names no encoding."""
    if s.format == "json_array":
        return json_array(decode(content, s.encoding or "utf-8"), s)
    if s.format == "xml":
        return xml(content, s)
    return {"delimited": delimited, "fixed_width": fixed_width, "jsonl": jsonl}[s.format](decode(content, s.encoding or "utf-8"), s)


_SCHEMA = "file_id string, ordinal long, line long, end_line long, fields array<struct<name:string,value:string>>, error struct<code:string,message:string>"
_ARROW = pa.schema(
    [("file_id", pa.string()), ("ordinal", pa.int64()), ("line", pa.int64()), ("end_line", pa.int64()), ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("error", pa.struct([("code", pa.string()), ("message", pa.string())]))]
)


def _open(file: str):
    """A seekable handle of a file that Spark names."""
    if file.startswith("file:"):
        return open("/" + file[5:].lstrip("/"), "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(file)
    return system.open_input_file(at)


def _heads(batches):
    """The first bytes of each file, and whether they are all."""
    for b in batches:
        heads = []
        for file in b.column(0).to_pylist():
            with _open(file) as f:
                heads.append(f.read(HEAD_BYTES + 1))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([h[:HEAD_BYTES] for h in heads], pa.binary()), pa.array([len(h) <= HEAD_BYTES for h in heads], pa.bool_())], names=["file_id", "url", "length", "head", "whole"])


def file_heads(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, url, length, binary_kind, encoding, confidence, source) of all files at ``path``, told from their first bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file_id"), F.col("_metadata.file_path").alias("url"), "length")
    heads = found.mapInArrow(_heads, "file_id string, url string, length long, head binary, whole boolean")
    told = sniff(heads, "head", "whole").drop("head", "whole")
    # Filters on the told columns stop here: pushed further they would repeat the expressions behind them.
    return told.mapInArrow(lambda batches: batches, told.schema)


def _parse_file(file: str, encoding: str, s: Structure, after: int = 0) -> Iterator[tuple[int, Record]]:
    """(ordinal, record) of the records behind the first ``after``."""
    with _open(file) as f:
        if s.format == "xml":
            yield from enumerate(xml(f, s, after), after + 1)
        elif s.format == "json_array":
            yield from enumerate(json_array(io.TextIOWrapper(f, CODECS[encoding], "replace", newline=""), s, after), after + 1)
        elif s.format == "delimited":
            yield from islice(enumerate(delimited(io.TextIOWrapper(f, CODECS[encoding], "replace", newline=None), s), 1), after, None)
        else:
            yield from islice(enumerate(parse(f.read(), replace(s, encoding=encoding)), 1), after, None)


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 5000)):
        yield pa.RecordBatch.from_pylist(part, _ARROW)


def _shown(file: str, n: int, r: Record) -> dict:
    return {"file_id": file, "ordinal": n, "line": r.line, "end_line": r.end_line, "fields": [{"name": k, "value": v} for k, v in r.fields], "error": r.error and {"code": r.error[0], "message": r.error[1]}}


def read_records(spark: SparkSession, path: str, s: Structure, after: int = 0, longest: int = LONGEST) -> DataFrame:
    """Records of all files at ``path`` with ordinals from 1; those up to ``after`` are skipped (resume).

    A record whose JSON takes over ``longest`` bytes is the error record_too_large, without its fields.
    """
    if s.problems():
        raise ValueError("; ".join(s.problems()))
    by_line = s.format in ("jsonl", "fixed_width") or s.format == "delimited" and not s.quote and not s.escape

    def run(batches):
        def rows():
            for b in batches:
                for file, encoding in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield from (_shown(file, n, r) for n, r in _parse_file(file, encoding, s, after))

        return _batches(rows())

    if by_line and s.encoding and s.encoding not in WIDE:
        return finished(_line_records(spark, path, s, None, after), longest)
    if s.encoding or s.format == "xml":
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        files = found.select(F.col("path").alias("file_id"), F.col("_metadata.file_path").alias("url"), F.lit(s.encoding or "utf-8").alias("encoding"))
    else:
        # A row for each file, used several times: kept, so that heads are read and told once.
        files = file_heads(spark, path).select("file_id", "url", F.coalesce("encoding", F.lit("utf-8")).alias("encoding")).persist()
    split = F.lit(by_line) & ~F.col("encoding").isin(*WIDE)
    made = files.where(~split).select("file_id", "encoding").mapInArrow(run, _SCHEMA)
    if by_line and s.encoding not in WIDE:
        made = _line_records(spark, path, s, files.where(split), after).unionByName(made)
    return finished(made, longest)


def finished(made: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Parsed records with their hash; one of over ``longest`` bytes is the error record_too_large."""
    good = F.col("error").isNull()
    large = good & (record_bytes(F.col("fields")) + CHUNK_OVERHEAD > longest)
    fault = F.struct(F.lit("record_too_large").alias("code"), F.lit(f"the record is over {longest} bytes").alias("message"))
    none = F.array().cast("array<struct<name:string,value:string>>")
    plain = [c for c in made.columns if c not in ("fields", "error")]
    return made.select(*plain, F.when(large, none).otherwise(F.col("fields")).alias("fields"), F.when(large, fault).otherwise(F.col("error")).alias("error"), F.when(good & ~large, record_hash(F.col("fields"))).alias("hash"))


def text_of(value: Column, encoding: Column) -> Column:
    """The text of a line's bytes in one of the encodings that are not wide; wrong bytes become U+FFFD."""
    latin, high = F.decode(value, "ISO-8859-1"), bytes(range(128, 256))
    made = F
    for name, codec in CODECS.items():
        if name not in WIDE and codec != "utf-8":
            made = made.when(encoding == name, F.translate(latin, high.decode("latin-1"), high.decode(codec, "replace") if codec != "ascii" else "�" * 128))
    return made.otherwise(F.make_valid_utf8(value.cast("string")))


def _cut_names(s: Structure, header: str | None, first: str | None) -> list[str]:
    """The names of a file's columns, from its header or by counting its first record."""
    cells = (lambda line: cut(line, s.widths)) if s.format == "fixed_width" else (lambda line: line.split(s.delimiter))
    size = len(s.widths) if s.format == "fixed_width" else len(cells(first or ""))
    return unique_names(list(s.columns) or (cells(header) if header is not None else []) or [None] * size)


def _cut_lines(placed: DataFrame, heads: DataFrame, s: Structure, with_header: bool, by_file) -> DataFrame:
    """Fixed-width and delimited records, cut by built-in functions."""
    clean = lambda c: F.regexp_replace(F.translate(c, "\0", "�"), "^\ufeff", "")

    def name(batches):  # a row for each file
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_cut_names(s, h if with_header else None, f) for h, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.list_(pa.string()))], names=["file", "header", "names"])

    named = heads.select("file_id", clean("header").alias("header"), clean("first").alias("first")).mapInArrow(name, "file string, header string, names array<string>")
    lines = placed.join(by_file(named), F.col("file_id") == F.col("file")).withColumn("text", F.translate("text", "\0", "�"))
    if s.format == "fixed_width":
        starts = [sum(s.widths[:i]) + 1 for i in range(len(s.widths))]
        cells = F.array(*[F.trim(F.substring("text", a, w if i < len(starts) - 1 else LONGEST), F.lit(" \t")) for i, (a, w) in enumerate(zip(starts, s.widths, strict=True))])
        error = F.lit(None).cast("struct<code:string,message:string>")
    else:
        cells = F.split("text", "\\Q" + s.delimiter + "\\E", -1)
        n, m = F.size("cells"), F.size("names")
        said = F.concat(n.cast("string"), F.lit(" fields, "), m.cast("string"), F.lit(" expected"))
        fault = lambda code, message: F.struct(F.lit(code).alias("code"), message.alias("message"))
        same = lambda x: F.transform(x, lambda v: F.lower(F.trim(v)))
        error = F.when(n > m, fault("field_count_mismatch", said)).when(n < m, fault("short_record", said))
        if with_header:
            error = error.when(same(F.col("cells")) == same(F.split("header", "\\Q" + s.delimiter + "\\E", -1)), fault("structure_changed", F.lit("the header occurs again")))
    lines = lines.withColumn("cells", cells).withColumn("error", error)
    fields = F.zip_with("names", "cells", lambda k, v: F.struct(k.alias("name"), v.alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    return lines.select("file_id", "ordinal", "line", F.col("line").alias("end_line"), F.when(F.col("error").isNull(), fields).otherwise(none).alias("fields"), "error")


#: Files and blocks of them whose headers and counts may be sent to all tasks.
FEW_FILES = 20_000
# What counts as blank in a line, as in Unicode's definition of white space and the separators of ASCII.
BLANK = "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def _line_records(spark: SparkSession, path: str, s: Structure, files: DataFrame | None, after: int) -> DataFrame:
    """Records of the files that Spark splits; ``files`` (file_id, url, encoding) where the structure names no encoding."""
    lead = s.skip_rows + (s.has_header and s.format != "jsonl")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    blocks = found.n + found.bytes // max(1, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    few = blocks <= FEW_FILES

    def by_file(df: DataFrame) -> DataFrame:
        """A row for each file or block, to be joined with lines: sent to all tasks where they are few, so that a large file's lines stay where they are."""
        return F.broadcast(df) if few else df

    lines = spark.read.option("recursiveFileLookup", True)
    if s.format == "jsonl":  # a carriage return alone ends no line
        lines = lines.option("lineSep", "\n")
    lines = lines.text(path).select(F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    if files is None:
        # Names come with escapes, in which a plus is a plus.
        lines = lines.select(F.url_decode(F.replace(F.col("url"), F.lit("+"), F.lit("%2B"))).alias("file_id"), "block", text_of(F.col("value"), F.lit(s.encoding)).alias("text"))
    else:
        # A broadcast join leaves lines in their order; after a shuffle they are put in order again.
        order = [] if few else ["at"]
        placed = lines if few else lines.withColumn("at", F.monotonically_increasing_id())
        lines = placed.join(by_file(files), "url").select("file_id", "block", text_of(F.col("value"), F.col("encoding")).alias("text"), *order)
    some = F.length(F.trim("text", F.lit(" \t"))) > 0 if s.format == "fixed_width" else F.col("text").rlike(f"[^{BLANK}]")
    if s.format == "delimited":
        some = some | F.contains("text", F.lit(s.delimiter))
    every = _numbered(lines.withColumn("filled", some), by_file)
    is_record = F.col("filled") & (F.col("line") > lead)
    heads = every.groupBy("file_id").agg(
        F.count(F.when(F.col("filled") & (F.col("line") <= lead), 1)).alias("lead_filled"),
        F.max(F.when(F.col("line") == lead, F.col("text"))).alias("header"),
        F.min_by(F.when(is_record, F.col("text")), F.when(is_record, F.col("line"))).alias("first"),
    )
    placed = every.where(is_record)
    if lead:
        placed = placed.join(by_file(heads.select("file_id", "lead_filled")), "file_id").withColumn("nth", F.col("nth") - F.col("lead_filled"))
    text = F.when(F.col("line") == 1, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text"))
    placed = placed.select("file_id", "line", F.col("nth").alias("ordinal"), text.alias("text")).where(F.col("ordinal") > after)
    if s.format != "jsonl":
        return _cut_lines(placed, heads, s, lead > s.skip_rows, by_file)

    def run(batches):
        def rows():
            for b in batches:
                for file, line, n, value in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    yield _shown(file, n, json_line(value, line))

        return _batches(rows())

    return placed.select("file_id", "line", "ordinal", "text").mapInArrow(run, _SCHEMA)


def _content_hash(batches):
    """SHA-256 of each file, in blocks of 1 MiB from a handle, so that files may have any size."""
    for b in batches:
        found = []
        for file in b.column(b.num_columns - 1).to_pylist():
            digest = hashlib.sha256()
            with _open(file) as f:
                while part := f.read(1 << 20):
                    digest.update(part)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string())], names=[*b.schema.names[:-1], "content_hash"])


def scan_folder(spark: SparkSession, path: str, hidden: bool = False) -> DataFrame:
    """Files below a folder, empty ones too, with name, extension, kind hint and its reason, size, time and content hash.

    Files and folders whose name begins with a dot, and the system's own, are left out unless ``hidden``.
    """
    files, _ = walk(spark, path, hidden)
    extension = F.col("extension")
    seen = files.select("path", "name", "extension", kind_hint(extension).alias("hint"), hint_reason(extension).alias("reason"), "length", F.col("modified").alias("modificationTime"), F.col("path").alias("url"))
    return seen.mapInArrow(_content_hash, "path string, name string, extension string, hint string, reason string, length long, modificationTime timestamp, content_hash string")


def _number(batches):
    """Adds place and in_block: numbers of the line, and of the filled ones so far, within its block; vectors, as a block's lines come together."""
    key, lines, some = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        file, block = np.asarray(b.column(0).dictionary_encode().indices), np.asarray(b.column(1))
        filled = np.asarray(b.column(3).cast(pa.int64()))
        new = np.r_[True, (file[1:] != file[:-1]) | (block[1:] != block[:-1])]
        starts, run = np.flatnonzero(new), np.cumsum(new) - 1
        place = np.arange(1, b.num_rows + 1) - starts[run]
        total = np.cumsum(filled)
        nth = total - (total[starts] - filled[starts])[run]
        if key == (b.column(0)[0].as_py(), b.column(1)[0].as_py()):
            place[run == 0] += lines
            nth[run == 0] += some
        key, lines, some = (b.column(0)[-1].as_py(), b.column(1)[-1].as_py()), int(place[-1]), int(nth[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(nth)], names=[*b.schema.names, "place", "in_block"])


def _numbered(lines: DataFrame, by_block=lambda df: df) -> DataFrame:
    """(file_id, block, text, filled) with line and nth, the numbers of the line and of the filled ones in its file.

    Lines are numbered within their block, and counts of the blocks before are added.  Lines that a
    join has moved have ``at``, by which their block is put in order again; a block is as large as Spark splits files.
    """
    if "at" in lines.columns:
        within = Window.partitionBy("file_id", "block").orderBy("at")
        counted = lines.withColumns({"place": F.row_number().over(within).cast("long"), "in_block": F.count_if("filled").over(within)}).drop("at")
    else:
        counted = lines.mapInArrow(_number, "file_id string, block long, text string, filled boolean, place long, in_block long")
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy(F.col("file_id").alias("f"), F.col("block").alias("b")).agg(F.max("place").alias("n"), F.max("in_block").alias("m"))
    bases = blocks.select("f", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("full_base"))
    joined = counted.join(by_block(bases), (F.col("file_id") == F.col("f")) & (F.col("block") == F.col("b")))
    return joined.select("file_id", "text", (F.col("base") + F.col("place")).alias("line"), "filled", (F.col("full_base") + F.col("in_block")).alias("nth"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, ordinal, value) of text files that Spark splits."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"), F.lit(True).alias("filled"))
    return _numbered(lines).select("file_id", F.col("line").alias("ordinal"), F.col("text").alias("value"))
