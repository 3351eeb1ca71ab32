"""The record formats as a Spark data source, for batches and streams.

``register(spark)`` makes ``spark.read.format("rowfacts").options(**options(s)).load(path)`` known: a partition a
file, each streamed from its handle.  Filters on ``ordinal`` and ``file_id`` are pushed into the reader:
files that are not asked for are not opened, and records before the first one asked for are passed
over without being flattened or sent.  Large files of one record a line are better read by
``read_records``, which splits them.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from .records import _ARROW, _batches, _open, _parse_file, _shown, finished
from .structure import Structure

NAME = "rowfacts"
SCHEMA = "file_id string, ordinal long, line long, end_line long, fields array<struct<name:string,value:string>>, error struct<code:string,message:string>"
#: Columns that a stream adds: the SHA-256 of the file's content, which tells its versions.
STREAM_SCHEMA = SCHEMA + ", content_hash string"


def options(s: Structure) -> dict[str, str]:
    """The reader's options for a structure."""
    if s.problems():
        raise ValueError("; ".join(s.problems()))
    return {"structure": json.dumps(dataclasses.asdict(s))}


def _structure(opts) -> Structure:
    made = json.loads(opts["structure"])
    return Structure(**{k: tuple(v) if isinstance(v, list) else v for k, v in made.items()})


@dataclasses.dataclass
class FilePart(ds.InputPartition):
    """One file as it was when the read was planned."""

    file: str
    size: int
    changed: int

    def __post_init__(self):
        super().__init__(self.file)


def _system(path: str):
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    system, at = fs.FileSystem.from_uri(path)
    return system, at, "file:" if path.startswith("file:") else path[: path.index(at)] if at in path else path.split("://")[0] + "://"


def listed(path: str) -> list[FilePart]:
    """All files below a folder (or one file) in order, but hidden and marker files and, as in Spark's own sources, those without a byte."""
    from pyarrow import fs

    system, at, lead = _system(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    files = [f for f in found if f.type == fs.FileType.File and f.size and not any(p.startswith((".", "_")) for p in f.path[len(at) :].split("/"))]
    return sorted((FilePart(lead + f.path, f.size, f.mtime_ns or 0) for f in files), key=lambda f: f.file)


def _unchanged(part: FilePart) -> None:
    from pyarrow import fs

    system, at, _ = _system(part.file)
    now = system.get_file_info(at)
    if now.type != fs.FileType.File or (now.size, now.mtime_ns or 0) != (part.size, part.changed):
        raise OSError(f"{part.file} has changed since it was planned; read it again as a new version")


def _hash(file: str) -> str:
    digest = hashlib.sha256()
    with _open(file) as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def _records(part: FilePart, s: Structure, after: int, with_hash: bool) -> Iterator:
    import pyarrow as pa

    _unchanged(part)
    name = part.file if "%" in part.file else part.file.replace(" ", quote(" ")) if "://" in part.file else part.file
    content = _hash(part.file) if with_hash else None
    for b in _batches(_shown(name, n, r) for n, r in _parse_file(part.file, s.encoding or "utf-8", s, after)):
        yield b.append_column("content_hash", pa.array([content] * b.num_rows)) if with_hash else b
    _unchanged(part)


class RecordReader(ds.DataSourceReader):
    def __init__(self, opts):
        self.path, self.structure = opts["path"], _structure(opts)
        self.after, self.files = 0, None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if isinstance(f, ds.GreaterThan) and f.attribute == ("ordinal",):
                self.after = max(self.after, f.value)
            elif isinstance(f, ds.GreaterThanOrEqual) and f.attribute == ("ordinal",):
                self.after = max(self.after, f.value - 1)
            elif isinstance(f, (ds.EqualTo, ds.In)) and f.attribute == ("file_id",):
                wanted = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
                self.files = wanted if self.files is None else self.files & wanted
            else:
                yield f

    def partitions(self) -> Sequence[FilePart]:
        return [p for p in listed(self.path) if self.files is None or p.file in self.files]

    def read(self, partition: FilePart) -> Iterator:
        yield from _records(partition, self.structure, self.after, False)


class RecordStream(ds.DataSourceStreamReader):
    """New and changed files of a folder.  What each offset has added is written to the folder ``log`` first, so a restarted query plans the same batches."""

    def __init__(self, opts):
        self.path, self.log, self.structure = opts["path"], opts["log"].rstrip("/"), _structure(opts)
        self.files_per_batch = int(opts.get("filesPerBatch", "100"))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _entry(self, n: int) -> str:
        return f"{self.log}/{n:012d}.json"

    def _logged(self) -> list[tuple[int, list[FilePart]]]:
        from pyarrow import fs

        system, at, _ = _system(self.log)
        system.create_dir(at, recursive=True)
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".json"))
        out = []
        for name in names:
            with system.open_input_file(f"{at}/{name}") as f:
                out.append((int(name.removesuffix(".json")), [FilePart(*x) for x in json.loads(f.read())]))
        return out

    def latestOffset(self) -> dict:
        logged = self._logged()
        known = {p.file: (p.size, p.changed) for _, parts in logged for p in parts}
        new = [p for p in listed(self.path) if known.get(p.file) != (p.size, p.changed)][: self.files_per_batch]
        n = logged[-1][0] if logged else 0
        if not new:
            return {"n": n}
        system, at, _ = _system(self._entry(n + 1))
        with system.open_output_stream(at + ".new") as f:
            f.write(json.dumps([[p.file, p.size, p.changed] for p in new]).encode())
        system.move(at + ".new", at)
        return {"n": n + 1}

    def partitions(self, start: dict, end: dict) -> Sequence[FilePart]:
        return [p for n, parts in self._logged() if start["n"] < n <= end["n"] for p in parts]

    def read(self, partition: FilePart) -> Iterator:
        yield from _records(partition, self.structure, 0, True)


class RecordSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return STREAM_SCHEMA if "log" in self.options else SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def streamReader(self, schema) -> RecordStream:
        return RecordStream(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)


def load_records(spark: SparkSession, path: str, s: Structure, after: int = 0, files: list[str] | None = None) -> DataFrame:
    """What ``read_records`` gives, through the data source: resumed behind ``after``, of some files alone if named."""
    from pyspark.sql import functions as F

    register(spark)
    made = spark.read.format(NAME).options(**options(s)).load(path)
    if after:
        made = made.where(F.col("ordinal") > after)
    if files is not None:
        made = made.where(F.col("file_id").isin(files))
    return finished(made)


assert _ARROW.names == [c.split()[0] for c in SCHEMA.split(", ")]
