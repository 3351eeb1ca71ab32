"""Folders listed by tasks: every file below one with its metadata, and a row for each thing that could not be looked at."""

from __future__ import annotations

import errno
import os
import re
import stat
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that one call of a task lists before it hands the rest on, so that large trees spread over tasks.
FOLDERS_A_CALL = 1000
# What a file's extension says.
TEXT = ("csv", "tsv", "tab", "txt", "dat", "prn", "psv", "dsv", "xml", "jsonl", "ndjson", "json", "log", "asc", "lst", "out", "list")
ADAPTER = ("xlsx", "xlsm", "xls", "ods", "docx", "doc", "rtf", "odt", "mdb", "accdb", "dbf")
BINARY = (
    "pdf", "png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp", "heic", "ico", "svgz", "zip", "rar", "7z", "gz", "tgz", "bz2", "xz", "tar", "cab", "iso",
    "exe", "dll", "sys", "msi", "bin", "dmp", "mp3", "wav", "flac", "ogg", "m4a", "mp4", "avi", "mkv", "mov", "wmv", "sqlite", "db", "mdf", "ldf", "bak", "pst",
)
# Names that a system hides.
_HIDDEN = re.compile(r"(?i)\..*|\$recycle\.bin|system volume information|thumbs\.db|desktop\.ini")
_FIELDS = pa.schema([("kind", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("identity", pa.string()), ("issue", pa.string()), ("message", pa.string())])
_SCHEMA = "kind string, path string, length long, modified timestamp, identity string, issue string, message string"


def issue_of(error: OSError) -> str:
    """access_denied, path_too_long or io_error."""
    if isinstance(error, PermissionError) or error.errno in (errno.EACCES, errno.EPERM):
        return "access_denied"
    return "path_too_long" if error.errno == errno.ENAMETOOLONG else "io_error"


def _row(kind: str, path: str, length: int | None = None, modified: datetime | None = None, identity: str | None = None, issue: str | None = None, message: str | None = None) -> tuple:
    return kind, path, length, modified, identity, issue, message


def _fault(path: str, error: OSError) -> tuple:
    return _row("issue", path, issue=issue_of(error), message=error.strerror or str(error))


def _local(folder: str, hidden: bool, follow: bool) -> Iterator[tuple]:
    try:
        entries = os.scandir("/" + folder[5:].lstrip("/"))
    except OSError as error:
        yield _fault(folder, error)
        return
    with entries:
        for e in sorted(entries, key=lambda e: e.name):
            path = f"{folder.rstrip('/')}/{e.name}"
            if not hidden and _HIDDEN.fullmatch(e.name):
                continue
            try:
                if e.is_symlink() and not follow:
                    yield _row("issue", path, issue="link_skipped", message="links are not followed")
                    continue
                found = e.stat()
            except OSError as error:
                yield _fault(path, error)
                continue
            identity = f"{found.st_dev}:{found.st_ino}"
            if stat.S_ISDIR(found.st_mode):
                yield _row("folder", path, identity=identity)
            elif stat.S_ISREG(found.st_mode):
                yield _row("file", path, found.st_size, datetime.fromtimestamp(found.st_mtime, UTC), identity)
            else:
                yield _row("issue", path, issue="not_a_file", message="neither a file nor a folder")


def _remote(folder: str, hidden: bool) -> Iterator[tuple]:
    from pyarrow import fs

    try:
        system, at = fs.FileSystem.from_uri(folder)
        entries = system.get_file_info(fs.FileSelector(at))
    except OSError as error:
        yield _fault(folder, error)
        return
    for e in sorted(entries, key=lambda e: e.base_name):
        path = f"{folder.rstrip('/')}/{e.base_name}"
        if not hidden and _HIDDEN.fullmatch(e.base_name):
            continue
        if e.type == fs.FileType.Directory:
            yield _row("folder", path, identity=path)
        else:
            yield _row("file", path, e.size, e.mtime and e.mtime.astimezone(UTC), path)


def _walk(folders: list[str], hidden: bool, follow: bool, deep: bool = True) -> Iterator[tuple]:
    """Files and issues below folders, and the folders that are left; with links, or if not ``deep``, each folder's own entries only, as a round decides which are new."""
    stack, done = folders[::-1], 0
    deep = deep and not follow
    most = max(FOLDERS_A_CALL, len(folders)) if deep else len(folders)
    while stack and done < most:
        folder = stack.pop()
        done += 1
        for row in _local(folder, hidden, follow) if folder.startswith("file:") else _remote(folder, hidden):
            if row[0] == "folder" and deep:
                stack.append(row[1])
            else:
                yield row
    for folder in stack:
        yield _row("folder", folder)


def walk(spark: SparkSession, path: str, hidden: bool = False, follow: bool = False, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, issues) below the folder ``path``.

    files: path, relative, name, extension, length, modified; empty files too.  issues: path, issue, message
    with access_denied, path_too_long, io_error, link_skipped, not_a_file or cycle.  Hidden names are left out
    unless ``hidden``.  With ``follow`` links are followed, and a folder that is reached twice counts once, by
    the shortest and then first of its paths; the others are cycle issues.  Each round lists the folders that
    the last one left, in tasks; what it finds is written in the shared folder.
    """
    from ..catalog import shared_folder

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    root = system.makeQualified(hadoop).toString().rstrip("/")
    if not system.exists(hadoop) or not system.getFileStatus(hadoop).isDirectory():
        raise FileNotFoundError(f"no folder {path}")
    if root.startswith("file:"):
        root = "file:/" + root[5:].lstrip("/")

    def run(batches):
        for b in batches:
            part: list[tuple] = []
            for row in _walk(b.column(0).to_pylist(), hidden, follow, recursive):
                part.append(row)
                if len(part) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _FIELDS, strict=True)], schema=_FIELDS)
                    part = []
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _FIELDS, strict=True)], schema=_FIELDS)

    store = shared_folder(spark, f"walk-{uuid.uuid4().hex[:8]}")
    todo = spark.createDataFrame([(root,)], "path string")
    cycles, known, depth = [], None, 0
    if follow and root.startswith("file:"):
        top = os.stat("/" + root[5:].lstrip("/")) if os.path.isdir("/" + root[5:].lstrip("/")) else None
        known = spark.createDataFrame([(f"{top.st_dev}:{top.st_ino}",)] if top else [], "identity string")
    levels = []
    while True:
        at = f"{store}/{depth}"
        todo.mapInArrow(run, _SCHEMA).write.parquet(at)
        level = spark.read.schema(_SCHEMA).parquet(at)
        levels.append(level.where("kind <> 'folder'"))
        below = level.where("kind = 'folder'")
        if not recursive:
            break
        if follow:
            first = below.groupBy("identity").agg(F.min("path").alias("path"))
            fresh = first.join(known, "identity", "left_anti") if known is not None else first
            known = fresh.select("identity") if known is None else known.union(fresh.select("identity"))
            again = below.join(fresh.select("path"), "path", "left_anti")
            cycles.append(again.select("path", F.lit("cycle").alias("issue"), F.lit("the folder was reached by another path").alias("message")))
            below = fresh
        if below.isEmpty():
            break
        todo = below.select("path").repartition(F.col("path"))
        depth += 1
    found = levels[0]
    for more in levels[1:]:
        found = found.union(more)
    name = F.element_at(F.split("path", "/"), -1)
    relative = F.substring(F.col("path"), F.lit(len(root) + 2), F.length("path"))
    files = found.where("kind = 'file'").select("path", relative.alias("relative"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), "length", "modified")
    issues = found.where("kind = 'issue'").select("path", "issue", "message")
    for more in cycles:
        issues = issues.union(more)
    return files, issues


def kind_hint(extension: Column) -> Column:
    """text_candidate, adapter_required, binary or unknown, by a file's extension."""
    return F.when(extension.isin(*TEXT), "text_candidate").when(extension.isin(*ADAPTER), "adapter_required").when(extension.isin(*BINARY), "binary").otherwise("unknown")


def hint_reason(extension: Column) -> Column:
    """Why a file is not read as text, or null."""
    hint, dotted = kind_hint(extension), F.concat(F.lit("."), extension)
    return F.when(hint == "adapter_required", F.concat(F.lit("needs an adapter: "), dotted)).when(hint == "binary", F.concat(F.lit("binary by its name: "), dotted)).when((hint == "unknown") & (extension == ""), "no extension").when(hint == "unknown", F.concat(F.lit("extension not known: "), dotted))
