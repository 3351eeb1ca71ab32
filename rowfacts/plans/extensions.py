"""Extension points: extractors and parsers that are named, and called as table functions from SQL too.

An extractor takes a record's fields as (name, value) pairs and yields persons: dictionaries with the keys of
``PERSON`` and ``candidates``.  A parser takes a file's name and yields records as dictionaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import CANDIDATE_FACT, extract_by_columns

PERSON = "struct<surname:string,name:string,patronymic:string,birth_date:string,birth_evidence:string,birth_place:string>"
EXTRACTED = f"person_index int, person {PERSON}, candidates array<{CANDIDATE_FACT}>"
PARSED = "ordinal long, line long, end_line long, fields array<struct<name:string,value:string>>, error struct<code:string,message:string>"
_FACT = ("type", "label", "value", "source_column", "evidence")
_PERSON = ("surname", "name", "patronymic", "birth_date", "birth_evidence", "birth_place")
_extractors: dict[str, object] = {}
_parsers: dict[str, object] = {}


def register_extractor(spark: SparkSession, name: str, extract: Callable[[list[tuple[str, str | None]]], Iterable[dict]]) -> None:
    """Names an extractor; ``SELECT ... FROM records, LATERAL name(fields)`` calls it too.  A record without persons yields one row, of a null person."""

    class Extractor:
        def eval(self, fields):
            i = -1
            for i, p in enumerate(extract([(f["name"], f["value"]) for f in fields or []])):
                yield i, tuple(p.get(k) for k in _PERSON), [tuple(c.get(k) for k in _FACT) for c in p.get("candidates", [])]
            if i < 0:
                yield 0, None, []

    made = F.udtf(Extractor, returnType=EXTRACTED)
    spark.udtf.register(name, made)
    _extractors[name] = made


def register_parser(spark: SparkSession, name: str, parse: Callable[[str], Iterable[dict]]) -> None:
    """Names a parser of whole files."""

    class Parser:
        def eval(self, file):
            for n, r in enumerate(parse(file), 1):
                yield n, r.get("line"), r.get("end_line"), [(k, v) for k, v in r.get("fields", [])], r.get("error")

    made = F.udtf(Parser, returnType=PARSED)
    spark.udtf.register(name, made)
    _parsers[name] = made


def extract_with(records: DataFrame, name: str = "by_columns", fields: str = "fields") -> DataFrame:
    """``records`` with person and candidates from a named extractor, ready for ``verify``; one row for each person, or one of a null person."""
    if name == "by_columns":
        return extract_by_columns(records, fields)
    if name not in _extractors:
        raise KeyError(f"no extractor is registered as {name}")
    return records.lateralJoin(_extractors[name](F.col(fields).outer()))


def parse_with(files: DataFrame, name: str, file: str = "file_id") -> DataFrame:
    """``files`` joined with the records that a named parser reads from each."""
    if name not in _parsers:
        raise KeyError(f"no parser is registered as {name}")
    return files.lateralJoin(_parsers[name](F.col(file).outer()))
