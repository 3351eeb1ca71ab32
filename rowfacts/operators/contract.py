"""Answers of a model about the structure of files, held against the contract: a row for each answer, checked by Column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sniff import canonical_encoding
from ..sources.structure import FORMATS, Structure, unique_names

#: An answer's fields.  One of another type counts as missing.
ANSWER = (
    "classification string, format string, encoding string, has_header boolean, header_row int, skip_rows int, delimiter string, quote_char string, escape_char string, "
    "columns array<string>, fixed_widths array<int>, xml_record_path string, xml_namespaces map<string,string>, json_record_path string, confidence double, reason string"
)
FIELDS = tuple(part.split()[0] for part in ANSWER.split(", "))
# Classes of files, words for delimiters, and the limits of a structure.
CLASSES = ("structured", "unstructured", "insufficient_sample")
DELIMITER_WORDS = {
    "\\t": "\t",
    "tab": "\t",
    "tabulation": "\t",
    "табуляция": "\t",
    "comma": ",",
    "запятая": ",",
    "semicolon": ";",
    "точка с запятой": ";",
    "pipe": "|",
    "vertical bar": "|",
    "space": " ",
    "пробел": " ",
}
MOST_COLUMNS, LONGEST_NAME, MOST_SKIPPED, WIDEST = 2000, 256, 1000, 100_000
LONGEST_REASON, LONGEST_PATH, LONGEST_NAMESPACE = 2000, 512, 1024
# Names of elements and prefixes.
_NAME = r"[\p{L}_][\w\-.]*"
_PATH = rf"(?U)^/?({_NAME}:)?{_NAME}(/({_NAME}:)?{_NAME})*$"
_ISSUES = "array<struct<code:string,message:string>>"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _blank(c: Column) -> Column:
    return c.isNull() | (_trim(c) == "")


def delimiter_character(value: Column) -> Column:
    """The character that a delimiter's name or spelling stands for; other texts stay."""
    bare = _trim(value)
    words = F.create_map(*[F.lit(x) for pair in DELIMITER_WORDS.items() for x in pair])
    return F.when(F.length(value) == 1, value).otherwise(F.coalesce(words[F.lower(bare)], F.when(F.length(bare) == 1, bare), value))


def xml_path(value: Column) -> Column:
    """A path of elements without leading ``./`` and trailing slashes."""
    bare = F.regexp_replace(_trim(value), r"^(\./)+", "")
    return F.when(F.length(bare) > 1, F.regexp_replace(bare, "/+$", "")).otherwise(bare)


def _issues(*found: tuple[Column, str, Column | None]) -> Column:
    """The issues whose condition holds, in order, each with the value at fault."""
    made = [F.when(when, F.struct(F.lit(code).alias("code"), (F.lit(None) if value is None else value).cast("string").alias("message"))) for when, code, value in found]
    return F.filter(F.array(*made), lambda x: x.isNotNull()).cast(_ISSUES) if made else F.array().cast(_ISSUES)


def _each(values: Column, bad, code: str) -> Column:
    """An issue for each of ``values`` that is bad."""
    return F.coalesce(F.transform(F.filter(values, bad), lambda x: F.struct(F.lit(code).alias("code"), x.cast("string").alias("message"))), F.array()).cast(_ISSUES)


def checked_structures(answers: DataFrame, answer: str, detected: str | None = None) -> DataFrame:
    """``answers`` with structure, errors and warnings: the normalised answer, and what the contract has against it.

    ``answer`` is the model's JSON text, ``detected`` a column with the encoding told from the file's bytes,
    which wins over the answer's.  Text that is no JSON object, and null, have the error answer_missing and no structure.
    A file may be read where errors is empty and its class is structured.  Columns of ``answers`` with the
    new names give way to them.  Lengths are in code points.
    """
    kept = [c for c in answers.columns if c not in ("structure", "errors", "warnings")]
    read = F.when(F.trim(F.col(answer)).startswith("{"), F.from_json(F.col(answer), ANSWER))
    told = F.col(detected) if detected else F.lit(None).cast("string")
    d = answers.select(F.struct(*answers.columns).alias("_row"), read.alias("_a"), canonical_encoding(told).alias("_told"))
    d = d.select("_row", "_told", F.col("_a").isNull().alias("_none"), *[F.col("_a")[f].alias(f) for f in FIELDS])

    # Values in their canonical form.
    d = d.withColumns({"_class": F.lower(_trim(F.col("classification"))), "_format": F.lower(_trim(F.col("format"))), "_proposed": canonical_encoding(F.col("encoding"))})
    known = F.coalesce(F.col("_class").isin(*CLASSES), F.lit(False))
    structured = known & (F.col("_class") == "structured")
    is_format = lambda *names: F.coalesce(structured & F.col("_format").isin(*names), F.lit(False))
    cells, widths, xml, json = is_format("delimited"), is_format("fixed_width"), is_format("xml"), is_format("jsonl", "json_array")
    lines = cells | widths
    empty = lambda c: F.when(cells & (c == ""), None).otherwise(c)
    d = d.withColumns(
        {
            "_cells": cells,
            "_widths": widths,
            "_xml": xml,
            "_delimiter": F.when(cells, delimiter_character(F.col("delimiter"))).otherwise(F.col("delimiter")),
            "_quote": empty(F.col("quote_char")),
            "_escape": empty(F.col("escape_char")),
            "_skip": F.when(lines, F.coalesce("skip_rows", F.lit(0))).otherwise(F.col("skip_rows")),
            "_path": F.when(xml, xml_path(F.col("xml_record_path"))).otherwise(F.col("xml_record_path")),
        }
    )
    unsure = F.coalesce(F.isnan("confidence") | ~F.col("confidence").between(0, 1), F.lit(False))
    sure = lambda c: F.coalesce(c, F.lit(False))
    family = lambda c: F.when(c.isin("utf-8-sig", "ascii"), "utf-8").otherwise(c)
    cells, widths, xml = F.col("_cells"), F.col("_widths"), F.col("_xml")
    lines = cells | widths

    # Header and skipped rows: the first of these that fails ends their check.
    skip_bad = lines & ~F.col("_skip").between(0, MOST_SKIPPED)
    header_missing = lines & ~skip_bad & F.col("has_header").isNull()
    header = sure(lines & ~skip_bad & F.col("has_header"))
    no_header = sure(lines & ~skip_bad & ~F.col("has_header"))
    header_off = sure(header & (F.col("header_row") != F.col("_skip")))

    # Columns and widths.
    no_widths = widths & (F.coalesce(F.size("fixed_widths"), F.lit(0)) <= 0)
    n, m = F.coalesce(F.greatest(F.size("columns"), F.lit(0)), F.lit(0)), F.size("fixed_widths")
    named = lines & ~no_widths
    too_many = named & (n > MOST_COLUMNS)
    uneven = widths & named & (n > 0) & ~too_many & (n != m)
    usable = named & (n > 0) & ~too_many & ~uneven
    numbered = widths & named & (n == 0)
    short = F.transform("columns", lambda c: F.substring(_trim(F.coalesce(c, F.lit(""))), 1, LONGEST_NAME))
    long_names = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.length(_trim(F.get("columns", i - 1))) > LONGEST_NAME)
    d = d.withColumns({"_usable": usable, "_numbered": numbered, "_short": F.when(usable, short)})
    # Names are compared without case and numbered one after the other, a small loop over one answer's columns.
    unique = F.udf(lambda names: names and unique_names(names), "array<string>")
    d = d.withColumn("_unique", unique("_short"))
    made = F.when(F.col("_usable"), F.col("_unique")).when(F.col("_numbered"), F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.concat(F.lit("Колонка "), i.cast("string")))).otherwise(F.col("columns"))

    # XML.
    no_path = xml & _blank(F.col("_path"))
    bad_path = sure(xml & ~no_path & ((F.length("_path") > LONGEST_PATH) | ~F.col("_path").rlike(_PATH)))
    good_path = xml & ~no_path & ~bad_path
    spaces = F.coalesce("xml_namespaces", F.create_map().cast("map<string,string>"))
    entries = F.map_entries(spaces)
    bad_space = F.transform(F.filter(entries, lambda e: ~e["key"].rlike(f"(?U)^{_NAME}$") | _blank(e["value"]) | (F.length(e["value"]) > LONGEST_NAMESPACE)), lambda e: e["key"])
    steps = F.transform(F.filter(F.split(F.regexp_replace("_path", "^/+|/+$", ""), "/"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.substring_index(x, ":", 1))

    width_off = F.exists("fixed_widths", lambda w: F.coalesce(w <= 0, F.lit(True)) | (w > WIDEST))
    foreign = sure(structured & ~F.coalesce(F.col("_format").isin(*FORMATS), F.lit(False)))
    delimiter, quote, escape = F.col("_delimiter"), F.col("_quote"), F.col("_escape")
    none = F.array().cast(_ISSUES)
    errors = F.concat(
        _issues(
            (F.col("_none"), "answer_missing", None),
            (~F.col("_none") & ~known, "classification_invalid", F.col("classification")),
            (foreign, "format_invalid", F.col("format")),
            (cells & F.coalesce(delimiter == "", F.lit(True)), "delimiter_missing", None),
            (sure(cells & (F.length(delimiter) > 1)), "delimiter_too_long", delimiter),
            (sure(cells & delimiter.isin("\r", "\n")), "delimiter_line_break", None),
            (sure(cells & (F.length(quote) != 1)), "quote_too_long", quote),
            (sure(cells & (F.length(escape) != 1)), "escape_too_long", escape),
            (sure(cells & (quote == delimiter)), "quote_is_delimiter", quote),
            (sure(cells & (escape == delimiter)), "escape_is_delimiter", escape),
            (skip_bad, "skip_rows_out_of_range", F.col("_skip")),
            (header_missing, "has_header_missing", None),
            (header_off, "header_row_differs", F.col("header_row")),
            (no_widths, "widths_missing", None),
            (sure(widths & (m > MOST_COLUMNS)), "too_many_widths", m),
            (sure(widths & width_off), "width_out_of_range", None),
            (cells & (n == 0), "columns_missing", None),
            (too_many, "too_many_columns", n),
            (sure(uneven), "columns_differ_from_widths", n),
            (no_path, "record_path_missing", None),
            (bad_path, "record_path_invalid", F.col("_path")),
            (sure(json & ~_blank(F.col("json_record_path"))), "json_record_path_unsupported", F.col("json_record_path")),
        ),
        F.when(good_path, _each(bad_space, lambda x: F.lit(True), "namespace_invalid")).otherwise(none),
        F.when(good_path, _each(steps, lambda p: ~F.array_contains(F.map_keys(spaces), p), "prefix_undeclared")).otherwise(none),
    )
    warnings = F.concat(
        _issues(
            (known & unsure, "confidence_ignored", F.col("confidence")),
            (known & ~_blank(F.col("encoding")) & F.col("_proposed").isNull(), "encoding_unsupported", F.col("encoding")),
            (sure(known & (family(F.col("_told")) != family(F.col("_proposed")))), "encoding_differs", F.col("_proposed")),
            (header & F.col("header_row").isNull(), "header_row_assumed", F.col("_skip")),
            (no_header & F.col("header_row").isNotNull(), "header_row_ignored", F.col("header_row")),
            (F.col("_numbered"), "columns_numbered", m),
        ),
        F.when(F.col("_usable"), _each(long_names, lambda x: F.lit(True), "column_name_cut")).otherwise(none),
        _issues((sure(F.col("_usable") & (F.col("_unique") != F.col("_short"))), "columns_renamed", None)),
    )
    row = F.when(header & F.col("header_row").isNull(), F.col("_skip")).when(no_header, None).otherwise(F.col("header_row"))
    reason = F.when(known & (F.length("reason") > LONGEST_REASON), F.concat(F.substring("reason", 1, LONGEST_REASON), F.lit("…"))).otherwise(F.col("reason"))
    shown = {
        "classification": F.col("_class"),
        "format": F.when(structured, F.col("_format")).otherwise(F.col("format")),
        "encoding": F.when(known, F.coalesce("_told", "_proposed")).otherwise(F.col("encoding")),
        "header_row": row,
        "skip_rows": F.col("_skip"),
        "delimiter": delimiter,
        "quote_char": quote,
        "escape_char": escape,
        "columns": made,
        "xml_record_path": F.col("_path"),
        "xml_namespaces": F.when(good_path, spaces).otherwise(F.col("xml_namespaces")),
        "json_record_path": F.when(json, None).otherwise(F.col("json_record_path")),
        "confidence": F.when(known & unsure, None).otherwise(F.col("confidence")),
        "reason": reason,
    }
    structure = F.struct(*[shown.get(f, F.col(f)).alias(f) for f in FIELDS])
    return d.select(*[F.col("_row")[c].alias(c) for c in kept], F.when(~F.col("_none"), structure).alias("structure"), errors.alias("errors"), warnings.alias("warnings"))


def as_structure(checked: Mapping) -> Structure:
    """What a reader takes, from the structure of one answer without errors."""
    s = checked
    if s["classification"] != "structured":
        raise ValueError(f"a file that is {s['classification']} cannot be read")
    cells = s["format"] == "delimited"
    return Structure(
        s["format"],
        encoding=s["encoding"],
        has_header=bool(s["has_header"]),
        skip_rows=s["skip_rows"] or 0,
        delimiter=s["delimiter"] if cells else ";",
        quote=s["quote_char"] if cells else None,
        escape=s["escape_char"] if cells and s["escape_char"] != s["quote_char"] else None,
        columns=tuple(s["columns"] or ()) if s["format"] in ("delimited", "fixed_width") else (),
        widths=tuple(s["fixed_widths"] or ()) if s["format"] == "fixed_width" else (),
        record_path=s["xml_record_path"] or "" if s["format"] == "xml" else "",
        namespaces=dict(s["xml_namespaces"] or {}) if s["format"] == "xml" else {},
    )
