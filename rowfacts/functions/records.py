"""Functions of records: hashes, codes, estimates and the JSON documents of observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import TITLES, title
from .text import digits_only

RECORD = (
    "file_id string, ordinal long, line long, end_line long, fields array<struct<name:string,value:string>>, hash string, error struct<code:string,message:string>"
)
# Bytes around a record and around a chunk of records.
RECORD_OVERHEAD, CHUNK_OVERHEAD = 160, 1024
FACTS = "array<struct<type:string,label:string,value:string,normalized_value:string,source_column:string,evidence:string,search_key:string>>"
UNRESOLVED = "array<struct<field:string,raw_value:string,reason:string>>"
ALL_JSON = f"schema_version int, kind string, identity_status string, facts {FACTS}, unresolved_fields {UNRESOLVED}, warnings array<string>"


def record_json(fields: Column) -> Column:
    """The compact JSON [[name, value], ...] in the fields' own order."""
    pairs = F.transform(fields, lambda f: F.array(f["name"], f["value"]))
    return F.to_json(pairs, {"ignoreNullFields": "false"})


def record_hash(fields: Column) -> Column:
    """SHA-256 of a record's JSON."""
    return F.sha2(record_json(fields), 256)


def record_bytes(fields: Column) -> Column:
    """What a record takes in a chunk: the bytes of its JSON and what goes around it."""
    return (F.octet_length(record_json(fields)) + RECORD_OVERHEAD).cast("long")


def extraction_version(prompt: Column, *parts: Column) -> Column:
    """The prompt's name and 16 hex digits over everything that shapes an extraction; nulls count as empty."""
    joined = F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(prompt, F.lit("-"), F.substring(F.sha2(joined, 256), 1, 16))


def file_code(path: Column, content_hash: Column) -> Column:
    """T_ and 18 digits that follow from the path and the content."""
    number = F.conv(F.substring(F.sha2(F.concat_ws("\n", path, content_hash), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return F.concat(F.lit("T_"), F.lpad((number % F.lit(10**18).cast("decimal(20,0)")).cast("string"), 18, "0"))


def token_estimate(x: Column) -> Column:
    """Tokens of a text: 3.6 ASCII or 1.8 other UTF-16 units each, and one; 0 if empty."""
    ascii_ = F.length(F.regexp_replace(x, r"[^\x00-\x7F]", ""))
    wide = F.length(F.regexp_replace(x, r"[^\x{10000}-\x{10FFFF}]", ""))
    estimate = F.ceil(ascii_ / F.lit(3.6) + (F.length(x) - ascii_ + wide) / F.lit(1.8)) + 1
    return F.when(F.length(x) > 0, estimate).otherwise(F.lit(0)).cast("long")


def evidence_text(fields: Column) -> Column:
    """``name: value`` lines of the fields that are not blank."""
    kept = F.filter(fields, lambda f: F.length(F.trim(F.coalesce(f["value"], F.lit("")))) > 0)
    return F.array_join(F.transform(kept, lambda f: F.concat(f["name"], F.lit(": "), f["value"], F.lit("\n"))), "")


def row_prompt(row_id: Column, fields: Column) -> Column:
    return F.to_json(F.struct(row_id.alias("source_row_id"), F.map_from_entries(fields).alias("fields")))


def all_json(kind: Column, identity_status: Column, facts: Column, unresolved: Column, warnings: Column, provenance: Column | None = None, rejected: Column | None = None) -> Column:
    """The JSON document of an observation; where it came from and rejected candidates are shown if given and not empty."""
    more = [] if provenance is None else [provenance.alias("provenance")]
    if rejected is not None:
        more.append(F.when(F.size(rejected) > 0, rejected).alias("rejected_candidates"))
    return F.to_json(
        F.struct(
            F.lit(1).alias("schema_version"),
            kind.alias("kind"),
            identity_status.alias("identity_status"),
            facts.alias("facts"),
            unresolved.alias("unresolved_fields"),
            F.array_distinct(warnings).alias("warnings"),
            *more,
        )
    )


def parse_all_json(x: Column) -> Column:
    """The document as a struct; facts of unknown types are left out."""
    doc = F.from_json(x, ALL_JSON)
    return doc.withField("facts", F.filter(doc["facts"], lambda f: f["type"].isin(*TITLES)))


def is_json(x: Column) -> Column:
    return F.try_parse_json(x).isNotNull()


def file_text(name: Column, code: Column) -> Column:
    """Words under which a file is found: its name, the name's parts, its code and the code's digits."""
    parts = F.trim(F.regexp_replace(name, r"[^\p{L}\p{Nd}]+", " "))
    return F.substring(F.concat_ws(" ", name, parts, code, digits_only(code)), 1, 2000)


def facts_text(facts: Column, unresolved: Column) -> Column:
    """Values, stored forms that differ, and labels of all facts, then the raw values that stayed unresolved."""
    said = F.transform(facts, lambda f: F.concat_ws(" ", f["value"], F.when(f["normalized_value"] != f["value"], f["normalized_value"]), f["label"]))
    parts = F.filter(F.concat(said, F.transform(unresolved, lambda u: u["raw_value"])), lambda x: F.length(F.trim(x)) > 0)
    return F.array_join(parts, " ")


def search_text(surname: Column, name: Column, patronymic: Column, birth_date: Column, birth_place: Column, facts: Column, file: Column) -> Column:
    blank = lambda x: F.when(F.length(F.trim(x)) > 0, x)
    dates = [F.date_format(birth_date, "yyyy-MM-dd"), F.date_format(birth_date, "dd.MM.yyyy")]
    return F.concat_ws(" ", blank(surname), blank(name), blank(patronymic), *dates, blank(birth_place), blank(facts), blank(file))


def facts_summary(facts: Column, unresolved: Column, shown: int = 4, total: Column | None = None) -> Column:
    """The first facts as ``Title: value``, how many more there are (of ``total``, if ``facts`` are the first ones only), or a dash."""
    total = F.size(facts) if total is None else total
    first = F.array_join(F.transform(F.slice(facts, 1, shown), lambda f: F.concat(title(f["type"]), F.lit(": "), f["value"])), "; ")
    more = F.when(total > shown, F.concat(F.lit("; ещё "), (total - shown).cast("string"))).otherwise("")
    open_ = F.when(F.size(unresolved) > 0, F.array_join(F.transform(unresolved, lambda u: F.concat(F.lit("? "), u["raw_value"])), "; ")).otherwise("")
    whole = F.concat_ws("; ", F.when(F.size(facts) > 0, F.concat(first, more)), F.when(open_ != "", open_))
    return F.when(F.length(whole) > 0, whole).otherwise("—")


def details_json(warnings: Column, rejected: Column, most: int = 50) -> Column:
    return F.to_json(F.struct(F.slice(F.array_distinct(warnings), 1, most).alias("warnings"), F.slice(rejected, 1, most).alias("rejected")))


def cost_estimate(records: Column, rows_per_request: int, tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """struct<requests, cost>: whole requests, and the price of tokens per million."""
    requests = F.ceil(records / F.lit(rows_per_request))
    cost = (tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)) / F.lit(1_000_000)
    return F.struct(requests.alias("requests"), cost.alias("cost"))
