"""What samples of files say about a structure: set queries over lines, fields and records of many files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import corrected_type

# Delimiters that are tried, shares that decide, and the sizes of samples and previews.
DELIMITERS = (";", ",", "\t", "|")
DELIMITED_SHARE, BAD_SHARE, REPLACED_SHARE, NAME_SHARE = 0.8, 0.2, 0.05, 0.8
SAMPLE_LINES, SAMPLE_BYTES, PREVIEW_ROWS = 5, 65536, 100
# What a column's name implies, first match first, and the names of types that values can decide.
NAME_HINTS = {
    "snils": r"(?iu)(?<![\p{L}\p{N}])снилс(?![\p{L}\p{N}])",
    "inn": r"(?iu)(?<![\p{L}\p{N}])инн(?![\p{L}\p{N}])",
    "license_plate": r"(?iuU)госномер|гос\.?\s*номер|номерной\s+знак|\bгрз\b",
    "vin": r"(?iu)(?<![\p{L}\p{N}])vin(?![\p{L}\p{N}])",
    "vehicle": r"(?iu)автомобил|транспорт|машин",
}
CANONICAL_NAMES = {"inn": "ИНН", "snils": "СНИЛС", "license_plate": "Госномер", "vin": "VIN"}


def sample_lines(lines: DataFrame, by: str, ordinal: str, text: str, most: int = SAMPLE_LINES, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(by, ordinal, text, truncated): the first lines of each file within a number of bytes; the last one may be cut.

    Only lines of small ordinals are looked at, so no file gathers in one task.
    """
    size = F.octet_length(text) + 1
    before = Window.partitionBy(by).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    first = lines.where(F.col(ordinal) <= most).withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0)))
    left = F.lit(most_bytes) - F.col("_before")
    cut = F.octet_length(text) > left
    whole = F.make_valid_utf8(F.substring(F.col(text).cast("binary"), F.lit(1), left.cast("int")).cast("string"))
    shown = F.when(cut, F.regexp_replace(whole, "\ufffd+$", "")).otherwise(F.col(text))
    return first.where(left > 0).select(by, ordinal, shown.alias(text), cut.alias("truncated"))


def preview(records: DataFrame, ordinal: str = "ordinal", most: int = PREVIEW_ROWS) -> DataFrame:
    """The first records of each file with their errors."""
    return records.where(F.col(ordinal) <= most)


def delimiter_guess(lines: DataFrame, by: str, text: str) -> DataFrame:
    """(by, delimiter): the one that most filled lines have equally often, if four in five have it; ties go to more fields, then to the later one."""
    filled = lines.where(F.length(F.trim(F.col(text))) > 0)
    tried = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.lit(i).alias("place"), (F.length(text) - F.length(F.replace(F.col(text), F.lit(d)))).alias("n")) for i, d in enumerate(DELIMITERS)])
    counts = filled.select(by, F.explode(tried).alias("t")).groupBy(by, "t.delimiter", "t.place", "t.n").agg(F.count("*").alias("lines"))
    found = counts.groupBy(by, "delimiter", "place").agg(
        F.max(F.when(F.col("n") > 0, F.struct("lines", "n"))).alias("mode"),
        F.sum("lines").alias("total"),
        F.sum(F.when(F.col("n") > 0, F.col("lines")).otherwise(0)).alias("having"),
    )
    fit = found.where(F.col("having") >= DELIMITED_SHARE * F.col("total"))
    return fit.groupBy(by).agg(F.max_by("delimiter", F.struct("mode.lines", "mode.n", "place")).alias("delimiter"))


def _guess(said: str) -> Column:
    """The delimiter that ``delimiter_guess`` finds for an array of the counts (n0, n1 ...) of each delimiter in filled lines."""

    def mode(place: int) -> Column:
        having = F.filter(F.transform(said, lambda x: x[f"n{place}"]), lambda n: n > 0)
        modes = F.transform(F.array_distinct(having), lambda n: F.struct(F.size(F.filter(having, lambda m: m == n)).alias("lines"), n.alias("n"), F.lit(place).alias("place")))
        return F.when(F.size(having) >= DELIMITED_SHARE * F.size(said), F.array_max(modes))

    best = F.array_max(F.array(*[mode(i) for i in range(len(DELIMITERS))]))
    return F.get(F.array(*map(F.lit, DELIMITERS)), best["place"])


def detected(files: DataFrame, lines: DataFrame, by: str, ordinal: str, text: str, hint: str = "hint", binary: str = "binary_kind") -> DataFrame:
    """(by, delimiter, status, reason) for each of ``files``: what a sample of its lines says about it.

    not_supported where the name or the content tell a binary or a document format, not_tabular where the
    sample is empty, needs_configuration where no delimiter fits, tabular otherwise.
    """
    # A file's sample is a few lines, so what they say fits a row, and only its counts are gathered.
    line = sample_lines(lines, by, ordinal, text).where(F.length(F.trim(F.col(text))) > 0)
    many = F.struct(*[(F.length(text) - F.length(F.replace(F.col(text), F.lit(d)))).alias(f"n{i}") for i, d in enumerate(DELIMITERS)])
    said = line.groupBy(by).agg(F.collect_list(many).alias("_said"))
    found = said.select(by, F.size("_said").alias("_filled"), _guess("_said").alias("delimiter"))
    told = files.select(by, hint, binary).join(found, by, "left")
    reason = (
        F.when(F.col(hint).isin("binary", "adapter_required"), F.col(hint))
        .when(F.col(binary).isNotNull(), F.col(binary))
        .when(F.coalesce("_filled", F.lit(0)) == 0, "empty")
        .when(F.col("delimiter").isNull(), "no_delimiter")
    )
    told = told.withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), "tabular").when(F.col("reason") == "empty", "not_tabular").when(F.col("reason") == "no_delimiter", "needs_configuration").otherwise("not_supported")
    return told.select(by, F.when(F.col("reason").isNull(), F.col("delimiter")).alias("delimiter"), status.alias("status"), "reason")


def field_count_mode(counts: DataFrame, by: str, n: str, declared: str) -> DataFrame:
    """(by, declared, mode, matches): the most frequent number of fields; of equal frequencies the declared one wins, then the larger."""
    many = counts.groupBy(by, declared, n).agg(F.count("*").alias("many"))
    mode = F.max_by(n, F.struct("many", F.col(n) == F.col(declared), n))
    return many.groupBy(by, declared).agg(mode.alias("mode")).withColumn("matches", F.col("mode") == F.col(declared))


def bad_records(records: DataFrame, by: str, is_bad: Column, ordinal: str) -> DataFrame:
    """(by, checked, bad, first_bad, issue): too_many_bad_records over a fifth, bad_records_present below, no_records_found without any."""
    n, bad = F.count("*"), F.count_if(is_bad)
    issue = F.when(F.col("checked") == 0, "no_records_found").when(F.col("bad") > BAD_SHARE * F.col("checked"), "too_many_bad_records").when(F.col("bad") > 0, "bad_records_present")
    return records.groupBy(by).agg(n.alias("checked"), bad.alias("bad"), F.min(F.when(is_bad, F.col(ordinal))).alias("first_bad")).withColumn("issue", issue)


def replaced_characters(lines: DataFrame, by: str, text: str) -> DataFrame:
    """(by, replaced, issue): decode_failed where over a twentieth of all characters are U+FFFD, replacement_characters where some are."""
    one = F.length(text) - F.length(F.replace(F.col(text), F.lit("\ufffd")))
    made = lines.groupBy(by).agg(F.coalesce(F.sum(one), F.lit(0)).alias("replaced"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("_n"))
    issue = F.when(F.col("replaced") > REPLACED_SHARE * F.col("_n"), "decode_failed").when(F.col("replaced") > 0, "replacement_characters")
    return made.withColumn("issue", issue).drop("_n")


def header_issue(found: Column, declared: Column) -> Column:
    """column_count_mismatch, header_differs or null for two arrays of names; case and outer spaces do not count."""
    same = lambda x: F.transform(x, lambda v: F.lower(F.trim(v)))
    return F.when(F.size(found) != F.size(declared), "column_count_mismatch").when(same(found) != same(declared), "header_differs")


def record_path(paths: DataFrame, by: str, path: str, n: str | None = None) -> DataFrame:
    """(by, path, n): the element path that occurs most often, at least twice; of equal counts the shallowest, then the first by name.

    ``paths`` has a row for each element, or for each path of a file with its count ``n``.
    """
    depth = F.length(path) - F.length(F.replace(F.col(path), F.lit("/")))
    counts = paths.groupBy(by, path).agg((F.sum(n) if n else F.count("*")).alias("n")).where("n >= 2").withColumn("_depth", depth)
    order = Window.partitionBy(by).orderBy(F.desc("n"), "_depth", path)
    return counts.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_depth", "_k")


def inferred_names(columns: DataFrame, values: DataFrame, by: str, place: str, name: str, value: str) -> DataFrame:
    """(by, place, name, new_name, hits, total): columns whose name implies a type that four in five of at least two values deny.

    ``columns`` is (by, place, name), ``values`` (by, place, value).  A name that another column of
    the file has already gets the first number from 2 on behind it that makes it free.
    """
    implied = F
    for type_, pattern in NAME_HINTS.items():
        implied = implied.when(F.col(name).rlike(pattern), type_)
    asked = columns.withColumn("_implied", implied).where("_implied IS NOT NULL")
    said = asked.join(values.where(F.length(F.trim(F.col(value))) > 0), [by, place]).withColumn("_type", corrected_type(F.col("_implied"), F.col(value), F.lit(None).cast("string")))
    counts = said.groupBy(by, place, name, "_implied", "_type").agg(F.count("*").alias("n"))
    most = counts.groupBy(by, place, name, "_implied").agg(F.max_by("_type", F.struct("n", "_type")).alias("_type"), F.max("n").alias("hits"), F.sum("n").alias("total"))
    names = F.create_map(*[F.lit(x) for pair in CANONICAL_NAMES.items() for x in pair])
    new = most.where((F.col("total") >= 2) & (F.col("_type") != F.col("_implied")) & (F.col("hits") >= NAME_SHARE * F.col("total"))).withColumn("_new", names[F.col("_type")]).where("_new IS NOT NULL")
    # A file's names are as many as its columns.
    named = columns.groupBy(F.col(by).alias("_b")).agg(F.collect_list(F.struct(F.col(place).alias("p"), F.lower(name).alias("n"))).alias("_names"))
    taken = F.transform(F.filter("_names", lambda x: x["p"] != F.col(place)), lambda x: x["n"])
    said = new.join(named, F.col(by) == F.col("_b")).withColumn("_taken", taken)
    # Columns that get the same name take the free ones in order.
    said = said.withColumn("_nth", F.row_number().over(Window.partitionBy(by, "_new").orderBy(place)))
    numbered = F.transform(F.sequence(F.lit(2), F.size("_taken") + F.col("_nth") + 1), lambda k: F.concat_ws(" ", "_new", k.cast("string")))
    free = F.filter(F.concat(F.array("_new"), numbered), lambda x: ~F.array_contains("_taken", F.lower(x)))
    shown = F.get(free, F.col("_nth") - 1)
    return said.select(by, place, name, shown.alias("new_name"), "hits", "total")


def column_starts(lines: DataFrame, by: str, text: str) -> DataFrame:
    """(by, start): places, from 0, at which some line of a file has a character behind a place that is blank or past the end in all lines.

    Lines with tabs, and blank ones, do not count, and files of fewer than two lines have no starts.
    """
    plain = lines.where((F.length(F.trim(F.col(text))) > 0) & ~F.contains(F.col(text), F.lit("\t"))).withColumn("_text", F.rtrim(F.col(text)))
    letters = plain.select(by, F.posexplode(F.split("_text", "")).alias("at", "c")).where("c <> ' ' AND c <> ''")
    filled = letters.select(by, "at").distinct()
    many = plain.groupBy(by).agg(F.count("*").alias("n")).where("n >= 2").select(by)
    before = filled.select(by, (F.col("at") + 1).alias("at"))
    return filled.where("at > 0").join(before, [by, "at"], "left_anti").join(many, by, "left_semi").select(by, F.col("at").alias("start"))


def refined_widths(lines: DataFrame, declared: DataFrame, by: str, text: str, widths: str = "widths", reach: int = 3) -> DataFrame:
    """(by, widths, refined): inner edges moved to the nearest column start within reach.

    Where two starts are equally near, or edges would meet, the declared widths stay; the sum stays.
    """
    ends = F.transform(F.sequence(F.lit(1), F.size(widths) - 1), lambda i: F.aggregate(F.slice(F.col(widths), 1, i), F.lit(0), lambda a, w: a + w))
    edges = declared.where(F.size(widths) >= 2).select(by, widths, F.posexplode(ends).alias("i", "edge"))
    near = edges.join(column_starts(lines, by, text), by).where(F.abs(F.col("start") - F.col("edge")) <= reach).groupBy(by, "i").agg(F.sort_array(F.collect_list(F.struct(F.abs(F.col("start") - F.col("edge")).alias("d"), "start"))).alias("near"))
    unclear = (F.size("near") > 1) & (F.get("near", F.lit(0))["d"] == F.get("near", F.lit(1))["d"])
    moved = edges.join(near, [by, "i"], "left").select(by, widths, "i", F.coalesce(F.get("near", F.lit(0))["start"], "edge").alias("to"), F.coalesce(unclear, F.lit(False)).alias("unclear"))
    made = moved.groupBy(by, widths).agg(F.sort_array(F.collect_list(F.struct("i", "to"))).alias("e"), F.max("unclear").alias("unclear"))
    total = F.aggregate(widths, F.lit(0), lambda a, w: a + w)
    bounds = F.concat(F.array(F.lit(0)), F.transform("e", lambda x: x["to"]), F.array(total))
    made = made.withColumn("_bounds", bounds)
    steps = F.transform(F.sequence(F.lit(1), F.size("_bounds") - 1), lambda i: F.get("_bounds", i) - F.get("_bounds", i - 1))
    made = made.withColumn("_steps", steps)
    refined = F.when(~F.col("unclear") & F.forall("_steps", lambda w: w > 0), F.col("_steps")).otherwise(F.col(widths))
    return declared.join(made.select(by, refined.alias("refined")), by, "left").select(by, widths, F.coalesce("refined", widths).alias("refined"))
