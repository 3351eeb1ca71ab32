"""Birth dates: a proposed date holds only if the record's own text confirms it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_text, words

LEAST_YEAR = 1850
# Month words. Russian stems take these case endings; «май» and «мая» stand alone.
SOFT, HARD, ALONE = ("ь", "я", "е", "ю", "ем"), ("", "а", "е", "у", "ом"), ("",)
RUSSIAN = (
    (("январ",), SOFT),
    (("феврал",), SOFT),
    (("март",), HARD),
    (("апрел",), SOFT),
    (("мая", "май"), ALONE),
    (("июн",), SOFT),
    (("июл",), SOFT),
    (("август",), HARD),
    (("сентябр",), SOFT),
    (("октябр",), SOFT),
    (("ноябр",), SOFT),
    (("декабр",), SOFT),
)
ENGLISH = (
    ("january", "jan"),
    ("february", "feb"),
    ("march",),
    ("april", "apr"),
    ("may",),
    ("june", "jun"),
    ("july", "jul"),
    ("august", "aug"),
    ("september", "sep", "sept"),
    ("october", "oct"),
    ("november", "nov"),
    ("december", "dec"),
)


def month_words() -> dict[str, int]:
    found = {stem + end: m for m, (stems, ends) in enumerate(RUSSIAN, 1) for stem in stems for end in ends}
    return found | {w: m for m, names in enumerate(ENGLISH, 1) for w in names}


def parse_date(x: Column, pattern: str) -> Column:
    """A strictly valid date of the pattern, or null."""
    return F.try_to_timestamp(x, F.lit(pattern)).cast("date")


def parse_search_date(x: Column) -> Column:
    v = F.trim(x)
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), parse_date(v, "yyyy-MM-dd"))
    dotted = F.when(v.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), parse_date(v, "d.M.yyyy"))
    slashed = F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), parse_date(v, "d/M/yyyy"))
    return F.coalesce(iso, dotted, slashed)


def dotted_dates(x: Column) -> Column:
    """All dd.MM.yyyy dates of a text that exist, as dates."""
    found = F.regexp_extract_all(x, F.lit(r"(?<!\d)(\d{1,2}\.\d{1,2}\.\d{4})(?!\d)"), F.lit(1))
    return F.filter(F.transform(found, lambda d: parse_date(d, "d.M.yyyy")), lambda d: d.isNotNull())


def _parts(match: Column, sep: str) -> list[Column]:
    return [F.split(match, sep)[i].cast("int") for i in range(3)]


def _evidence(text: Column) -> dict[str, Column]:
    """What a normalised text says of dates; month names and numbers only where no date in digits is found."""
    found = {
        "iso": F.regexp_extract_all(text, F.lit(r"(?<!\d)\d{4}-\d{1,2}-\d{1,2}(?!\d)"), F.lit(0)),
        "dotted": F.regexp_extract(text, r"(?<!\d)\d{1,2}\.\d{1,2}\.\d{2,4}(?!\d)", 0),
        "slashed": F.regexp_extract(text, r"(?<!\d)\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}(?!\d)", 0),
    }
    names = F.create_map(*[F.lit(x) for pair in month_words().items() for x in pair])
    bare = ~text.rlike(r"\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}")
    named = F.filter(F.transform(words(text), lambda w: names[w]), lambda n: n.isNotNull())
    return found | {"named": F.when(bare, named), "numbers": F.when(bare, F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{1,4})(?!\d)"), F.lit(1)))}


def _judged(v: Column, date: Column, text: Column, e: dict[str, Column], today: Column) -> Column:
    """struct<date, reason> from a trimmed value, its date and what the evidence says."""
    year, month, day = F.year(date), F.month(date), F.dayofmonth(date)
    dotted, slashed = e["dotted"], e["slashed"]
    by_iso = F.exists(e["iso"], lambda m: (_parts(m, "-")[0] == year) & (_parts(m, "-")[1] == month) & (_parts(m, "-")[2] == day))
    d, m, y = _parts(F.when(dotted != "", dotted), r"\.")
    a, b, c = _parts(F.when(slashed != "", slashed), r"[/\-]")
    four = lambda x: F.length(F.element_at(F.split(x, r"[./\-]"), -1)) == 4
    none = F.array().cast("array<string>")
    named, numbers = F.coalesce(e["named"], F.array().cast("array<int>")), F.coalesce(e["numbers"], none)
    has = lambda n, size=0: F.exists(numbers, lambda x: (x.cast("int") == n) & (F.length(x) == size if size else F.lit(True)))
    reason = (
        F.when(date.isNull(), "not a valid ISO date")
        .when(year < LEAST_YEAR, "year too early")
        .when(date > today, "date in the future")
        .when(F.length(F.coalesce(text, F.lit(""))) == 0, "no evidence")
        .when(by_iso, None)
        .when(dotted != "", F.when(~four(dotted), "two-digit year").when((y == year) & (m == month) & (d == day), None).otherwise("evidence has another date"))
        .when(
            slashed != "",
            F.when(~four(slashed), "two-digit year")
            .when((a <= 12) & (b <= 12) & (a != b), "ambiguous order of day and month")
            .when((c == year) & (((a == day) & (b == month)) | ((b == day) & (a == month))), None)
            .otherwise("evidence has another date"),
        )
        .when(F.size(named) > 0, F.when(has(year, 4) & (F.get(named, F.lit(0)) == month) & has(day), None).otherwise("month name does not confirm the date"))
        .when(F.exists(numbers, lambda n: F.length(n) == 4), "no full date in the evidence")
        .otherwise("format of the evidence not known")
    )
    empty = F.length(F.coalesce(v, F.lit(""))) == 0
    return F.struct(F.when(reason.isNull() & ~empty, date).alias("date"), F.when(~empty, reason).alias("reason"))


def _iso_date(v: Column) -> Column:
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), parse_date(v, "yyyy-MM-dd"))


def check_birth_date(value: Column, evidence: Column, today: Column) -> Column:
    """struct<date, reason>: the date if it is ISO, plausible and confirmed by the evidence, else why not.

    Evidence is tried as ISO anywhere, then day.month.year (the first one decides), then with
    slashes or dashes (both parts up to 12 and different: ambiguous), then with a month's name.
    """
    v, text = F.trim(value), normalize_text(evidence)
    return _judged(v, _iso_date(v), text, _evidence(text), today)


def with_birth_date(df: DataFrame, value: Column, evidence: Column, today: Column, out: str) -> DataFrame:
    """``df`` with the column ``out`` of ``check_birth_date``, computed in steps so that nothing is computed twice."""
    base = df.withColumns({"_bv": F.trim(value), "_bt": normalize_text(evidence)})
    base = base.withColumns({"_bd": _iso_date(F.col("_bv")), **{f"_b_{k}": c for k, c in _evidence(F.col("_bt")).items()}})
    e = {k: F.col(f"_b_{k}") for k in ("iso", "dotted", "slashed", "named", "numbers")}
    return base.withColumn(out, _judged(F.col("_bv"), F.col("_bd"), F.col("_bt"), e, today)).drop("_bv", "_bt", "_bd", *[f"_b_{k}" for k in e])


def unix_nanos(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000
