"""Text functions as Column expressions.

A letter or digit is Unicode ``\\p{L}`` or ``\\p{Nd}``, white space is Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{Nd}]+"
# Signs folded before texts are compared.
QUOTES = "«»“”„‟‘’‚‛`´"
DASHES = "‐‑‒–—―−"
INVISIBLE = "​‌‍⁠﻿­"


def blank_to_null(x: Column) -> Column:
    return F.when(F.length(F.trim(x)) > 0, x)


def digits_only(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def alnum_upper(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, r"[^\p{L}\p{Nd}]", ""))


def collapse_spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_text(x: Column) -> Column:
    """Lower case, ё as е, one kind of quote and dash, no invisible signs, single spaces."""
    folded = F.translate(F.lower(x), "ё" + QUOTES + DASHES, "е" + '"' * len(QUOTES) + "-" * len(DASHES))
    return collapse_spaces(F.regexp_replace(folded, f"[{INVISIBLE}]", ""))


def alnum_lower(x: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(x, r"[^\p{L}\p{Nd}]", "")), "ё", "е")


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(WORD), F.lit(0))


def spaced_words(x: Column) -> Column:
    """The words of ``words`` in one text with a space between, perhaps one at its ends."""
    return F.regexp_replace(x, r"[^\p{L}\p{Nd}]+", " ")


def contains_fragment(normalized: Column, fragment: Column) -> Column:
    """Whether an already normalised text has the fragment; an empty fragment is in nothing."""
    needle = normalize_text(fragment)
    return F.coalesce((F.length(needle) > 0) & F.contains(normalized, needle), F.lit(False))


def contains_alnum(alnum: Column, fragment: Column, least: int = 3) -> Column:
    needle = alnum_lower(fragment)
    return F.coalesce((F.length(needle) >= least) & F.contains(alnum, needle), F.lit(False))


def all_words_present(text_words: Column, value: Column) -> Column:
    """At least two words of two or more letters, all among ``text_words``."""
    some = F.filter(words(normalize_text(value)), lambda w: F.length(w) >= 2)
    return F.coalesce((F.size(some) >= 2) & (F.size(F.array_except(some, text_words)) == 0), F.lit(False))


def plausible_variant(value: Column, evidence: Column) -> Column:
    """``value`` is in ``evidence`` but for word endings: each word shares a long enough beginning with some word there."""
    v, e = normalize_text(value), normalize_text(evidence)

    def begins(w: Column, x: Column) -> Column:
        long = F.greatest(F.lit(3), F.length(w) - 3)
        need = F.greatest(F.least(long, F.length(w), F.length(x)), F.least(F.lit(3), F.length(w)))
        return (F.length(x) >= need) & (F.substring(w, F.lit(1), need) == F.substring(x, F.lit(1), need))

    near = F.forall(words(v), lambda w: F.exists(words(e), lambda x: begins(w, x)))
    return F.coalesce((F.length(v) > 0) & (F.length(e) > 0) & (F.contains(e, v) | near), F.lit(False))


def capped(x: Column, limit: int) -> Column:
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("…"))).otherwise(x)


def strip_code_fence(x: Column) -> Column:
    """The inside of a fenced answer, or the answer itself."""
    inside = F.regexp_extract(F.trim(x), r"(?s)^```[A-Za-z]*\s*\n?(.*?)\n?```$", 1)
    return F.when(F.trim(x).startswith("```") & (F.length(inside) > 0), F.trim(inside)).otherwise(F.trim(x))


def escape_like(value: str) -> str:
    """A LIKE pattern that matches ``value`` itself, with backslash as the escape sign."""
    return "".join("\\" + c if c in "\\%_" else c for c in value)


def highlight(x: Column, terms: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """Marks every term (two letters or more, case ignored); of terms at one place the longest wins."""
    import re

    kept = sorted({t.lower() for t in terms if len(t) >= 2}, key=lambda t: (-len(t), t))
    if not kept:
        return x
    pattern = "(?iu)(" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in kept) + ")"
    return F.regexp_replace(x, pattern, f"{before}$1{after}")


def mask_secrets(x: Column) -> Column:
    """Keys and passwords as ***, e-mail names but for one letter, and all but the last digits of long digit runs."""
    y = F.regexp_replace(x, r"(?i)\b(password|pwd|token|secret|api[_-]?key|authorization)\b(\s*[:=]\s*)(?:bearer\s+)?[^\s,;\"']+", "$1$2***")
    y = F.regexp_replace(y, r"(?i)\b(sk|key)-[A-Za-z0-9_\-]{8,}", "***")
    y = F.regexp_replace(y, r"([A-Za-z0-9])[A-Za-z0-9._%+\-]*@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})", "$1***@$2")
    # Runs of 12 digits and more keep four, of 7 to 11 two; dates like 2024-05-17 have shorter runs.
    y = F.regexp_replace(y, r"(?<!\d)\d{8,}(\d{4})(?!\d)", "***$1")
    return F.regexp_replace(y, r"(?<!\d)\d{5,9}(\d{2})(?!\d)", "***$1")


def path_identity(x: Column) -> Column:
    r"""A path for comparing: no ``\\?\`` prefix, backslashes, no trailing ones, upper case."""
    plain = F.regexp_replace(F.trim(x), r"^\\\\\?\\", "")
    return F.upper(F.regexp_replace(F.regexp_replace(plain, "/", r"\\\\"), r"\\+$", ""))


def relative_path(path: Column, root: Column) -> Column:
    base = F.concat(F.regexp_replace(root, r"[/\\]+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)
