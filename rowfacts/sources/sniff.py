"""What a file is, told from its first bytes by built-in functions: binary kinds, byte order marks, encodings.

Bytes are looked at as a Latin-1 string, so every test is a string function.  ``sniff`` keeps what
several tests need in columns, so that it is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD_BYTES = 1 << 16
# Published file signatures as (kind, then places and the bytes there; all must fit).
SIGNATURES = (
    ("pdf", (0, b"%PDF-")),
    ("zip", (0, b"PK\x03\x04")),
    ("zip", (0, b"PK\x05\x06")),
    ("zip", (0, b"PK\x07\x08")),
    ("png", (0, b"\x89PNG\r\n\x1a\n")),
    ("jpeg", (0, b"\xff\xd8\xff")),
    ("gif", (0, b"GIF87a")),
    ("gif", (0, b"GIF89a")),
    ("tiff", (0, b"II*\x00")),
    ("tiff", (0, b"MM\x00*")),
    ("bmp", (0, b"BM"), (6, b"\x00\x00\x00\x00"), (15, b"\x00\x00\x00")),
    ("ole", (0, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")),
    ("gzip", (0, b"\x1f\x8b\x08")),
    ("rar", (0, b"Rar!\x1a\x07")),
    ("7z", (0, b"7z\xbc\xaf\x27\x1c")),
    ("exe", (0, b"MZ"), (62, b"\x00\x00")),
    ("riff", (0, b"RIFF"), (8, b"WAVE")),
    ("riff", (0, b"RIFF"), (8, b"AVI ")),
    ("riff", (0, b"RIFF"), (8, b"WEBP")),
    ("mp4", (4, b"ftyp")),
    ("mp3", (0, b"ID3\x02\x00")),
    ("mp3", (0, b"ID3\x03\x00")),
    ("mp3", (0, b"ID3\x04\x00")),
    ("sqlite", (0, b"SQLite format 3\x00")),
)
# Byte order marks, longest first.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
# Encodings by their canonical names, with the codec and other spellings of each.
ENCODINGS = {
    "utf-8": ("utf-8", "utf8"),
    "utf-8-sig": ("utf-8", "utf8-sig"),
    "utf-16-le": ("utf-16-le", "utf-16le", "utf-16", "utf16"),
    "utf-16-be": ("utf-16-be", "utf-16be"),
    "utf-32-le": ("utf-32-le", "utf-32le"),
    "utf-32-be": ("utf-32-be", "utf-32be"),
    "windows-1251": ("cp1251", "cp1251", "1251", "win-1251"),
    "cp866": ("cp866", "ibm866", "866"),
    "koi8-r": ("koi8_r", "koi8r"),
    "windows-1252": ("cp1252", "cp1252", "1252"),
    "iso-8859-1": ("latin-1", "latin-1", "latin1"),
    "ascii": ("ascii", "us-ascii"),
}
CODECS = {name: codec for name, (codec, *_) in ENCODINGS.items()}
WIDE = tuple(n for n in ENCODINGS if n.startswith(("utf-16", "utf-32")))
#: Candidates for bytes that are no UTF-8; of equal scores the first wins.
SINGLE_BYTE = ("windows-1251", "cp866", "koi8-r", "windows-1252")


def _latin(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def _size_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def canonical_encoding(name: Column) -> Column:
    """The canonical name of a spelling, or null."""
    known = {s: n for n, (_, *spellings) in ENCODINGS.items() for s in (n, *spellings)}
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.translate(F.lower(F.trim(name)), "_", "-")]


def equivalent(a: Column, b: Column, ascii_only: Column) -> Column:
    """Whether two canonical encodings read a file alike."""
    bare = lambda x: F.regexp_replace(x, "-sig$", "")
    return (bare(a) == bare(b)) | (ascii_only & ~a.isin(*WIDE) & ~b.isin(*WIDE))


def binary_kind(head: Column) -> Column:
    """The kind of a known binary format, or null."""
    kind = F
    for name, *places in SIGNATURES:
        fits = [F.substring(head, at + 1, len(data)) == F.lit(data) for at, data in places]
        whole = fits[0]
        for more in fits[1:]:
            whole = whole & more
        kind = kind.when(whole, name)
    return kind


def control_share(text: Column) -> Column:
    """Share of bytes that texts do not have: controls but tab, line ends, form feed, end of file and escape."""
    return F.when(F.length(text) > 0, 1 - _size_without(text, r"[\x00-\x08\x0E-\x19\x1C-\x1F\x7F]") / F.length(text)).otherwise(0.0)


# The share of controls that no text has, and the one that none with a run of zeros has.
MANY_CONTROLS, SOME_CONTROLS = 0.05, 0.01


def looks_binary(controls: Column, text: Column) -> Column:
    """Whether bytes with such a share of controls are no text in a single-byte encoding or UTF-8."""
    return (controls >= MANY_CONTROLS) | (controls >= SOME_CONTROLS) & F.contains(text, F.lit("\0" * 4))


def byte_order_mark(head: Column) -> Column:
    """The encoding that a byte order mark names, or null."""
    mark = F
    for data, name in MARKS:
        mark = mark.when(F.substring(head, 1, len(data)) == F.lit(data), name)
    return mark


def wide_encoding(head: Column, text: Column) -> Column:
    """UTF-16 or UTF-32 without a mark, by its zero bytes, or null.

    Letters, digits and spaces of most texts have zero bytes at one end of their code units.
    """

    def zeros(step: int, at: int) -> Column:
        picked = F.regexp_replace(text, "(?s)" + "." * at + "(.)" + "." * (step - at - 1), "$1")
        return 1 - _size_without(picked, r"\x00") / F.greatest(F.length(picked), F.lit(1))

    pattern = {"utf-32-le": (zeros(4, 3) == 1) & (zeros(4, 2) > 0.9), "utf-32-be": (zeros(4, 0) == 1) & (zeros(4, 1) > 0.9), "utf-16-le": (zeros(2, 1) >= 0.05) & (zeros(2, 0) <= 0.02), "utf-16-be": (zeros(2, 0) >= 0.05) & (zeros(2, 1) <= 0.02)}
    name = F
    for n, zero in pattern.items():
        name = name.when(zero, n)
    return F.when((F.length(head) >= 4) & F.contains(text, F.lit("\0")), name)


def _wide_text(head: Column, text: Column, name: Column) -> Column:
    """The text of a wide encoding; UTF-32 is read as UTF-16 without its upper halves."""
    low = F.encode(F.when(name.endswith("le"), F.regexp_replace(text, "(?s)(..)..", "$1")).otherwise(F.regexp_replace(text, "(?s)..(..)", "$1")), "ISO-8859-1")
    units = F.when(name.startswith("utf-32"), low).otherwise(head)
    return F.when(name.endswith("le"), F.decode(units, "UTF-16LE")).otherwise(F.decode(units, "UTF-16BE"))


# Well-formed words: one script, and capitals only in front or throughout; in Latin ones accents stand alone among plain letters.
_RUSSIAN_WORD = r"(?<!\p{L})(?:[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+)(?!\p{L})"
_LATIN_WORD = r"(?<!\p{L})(?=\p{L}*[A-Za-z])(?:\p{Lu}?\p{Ll}+|\p{Lu}+)(?<!(?![A-Za-z])\p{L}{2}\p{L}{0,40})(?!\p{L})"
# The ten most frequent letters of Russian.
_COMMON = "оеаинтсрвл"


def plausibility(text: Column, encoding: str) -> Column:
    """0 to 1: how well bytes over 127 make words when read in a single-byte encoding."""
    high = bytes(range(128, 256))
    text = F.translate(text, high.decode("latin-1"), high.decode(CODECS[encoding], "replace"))
    odd = r"[^\x00-\x7F «»–—…“”„‘’•·°№©®±§€™]"
    all_odd = F.length(text) - _size_without(text, odd)
    if encoding == "windows-1252":
        lone = r"(?<![^\x00-\x7F])[^\W\x00-\x7F_](?![^\x00-\x7F])"  # an accented letter whose neighbours are plain
        near = r"(?:(?<=[A-Za-z])" + lone + "|" + lone + r"(?=[A-Za-z]))"
        good = F.length(text) - _size_without(text, "(?U)" + near)
        return F.when(all_odd > 0, good / all_odd).otherwise(0.0)
    words = F.regexp_replace(text, _RUSSIAN_WORD, "")
    good = all_odd - (F.length(words) - _size_without(words, odd))
    letters = F.length(text) - _size_without(text, "[А-Яа-яЁё]")
    common = F.length(text) - _size_without(text, f"(?iu)[{_COMMON}]")
    return F.when(all_odd > 0, good / all_odd * common / F.greatest(letters, F.lit(1))).otherwise(0.0)


def sniff(files: DataFrame, head: str, whole: str) -> DataFrame:
    """``files`` with binary_kind, encoding, confidence and source, told from the bytes in ``head``.

    The encoding is that of a byte order mark, of wide text without one, of ASCII, of strict UTF-8, or
    the most plausible single-byte one.  ``whole`` says whether ``head`` is all of a file; otherwise a
    character cut at its end is no fault.  The kind is unknown_binary where controls say so; a binary
    file has no encoding.
    """
    h, text = F.col(head), F.col("_text")
    base = files.withColumn("_text", _latin(h))
    base = base.withColumns({"_mark": byte_order_mark(h), "_wide": wide_encoding(h, text), "_kind": binary_kind(h), "_controls": control_share(text), "_high": F.length(text) - _size_without(text, r"[\x80-\xFF]")})
    base = base.withColumn("_shown", F.when(F.col("_wide").isNotNull(), _wide_text(h, text, F.col("_wide"))))
    odd = _size_without(F.col("_shown"), r"[\p{L}\p{M}\p{N}\p{P}\p{S}\p{Z}\t\r\n]") / F.greatest(F.length("_shown"), F.lit(1))
    complete = F.when(F.col(whole), text).otherwise(F.regexp_replace(text, r"[\xC0-\xFF][\x80-\xBF]{0,2}$", ""))
    base = base.withColumns({"_odd": odd, "_utf8": F.is_valid_utf8(F.encode(complete, "ISO-8859-1").cast("string"))})
    unclear = F.col("_mark").isNull() & ~F.col("_utf8") & F.coalesce(F.col("_odd") > 0.05, F.lit(True))
    base = base.withColumns({f"_score{i}": F.when(unclear, plausibility(text, n)) for i, n in enumerate(SINGLE_BYTE)})
    scores = F.sort_array(F.array(*[F.struct(F.col(f"_score{i}").alias("score"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(SINGLE_BYTE)]), asc=False)
    base = base.withColumn("_scores", scores)
    best, second = F.col("_scores")[0], F.col("_scores")[1]
    sure = F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.05), (best["score"] - second["score"] / 2) * (0.7 + 0.3 * F.least(F.lit(1.0), F.col("_high") / 100)))), 3)
    source = F.when(F.col("_mark").isNotNull(), "mark").when(F.col("_odd") <= 0.05, "zeros").when((F.col("_high") == 0), "ascii").when(F.col("_utf8"), "utf-8").otherwise("words")
    base = base.withColumn("source", source)
    by = lambda **x: F.coalesce(*[F.when(F.col("source") == n, v) for n, v in x.items()])
    encoding = F.coalesce(by(mark=F.col("_mark"), zeros=F.col("_wide"), ascii=F.lit("utf-8"), words=best["name"]), F.lit("utf-8"))
    base = base.withColumns({"encoding": encoding, "confidence": F.coalesce(by(mark=F.lit(1.0), zeros=F.round(F.least(F.lit(0.99), 1 - F.col("_odd")), 3), ascii=F.lit(0.9), words=sure), F.lit(0.99))})
    binary = ~F.col("encoding").isin(*WIDE) & looks_binary(F.col("_controls"), text)
    base = base.withColumn("binary_kind", F.coalesce("_kind", F.when(binary, F.lit("unknown_binary"))))
    is_text = F.col("binary_kind").isNull()
    return base.select(*files.columns, "binary_kind", F.when(is_text, F.col("encoding")).alias("encoding"), F.when(is_text, F.col("confidence")).otherwise(0.0).alias("confidence"), F.when(is_text, F.col("source")).alias("source"))


def decode(content: bytes, encoding: str) -> str:
    """The text of whole content; an own byte order mark is left out, wrong bytes become U+FFFD."""
    return content.decode(CODECS[encoding], "replace").removeprefix("﻿") if encoding.startswith("utf") else content.decode(CODECS[encoding], "replace")
