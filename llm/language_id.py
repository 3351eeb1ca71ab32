"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to ORDER is counted once and then frozen.  The
next byte costs -log2 of its share in the longest context that has it; every longer known context
adds the cost of its escape (as often as it has different successors), and below order 0 all 256
bytes are equal (lower orders are not corrected for what higher ones have).  A text's code length is the exact
sum over all its bytes, and the language of the shortest code wins.  As the statistics are frozen, each worker
tables once the costs of the strings that some language has and the escape costs of their contexts, as sorted
keys, so memory grows with what was seen, not with contexts times bytes times languages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, col, free_names, keyed, map_arrow, register_cache, ship
from .words import _LOWER, steps

ORDER = 3
#: Training texts of each language, expected: those whose hash is in the share of all hashes that makes so many.
SAMPLE_TEXTS = 3000
#: Contexts of the full order and followers seen less often than this are left out of the tree.
LEAST_CONTEXT, LEAST_SEEN = 8, 2
UNKNOWN = "und"
_SIGN = re.compile(r"[^\W\d_]")
_LEAD = bytes([0x20] * ORDER)


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode category L occurs; signs like ² and ½ are none."""
    return any(m.group().isalpha() for m in _SIGN.finditer(text))


def _led(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with ORDER spaces before each text, and the new offsets."""
    n = len(offsets) - 1
    shift = ORDER * np.arange(n + 1)
    out = np.full(len(raw) + ORDER * n, 0x20, np.uint8)
    out[np.arange(len(raw)) + np.repeat(shift[1:], np.diff(offsets))] = _LOWER[raw]
    return out, offsets + shift


def _ends(offsets: np.ndarray) -> np.ndarray:
    """Places in led bytes that hold a byte of a text."""
    keep = np.ones(int(offsets[-1]), bool)
    for k in range(ORDER):
        keep[offsets[:-1] + k] = False
    return np.flatnonzero(keep)


def _count(batches):
    """Partial counts of (language, four bytes)."""
    for b in batches:
        langs = b.column(1).to_pylist()
        totals: dict[str, list] = {}
        for r0, r1, raw, offsets in steps(b.column(0)):
            led, at = _led(raw, offsets)
            place = _ends(at)
            wide = led.astype(np.int64)
            gram = wide[place - 3] << 24 | wide[place - 2] << 16 | wide[place - 1] << 8 | wide[place]
            owner = np.repeat(np.arange(r1 - r0), np.diff(offsets))
            for lang in set(langs[r0:r1]):
                rows = np.array([x == lang for x in langs[r0:r1]])
                totals.setdefault(lang, []).append(np.unique(gram[rows[owner]], return_counts=True))
        for lang, parts in totals.items():
            gram, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([c for _, c in parts]), len(gram)).astype(np.int64)
            yield batch([("lang", pa.array([lang] * len(gram), pa.string())), ("gram", gram), ("n", n)])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted key in the sorted keys, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """Frozen trees of all languages: for each order sorted strings with their costs, and sorted contexts with their escapes.

    A string of order o is o bytes of context and the byte that follows, as one number.
    """

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        k = len(languages)
        counts = [(np.asarray(g).astype(np.uint32), np.asarray(n, float)) for g, n in counts]
        kept = [np.zeros(0, np.uint32)]
        for gram, n in counts:
            context, inverse = np.unique(gram >> 8, return_inverse=True)
            kept.append(context[np.bincount(inverse, n, len(context)) >= LEAST_CONTEXT])
        kept = np.unique(np.concatenate(kept))
        self.strings, self.costs, self.contexts, self.escapes = [], [], [], []
        below_keys, below = np.zeros(0, np.uint32), np.full((1, k), 1 / 256)
        for order in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            of = [(g & mask, n) for g, n in counts]
            if order == ORDER:
                of = [(g[_find(kept, g >> 8)[1]], n[_find(kept, g >> 8)[1]]) for g, n in of]
            keys = np.unique(np.concatenate([g for g, _ in of] + [np.zeros(0, np.uint32)]))
            seen = np.zeros((len(keys), k))
            for j, (g, n) in enumerate(of):
                np.add.at(seen, (np.searchsorted(keys, g), j), n)
            contexts, owner = np.unique(keys >> 8, return_inverse=True)
            total, different = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            np.add.at(total, owner, seen)
            np.add.at(different, owner, seen > 0)
            escape = np.where(total > 0, different / np.maximum(total + different, 1), 1.0)
            lower = below[np.zeros(len(keys), np.int64) if not order else np.searchsorted(below_keys, keys & (mask >> np.uint32(8)))] if len(keys) else np.zeros((0, k))
            whole = np.maximum(total + different, 1)[owner]
            share = np.where(seen > 0, seen / whole, escape[owner] * lower)
            self.strings.append(keys)
            self.costs.append(-np.log2(share).astype(np.float32))
            self.contexts.append(contexts)
            self.escapes.append(-np.log2(escape).astype(np.float32))
            below_keys, below = keys, share

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        led, at = _led(raw, offsets)
        place = _ends(at)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(place):
            return out
        wide = led.astype(np.uint32)
        gram = wide[place - 3] << 24 | wide[place - 2] << 16 | wide[place - 1] << 8 | wide[place]
        cost, open_ = np.zeros((len(gram), len(self.languages)), np.float32), np.arange(len(gram))
        for order in range(ORDER, -1, -1):
            key = gram[open_] & np.uint32((1 << 8 * (order + 1)) - 1)
            found, there = _find(self.strings[order], key)
            cost[open_[there]] += self.costs[order][found[there]]
            open_, key = open_[~there], key[~there]
            found, there = _find(self.contexts[order], key >> 8)
            cost[open_[there]] += self.escapes[order][found[there]]
        cost[open_] += 8
        some = np.flatnonzero(np.diff(offsets))
        out[some] = np.add.reduceat(cost, offsets[some], axis=0, dtype=np.float64)
        return out


_models: dict[str, Model] = {}
register_cache("languages", _models.clear)


def learn(taught: DataFrame):
    """(languages, counts): the frozen statistics of ``taught`` (doc_id, text, lang); rows of null text or language teach nothing."""
    rows = taught.where("text IS NOT NULL AND lang IS NOT NULL")
    hashed = rows.withColumn("hashed", F.xxhash64("doc_id", "text"))
    # One number for each language; counts combine before they move.
    many = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not many:
        return [], []
    edges = {lang: int(min(SAMPLE_TEXTS / n, 1) * ((1 << 64) - 1)) - (1 << 63) for lang, n in many.items()}
    edge = F.create_map(*[F.lit(x) for pair in edges.items() for x in pair])[F.col("lang")]
    # Repeated rows have one hash and count once, so they cannot swell the sample.
    sample = hashed.where(F.col("hashed") <= edge).dropDuplicates(["lang", "hashed"])
    parts = map_arrow(sample.select("text", "lang").repartition(16), _count, "lang string, gram long, n long")
    counts = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN).orderBy("lang", "gram").toArrow()
    lang = np.array(counts.column("lang").to_pylist(), dtype=object)
    gram, n = np.asarray(counts.column("gram")), np.asarray(counts.column("n"))
    languages = sorted(set(lang.tolist()))
    return languages, [(gram[lang == x], n[lang == x]) for x in languages]


def predict(texts: DataFrame, statistics, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred and score (the language's share of the likelihood) of each whole text.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned.  Ties go to the
    language first by name.  Where ``keep`` has a lang_pred or score already, the new one is lang_pred_1 or score_1.
    """
    names_of = free_names(keep, ("lang_pred", "score"))
    shared, token = texts.sparkSession.sparkContext.broadcast(statistics), f"{id(statistics)}-{np.random.default_rng().integers(1 << 62)}"
    base = texts.select(*[col(c) for c in keep], col(text_col).cast("string").alias("_source_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema[:-1])

    def run(batches):
        if token not in _models:
            _models.clear()
            _models[token] = Model(*shared.value)
        model = _models[token]
        for b in batches:
            for r0, r1, raw, offsets in steps(b.column(b.num_columns - 1), max(1 << 14, (1 << 21) // max(len(model.languages), 1))):
                data = raw.tobytes()
                letters = np.array([has_letter(data[a:z].decode("utf-8", "replace")) for a, z in zip(offsets[:-1], offsets[1:], strict=True)])
                names, score = np.full(r1 - r0, UNKNOWN, object), np.zeros(r1 - r0)
                if model.languages:
                    bits = model.bits(raw, offsets)
                    best = bits.argmin(axis=1)
                    share = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
                    names[letters] = np.array(model.languages, object)[best[letters]]
                    score[letters] = share[letters]
                yield batch([(n, b.column(i)[r0:r1]) for i, n in enumerate(b.schema.names[:-1])] + [(names_of[0], pa.array(names.tolist(), pa.string())), (names_of[1], score)])

    return map_arrow(base, run, schema + f"{names_of[0]} string, {names_of[1]} double", cache="languages")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2) -> DataFrame:
    """(doc_key, doc_id, held_out, lang_pred, score): one row for each row of ``docs``.

    Learns only from rows whose crc32 of the id as text modulo ``parts`` is not ``part``; ids, the
    source and the language column are no inputs of a prediction.  A null id is not held out.
    Repeated and null ids are separate rows; other columns are not read; an empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))
    taught = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"))
    statistics = learn(taught.where(~held))
    found = predict(keyed(docs, id_col, text_col), statistics, ("doc_key", "doc_id"))
    return found.select("doc_key", "doc_id", held.alias("held_out"), "lang_pred", "score")
