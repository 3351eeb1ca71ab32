"""Quality: a regularised quadratic discriminant over transformed document statistics.

Each text becomes STATISTICS numbers: log sizes, and log odds of shares such as upper-case letters,
signs, or words of repeated lines.  Each class of label has a mean and a covariance of them, which is
shrunk in two steps: towards the covariance that the classes have in common, and towards a multiple
of the identity.  A text's score compares the classes' log densities, that is their Mahalanobis
distances by Cholesky factors which are made once and cached with the model, and their shares.
Statistics are kept as whole multiples of 1 / UNIT, so that sums of them and of their products are
exact: the model is the same in whatever order tasks end, and all labelled rows count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, col, ints, keyed, map_arrow, ship, stored
from .toxicity import held_out
from .words import hash_runs, hash_words, mix, split_words, steps

STATISTICS = (
    "words", "word_bytes", "word_spread", "upper", "capital_words", "digits", "signs", "stops", "bare_words",
    "trailing_signs", "distinct", "repeated_lines", "repeated_runs", "line_words", "entropy", "long_words",
)
SIZE = len(STATISTICS)
#: Fixed-point unit and bound of a statistic: products of two stay below 2^32, so 2^31 rows add up in a long.
UNIT, BOUND = 1 << 10, (1 << 16) - 1
#: Words of a run that counts as repeated; bytes of a long word.
RUN_WORDS, LONG_WORD = 3, 24
#: Weight of the common covariance, and of the multiple of the identity.
COMMON, SPHERE = 0.1, 0.02
THRESHOLD = 0.7

_KIND = np.zeros(256, np.uint8)
_UPPER, _LOWER, _DIGIT, _SIGN, _STOP = 1, 2, 3, 4, 5
_KIND[65:91], _KIND[97:123], _KIND[48:58] = _UPPER, _LOWER, _DIGIT
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _SIGN
_KIND[[ord("."), ord(",")]] = _STOP


def _odds(part, whole):
    """Log odds of a share, with half a count on either side."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _repeats(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which entries repeat an earlier one of their row."""
    again = np.ones(len(keys), bool)
    again[np.unique(mix(keys + mix(rows.astype(np.uint64), 61), 62), return_index=True)[1]] = False
    return again


def _kinds(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Kind of each byte; the two bytes of a Latin letter with an accent count as one letter of its case."""
    kind = _KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) if len(raw) else np.zeros(0, np.int64)
    after = raw[lead + 1]
    kind[lead] = np.where(after < 0x9F, _UPPER, _LOWER)
    return kind


def text_statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS of each text, as whole multiples of 1 / UNIT."""
    n = len(offsets) - 1
    starts, ends, first = split_words(raw, offsets)
    words = np.diff(first)
    rows = np.repeat(np.arange(n), words)
    kind = _kinds(raw, offsets)
    upto = [np.r_[0, np.cumsum(kind == k)] for k in range(6)]

    def of_text(k):
        return upto[k][offsets[1:]] - upto[k][offsets[:-1]]

    def of_word(k):
        return upto[k][ends] - upto[k][starts]

    def summed(mask_or_values):
        return np.bincount(rows, mask_or_values, n)

    size = ends - starts
    up, low, signs = of_word(_UPPER), of_word(_LOWER), of_word(_SIGN) + of_word(_STOP)
    last = kind[ends - 1] if len(ends) else kind[:0]
    before = kind[np.maximum(ends - 2, starts)] if len(ends) else kind[:0]
    trailing = (last >= _SIGN) & (before >= _SIGN) & (size > 1)
    hashed = hash_words(raw, starts, ends, lower=True)
    mean = summed(size) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(summed(size.astype(float) ** 2) / np.maximum(words, 1) - mean**2, 0))

    # Lines: the bytes between line feeds, those without a word left out.
    feeds = np.r_[0, np.cumsum(raw == 10)]
    line = feeds[starts]
    new_line = np.ones(len(starts), bool)
    new_line[1:] = (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])
    heads = np.flatnonzero(new_line)
    tails = np.r_[heads[1:], len(starts)]
    line_hash = hash_words(raw, starts[heads], ends[tails - 1])
    said_again = _repeats(rows[heads], line_hash)
    line_words = tails - heads
    repeated_lines = np.bincount(rows[heads], line_words * said_again, n)
    lines = np.bincount(rows[heads], minlength=n)

    runs = hash_runs(hashed, RUN_WORDS)
    inside = rows[: len(runs)] == rows[RUN_WORDS - 1 :] if len(runs) else np.zeros(0, bool)
    run_rows = rows[: len(runs)][inside]
    again = _repeats(run_rows, runs[inside])

    every = np.diff(offsets)
    count = np.bincount(np.repeat(np.arange(n), every) * 256 + raw, minlength=n * 256).reshape(n, 256)
    entropy = np.log2(np.maximum(every, 1)) - (count * np.log2(np.maximum(count, 1))).sum(axis=1) / np.maximum(every, 1)
    letters = of_text(_UPPER) + of_text(_LOWER)
    found = np.stack([
        np.log1p(words), np.log1p(mean), np.log1p(spread), _odds(of_text(_UPPER), letters), _odds(summed((up > 1) & (low == 0)), words), _odds(of_text(_DIGIT), every),
        _odds(of_text(_SIGN), every), _odds(of_text(_STOP), every), _odds(summed(up + low == 0), words), _odds(summed(trailing), words), _odds(summed(~_repeats(rows, hashed)), words),
        _odds(repeated_lines, words), _odds(np.bincount(run_rows, again, n), np.maximum(words - RUN_WORDS + 1, 0)), np.log1p(words / np.maximum(lines, 1)), entropy, _odds(summed(size > LONG_WORD), words),
    ], axis=1)
    return np.clip(np.rint(found * UNIT), -BOUND, BOUND).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """For class 0 and 1: share, mean and the inverse of the Cholesky factor of its covariance, in units of ``scale``."""

    share: tuple[float, float]
    scale: np.ndarray
    means: tuple[np.ndarray, ...] = ()
    inverses: tuple[np.ndarray, ...] = ()
    log_volumes: tuple[float, ...] = ()

    def score(self, statistics: np.ndarray) -> np.ndarray:
        """The probability of class 1; that of the classes' shares where only one class was seen."""
        odds = np.full(len(statistics), np.log(self.share[1] / self.share[0]))
        if self.means:
            for sign, mean, inverse, volume in zip((-1, 1), self.means, self.inverses, self.log_volumes, strict=True):
                z = ((statistics - mean) / self.scale) @ inverse.T
                odds -= sign * (volume + 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def make_model(moments: dict[tuple[int, int], int], common: float = COMMON, sphere: float = SPHERE) -> Model:
    """A model from exact sums: (label, cell) -> value, where the cells are those of ``_moments``."""
    counts = [moments.get((k, 0), 0) for k in (0, 1)]
    share = tuple((c + 0.5) / (sum(counts) + 1) for c in counts)
    if not all(counts):
        return Model(share, np.ones(SIZE))
    i, j = np.triu_indices(SIZE)
    means, covariances = [], []
    for k, n in enumerate(counts):
        sums = [moments[k, 1 + a] for a in range(SIZE)]
        covariance = np.zeros((SIZE, SIZE))
        for cell, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            covariance[a, b] = covariance[b, a] = (n * moments[k, 1 + SIZE + cell] - sums[a] * sums[b]) / (n * n)  # whole numbers until divided
        means.append(np.array([x / n for x in sums]))
        covariances.append(covariance)
    pooled = (counts[0] * covariances[0] + counts[1] * covariances[1]) / sum(counts)
    scale = np.sqrt(np.diag(pooled))
    scale[scale == 0] = 1.0
    inverses, volumes = [], []
    for covariance in covariances:
        shrunk = ((1 - common) * covariance + common * pooled) / scale / scale[:, None]
        shrunk = (1 - sphere) * shrunk + sphere * np.eye(SIZE) * max(np.trace(shrunk) / SIZE, 1e-3)
        factor = np.linalg.cholesky(shrunk)
        inverses.append(np.linalg.inv(factor))
        volumes.append(float(np.log(np.diag(factor)).sum()))
    return Model(share, scale, tuple(means), tuple(inverses), tuple(volumes))


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), SIZE)


def _describe(batches):
    for b in batches:
        last = b.num_columns - 1
        for r0, r1, raw, offsets in steps(b.column(last)):
            found = text_statistics(raw, offsets)
            kept = [(n, b.column(i)[r0:r1]) for i, n in enumerate(b.schema.names[:last])]
            yield batch([*kept, ("statistics", ints(np.arange(r1 - r0 + 1) * SIZE, found.ravel()))])


def _moments(batches):
    """(label, cell, value) of a task: cell 0 counts rows, then sums of each statistic, then of each product of two."""
    i, j = np.triu_indices(SIZE)
    sums = np.zeros((2, 1 + SIZE + len(i)), np.int64)
    for b in batches:
        x, labels = _matrix(b.column(0)), np.asarray(b.column(1))
        for k in (0, 1):
            of = x[labels == k]
            sums[k] += np.r_[len(of), of.sum(axis=0), (of.T @ of)[i, j]]
    label, cell = np.nonzero(sums)
    yield batch([("label", label.astype(np.int32)), ("cell", cell.astype(np.int32)), ("value", sums[label, cell])])


def describe(texts: DataFrame, id_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``id_cols`` and the statistics (array<int>) of each whole text; a null counts as empty."""
    base = texts.select(*[col(c) for c in id_cols], col(text_col).cast("string").alias("_source_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema[:-1])
    return map_arrow(base, _describe, schema + "statistics array<int>")


def learn(described: DataFrame, labels: DataFrame) -> Model:
    """A model from all rows of ``described`` (doc_id, statistics) that have a label 0 or 1 in ``labels`` (id, label).

    Tasks sum before anything moves; what reaches the driver is two times 153 numbers whatever the input.
    """
    known = labels.where("label IN (0, 1) AND id IS NOT NULL")
    taught = described.join(known, F.col("doc_id") == F.col("id")).select("statistics", "label")
    parts = map_arrow(taught, _moments, "label int, cell int, value long")
    rows = parts.groupBy("label", "cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    moments = {(k, c): 0 for k in (0, 1) for c in range(1 + SIZE + SIZE * (SIZE + 1) // 2)}
    return make_model(moments | {(r.label, r.cell): int(r.value) for r in rows})


def score(described: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and the score of each row of ``described``."""
    shared = described.sparkSession.sparkContext.broadcast(model)
    base = described.select(*[col(c) for c in keep], "statistics")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema[:-1])

    def run(batches):
        for b in batches:
            last = b.num_columns - 1
            kept = [(n, b.column(i)) for i, n in enumerate(b.schema.names[:last])]
            yield batch([*kept, ("score", shared.value.score(_matrix(b.column(last))))])

    return map_arrow(base, run, schema + "score double")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 4, part: int = 2) -> DataFrame:
    """(doc_key, doc_id, held_out, score, predicted): one row for each row of ``docs``.

    Learns from all labelled rows but those whose crc32 of the id as text leaves ``part`` modulo
    ``parts``; labels, ids, language and source are no inputs of a score.  ``predicted`` is 1 from a
    score of THRESHOLD on.  Several labels of one id all count, other labels than 0 and 1 don't.
    Repeated and null ids are separate rows; a null id has no label and is not held out.  Without
    labels of both kinds all scores are the same.  Other columns are not read; an empty table gives
    an empty result.  Texts are read once: their statistics are stored for learning and scoring.
    """
    ship(docs.sparkSession)
    rows = keyed(docs, id_col, text_col).withColumn("held_out", held_out("doc_id", parts, part))
    described = stored(describe(rows, ("doc_key", "doc_id", "held_out")), "statistics")
    known = labels.select(col(id_col).cast("long").alias("id"), col(label_col).cast("int").alias("label"))
    model = learn(described.where("NOT held_out"), known)
    found = score(described, model, ("doc_key", "doc_id", "held_out"))
    return found.select("doc_key", "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
