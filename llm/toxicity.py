"""Toxicity: a linear classifier with counterfactual regularisation.

Features are the distinct words of a text and their beginnings, hashed.  In every sentence of a labelled
text that mentions identity terms, the terms are swapped for each other one of their group; training
minimises the logistic loss plus a weight times the squared change of the logit that the swaps make,
averaged over the swaps of a text, so that mentions as such do not move the score.  As the model is
linear, a swap is told by the features that it takes away and brings, whatever else the sentence says.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, col, free_name, keyed, map_arrow, ship
from .words import hash_words, mix, prefix_hashes, split_words, steps

#: log2 of the hashed features, lengths in bytes of word beginnings, and buckets of text length.
BITS, BEGINNINGS, LENGTHS = 20, (4, 5, 6, 7, 8), 48
#: Labelled rows that training uses at most (those of smallest hashed id): the bound on its one task.
SAMPLE_ROWS = 12_000
#: Texts in which a feature must occur, passes, texts per step, step size.
LEAST_TEXTS, PASSES, STEP_TEXTS, RATE = 15, 20, 128, 0.3
#: Absolute and squared penalty of a weight, power of the class weights, weight of the counterfactual penalty.
SPARSE, SHRINK, BALANCE, COUNTERFACTUAL = 20.0, 1.0, 1.0, 2.0
THRESHOLD = 0.7

# Neutral group terms; a term is swapped for every other one of its group.
IDENTITY_GROUPS = (
    ("women", "men", "people"),
    ("woman", "man", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("muslime", "christen", "juden"),
    ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"),
)


_TERMS = [t for g in IDENTITY_GROUPS for t in g]
#: For each term its group's first place in _TERMS and the group's size.
_GROUP = [(start, len(g)) for start, g in zip(itertools.accumulate([0, *map(len, IDENTITY_GROUPS)]), IDENTITY_GROUPS) for _ in g]


def _term_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the identity terms, and the place of each in _TERMS."""
    raw = np.frombuffer("".join(_TERMS).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in _TERMS])
    hashes = hash_words(raw, np.r_[0, ends[:-1]], ends, lower=True)
    order = np.argsort(hashes)
    return hashes[order], order


def _other(term: int, k: int) -> int:
    """The k-th next term of the group, round and round."""
    start, size = _GROUP[term]
    return start + (term - start + k) % size


def text_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs: hashed distinct words and their beginnings, and one length bucket for each row."""
    starts, ends, first = split_words(raw, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    starts, ends = _core(raw, starts, ends)
    some = ends > starts
    starts, ends, rows = starts[some], ends[some], rows[some]
    words = hash_words(raw, starts, ends, lower=True)
    _, at = np.unique(mix(words + mix(rows.astype(np.uint64), 71), 72), return_index=True)
    starts, ends, rows, words = starts[at], ends[at], rows[at], words[at]
    shift = np.uint64(64 - BITS)
    out_rows, out = [rows], [(mix(words, 73) >> shift).astype(np.int64)]
    for n, hashed in prefix_hashes(raw, starts, BEGINNINGS):
        long = ends - starts > n
        out_rows.append(rows[long])
        out.append((mix(hashed[long], 73 + n) >> shift).astype(np.int64))
    sizes = np.bincount(rows, minlength=len(offsets) - 1)
    out_rows.append(np.arange(len(sizes)))
    out.append((1 << BITS) + np.minimum(2 * np.log2(sizes + 1), LENGTHS - 1).astype(np.int64))
    return np.concatenate(out_rows), np.concatenate(out)


def _core(raw, starts, ends):
    """Words without ASCII punctuation at either end."""
    sign = np.zeros(256, bool)
    sign[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    starts, ends = starts.copy(), ends.copy()
    is_sign = sign[raw]
    turns = np.r_[0, np.flatnonzero(is_sign[1:] != is_sign[:-1]) + 1, len(raw)]  # starts of runs
    cut = np.flatnonzero(ends > starts)
    cut = cut[is_sign[ends[cut] - 1]]
    ends[cut] = np.maximum(starts[cut], turns[np.searchsorted(turns, ends[cut] - 1, "right") - 1])
    cut = np.flatnonzero(ends > starts)
    cut = cut[is_sign[starts[cut]]]
    starts[cut] = np.minimum(ends[cut], turns[np.searchsorted(turns, starts[cut], "right")])
    return starts, ends


def _mentions(raw: np.ndarray, offsets: np.ndarray, known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, sentence, term, start, end) of every identity term; a sentence ends with . ! ? or a line."""
    hashes, places = known
    starts, ends, first = split_words(raw, offsets)
    a, z = _core(raw, starts, ends)
    words = hash_words(raw, a, z, lower=True)
    at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
    found = np.flatnonzero((hashes[at] == words) & (z > a))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    stops = np.r_[0, np.cumsum(np.isin(raw, np.frombuffer(b".!?", np.uint8)))]
    lines = np.r_[0, np.cumsum(raw == 10)]
    ended = stops[ends] > stops[z]  # signs behind a word's letters
    sentence = np.r_[0, np.cumsum(ended)[:-1]] + lines[starts] if len(starts) else starts
    return rows[found], sentence[found], places[at[found]], a[found], z[found]


def swap_terms(text: bytes, k: int = 1, known=None) -> bytes | None:
    """``text`` with every identity term swapped for the k-th next of its group, or None if it has none."""
    raw = np.frombuffer(text, np.uint8)
    _, _, terms, starts, ends = _mentions(raw, np.array([0, len(raw)]), known or _term_hashes())
    out, done = [], 0
    for term, a, z in zip(terms.tolist(), starts.tolist(), ends.tolist(), strict=True):
        out += [text[done:a], _TERMS[_other(term, k)].encode()]
        done = z
    return b"".join([*out, text[done:]]) if out else None


def _row_lists(rows, feats, n):
    order = np.argsort(rows, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(rows, minlength=n))], feats[order].astype(np.int32)


def _term_features() -> list[frozenset[int]]:
    """The features of each term, without the length's."""
    raw = np.frombuffer("".join(_TERMS).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in _TERMS])]
    rows, feats = text_features(raw, offsets)
    return [frozenset(x for x in feats[rows == i].tolist() if x < 1 << BITS) for i in range(len(_TERMS))]


def swaps(raw: np.ndarray, offsets: np.ndarray, known, features: list[frozenset[int]]) -> list[list[tuple[float, list[int], list[int]]]]:
    """For each row its different swaps: (share of the row's swaps, features taken away, features brought)."""
    rows, sentences, terms, _, _ = _mentions(raw, offsets, known)
    said: dict[tuple[int, int], set[int]] = {}
    for row, sentence, term in zip(rows.tolist(), sentences.tolist(), terms.tolist(), strict=True):
        said.setdefault((row, sentence), set()).add(term)
    count: list[Counter] = [Counter() for _ in range(len(offsets) - 1)]
    for (row, _), found in said.items():
        for k in range(1, max(_GROUP[t][1] for t in found)):
            new = {_other(t, k) for t in found}
            if new != found:
                count[row][frozenset(found), frozenset(new)] += 1
    out = []
    for row in count:
        total = sum(row.values())
        made = []
        for (old, new), n in sorted(row.items(), key=lambda x: (sorted(x[0][0]), sorted(x[0][1]))):
            a, b = (frozenset().union(*[features[t] for t in side]) for side in (old, new))
            made.append((n / total, sorted(a - b), sorted(b - a)))
        out.append(made)
    return out


def _labelled(batches):
    known, features = _term_hashes(), _term_features()
    for b in batches:
        for r0, r1, raw, offsets in steps(b.column(1)):
            at, flat = _row_lists(*text_features(raw, offsets), r1 - r0)
            made = [[{"share": share, "away": away, "come": come} for share, away, come in row] for row in swaps(raw, offsets, known, features)]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
            yield batch([("hashed", b.column(0)[r0:r1]), ("label", b.column(2)[r0:r1]), ("features", lists), ("swaps", pa.array(made, _SWAPS))])


_SWAPS = pa.list_(pa.struct([("share", pa.float64()), ("away", pa.list_(pa.int32())), ("come", pa.list_(pa.int32()))]))


class Pairs:
    """The swaps of all texts in flat form: swaps of text i are ``at[i] .. at[i + 1]``, features of swap j ``of[j] .. of[j + 1]``."""

    def __init__(self, rows: list[list[tuple[float, list[int], list[int]]]]):
        self.at = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
        every = [p for r in rows for p in r]
        self.share = np.array([p[0] for p in every], float)
        self.of = np.r_[0, np.cumsum([len(p[1]) + len(p[2]) for p in every])].astype(np.int64)
        self.feature = np.array([f for p in every for f in (*p[1], *p[2])], np.int64)
        self.sign = np.array([s for p in every for s in [1.0] * len(p[1]) + [-1.0] * len(p[2])])


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of every place in the ranges."""
    n = ends - starts
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def fit(labels: np.ndarray, at: np.ndarray, flat: np.ndarray, pairs: Pairs | None = None, order: np.ndarray | None = None, counterfactual: float = COUNTERFACTUAL) -> np.ndarray:
    """Weights (the last is the bias) from feature lists in CSR form; deterministic for a given order of rows.

    Follow-the-regularised-leader steps with an absolute penalty, so that most weights are zero.
    """
    size = (1 << BITS) + LENGTHS + 1
    active = np.bincount(flat, minlength=size) >= LEAST_TEXTS
    weights, sums, squares = np.zeros(size), np.zeros(size), np.zeros(size)
    order_of = np.random.default_rng(7)
    order = np.arange(len(labels)) if order is None else order
    share = float(labels.mean()) if len(labels) else 0.5
    weight_of = np.where(labels > 0, 0.5 / max(share, 0.02), 0.5 / max(1 - share, 0.02)) ** BALANCE
    for _ in range(PASSES):
        for pick in np.array_split(order[order_of.permutation(len(labels))], max(1, len(labels) // STEP_TEXTS)):
            if not len(pick):
                continue
            row, place = _ranges(at[pick], at[pick + 1])
            f = flat[place]
            row, f = row[active[f]], f[active[f]]
            z = weights[-1] + np.bincount(row, weights[f], len(pick))
            pull = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * weight_of[pick]
            grad = np.bincount(f, pull[row], size)
            grad[-1] += pull.sum()
            if pairs is not None and counterfactual:
                swap = _ranges(pairs.at[pick], pairs.at[pick + 1])[1]
                number, place = _ranges(pairs.of[swap], pairs.of[swap + 1])
                f, sign = pairs.feature[place], pairs.sign[place]
                number, f, sign = number[active[f]], f[active[f]], sign[active[f]]
                change = np.bincount(number, sign * weights[f], len(swap))
                force = 2 * counterfactual * pairs.share[swap] * change
                grad += np.bincount(f, sign * force[number], size)
            hit = np.flatnonzero(grad)
            g = grad[hit]
            root = np.sqrt(squares[hit] + g * g)
            sums[hit] += g - (root - np.sqrt(squares[hit])) / RATE * weights[hit]
            squares[hit] += g * g
            least = np.where(hit == size - 1, 0.0, SPARSE)
            over = np.maximum(np.abs(sums[hit]) - least, 0)
            weights[hit] = -np.sign(sums[hit]) * over / ((1 + root) / RATE + SHRINK)
    return weights


def _train(counterfactual: float):
    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        labels, hashed = np.asarray(table.column("label")).astype(float), np.asarray(table.column("hashed"))
        lists = table.column("features")
        at = np.r_[0, np.cumsum(np.concatenate([np.asarray(c.value_lengths()) for c in lists.chunks]))].astype(np.int64)
        flat = np.concatenate([np.asarray(c.flatten()) for c in lists.chunks])
        pairs = Pairs([[(p["share"], p["away"], p["come"]) for p in row] for row in table.column("swaps").to_pylist()])
        # Rows arrive in any order: they are numbered by hash, label and length before anything random.
        weights = fit(labels, at, flat, pairs, np.lexsort((np.diff(at), labels, hashed)), counterfactual)
        used = np.flatnonzero(weights)
        yield batch([("feature", used.astype(np.int32)), ("weight", weights[used])])

    return run


def learn(docs: DataFrame, labels: DataFrame, counterfactual: float = COUNTERFACTUAL) -> np.ndarray:
    """Weights of a classifier for ``docs`` (doc_id, text) and ``labels`` (id, label), fitted in one task on a bounded sample.

    The sample holds the texts of the SAMPLE_ROWS labelled ids of smallest hash, or of all if there
    are fewer; its edge comes from the labels alone, and only its texts move.  Null labels teach
    nothing; without any label, or with one kind of label only, scores are the same for all texts.
    """
    known = labels.where("label IS NOT NULL AND id IS NOT NULL").select("id", "label", F.xxhash64("id").alias("hashed"))
    edge = known.select("hashed").orderBy("hashed").limit(SAMPLE_ROWS).agg(F.max("hashed")).first()[0]
    if edge is None:
        return np.zeros((1 << BITS) + LENGTHS + 1, np.float32)
    texts = docs.where(F.xxhash64("doc_id") <= F.lit(edge)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = texts.join(known.where(F.col("hashed") <= F.lit(edge)), F.col("doc_id") == F.col("id")).select("hashed", "text", "label").repartition(16)
    lists = map_arrow(sample, _labelled, "hashed long, label int, features array<int>, swaps array<struct<share:double,away:array<int>,come:array<int>>>")
    found = map_arrow(lists.repartition(1), _train(counterfactual), "feature int, weight double").collect()
    weights = np.zeros((1 << BITS) + LENGTHS + 1, np.float32)
    for r in found:
        weights[r.feature] = r.weight
    return weights


def score(texts: DataFrame, weights: np.ndarray, id_cols: tuple[str, ...], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``id_cols`` and score, 0 to 1 and higher where the label 1 is likelier, of each whole text; a null counts as empty."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    base = texts.select(*[col(c) for c in id_cols], col(text_col).cast("string").alias("_source_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema[:-1])

    def run(batches):
        w = shared.value
        for b in batches:
            for r0, r1, raw, offsets in steps(b.column(b.num_columns - 1)):
                row, feature = text_features(raw, offsets)
                z = w[-1] + np.bincount(row, w[feature], r1 - r0)
                yield batch([(n, b.column(i)[r0:r1]) for i, n in enumerate(b.schema.names[:-1])] + [(out_col, 1 / (1 + np.exp(-np.clip(z, -60, 60))))])

    return map_arrow(base, run, schema + f"{out_col} double")


def held_out(id_col: str, parts: int = 3, part: int = 1):
    """Whether crc32 of the id as text leaves ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", counterfactual: float = COUNTERFACTUAL) -> DataFrame:
    """(doc_key, doc_id, held_out, score, predicted): one row for each row of ``docs``.

    Learns from labelled rows that are not held out; language, source, labels and ids are no inputs
    of a score.  ``counterfactual`` weighs the penalty of score changes under swapped identity terms; 0
    leaves it out.  ``predicted`` is 1 from a score of THRESHOLD on.  Several labels of one id all
    count.  Repeated and null ids are separate rows; a null id has no label.  Other columns are not
    read; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    known = labels.select(col(id_col).cast("long").alias("id"), col(label_col).cast("int").alias("label"))
    weights = learn(rows.where(~held_out("doc_id")), known.where(~held_out("id")), counterfactual)
    scored = score(rows, weights, ("doc_key", "doc_id"))
    return scored.select("doc_key", "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    ship(docs.sparkSession)
    known = labels.select(col(id_col).cast("long").alias("id"), col(label_col).cast("int").alias("label"))
    taught = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    weights = learn(taught.where(~held_out("doc_id")), known.where(~held_out("id")))
    return score(docs, weights, tuple(docs.columns), text_col, out_col=(out := free_name(docs.columns, "score"))).where(F.col(out) < THRESHOLD).drop(out)
