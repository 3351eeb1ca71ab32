"""Repeated-passage removal with difference-cover anchors.

Only windows at word positions in a difference cover modulo PERIOD are hashed.  For any two
positions i and j some offset k < PERIOD puts both i + k and j + k on the cover, so two equal windows
of ``window`` words share an aligned anchor of ``window - PERIOD + 1`` words.  Anchors that occur
once end there; around the others the match is extended to every whole window that contains one,
and those windows are resolved by 96 bits of hash: the earliest stays, all later ones are marked.
Whole texts that repeat are told by 96 bits as well and leave before their windows are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import hits, repeated_plane
from .common import batch, col, free_name, keyed, map_arrow, ship, stored, with_key
from .words import hash_runs, hash_words, mix, split_words, steps

#: Perfect difference covers, by period: every residue is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
#: Keys that one task combines before it hands them on; a bound on memory, not on results.
COMBINE_ROWS = 1 << 20
#: Position that stands for "this whole text repeats an earlier one".
_COPY = -1


def _period(window: int) -> int:
    return max(p for p in COVERS if p <= max(1, (2 * window + 2) // 3))


def _text_ids(words: np.ndarray, first: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of each row's whole word sequence; ``lane`` picks independent functions."""
    at = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words, 61 + 10 * lane) * mix(at.astype(np.uint64), 62 + 10 * lane), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64), 63 + 10 * lane)


class _Combiner:
    """Keeps a task's earliest place of each key; later places are known to repeat.

    ``known`` rows only travel; they are dealt by document, so that a frequent key gathers nowhere.
    """

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, key, check, doc, at):
        self.parts.append((key, check, doc, at))
        self.rows += len(key)
        return self.flush() if self.rows >= COMBINE_ROWS else ()

    def flush(self):
        if not self.rows:
            return
        key, check, doc, at = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.rows = [], 0
        order = np.lexsort((at, doc, check, key))
        key, check, doc, at = key[order], check[order], doc[order], at[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])]
        more = np.r_[~new[1:], False] & new
        deal = np.where(new, key, mix(doc.view(np.uint64), 64))
        for a in range(0, len(key), 1 << 16):
            s = slice(a, a + (1 << 16))
            yield batch([("deal", deal[s]), ("key", key[s]), ("spot", check[s] << np.uint64(32) | at[s].astype(np.uint32).astype(np.uint64)), ("doc_key", doc[s]), ("kind", (2 * ~new[s] + more[s]).astype(np.int8))])


_COMBINED = "deal long, key long, spot long, doc_key long, kind byte"


def _repeats(all_of_group: bool):
    """Streams rows sorted by (key, check, document, place) and yields the places that repeat.

    ``all_of_group``: every place of a key that occurs at least twice; otherwise, and for whole
    texts always, all but the earliest.
    kind: 0 alone in its task, 1 earliest in its task of several, 2 a later one in its task.
    """

    def run(batches):
        last = None  # (key, check, document, place, kind, emitted) of the row before
        for b in batches:
            if not b.num_rows:
                continue
            key, spot = (np.asarray(b.column(i)).view(np.uint64) for i in (1, 2))
            doc, kind = np.asarray(b.column(3)), np.asarray(b.column(4))
            check, at = spot >> np.uint64(32), (spot & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            plain = kind < 2
            out_doc, out_at = [doc[~plain]], [at[~plain]]
            key, check, doc, at, kind = (x[plain] for x in (key, check, doc, at, kind))
            if len(key):
                same = np.r_[last is not None and last[:2] == (int(key[0]), int(check[0])), (key[1:] == key[:-1]) & (check[1:] == check[:-1])]
                if all_of_group:
                    emit = same | (at >= 0) & ((kind == 1) | np.r_[same[1:], False])
                    if same[0] and not last[4] and last[3] >= 0:
                        out_doc.append(np.array([last[2]], np.int64))
                        out_at.append(np.array([last[3]], np.int32))
                else:
                    emit = same
                out_doc.append(doc[emit])
                out_at.append(at[emit])
                last = (int(key[-1]), int(check[-1]), int(doc[-1]), int(at[-1]), bool(emit[-1]))
            yield batch([("doc_key", np.concatenate(out_doc).astype(np.int64)), ("at", np.concatenate(out_at).astype(np.int32))])

    return run


def _resolved(rows: DataFrame, all_of_group: bool) -> DataFrame:
    """(doc_key, places array<int>) from combined rows; the hot keys were combined by the tasks that made them."""
    check, at = F.shiftrightunsigned("spot", 32), F.col("spot").bitwiseAND(0xFFFFFFFF)
    dealt = rows.repartition("deal").sortWithinPartitions("key", check, "doc_key", at)
    return map_arrow(dealt, _repeats(all_of_group), "doc_key long, at int").groupBy("doc_key").agg(F.collect_list("at").alias("places"))


def _anchors(window: int, period: int):
    cover, length = np.array(COVERS[period]), window - period + 1

    def run(batches):
        combine = _Combiner()
        for b in batches:
            for r0, r1, raw, offsets in steps(b.column(1)):
                starts, ends, first = split_words(raw, offsets)
                words = hash_words(raw, starts, ends)
                docs, sizes = np.asarray(b.column(0)[r0:r1]), np.diff(first)
                ids, checks = (_text_ids(words, first, lane) for lane in (0, 1))
                long = sizes >= window
                yield from combine.add(ids[long], checks[long] >> np.uint64(32), docs[long], np.full(long.sum(), _COPY))
                runs = hash_runs(words, length)
                at = np.arange(len(words)) - np.repeat(first[:-1], sizes)
                left = np.repeat(sizes, sizes) - at
                pick = np.flatnonzero((left >= length) & (np.repeat(sizes, sizes) >= window) & np.isin(at % period, cover))
                yield from combine.add(runs[pick], np.zeros(len(pick), np.uint64), np.repeat(docs, sizes)[pick], at[pick])
        yield from combine.flush()

    return run


def _windows(window: int, period: int):
    def run(batches):
        combine = _Combiner()
        for b in batches:
            places = b.column(2)
            for r0, r1, raw, offsets in steps(b.column(1)):
                starts, ends, first = split_words(raw, offsets)
                lists = places[r0:r1]
                flat, bounds = np.asarray(lists.flatten()), np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))]
                docs, sizes = np.asarray(b.column(0)[r0:r1]), np.diff(first)
                owner = np.repeat(np.arange(len(docs)), np.diff(bounds))
                anchor = flat >= 0
                ok = np.zeros(len(starts) + 1, bool)
                for k in range(period):
                    at = flat[anchor] - k
                    own = owner[anchor]
                    fine = (at >= 0) & (at + window <= sizes[own])
                    ok[first[:-1][own[fine]] + at[fine]] = True
                pick = np.flatnonzero(ok[:-1])
                key = hash_runs(hash_words(raw, starts, ends), window)[pick]
                check = hash_runs(hash_words(raw, starts, ends, lane=1), window, 1)[pick] >> np.uint64(32)
                doc_of = np.repeat(np.arange(len(docs)), sizes)
                yield from combine.add(key, check, docs[doc_of[pick]], pick - first[:-1][doc_of[pick]])
        yield from combine.flush()

    return run


def _strip(window: int, trim: bool):
    def run(batches):
        for b in batches:
            out = {name: [] for name in ("n_words", "n_removed", "kept")}
            for r0, r1, raw, offsets in steps(b.column(2)):
                starts, ends, first = split_words(raw, offsets)
                sizes = np.diff(first)
                lists, copies = b.column(3)[r0:r1], np.asarray(b.column(4)[r0:r1])
                flat, bounds = np.asarray(lists.flatten()), np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))]
                owner = np.repeat(np.arange(r1 - r0), np.diff(bounds))
                step = np.zeros(len(starts) + 1, np.int64)
                np.add.at(step, first[:-1][owner] + flat, 1)
                np.add.at(step, first[:-1][owner] + flat + window, -1)
                gone = (np.cumsum(step)[:-1] > 0) | np.repeat(copies, sizes)
                text = raw.tobytes()
                for i in range(r1 - r0):
                    a, z = first[i], first[i + 1]
                    lost = int(gone[a:z].sum())
                    if lost == 0 and not trim:
                        kept = text[offsets[i] : offsets[i + 1]]
                    else:
                        stay = np.flatnonzero(~gone[a:z]) + a
                        kept = b" ".join([text[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
                    out["n_words"].append(int(sizes[i]))
                    out["n_removed"].append(lost)
                    out["kept"].append(kept)
            n = pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64())
            yield batch([("doc_key", b.column(0)), ("doc_id", b.column(1)), ("n_words", n[0]), ("n_removed", n[1]), ("kept_text", pa.array(out["kept"], pa.binary()).cast(pa.string()))])

    return run


def _possibly(texts: DataFrame, wanted: DataFrame, schema: str, rest=None, rest_schema: str = "") -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key may be in ``wanted``, and what ``rest`` makes of the others: a Bloom filter of bounded size.

    ``rest`` works in the process that filters: a task of two Python steps would hold two workers.
    """
    plane, bits = repeated_plane(wanted.select("doc_key"), wanted.count(), key="doc_key", repeated=False)
    want = texts.sparkSession.sparkContext.broadcast(plane)

    def flag(keep: bool):
        def run(batches):
            for b in batches:
                found = hits(np.asarray(b.column(0)).view(np.uint64), want.value, bits)
                yield b.filter(pa.array(found == keep))

        return run

    others = flag(False)
    return map_arrow(texts, flag(True), schema), rest and map_arrow(texts, lambda batches: rest(others(batches)), rest_schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, trim: bool = True, unique: bool = False) -> DataFrame:
    """(doc_key, doc_id, n_words, n_removed, kept_text): one row for each row of ``docs``.

    A word is a run of bytes outside {0x20, 0x09-0x0D}; a window is ``window`` consecutive words of
    one text.  Every word is removed that some window covers whose word sequence also starts
    earlier: in a smaller id, or in the same text at an earlier place.  Windows are judged on the
    input.  ``kept_text`` joins the kept words by one space; with ``trim`` off a text that loses
    nothing stays as it is.  Nulls and texts of fewer than ``window`` words lose nothing.  Repeated
    and null ids are ordered as ``common.keyed`` says, each row being a text of its own.  Other
    columns are not read; an empty table gives an empty result.  ``unique`` as in ``common.keyed``.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs, id_col, text_col, unique)
    texts = rows.select("doc_key", "text")
    period = _period(window)

    anchors = stored(_resolved(map_arrow(texts, _anchors(window, period), _COMBINED), True), "anchors")
    is_copy = F.array_contains("places", _COPY)
    near = _possibly(texts, anchors.where(~is_copy), "doc_key long, text string")[0]
    # Merged, so that rows are filtered and worked on in tasks of their own, each with one worker.
    near = near.join(anchors.where(~is_copy).withColumnRenamed("doc_key", "k").hint("merge"), F.col("doc_key") == F.col("k"))
    later = _resolved(map_arrow(near.select("doc_key", "text", "places"), _windows(window, period), _COMBINED), False)
    none = F.array().cast("array<int>")
    copies = anchors.where(is_copy).select("doc_key", none.alias("places"), F.lit(True).alias("copy"))
    lost = stored(later.withColumn("copy", F.lit(False)).unionByName(copies), "lost")

    strip, schema = _strip(window, trim), "doc_key long, doc_id long, n_words long, n_removed long, kept_text string"

    def untouched(batches):
        for b in batches:
            nothing = pa.ListArray.from_arrays(pa.array(np.zeros(b.num_rows + 1, np.int32)), pa.array([], pa.int32()))
            yield from strip([batch([*((n, b.column(i)) for i, n in enumerate(b.schema.names)), ("places", nothing), ("copy", np.zeros(b.num_rows, bool))])])

    hit, clear = _possibly(rows, lost, "doc_key long, doc_id long, text string", untouched, schema)
    hit = hit.join(lost.withColumnRenamed("doc_key", "k").hint("merge"), F.col("doc_key") == F.col("k"), "left")
    hit = hit.select("doc_key", "doc_id", "text", F.coalesce("places", none).alias("places"), F.coalesce("copy", F.lit(False)).alias("copy"))
    return map_arrow(hit, strip, schema).unionByName(clear)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """``docs`` with all columns and rows, the repeated passages cut from ``text_col``; nulls stay null.

    Texts that lose nothing stay as they are.
    """
    rows, key = with_key(docs, id_col, text_col)
    kept = remove_repeats(rows, key, text_col, window, trim=False, unique=True).where("n_removed > 0")
    cut, at = free_name(rows.columns, "cut_text"), free_name(rows.columns, "cut_key")
    changed = rows.join(kept.select(F.col("doc_key").alias(at), F.col("kept_text").alias(cut)), col(key) == F.col(at), "left")
    new = F.when(F.col(at).isNotNull(), F.col(cut)).otherwise(col(text_col))
    return changed.select(*[new.alias(c) if c == text_col else col(c) for c in docs.columns])
