"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Overlong documents are cut into full windows and a tail.  Best-fit decreasing only looks at lengths,
and there are at most ``capacity`` of them, so the plan is made from the histogram of piece lengths:
a segment tree indexed by remaining capacity finds the tightest open windows, and whole runs of
equally filled windows take their items in one step.  The plan's size depends on the capacity, not
on the number of documents.  Each piece then finds its place by its rank among pieces of its length;
ranks come from per-task counters and a prefix sum over tasks, so no length gathers in one task.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, keyed, map_arrow, register_cache, ship, stored

#: Parts of chunks that a process keeps (about 75 MB at most), the longest that it keeps, and texts and bytes encoded together.
_CACHED_WORDS, _CACHED_BYTES, _TOGETHER, _TOGETHER_BYTES = 500_000, 64, 1024, 4 << 20
#: Bytes that do not stand for themselves in the vocabulary are numbered from 256 on.
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b < 0x7F or 0xA1 <= b and b != 0xAD))}


class CapacityTree:
    """A segment tree over remaining capacities that tells the smallest non-empty one at or above a value."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, at: int, value: bool) -> None:
        at += self.leaves
        while at and self.any[at] != value:
            self.any[at] = value
            at >>= 1
            value = self.any[2 * at] or self.any[2 * at + 1] if at else value

    def tightest(self, least: int) -> int | None:
        at = least + self.leaves
        while not self.any[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:  # wrapped to the next level
                return None
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts`` (length: number) as rows (length, first rank, first window, per window, offset).

    A row holds from its first rank on until the next row of the length; rank i of it lies in window
    ``first window + i // per window`` at ``offset + i % per window * length``.
    """
    tree, open_runs = CapacityTree(capacity), defaultdict(list)  # remaining: [(first window, windows)]
    rows, windows = [], 0

    def give(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_runs[remaining].append((first, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, n = capacity, windows, -(-left // (capacity // length))
                windows += n
            else:
                first, n = open_runs[remaining].pop()
                if not open_runs[remaining]:
                    tree.set(remaining, False)
            each = remaining // length
            full, part = (n, 0) if left >= n * each else divmod(left, each)
            rows.append((length, rank, first, each, capacity - remaining))
            give(remaining - each * length, first, full)
            give(remaining - part * length, first + full, bool(part))
            give(remaining, first + full + bool(part), n - full - bool(part))
            rank += full * each + part
            left -= full * each + part
    return rows


def _bytes(strings: pa.Array) -> list[bytes]:
    return strings.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def _runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ``values`` one behind the other, their ends after a 0)."""
    ends = np.r_[0, np.cumsum(sizes)]
    return values[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)], ends


class WordIds:
    """Ids of white-space separated chunks as little-endian 32-bit bytes, computed once in a process.

    The tokenizer drops white space before it splits and merges, so a text's ids are those of its
    chunks in order, and a chunk of letters followed by signs gives the ids of its letters and then
    of its signs.  Arrow cuts the different chunks of a group of texts into such parts, other chunks
    stay whole, and only different parts that are new are seen by Python.  Words of Latin letters,
    normalised, go to the tokenizer's merges directly, in the characters that stand for their bytes.
    Other new letters are encoded together, joined to one text, and cut again behind the ids that end
    a word.

    Parts are kept in a young and an old table: a hit in the old one moves to the young one, and when
    the young one is full it replaces the old one, so that rare parts leave and frequent ones stay.
    """

    #: ASCII signs but the apostrophe, which the tokenizer takes together with letters.
    _SIGNS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and b != ord("'"))
    _LATIN = re.compile("[a-zß-öø-ɏ]+")

    def __init__(self, path: str, most: int = _CACHED_WORDS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task on each core
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.most = most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        # Of the library's calls the one that leaves out offsets.
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, shown: str) -> bytes:
        made = [t.id for t in self.merge(shown)]
        return struct.pack(f"<{len(made)}I", *made)

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters, not all of them ASCII."""
        normal = self.tokenizer.normalizer.normalize_str(b" ".join(words).decode()).split(" ")
        if len(normal) != len(words):
            normal = [""] * len(words)
        out = [self._merged(text.encode().decode("latin-1").translate(_BYTE_CHARS)) if self._LATIN.fullmatch(text) else None for text in normal]
        rest = [i for i, ids in enumerate(out) if ids is None]
        if rest:
            for i, ids in zip(rest, self._by_library([words[i].decode() for i in rest]), strict=True):
                out[i] = ids
        return out

    def _by_library(self, words: list[str]) -> list[bytes]:
        data = self._ids([" ".join(words)])[0]
        ends = np.flatnonzero(self.last[np.frombuffer(data, "<u4")]) + 1
        if len(ends) == len(words):  # every one gives at least one word, so each gave exactly one
            return [data[a:z] for a, z in itertools.pairwise([0, *(4 * ends).tolist()])]
        return self._ids(words)

    def learn(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new parts; words of ASCII letters are in lower case."""
        out, letters, others = {}, [], []
        for part in parts:
            if part.isalpha():  # of bytes: ASCII letters only
                out[part] = self._merged(part.decode())
            elif not part.isascii() and part.decode("utf-8", "replace").isalpha():
                letters.append(part)
            else:
                others.append(part)
        for group in itertools.batched(letters, 4096):
            out.update(zip(group, self._of_words(list(group)), strict=True))
        out.update(zip(others, self._ids([x.decode("utf-8", "replace") for x in others]), strict=True))
        return out

    def _parts(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(word of letters or whole chunk, signs behind the word) of each chunk."""
        words = pc.ascii_rtrim(chunks, characters=self._SIGNS)
        plain = pc.ascii_is_alpha(words)
        letters = np.array(plain)
        foreign = np.flatnonzero(~np.asarray(pc.string_is_ascii(words)))
        letters[foreign] = [w.decode("utf-8", "replace").isalpha() for w in _bytes(words.take(pa.array(foreign)))]
        heads = pc.if_else(pa.array(letters), pc.if_else(plain, pc.ascii_lower(words), words), chunks)
        width = np.where(letters, np.asarray(pc.binary_length(chunks)) - np.asarray(pc.binary_length(words)), 0)
        _, at, data = chunks.buffers()
        ends = np.frombuffer(at, np.int64)[chunks.offset + 1 : chunks.offset + len(chunks) + 1]
        signs, cuts = _runs(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends - width, width)
        return heads, pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(cuts), pa.py_buffer(signs))

    def encode(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """The ids of each whole text; each part of the texts is looked up once, and its ids are put in place by numpy."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary())).view(pa.large_string())
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(column))
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(column)
        parted = pa.concat_arrays(self._parts(coded.dictionary)).dictionary_encode()
        parts = _bytes(parted.dictionary)
        ids = list(map(self.young.get, parts))
        new = [i for i, x in enumerate(ids) if x is None]
        known = {w: self.old[w] for w in (parts[i] for i in new) if w in self.old}
        known |= self.learn([parts[i] for i in new if parts[i] not in known])
        for i in new:
            ids[i] = known[parts[i]]
        self.young.update((w, x) for w, x in known.items() if len(w) <= _CACHED_BYTES)
        if len(self.young) >= self.most // 2:
            self.young, self.old = {}, self.young
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        # A chunk is its word and its signs, a text its chunks.
        both = np.asarray(parted.indices).reshape(2, -1).T.ravel()
        flat, ends = _runs(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(sizes) - sizes)[both], sizes[both])
        starts, code = ends[::2], np.asarray(coded.indices)
        flat, ends = _runs(flat, starts[code], np.diff(starts)[code])
        data, cuts = flat.tobytes(), 4 * ends[np.r_[0, np.cumsum(np.asarray(split.value_lengths()))]]
        return [data[a:z] for a, z in itertools.pairwise(cuts.tolist())]


_codecs: dict[str, WordIds] = {}
register_cache("packing", _codecs.clear)


def word_ids(path: str) -> WordIds:
    """The tokenizer of a path with what it has learned, one in a process: tasks of a worker share it."""
    if path not in _codecs:
        _codecs[path] = WordIds(path)
    return _codecs[path]


def _groups(sizes: np.ndarray) -> Iterator[slice]:
    """Rows in a row that are encoded together: at most _TOGETHER, and _TOGETHER_BYTES or one row."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        most = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + _TOGETHER_BYTES, "right"))
        high = min(max(low + 1, most), low + _TOGETHER)
        yield slice(low, high)
        low = high


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches):
        task = TaskContext.get().partitionId()
        ids_of, rank = word_ids(path), defaultdict(int)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            rows = []
            keys, docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary()).fill_null(b"")
            for some in _groups(np.asarray(pc.binary_length(texts))):
                encoded = ids_of.encode(texts[some])
                for key, doc, ids in zip(keys[some], docs[some], encoded, strict=True):
                    ids += end
                    for a in range(0, len(ids), step):
                        part = ids[a : a + step]
                        n = len(part) // 4
                        rows.append((key, doc, a // 4, n, zlib.crc32(part), len(ids) // 4, task, rank[n], part if keep_ids else None))
                        rank[n] += 1
            names = ("doc_key", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth")
            columns = list(zip(*rows, strict=True)) or [()] * 9
            out = [(n, pa.array(c, pa.int64())) for n, c in zip(names, columns[:8], strict=True)]
            if keep_ids:
                flat = np.frombuffer(b"".join(columns[8]), "<i4")
                out.append(("ids", pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) // 4 for x in columns[8]])], pa.int32()), pa.array(flat))))
            yield batch(out)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_key, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is the tokenizer's ids of its whole text (null counts as empty) and ``end_id``; it is
    cut every ``capacity`` ids.  Sequences are numbered from 0 and filled from offset 0 without gaps.
    Equal lengths fill in the order of the tasks that read them, so which of equally long pieces
    takes which place may depend on how the input is split.  Repeated or null ids are separate
    documents (``common.keyed``); other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    names = "doc_key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long"
    schema = names + (", ids array<int>" if keep_ids else "")
    pieces = stored(map_arrow(keyed(docs, id_col, text_col), _pieces(tokenizer, capacity, end_id, keep_ids), schema, cache="packing"), "pieces")
    counts = pieces.groupBy(F.col("task").alias("t"), F.col("length").alias("n")).agg(F.count("*").alias("many"))
    before = Window.partitionBy("n").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("t", "n", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    # At most ``capacity`` rows, whatever the input.
    totals = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = np.array(plan(totals, capacity), np.int64).reshape(-1, 5)
    rows = rows[np.argsort(rows[:, 0] << 48 | rows[:, 1])]
    table = spark.sparkContext.broadcast((rows[:, 0] << 48 | rows[:, 1], rows))

    def place(batches):
        at, rows = table.value
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            row = rows[np.searchsorted(at, length << 48 | rank, side="right") - 1] if len(length) else rows[:0]
            i = rank - row[:, 1]
            sequence, offset = row[:, 2] + i // row[:, 3], row[:, 4] + i % row[:, 3] * length
            keep = [(n, b.column(n)) for n in ("doc_key", "doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield batch(keep + [("sequence_id", sequence), ("offset", offset)] + ([("ids", b.column("ids"))] if keep_ids else []))

    ranked = pieces.join(bases, (F.col("task") == F.col("t")) & (F.col("length") == F.col("n"))).withColumn("rank", F.col("base") + F.col("nth")).drop("t", "n", "base", "task", "nth")
    out = "doc_key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_arrow(ranked, place, out + (", ids array<int>" if keep_ids else ""))


def sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, segments): the packed windows of ``pack(..., keep_ids=True)``, padded to ``capacity``.

    ``segments`` numbers the pieces of a window from 1 and is 0 on padding.  A window has at most ``capacity`` ids.
    """
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    segments = F.flatten(F.transform("parts", lambda p, i: F.array_repeat(i + 1, F.size(p["ids"]))))
    fill = F.lit(capacity) - F.size(ids)
    return parts.select(
        "sequence_id",
        F.concat(ids, F.array_repeat(F.lit(pad_id), fill)).alias("ids"),
        F.concat(segments, F.array_repeat(F.lit(0), fill)).alias("segments"),
    )
