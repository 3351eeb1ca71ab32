"""SentencePiece encoding with spans in the original bytes, and decoding.

Every text passes the model's own normalisation: at each place the longest prefix known to the compiled
character map is replaced, and every normalised byte records the original byte it came from (its own
where nothing is replaced, else the first that was).  The library merges the normalised text as it is,
and pieces, measured in normalised bytes, are projected through that record.
"""

from __future__ import annotations

import itertools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, col, free_name, free_names, ints, map_arrow, register_cache, ship
from .words import steps

#: Runs that a process keeps (about 150 MB at most), the longest that it keeps, bytes of text normalised and rows handed on together.
_CACHED_RUNS, _CACHED_BYTES, _STEP_BYTES, _TOGETHER = 600_000, 64, 1 << 19, 256
_MARK = "▁".encode()
_TAIL = {True: re.compile(b"(?: |%b)*\\Z" % _MARK), False: re.compile(rb" *\Z")}


class CharacterMap:
    """Longest-prefix lookup in a compiled character map: a double-array trie and a pool of strings."""

    def __init__(self, blob: bytes, symbols: tuple[bytes, ...] = ()):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :]
        #: User-defined pieces stay as they are; longest first.
        self.symbols = sorted(symbols, key=len, reverse=True)
        #: Bytes with which an entry may start.
        self.first = np.array([self._step(self._child(0), b) is not None for b in range(256)]) if self.units else np.zeros(256, bool)
        self.first[[s[0] for s in self.symbols]] = True

    def _child(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10) << ((unit & 0x200) >> 6)

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int, stop: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest entry that starts at ``at`` and ends by ``stop``."""
        for symbol in self.symbols:
            if data.startswith(symbol, at, stop):
                return len(symbol), symbol
        if not self.units:
            return None
        base, found = self._child(0), None
        for end in range(at, stop):
            node = self._step(base, data[end])
            if node is None:
                break
            base = self._child(node)
            if self.units[node] >> 8 & 1:
                start = self.units[base] & 0x7FFFFFFF
                found = end + 1 - at, self.pool[start : self.pool.index(b"\0", start)]
        return found


class Normalizer:
    """The model's normalisation of many texts at once, with the origin of every normalised byte."""

    def __init__(self, spec, symbols: tuple[bytes, ...] = (), suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap, symbols)
        self.dummy, self.trim, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix

    def _mapped(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mapped bytes, their origins, row offsets into them)."""
        places = np.flatnonzero(self.map.first[raw])
        if not len(places):
            return raw, np.arange(len(raw)), offsets
        data, stops = raw.tobytes(), offsets[np.searchsorted(offsets, places, "right")]
        size, done, new = np.ones(len(raw), np.int64), 0, []
        for at, stop in zip(places.tolist(), stops.tolist(), strict=True):
            hit = self.map.longest(data, at, stop) if at >= done else None
            if hit:
                done = at + hit[0]
                size[at:done] = 0
                size[at] = len(hit[1])
                new.append((at, hit[1]))
        origin = np.repeat(np.arange(len(raw)), size)
        out, at = raw[origin], np.r_[0, np.cumsum(size)]
        if new:
            starts = at[[a for a, _ in new]]
            lengths = np.array([len(x) for _, x in new])
            place = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            out[place] = np.frombuffer(b"".join([x for _, x in new]), np.uint8)
        return out, origin, at[offsets]

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(normalised bytes, row offsets into them, origin of each byte in ``raw``) of the texts in ``raw``."""
        text, origin, rows = self._mapped(raw, offsets)
        space = text == 0x20
        keep = np.ones(len(text), bool)
        some = np.flatnonzero(np.diff(offsets) > 0)
        if self.trim:
            behind = np.r_[True, space[:-1]] if len(text) else space
            behind[rows[:-1][rows[:-1] < len(text)]] = True
            keep = ~(space & behind)
            full = np.flatnonzero(np.diff(rows))
            blank = text[rows[1:][full] - 1]
            for i in full[(blank == 0x20) | self.escape & (blank == _MARK[-1])].tolist():
                # At the end of a text a literal mark counts as a space.
                end = _TAIL[self.escape].search(text[rows[i] : rows[i + 1]].tobytes())
                keep[rows[i] + end.start() : rows[i + 1]] = False
            count = np.r_[0, np.cumsum(keep)]
            some = np.flatnonzero(count[rows[1:]] > count[rows[:-1]])
        if self.dummy and len(some):
            kept = np.flatnonzero(keep)
            first = np.searchsorted(kept, rows[some])
            begins = np.where(first < len(kept), origin[kept[np.minimum(first, len(kept) - 1)]] if len(kept) else 0, offsets[some + 1])
            begins = offsets[some + 1] if self.suffix else np.minimum(begins, offsets[some + 1])
            at = rows[some + 1] if self.suffix else rows[some]
            text, origin, keep, space = np.insert(text, at, 0x20), np.insert(origin, at, begins), np.insert(keep, at, True), np.insert(space, at, True)
            added = np.zeros(len(rows), np.int64)
            added[some + 1] = 1
            rows = rows + np.cumsum(added)
        size = keep.astype(np.int64)
        if self.escape:
            size[space & keep] = len(_MARK)
        ends = np.r_[0, np.cumsum(size)]
        out, origin = np.repeat(text, size), np.repeat(origin, size)
        if self.escape:
            marks = ends[:-1][space & keep]
            for i, byte in enumerate(_MARK):
                out[marks + i] = byte
        return out, ends[rows], origin


class Codec:
    """One loaded model: ids and byte spans of whole texts, and decoding.

    Where no piece has a space mark after another character, merges never cross the start of a run
    of space marks, so a text's pieces are those of its runs-and-words, and frequent ones are kept,
    as in ``packing.WordIds``, in a young and an old table.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        symbols = tuple(p.piece.encode() for p in proto.pieces if p.type == p.USER_DEFINED)
        self.normalize = Normalizer(spec, symbols, trainer.treat_whitespace_as_suffix)
        self.names = [p.piece for p in proto.pieces]
        #: Normalised bytes of each piece.
        self.widths = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        inner = any("▁" in p.piece.lstrip("▁") or p.type == p.USER_DEFINED and "▁" in p.piece for p in proto.pieces)
        self.by_run = trainer.model_type == trainer.BPE and trainer.byte_fallback and spec.escape_whitespaces and not inner
        # The same merges without any normalisation: they take the normalised text as it is.
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.runs = re.compile(b"(?:%b)+(?:(?!%b).)*|(?:(?!%b).)+" % (_MARK, _MARK, _MARK), re.DOTALL)

    def _by_runs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all normalised texts, row offsets into them)."""
        split, young = [], self.young
        for t in texts:
            words = t.split(_MARK)
            # Without the first mark every word stands for itself behind one mark; else runs are cut one by one.
            split.append(words[1:] if words[0] == b"" and b"" not in words[1:] else [b"\0" + r for r in self.runs.findall(t)])
        parts = [list(map(young.get, words)) for words in split]
        new = {w for words, ids in zip(split, parts, strict=True) if None in ids for w, i in zip(words, ids, strict=True) if i is None}
        known = {w: self.old[w] for w in new if w in self.old}
        asked = list(new - known.keys())
        texts_of = [(w[1:] if w.startswith(b"\0") else _MARK + w).decode("utf-8", "replace") for w in asked]
        for w, ids in zip(asked, self.bare.encode(texts_of, num_threads=1), strict=True):
            known[w] = struct.pack(f"={len(ids)}i", *ids)
        young.update((w, i) for w, i in known.items() if len(w) <= _CACHED_BYTES)
        if len(young) >= _CACHED_RUNS // 2:
            self.young, self.old = {}, young
        rows = [b"".join([known[w] if i is None else i for w, i in zip(words, ids, strict=True)] if None in ids else ids) for words, ids in zip(split, parts, strict=True)]
        return np.frombuffer(b"".join(rows), np.int32), np.r_[0, np.cumsum([len(r) // 4 for r in rows])]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, row offsets into them, start and end byte of each piece in its text) of the texts in ``raw``."""
        normal, rows, origin = self.normalize(raw, offsets)
        data = normal.tobytes()
        texts = [data[a:z] for a, z in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
        if self.by_run:
            ids, at = self._by_runs(texts)
            widths = self.widths[ids]
        else:
            shown = [t.decode("utf-8", "replace") for t in texts]
            made = self.bare.encode(shown, num_threads=1)
            ids, at = np.array([i for x in made for i in x], np.int32), np.r_[0, np.cumsum([len(x) for x in made])]
            widths = self.widths[ids]
            unknown = np.flatnonzero(ids == self.bare.unk_id())
            if len(unknown):  # what an unknown piece stands for is told by its surface
                surface = [p for x in self.bare.encode(shown, out_type=str, num_threads=1) for p in x]
                widths[unknown] = [len(surface[i].encode()) for i in unknown.tolist()]
        ends = np.r_[origin, len(raw)][np.minimum(np.cumsum(widths), len(origin))]
        some = np.flatnonzero(np.diff(at))
        ends[at[some + 1] - 1] = offsets[some + 1]
        base = np.repeat(offsets[:-1], np.diff(at))
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        starts[at[some]] = offsets[some]
        return ids, at, starts - base, ends - base


_codecs: dict[str, Codec] = {}
register_cache("pieces", _codecs.clear)


def codec(path: str) -> Codec:
    """The model of a path, loaded once in a process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(texts: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ids, starts, ends (array<int>): the pieces of each whole text and their byte spans.

    Spans are in the UTF-8 bytes of the original text and cover it without gaps; the dummy prefix
    covers no bytes.  No begin or end ids and no sampling.  A null counts as the empty text, which
    has no pieces.  Rows are independent; repeated rows, any ids and other columns are carried as they are.
    Where ``keep`` has a column of a new one's name, the new one is ids_1, starts_1 or ends_1.
    """
    names = free_names(keep, ("ids", "starts", "ends"))
    ship(texts.sparkSession)
    base = texts.select(*[col(c) for c in keep], col(text_col).cast("string").alias("_source_text"))

    def run(batches):
        c = codec(model)
        for b in batches:
            kept = [(n, b.column(i)) for i, n in enumerate(b.schema.names[:-1])]
            for r0, r1, raw, offsets in steps(b.column(b.num_columns - 1), _STEP_BYTES):
                ids, at, starts, ends = c.encode(raw, offsets)
                for low in range(0, r1 - r0, _TOGETHER):
                    rows = at[low : min(low + _TOGETHER, r1 - r0) + 1]
                    part = slice(rows[0], rows[-1])
                    lists = [(name, ints(rows - rows[0], x[part])) for name, x in zip(names, (ids, starts, ends), strict=True)]
                    yield batch([(n, x[r0 + low : r0 + low + len(rows) - 1]) for n, x in kept] + lists)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema[:-1])
    return map_arrow(base, run, schema + ", ".join(f"{n} array<int>" for n in names), cache="pieces")


def decoded(library, lists: pa.ListArray) -> list[str]:
    """The library's decoding of each list; its numbers become one Python list, without an Arrow object for each."""
    ids, ends = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum(lists.value_lengths().fill_null(0))
    return [library.decode(ids[a:z]) if z > a else "" for a, z in itertools.pairwise([0, *ends.tolist()])]


def decode(pieces: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``pieces`` with one more column: the library's decoding of each row's ids; null ids decode to the empty text.

    Where ``pieces`` has a column of that name already, the new one is decoded_1, decoded_2 and so on.
    """
    text_col = free_name(pieces.columns, text_col)
    base = pieces.select("*", col(ids_col).cast("array<int>").alias("_decoded_ids"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema[:-1])

    def run(batches):
        library = codec(model).library
        for b in batches:
            for low in range(0, b.num_rows, _TOGETHER):
                part = b.slice(low, _TOGETHER)
                texts = decoded(library, part.column(b.num_columns - 1))
                yield batch([(n, part.column(i)) for i, n in enumerate(b.schema.names[:-1])] + [(text_col, pa.array(texts, pa.string()))])

    return map_arrow(base, run, schema + f"`{text_col}` string", cache="pieces")
