"""MPEG audio columns: writing a payload as frames and reading frames back.

The writer makes a valid MPEG-1 layer III stream: an ID3v2 tag with the payload's length, a frame
with the variable-bitrate table (frame and byte counts, 100 seek points), then frames whose side
information declares silence, so that all bytes behind it are ancillary data, which hold the payload.
Every frame carries the CRC-16 of its header and side information.

The reader takes any stream of layers I-III, MPEG-1, 2 and 2.5, free format included: it skips ID3v2,
ID3v1 and APE tags, resynchronises at the next header that another valid header or the end follows, parses
Xing, Info and VBRI tables, verifies the checksums of layers I and III (those of layer II, whose extent
depends on its allocation tables, are passed over), and returns exact durations and all frames' offsets.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, col, free_names, map_arrow
from .words import steps

# Fixed values of the MPEG audio standards: kbit/s by bitrate index, sample rates, samples in a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

_OWNER = b"payload-bytes\0"
#: Bytes of texts or streams that a task works on together.
STEP_BYTES = 1 << 22


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8 ^ _CRC[crc >> 8 ^ byte]) & 0xFFFF
    return crc


class Header:
    """A parsed frame header; ``size`` is 0 for the free format, ``covered`` the bytes that a checksum covers besides the header's last two."""

    __slots__ = ("covered", "layer", "mono", "padded", "padding", "protected", "rate", "samples", "side", "size", "version")

    def __init__(self, version, layer, protected, bitrate, rate, padded, mono, bound=32):
        family = 1 if version == 3 else 2
        self.version, self.layer, self.protected, self.rate, self.padded, self.mono = version, layer, protected, rate, padded, mono
        self.samples = SAMPLES[family, layer]
        if not bitrate:
            self.size = 0
        elif layer == 1:
            self.size = (12000 * bitrate // rate + padded) * 4
        else:
            self.size = self.samples // 8 * 1000 * bitrate // rate + padded
        self.padding = padded * (4 if layer == 1 else 1)
        self.side = ((17 if mono else 32) if family == 1 else (9 if mono else 17)) if layer == 3 else 0
        # Layer I: four bits of allocation for each of 32 bands, and again for the bands below ``bound`` of a second channel.
        self.covered = self.side or ((16 if mono else (32 + bound) // 2) if layer == 1 else 0)


@lru_cache(1024)
def header(data: bytes) -> Header | None:
    """The header in four bytes, or None if they are none."""
    if len(data) < 4 or data[0] != 0xFF or data[1] & 0xE0 != 0xE0:
        return None
    version, layer = data[1] >> 3 & 3, 4 - (data[1] >> 1 & 3)
    bitrate, rate = data[2] >> 4, data[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate == 15 or rate == 3 or data[3] & 3 == 2:
        return None
    family = 1 if version == 3 else 2
    return Header(version, layer, not data[1] & 1, BITRATES[family, layer][bitrate], RATES[version][rate], data[2] >> 1 & 1, data[3] >> 6 == 3, 4 * (data[3] >> 4 & 3) + 4 if data[3] >> 6 == 1 else 32)


def _like(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _tags(data: bytes) -> tuple[int, int, dict[str, bytes]]:
    """(first byte behind leading tags, end before trailing tags, frames of the ID3v2 tags)."""
    start, end, found = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and start + 10 <= end:
        size = sum((b & 0x7F) << s for b, s in zip(data[start + 6 : start + 10], (21, 14, 7, 0), strict=True))
        at, stop, major = start + 10, min(start + 10 + size, end), data[start + 3]
        while major >= 3 and at + 10 <= stop and data[at]:
            raw = data[at + 4 : at + 8]
            n = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major == 4 else int.from_bytes(raw, "big")
            found.setdefault(data[at : at + 4].decode("latin-1"), data[at + 10 : min(at + 10 + n, stop)])
            at += 10 + n
        start = stop + (10 if data[start + 5] & 0x10 else 0)
    start = min(start, end)
    if data[start : start + 8] == b"APETAGEX" and start + 32 <= end:
        start = min(end, start + 32 + int.from_bytes(data[start + 12 : start + 16], "little"))
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little") + (32 if data[end - 9] & 0x80 else 0)
        if size <= end - start:
            end -= size
    return start, end, found


def _vbr(data: bytes, at: int, h: Header, length: int) -> dict | None:
    """The Xing, Info or VBRI table of the frame at ``at``."""
    place = at + 4 + 2 * h.protected + h.side
    kind = data[place : place + 4]
    if kind in (b"Xing", b"Info"):
        flags, place = int.from_bytes(data[place + 4 : place + 8], "big"), place + 8
        out = {"kind": kind.decode(), "frames": None, "bytes": None, "toc": None}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[place : place + 4], "big")
                place += 4
        if flags & 4:
            out["toc"] = data[place : place + 100]
        return out
    place = at + 36
    if length >= 62 and data[place : place + 4] == b"VBRI":
        size, frames, entries, scale, width = struct.unpack(">IIHHH", data[place + 10 : place + 24])
        toc = [int.from_bytes(data[place + 26 + i * width : place + 26 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


#: Bytes in which the second frame of a free format stream must begin.
FREE_REACH = 1 << 14


def _free_size(data: bytes, at: int, end: int, h: Header) -> int:
    """Bytes of a frame of the free format without padding: up to the next header alike whose own frame another one, or the end, follows; 0 if none."""
    place = data.find(b"\xff", at + 8, min(end, at + FREE_REACH))
    while place >= 0:
        next_ = header(data[place : place + 4])
        if _like(h, next_) and not next_.size:
            size = place - at - h.padding
            after = place + size + next_.padding
            third = header(data[after : after + 4])
            if after == end or after < end and _like(h, third) and not third.size:
                return size
        place = data.find(b"\xff", place + 1, min(end, at + FREE_REACH))
    return 0


class Stream:
    """What reading a stream finds: frames (offset, size), samples, rate, bad checksums, skipped bytes, table, tags, payload."""

    def __init__(self, data: bytes):
        start, end, self.tags = _tags(data)
        self.frames: list[tuple[int, int]] = []
        self.samples = self.bad = self.checked = self.skipped = self.rate = 0
        self.table, parts, at, first, free = None, [], start, None, 0
        while at + 4 <= end:
            h = header(data[at : at + 4])
            size = h.size if h is not None else 0
            if h is not None and not size and (first is None or _like(first, h)):
                free = free or _free_size(data, at, end, h)
                size = free and free + h.padding
            fits = h is not None and size > 4 + 2 * h.protected + h.covered and at + size <= end and (first is None or _like(first, h))
            if fits and (not self.frames or self.frames[-1][0] + self.frames[-1][1] != at):
                # After a gap a header counts only if another one, or the end, follows its frame.
                fits = at + size >= end - 3 or _like(h, header(data[at + size : at + size + 4]))
            if not fits:
                further = data.find(b"\xff", at + 1, end)
                further = end if further < 0 else further
                self.skipped += further - at
                at = further
                continue
            body = at + 4 + 2 * h.protected
            if h.protected and h.covered:
                self.checked += 1
                self.bad += crc16(data[at + 2 : at + 4] + data[body : body + h.covered]) != int.from_bytes(data[at + 4 : at + 6], "big")
            table = _vbr(data, at, h, size) if first is None and h.layer == 3 else None
            if first is None:
                first, self.rate = h, h.rate
            if table:
                self.table = table
            else:
                self.frames.append((at, size))
                self.samples += h.samples
                parts.append(data[body + h.side : at + size])
            at += size
        self.skipped += max(0, end - at)
        private = self.tags.get("PRIV", b"")
        length = int(private[len(_OWNER) :]) if private.startswith(_OWNER) else None
        self.payload = b"".join(parts)[:length]

    def duration(self) -> tuple[int, int]:
        """Seconds as an exact fraction (numerator, denominator)."""
        g = gcd(self.samples, self.rate) or 1
        return self.samples // g, (self.rate or 1) // g


def _sizes() -> list[tuple[int, int]]:
    """(ancillary bytes, bitrate index) of MPEG-1 layer III frames at 32 kHz, stereo, protected."""
    return [(144000 * k // 32000 - 6 - 32, i) for i, k in enumerate(BITRATES[1, 3]) if i]


_ROOM = _sizes()


@lru_cache(64)
def _front(index: int) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0))
    side = bytes(32)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


def write(payload: bytes) -> bytes:
    """A layer III stream that holds ``payload`` in its ancillary bytes; the last frame takes the least bitrate that fits."""
    room, top = _ROOM[-1]
    frames = []
    for at in range(0, len(payload), room):
        part = payload[at : at + room]
        space, index = next(x for x in _ROOM if x[0] >= len(part))
        frames.append(_front(index) + part + bytes(space - len(part)))
    room, index = next(x for x in _ROOM if x[0] >= 116)
    total = sum(map(len, frames)) + room + 38
    ends, at = [0], room + 38
    for f in frames:
        ends.append(at)
        at += len(f)
    toc = bytes(min(255, ends[1 + i * len(frames) // 100] * 256 // total) if frames else 0 for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    private = _OWNER + str(len(payload)).encode()
    tag = b"PRIV" + _synchsafe(len(private)) + b"\0\0" + private
    return b"ID3\x04\0\0" + _synchsafe(len(tag)) + tag + _front(index) + table + bytes(room - len(table)) + b"".join(frames)


def padded(text: bytes, unit: int = 64) -> bytes:
    """``text`` and zero bytes up to a positive multiple of ``unit``."""
    return text + bytes(-len(text) % unit if text else unit)


def store(rows: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes and media (binary): each whole text, padded to 64 bytes, as an MPEG audio stream.

    A null counts as the empty text, whose payload is 64 zero bytes.  Rows are independent: any ids,
    repeated rows and other columns are fine, and an empty table gives an empty result.  Where
    ``keep`` has a column of a new one's name, the new one is n_bytes_1 or media_1.
    """
    base = rows.select(*[col(c) for c in keep], col(text_col).cast("string").alias("_source_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[:-1])
    size, media = free_names(keep, ("n_bytes", "media"))

    def run(batches):
        for b in batches:
            for r0, r1, raw, offsets in steps(b.column(b.num_columns - 1), STEP_BYTES):
                texts = [raw[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
                made = (size, pa.array([len(t) for t in texts], pa.int64())), (media, pa.array([write(padded(t)) for t in texts], pa.binary()))
                yield batch([*[(n, b.column(i)[r0:r1]) for i, n in enumerate(b.schema.names[:-1])], *made])

    return map_arrow(base, run, f"{schema}, {size} long, {media} binary")


_FEATURES = "payload binary, frames int, samples long, sample_rate int, seconds_num long, seconds_den long, checked int, bad_checksums int, skipped_bytes long, table_frames long, seek_offsets array<int>, feature string"


def features(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes", "media")) -> DataFrame:
    """``keep`` columns and what reading each stream finds: payload, frames, exact duration, checksums, seek offsets.

    Null or broken streams have no frames and an empty payload; nothing raises.  Where ``keep`` has a
    column of a new one's name, the new one gets _1 behind its name.  ``feature`` sums up
    the stream in one line, with a checksum of all seek offsets.
    """
    base = media.select(*[col(c) for c in keep], col(media_col).alias("_source_media"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[:-1])
    names = free_names(keep, [f.split()[0] for f in _FEATURES.split(", ")])
    types = [f.split()[1] for f in _FEATURES.split(", ")]
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string())

    def run(batches):
        for b in batches:
            for r0, r1, raw, offsets in steps(b.column(b.num_columns - 1), STEP_BYTES):
                out = [[] for _ in names]
                for a, z in zip(offsets[:-1], offsets[1:], strict=True):
                    s = Stream(raw[a:z].tobytes())
                    num, den = s.duration()
                    seeks = [o for o, _ in s.frames]
                    table = s.table["frames"] if s.table else None
                    line = f"frames={len(seeks)} samples={s.samples} rate={s.rate} seconds={num}/{den} bad={s.bad}/{s.checked} skipped={s.skipped} table={table} seek={zlib.crc32(struct.pack(f'<{len(seeks)}I', *seeks)):08x}"
                    for place, value in zip(out, (s.payload, len(seeks), s.samples, s.rate, num, den, s.checked, s.bad, s.skipped, table, seeks, line), strict=True):
                        place.append(value)
                named = [(n, pa.array(v, k)) for n, v, k in zip(names, out, kinds, strict=True)]
                yield batch([(n, b.column(i)[r0:r1]) for i, n in enumerate(b.schema.names[:-1])] + named)

    return map_arrow(base, run, f"{schema}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
