"""Ogg in binary columns: pages are verified, packets reassembled, logical streams told apart, times derived.

Reading goes over the bytes once. A page counts if it is whole and its checksum is right; else it is damaged, and the search goes
on behind its first byte. Packets come from lacing values and may go on over pages. Pages that are missing (their numbers leave a
gap) or damaged take the packets with them that had a part there, and no others. Each page that begins a stream opens a new one,
so streams may be multiplexed, chained, and share a serial number one after another. A page says where the last packet that ends
on it ends; the places of those before it follow from their lengths where the codec is PCM (8 bits unsigned, in the header of
OggPCM), else they are null. Times are null where the codec is unknown, and for a packet whose page says no place.

Every row is handled by itself, in slices of a few megabytes; nothing is shuffled. Null media has no streams; so has empty media, or
media that is no Ogg. Null text counts as empty. Repeated rows stay, other columns are ignored; a very long text is a row of its own slice.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped

# The capture pattern, flags and checksum of a page; the identification header of PCM; what payloads are padded to.
CAPTURE, CONTINUED, BEGINS, ENDS = b"OggS", 1, 2, 4
PAGE = struct.Struct("<4sBBqIIIB")
PCM, PCM_U8 = struct.Struct(">8sHHIIBBHI"), 1
PCM_MAGIC = b"PCM     "
UNIT = 64
#: Samples a second, tracks, samples of a packet and lacing values of a page of what store() writes. Packets are longer than a
#: page's rest now and then, so they go on over pages.
RATE, TRACKS, FRAMES, LACING = 8000, 2, 1000, 17
SILENCE = 1 << 24

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """Ogg's CRC-32 (0x04c11db7, most significant bit first, from 0): zlib's, of mirrored bytes, mirrored."""
    crc = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    tail = bytes([len(lacing)]) + lacing + body
    head = PAGE.pack(CAPTURE, 0, flags, granule, serial, number, 0, 0)[:22]
    return head + checksum(head + b"\0\0\0\0" + tail).to_bytes(4, "little") + tail


def track_pages(serial: int, header: bytes, packets: list[tuple[bytes, int]]) -> tuple[bytes, list[tuple[int, bytes]]]:
    """The page that begins a logical stream, and (place, page) of the others; packets: (data, place where it ends)."""
    lacing, ends = bytearray(), []  # values of all packets; (value's number, place) of each packet's last
    for data, place in packets:
        lacing += b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        ends.append((len(lacing), place))
    body = b"".join(d for d, _ in packets)
    first = page(BEGINS | (0 if lacing else ENDS), 0, serial, 0, b"\xff" * (len(header) // 255) + bytes([len(header) % 255]), header)
    out, at, done, reached = [], 0, 0, 0
    for number, i in enumerate(range(0, len(lacing), LACING), 1):
        values, place = bytes(lacing[i : i + LACING]), -1
        while done < len(ends) and ends[done][0] <= i + LACING:
            place = reached = ends[done][1]
            done += 1
        flags = (CONTINUED if i and lacing[i - 1] == 255 else 0) | (ENDS if i + LACING >= len(lacing) else 0)
        size = sum(values)
        out.append((reached, page(flags, place, serial, number, values, body[at : at + size])))
        at += size
    return first, out


def multiplexed(tracks: list[tuple[bytes, list[tuple[bytes, int]]]]) -> bytes:
    """A physical stream: the pages that begin the logical streams (header, packets), then the others by the places they reach."""
    made = [track_pages(serial, *t) for serial, t in enumerate(tracks, 1)]
    rest = sorted(((place, serial, i, data) for serial, (_, pages) in enumerate(made) for i, (place, data) in enumerate(pages)), key=lambda x: x[:3])
    return b"".join([*(first for first, _ in made), *(data for *_, data in rest)])


@dataclass
class Stream:
    """packets: (data, start, end) by number; start and end in samples, or None. The header is the first packet, not among them."""

    serial: int
    header: bytes | None = None
    rate: int | None = None
    pcm: bool = False
    pages: int = 0
    lost: int = 0
    packets: list[tuple[bytes, int | None, int | None]] = field(default_factory=list)
    number: int = -1
    part: list[bytes] | None = None
    ended: bool = False

    def begin(self, header: bytes) -> None:
        self.header = header
        if header[:8] == PCM_MAGIC and len(header) >= PCM.size:
            _, _, _, kind, rate, _, channels, *_ = PCM.unpack_from(header)
            self.rate, self.pcm = rate or None, kind == PCM_U8 and channels == 1
        elif header[:8] == b"OpusHead":
            self.rate = 48_000
        elif header[:7] == b"\x01vorbis" and len(header) >= 16:
            self.rate = int.from_bytes(header[12:16], "little") or None

    def add(self, flags: int, granule: int, number: int, lacing: bytes, body: memoryview) -> None:
        self.pages += 1
        if self.number >= 0 and number != self.number + 1:
            self.lost += 1
            self.part = None
        self.number, self.ended = number, bool(flags & ENDS)
        if not lacing:
            return
        part = self.part if flags & CONTINUED else []  # None: the packet's head is lost, and so is the packet
        done, at = [], 0
        start = 0
        for v in lacing:
            at += v
            if v < 255:
                if part is not None:
                    done.append(b"".join([*part, body[start:at]]))
                part, start = [], at
        self.part = [*part, bytes(body[start:at])] if lacing[-1] == 255 and part is not None else None
        if self.header is None and done:
            self.begin(done.pop(0))
        end, placed = (granule if granule >= 0 else None), []
        for data in reversed(done):
            start_at = end - len(data) if self.pcm and end is not None else None
            placed.append((data, start_at, end))
            end = start_at
        self.packets += reversed(placed)


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview] | None]:
    """(flags, granule, serial, number, lacing, body) of each page whose checksum is right, None for each that is damaged."""
    view, at = memoryview(data), data.find(CAPTURE)
    while at >= 0:
        size = 0
        if at + PAGE.size <= len(data):
            _, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(data, at)
            lacing = data[at + PAGE.size : at + PAGE.size + n]
            size = PAGE.size + n + sum(lacing)
        if size and version == 0 and at + size <= len(data) and checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : at + size]))) == crc:
            yield flags, granule, serial, number, lacing, view[at + PAGE.size + n : at + size]
            at = data.find(CAPTURE, at + size)
        else:
            yield None
            at = data.find(CAPTURE, at + 1)


def demultiplexed(data: bytes) -> tuple[list[Stream], int]:
    """The logical streams in the order they begin, and the number of damaged pages. Pages of a stream that nothing began open it too."""
    out: list[Stream] = []
    now: dict[int, Stream] = {}
    damaged = 0
    for p in pages(data):
        if p is None:
            damaged += 1
            continue
        flags, granule, serial, number, lacing, body = p
        if flags & BEGINS or serial not in now:
            now[serial] = Stream(serial)
            out.append(now[serial])
            if not flags & BEGINS:
                now[serial].header, now[serial].lost = b"", 1  # its beginning is lost
        now[serial].add(flags, granule, number, lacing, body)
    return out, damaged


def stored(payload: bytes) -> bytes:
    """8-bit samples as an Ogg stream of TRACKS tracks that take turns; each is PCM of its own."""
    header = PCM.pack(PCM_MAGIC, 0, 0, PCM_U8, RATE, 8, 1, FRAMES, 0)
    tracks = []
    for t in range(TRACKS):
        own = payload[t::TRACKS]
        tracks.append((header, [(own[i : i + FRAMES], min(i + FRAMES, len(own))) for i in range(0, len(own), FRAMES)]))
    return multiplexed(tracks)


def samples(streams: list[Stream]) -> np.ndarray:
    """(sample, track) of PCM streams, each packet at its place; what was lost is silence (0).

    A packet more than SILENCE samples behind all that is there has a wrong place and is left out.
    """
    pcm = [s for s in streams if s.pcm]
    most = SILENCE + sum(len(d) for s in pcm for d, *_ in s.packets)
    placed = [(t, *p) for t, s in enumerate(pcm) for p in s.packets if p[1] is not None and 0 <= p[1] <= p[2] <= most]
    out = np.zeros((max((end for *_, end in placed), default=0), len(pcm)), np.uint8)
    for t, data, start, end in placed:
        out[start:end, t] = np.frombuffer(data, np.uint8)
    return out


def _binary(name: str, empty: bool):
    c = F.col(f"`{name}`")
    return F.coalesce(c.cast("binary"), F.lit(b"")) if empty else c.cast("binary")


def _types(df: DataFrame, keys: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(k, df.schema[k].dataType.simpleString()) for k in keys]


def _schema(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in columns)


def _mapped(df: DataFrame, column: str, keys: tuple[str, ...], new: list[tuple[str, str, pa.DataType]], rows, empty: bool = True) -> DataFrame:
    """keys... and new columns: rows(bytes or None) yields a tuple of them for each row to come of one row."""
    of = [F.col(f"`{k}`") for k in keys]
    names = [*keys, *[n for n, *_ in new]]

    def run(batches):
        for b in (part for whole in batches for part in grouped(whole, len(keys))):
            took, out = [], []
            for i, data in enumerate(b.column(len(keys))):
                for row in rows(data.as_py()):
                    took.append(i)
                    out.append(row)
            own = [c.take(pa.array(took, pa.int64())) for c in b.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays(own + [pa.array([r[j] for r in out], t) for j, (*_, t) in enumerate(new)], names)

    return df.select(*of, _binary(column, empty).alias("media_bytes_in")).mapInArrow(run, _schema(_types(df, keys) + [(n, t) for n, t, _ in new]))


def store(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., n_bytes, media): each text's bytes, with bytes 0 up to a positive multiple of UNIT, as 8-bit samples in Ogg."""

    def rows(data: bytes):
        yield len(data), stored(data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0"))

    return _mapped(docs, text, keys, [("n_bytes", "bigint", pa.int64()), ("media", "binary", pa.binary())], rows)


def packets(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., stream, serial, packet, data, first, last, seconds): a row for each packet; seconds: where it ends."""

    def rows(data: bytes | None):
        for k, s in enumerate(demultiplexed(data or b"")[0]):
            for i, (d, start, end) in enumerate(s.packets):
                yield k, s.serial, i, d, start, end, end / s.rate if s.rate and end is not None else None

    new = [("stream", "int", pa.int32()), ("serial", "bigint", pa.int64()), ("packet", "bigint", pa.int64()), ("data", "binary", pa.binary()), ("first", "bigint", pa.int64()), ("last", "bigint", pa.int64()), ("seconds", "double", pa.float64())]
    return _mapped(df, media, keys, new, rows, empty=False)


def streams(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., stream, serial, rate, pages, packets, bytes, seconds, lost, whole): a row for each logical stream.

    lost: gaps in the pages' numbers, a lost beginning among them; whole: it has its beginning and its end, and no gap between.
    """

    def rows(data: bytes | None):
        for k, s in enumerate(demultiplexed(data or b"")[0]):
            last = max((end for *_, end in s.packets if end is not None), default=None)
            yield k, s.serial, s.rate, s.pages, len(s.packets), sum(len(d) for d, *_ in s.packets), last / s.rate if s.rate and last is not None else None, s.lost, s.ended and not s.lost

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    new = [(n, t, kinds[t]) for n, t in (("stream", "int"), ("serial", "bigint"), ("rate", "bigint"), ("pages", "bigint"), ("packets", "bigint"), ("bytes", "bigint"), ("seconds", "double"), ("lost", "bigint"), ("whole", "boolean"))]
    return _mapped(df, media, keys, new, rows, empty=False)


def feature(found: list[Stream], damaged: int, x: np.ndarray) -> str:
    """Streams, pages, damaged ones, packets, length in seconds, then for each track the sum of its samples and of their squares."""
    s = max((end / t.rate for t in found if t.rate for *_, end in t.packets if end is not None), default=0.0)
    wide = x.astype(np.int64)
    sums = ",".join(f"{int(wide[:, t].sum())}/{int((wide[:, t] ** 2).sum())}" for t in range(x.shape[1]))
    return f"streams={len(found)};pages={sum(t.pages for t in found)};damaged={damaged};packets={sum(len(t.packets) for t in found)};seconds={s:.6f};tracks={sums}"


def digests(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of what the stored bytes hold."""

    def rows(data: bytes):
        found, damaged = demultiplexed(data)
        x = samples(found)
        payload = x.tobytes()
        yield len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(found, damaged, x)

    new = [("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]
    return _mapped(df, media, keys, new, rows)


def report(docs: DataFrame) -> DataFrame:
    """The columns of the contract: texts are stored, and everything but n_bytes comes from the stored bytes."""
    return digests(store(docs), keys=("doc_id", "n_bytes"))
