"""Ogg columns: round trips, an independent reader, damage."""

import hashlib
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import media

from .conftest import ROWS, texts_of


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def padded(text):
    data = (text or "").encode()
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def plain_read(data):
    """A reader of its own: whole, undamaged streams only. Returns {serial: packets}, pages."""
    at, out, open_, n = 0, {}, {}, 0
    while at < len(data):
        assert data[at : at + 5] == b"OggS\0"
        flags, granule, serial, number, crc, k = struct.unpack_from("<BqIIIB", data, at + 5)
        lacing = data[at + 27 : at + 27 + k]
        end = at + 27 + k + sum(lacing)
        assert slow_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) == crc
        body, i = data[at + 27 + k : end], 0
        assert bool(flags & 2) == (serial not in out) and bool(flags & 1) == bool(open_.get(serial))
        for v in lacing:
            open_[serial] = open_.get(serial, b"") + body[i : i + v]
            i += v
            if v < 255:
                out.setdefault(serial, []).append(open_.pop(serial))
        at, n = end, n + 1
    return out, n


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=600))
def test_checksum(data):
    assert media.checksum(data) == slow_crc(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=1200), max_size=12), min_size=1, max_size=4))
def test_packets_come_back(tracks):
    head = b"some codec"
    sent = []
    for packets in tracks:
        end, placed = 0, []
        for p in packets:
            end += len(p)
            placed.append((p, end))
        sent.append((head, placed))
    data = media.multiplexed(sent)
    found, damaged = media.demultiplexed(data)
    assert damaged == 0 and [[p for p, *_ in s.packets] for s in found] == tracks and all(s.header == head and s.ended and not s.lost for s in found)
    read, pages = plain_read(data)
    assert [read[k + 1][1:] for k in range(len(tracks))] == tracks and pages == sum(s.pages for s in found)


def test_payloads_and_times():
    rng = np.random.default_rng(1)
    for n in (64, 128, 4096, 64 * 1001, 64 * 12_345):
        payload = rng.integers(0, 256, n, np.uint8).tobytes()
        data = media.stored(payload)
        found, damaged = media.demultiplexed(data)
        assert damaged == 0 and media.samples(found).tobytes() == payload and len(data) < n * 1.02 + 300
        assert all(s.packets[-1][2] == n // 2 and [p[1] for p in s.packets] == list(range(0, n // 2, media.FRAMES)) for s in found)
        read, _ = plain_read(data)
        assert b"".join(read[1][1:]) == payload[0::2] and b"".join(read[2][1:]) == payload[1::2]
    assert any(p.flags & 1 for p in map(lambda x: type("P", (), {"flags": x[0]}), media.pages(data)))  # packets went over pages


def test_damage_takes_only_what_it_hit():
    payload = np.random.default_rng(2).integers(1, 256, 64_000, np.uint8).tobytes()
    data = media.stored(payload)
    places = [i for i in range(len(data)) if data.startswith(b"OggS", i)]
    at = places[5]
    broken = bytearray(data)
    broken[at + 200] ^= 1
    found, damaged = media.demultiplexed(bytes(broken))
    assert damaged == 1 and sum(s.lost for s in found) == 1
    x, want = media.samples(found), np.frombuffer(payload, np.uint8).reshape(-1, 2)
    gone = (x != want).any(axis=1)
    assert 0 < gone.sum() <= 6000 and (x[gone] == 0).any(axis=1).all()  # silence where packets were lost
    cut = data[: places[7]] + data[places[8] :]  # a page is missing
    found, damaged = media.demultiplexed(cut)
    assert damaged == 0 and sum(s.lost for s in found) == 1
    found, damaged = media.demultiplexed(data[: places[9] + 50])  # the end is missing
    assert damaged == 1 and not any(s.ended for s in found)
    found, damaged = media.demultiplexed(b"junk OggS junk" + data + data)  # chained, with junk before
    assert damaged == 1 and len(found) == 4 and [s.serial for s in found] == [1, 2, 1, 2]
    second = media.demultiplexed(data[places[1] :])[0]
    assert [(s.header, s.lost) for s in second if s.serial == 1] == [(b"", 1)]
    odd = media.page(2, 0, 9, 0, b"\x05", b"hello") + media.page(0, -1, 9, 1, b"", b"") + media.page(4, 1 << 60, 9, 2, b"\x03", b"abc")
    (s,), _ = media.demultiplexed(odd)
    assert [(d, a, b) for d, a, b in s.packets] == [(b"abc", None, 1 << 60)] and s.rate is None and media.samples([s]).size == 0
    far = media.multiplexed([(media.PCM.pack(media.PCM_MAGIC, 0, 0, 1, 8000, 8, 1, 9, 0), [(b"abc", 1 << 60)])])
    assert media.samples(media.demultiplexed(far)[0]).size == 0


def check(rows, got):
    assert len(got) == len(rows)
    want = sorted(((i, len((t or "").encode()), len(p := padded(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=repr) == want


def test_report(docs, odd, none):
    check(texts_of(), media.report(docs).collect())
    got = media.report(odd).collect()
    check(ROWS, got)
    texts = dict(ROWS)
    for r in got:
        data = media.stored(padded(texts[r["doc_id"]])) if r["doc_id"] != 6 else None
        if data:
            assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in (5, 50)}) == 1
    assert media.report(none).collect() == []


def test_tables_of_packets_and_streams(spark, docs):
    stored = media.store(docs)
    s = media.streams(stored, keys=("doc_id",)).collect()
    assert all(r["whole"] and r["rate"] == 8000 and r["lost"] == 0 for r in s) and len(s) == 2 * docs.count()
    p = media.packets(stored).where("doc_id = 3").orderBy("stream", "packet").collect()
    text = padded(dict(texts_of())[3])
    assert b"".join(r["data"] for r in p if r["stream"] == 0) == text[0::2]
    assert all(r["seconds"] == r["last"] / 8000 and r["last"] - r["first"] == len(r["data"]) for r in p)
    opus = media.multiplexed([(b"OpusHead" + bytes(11), [(b"x", 960), (b"y", 1920)])])
    rows = spark.createDataFrame([(1, None), (2, b""), (3, b"no ogg"), (4, bytearray(opus))], "doc_id bigint, media binary")
    assert [(r["doc_id"], r["data"], r["first"], r["seconds"]) for r in media.packets(rows).collect()] == [(4, b"x", None, None), (4, b"y", None, 0.04)]
    assert [r["doc_id"] for r in media.streams(rows).collect()] == [4]
