"""Packing as a cutting-stock problem: a linear program over the histogram of lengths, its columns priced by a knapsack
dynamic program, rounded patterns dealt to ranked documents.

A document's ids are cut into full pieces of `size` and a rest. Rests fall into classes of `GRAIN` tokens, so the program has
at most size/GRAIN rows whatever the number of documents; it runs on the driver on counts alone. Every basic pattern is used
as often as its rounded-down share says; what remains, fewer pieces than a few for each class, is filled by a bounded
knapsack, one sequence after another. Pieces are ranked within their class in chunks of about the square root of the class,
by a hash of their document, so a class that holds a third of all pieces is spread over many tasks.

Null text counts as empty: one piece, the end id alone. A very long text is held and encoded by itself and becomes as many
pieces as it needs. Repeated rows are packed each. An empty table gives an empty table.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import grouped, settled, text_or_empty

SIZE = 2048
GRAIN = 8
END_ID = 1
PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, size: int = SIZE, paths: tuple = (), with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): every id of every document in one piece; the last piece of a document may be short."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def run(batches):
        enc = tokens.encoder(*paths)
        for b in (part for whole in batches for part in grouped(whole, 1, 1000)):
            rows: list[list] = [[], [], [], [], []]
            ids_out: list[bytes] = []
            for row, ids in enumerate(enc.batch(b.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    data = part.tobytes()
                    for column, v in zip(rows, (row, start, len(part), zlib.crc32(data), len(ids)), strict=True):
                        column.append(v)
                    if with_ids:
                        ids_out.append(data)
            out = [b.column(0).take(pa.array(rows[0], pa.int32())), *[pa.array(c, pa.int64()) for c in rows[1:]]]
            if with_ids:
                whole = pa.array(np.frombuffer(b"".join(ids_out), "<u4").astype(np.int32))
                offsets = np.cumsum([0, *rows[2]]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), whole))
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECE}" + (", ids array<int>" if with_ids else ""))


def _best_fill(value: np.ndarray, weight: np.ndarray, room: int, stock: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """The pattern of most value in `room`: unbounded, or with at most `stock` of each class."""
    n = len(weight)
    if stock is None:
        best, last = np.zeros(room + 1), np.full(room + 1, -1)
        for r in range(1, room + 1):
            fits = weight <= r
            gain = np.where(fits, best[r - weight * fits] + value, -1.0)
            i = int(gain.argmax())
            if gain[i] > best[r - 1] + 1e-12:
                best[r], last[r] = gain[i], i
            else:
                best[r] = best[r - 1]
        used, r = np.zeros(n, int), room
        while r > 0:
            if last[r] >= 0:
                used[last[r]] += 1
                r -= int(weight[last[r]])
            else:
                r -= 1
        return float(best[room]), used
    parts = [(i, k) for i in np.argsort(-weight) for k in _binary(int(min(stock[i], room // weight[i])))]
    best, taken = np.zeros(room + 1), np.zeros((len(parts), room + 1), bool)
    for j, (i, k) in enumerate(parts):
        w = int(weight[i]) * k
        new = best.copy()
        new[w:] = np.maximum(new[w:], best[: room + 1 - w] + value[i] * k)
        taken[j] = new > best + 1e-12
        best = new
    used, r = np.zeros(n, int), room
    for j in range(len(parts) - 1, -1, -1):
        if taken[j, r]:
            i, k = parts[j]
            used[i] += k
            r -= int(weight[i]) * k
    return float(best[room]), used


def _binary(n: int) -> list[int]:
    out, k = [], 1
    while n > 0:
        out.append(min(k, n))
        n -= out[-1]
        k *= 2
    return out


def column_generation(weight: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-4, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows) and how often each is used by a linear program within `gap` of its least number; and that bound.

    Revised simplex: the duals price a new pattern by the unbounded knapsack, Farley's bound says when to stop.
    """
    m = len(weight)
    basis = np.diag((room // weight).astype(float))
    inverse = np.diag(1 / (room // weight))
    x = inverse @ demand
    bound = 0.0
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, pattern = _best_fill(np.maximum(duals, 0), weight, room)
        bound = max(bound, x.sum() / max(value, 1.0))
        if value <= 1 + 1e-9 or x.sum() - bound <= gap * x.sum():
            break
        way = inverse @ pattern
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * way
        x[out] = step
        x = np.maximum(x, 0)
        basis[:, out] = pattern
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
    return basis.T.astype(int).reshape(m, m), x, bound


def plan(histogram: dict[int, int], size: int = SIZE, grain: int = GRAIN) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each class, how many sequences)] that use every piece of the histogram {class: count}; class c holds lengths up to c * grain."""
    room = size // grain
    classes = np.array(sorted(histogram), int)
    left = np.array([histogram[c] for c in classes], int)
    out: list[tuple[dict[int, int], int]] = []
    if len(classes):
        patterns, x, _ = column_generation(classes, left.astype(float), room)
        for p, times in zip(patterns, np.floor(x + 1e-9).astype(int), strict=True):
            fits = [left[i] // p[i] for i in np.flatnonzero(p)]
            if times := int(min(times, *fits)) if fits else 0:
                out.append(({int(classes[i]): int(p[i]) for i in np.flatnonzero(p)}, times))
                left = left - p * times
    while left.sum():
        _, p = _best_fill(classes.astype(float), classes, room, left)
        times = int(min(left[i] // p[i] for i in np.flatnonzero(p)))
        out.append(({int(classes[i]): int(p[i]) for i in np.flatnonzero(p)}, times))
        left = left - p * times
    return out


def deal(found: DataFrame, size: int = SIZE, grain: int = GRAIN) -> DataFrame:
    """The pieces with sequence_id and offset. `found` is read twice: let it be a written table."""
    room = size // grain
    sized = found.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    histogram = {r["class"]: r["count"] for r in sized.groupBy("class").count().collect()}  # at most size / grain rows
    turns: dict[int, list[tuple[int, int, int, int]]] = {}  # class: (first rank, pieces a sequence, first sequence, slot)
    ranks, base = dict.fromkeys(histogram, 0), 0
    for pattern, times in plan(histogram, size, grain):
        slot = 0
        for c, a in pattern.items():
            turns.setdefault(c, []).append((ranks[c], a, base, slot))
            ranks[c] += a * times
            slot += a
        base += times
    chunks = F.array(*[F.lit(ceil(isqrt(histogram.get(c, 0))) + 1) for c in range(room + 1)])
    keyed = sized.withColumn("h", F.xxhash64("doc_id", "start")).withColumn("chunk", F.pmod("h", F.get(chunks, F.col("class"))).cast("int"))
    before = Window.partitionBy("class").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("class", "chunk").count().select("class", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("class", "chunk").orderBy("h", "doc_id", "start", "ids_crc32", "length", "doc_tokens")
    ranked = keyed.withColumn("n", F.row_number().over(order)).join(offsets, ["class", "chunk"]).withColumn("rank", F.col("before") + F.col("n") - 1).drop("h", "n", "before", "chunk")
    names = [c for c in ranked.columns if c not in ("class", "rank")]

    def place(batches):
        table = {c: np.array(t, np.int64) for c, t in turns.items()}
        for b in batches:
            cls, rank = b.column("class").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                t, here = table[int(c)], cls == c
                first, a, start, s = t[np.searchsorted(t[:, 0], rank[here], side="right") - 1].T
                seq[here], slot[here] = start + (rank[here] - first) // a, s + (rank[here] - first) % a
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(seq), pa.array(slot)], [*names, "sequence_id", "slot"])

    schema = ranked.select(*names).schema.add("sequence_id", "long").add("slot", "long")
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.mapInArrow(place, schema)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).drop("slot")


def pack(docs: DataFrame, size: int = SIZE, grain: int = GRAIN, paths: tuple = (), with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset), one row for each piece."""
    return deal(settled(pieces(docs, size, paths, with_ids), "pieces"), size, grain)
