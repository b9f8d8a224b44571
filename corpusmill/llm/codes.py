"""Vector codes by product quantisation; entries are found by exponion search.

Vectors are cut into parts; each part position has a codebook of its own, and a vector's code is the nearest entry of each part.
Components are integers (floor of SCALE times the value) and all distances exact squared ones, so nothing depends on the order of
sums, on batches or on machines; ties go to the lower index.

Exponion search: a part starts at the entry it had before, at squared distance u. Whatever is as near lies within twice that
distance of the entry, which is a squared distance of 4u, so the entry's list of neighbours, sorted by distance, is scanned up to
there and no further. That radius is sufficient by the triangle inequality, ties included. In the first round, which has no entry
before, a part starts at the nearest of a few entries spread over the codebook.

A round reads the table with the codes of the round before, writes it with its own, and sums parts by entry: in each task first,
then by a grouping, so that an entry with a third of all parts is a few rows a task. Only codebooks (parts x entries x part
length) are collected and sent with the tasks. Sums are cut into pieces of LIMB bits, so they are exact for vectors of any size.

Rows whose vector is null, or holds null or non-finite components, go. So do rows whose vector is not as long as that of the first
kept row by id; of lengths that parts do not divide, the first parts are longer by one. Of repeated ids the lesser vector comes
first; null ids come last. Fewer rows than entries make fewer entries. An error beyond a bigint stands as the greatest bigint. An empty table
gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .common import join_same, settled, spread

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that a task handles together.
ROWS = 8192
#: Components up to this size are handled as 64-bit integers: differences, squares and sums over a part (LONG components at most)
#: stay below 2^63. Others are Python's integers.
SMALL, LONG = 1 << 27, 64
LIMB = 40
MOST = 2**63 - 1


def scaled(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite floats, exactly."""
    x = np.floor(flat.astype(np.float64) * SCALE) if flat.size == 0 or np.abs(flat).max() < 2.0**900 else None
    if x is not None and (x.size == 0 or np.abs(x).max() <= SMALL):
        return x.astype(np.int64)
    return np.array([math.floor(v) * SCALE if v == math.floor(v) else math.floor(v * SCALE) for v in map(float, flat.ravel())], object).reshape(flat.shape)


def bounds(length: int, parts: int) -> list[int]:
    """Where parts begin, and the end."""
    return [k * (length // parts) + min(k, length % parts) for k in range(parts + 1)]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Codebook:
    """Entries of one part position with each entry's neighbours by (distance, index), and the entries a first search tries."""

    def __init__(self, entries: list[list[int]]):
        exact = np.array(entries, object).reshape(len(entries), len(entries[0]) if entries else 0)
        small = exact.size == 0 or (exact.shape[1] <= LONG and max(abs(int(v)) for v in exact.ravel()) <= SMALL)
        self.entries = exact.astype(np.int64) if small else exact
        between = squared(self.entries[:, None, :], self.entries[None, :, :]) if exact.size else np.zeros((len(entries),) * 2, np.int64)
        order = [sorted(range(len(entries)), key=lambda j, i=i: (between[i, j], j)) for i in range(len(entries))]
        self.near = np.array(order, np.int64).reshape(len(entries), len(entries))
        self.quarter = -(-np.take_along_axis(between, self.near, 1) // 4)  # within 4u if this is within u
        self.pivots = range(0, len(entries), max(1, math.isqrt(len(entries))))

    def nearest(self, x: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of each row's nearest entry, and how many distances were computed."""
        entries = self.entries if x.dtype == self.entries.dtype else self.entries.astype(object)
        n, looked = len(x), len(x)
        if before is None:
            at = np.zeros(n, np.int64)
            u = squared(x, entries[0])
            for p in self.pivots[1:]:
                d = squared(x, entries[p])
                at, u = np.where(d < u, p, at), np.where(d < u, d, u)
            looked = n * len(self.pivots)
        else:
            at = before.astype(np.int64)
            u = squared(x, entries[at])
        reach = np.zeros(n, np.int64)  # entries of the neighbours' list within the radius
        for e in np.unique(at):
            own = at == e
            reach[own] = np.searchsorted(self.quarter[e], u[own], side="right")
        order = np.argsort(-reach, kind="stable")
        still = np.searchsorted(-reach[order], -np.arange(1, len(entries) + 1), side="right")  # rows that reach that far
        x, home, best, least = x[order], at[order], at[order], u[order]
        for k in range(len(entries)):
            m = int(still[k])
            if not m:
                break
            looked += m
            j = self.near[home[:m], k]
            d = squared(x[:m], entries[j])
            better = (d < least[:m]) | ((d == least[:m]) & (j < best[:m]))
            best[:m] = np.where(better, j, best[:m])
            least[:m] = np.where(better, d, least[:m])
        index, distance = np.empty(n, np.int64), np.empty(n, least.dtype)
        index[order], distance[order] = best, least
        return index, distance, looked


@dataclass
class Codebooks:
    """books[part][entry] is a list of integers."""

    books: list[list[list[int]]]
    length: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.books for e in book for v in e).encode()).hexdigest()


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector holds finite numbers only; the vector as doubles."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = vectors.where(F.col(vector).isNotNull()) if isinstance(vectors.schema[vector].dataType, ArrayType) else vectors.where("false")
    return kept.withColumn(vector, F.col(vector).cast("array<double>")).where(F.forall(vector, fine))


def first_books(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the rows with the least ids."""
    head = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()]
    if not head:
        return Codebooks([[] for _ in range(parts)], 0)
    length = len(head[0])
    first = rows.where(F.size("v") == length).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    whole = [[int(v) for v in scaled(np.array(r["v"], np.float64))] for r in first]
    cut = bounds(length, parts)
    return Codebooks([[w[a:b] for w in whole] for a, b in zip(cut, cut[1:], strict=False)], length)


def _slices(batches, length: int):
    """(batch, vectors as integers) of ROWS rows at most; the vectors are in the third column."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            b = whole.slice(i, ROWS)
            if b.num_rows:
                yield b, scaled(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, length))


def assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, v, code, error, looked): one byte of code a part; rows (vec_id, label, v) or with the codes of the round before.

    error: squared distances over all parts; looked: distances that the search computed.
    """
    made, cut = [Codebook(b) for b in books.books], bounds(books.length, len(books.books))
    before = "code" in rows.columns
    kinds = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, v array<double>, code binary, error decimal(38,0), looked bigint"

    def run(batches):
        for b, x in _slices(batches, books.length):
            n = b.num_rows
            old = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(n, -1) if before else None
            code, error, looked = np.zeros((n, len(made)), np.uint8), np.zeros(n, object), 0
            for p, book in enumerate(made):
                index, d, k = book.nearest(x[:, cut[p] : cut[p + 1]], None if old is None else old[:, p])
                code[:, p], looked = index, looked + k
                error = error + d
            errors = pa.array([Decimal(min(int(e), MOST)) for e in error], pa.decimal128(38, 0))
            share = np.full(n, looked // n)
            share[: looked % n] += 1
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([c.tobytes() for c in code], pa.binary()), errors, pa.array(share)], ["vec_id", "label", "v", "code", "error", "looked"])

    columns = ["vec_id", "label", "v", "code"] if before else ["vec_id", "label", "v"]
    return rows.select(*columns).mapInArrow(run, kinds)


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the componentwise floor of its parts' mean; one without parts stays."""
    cut = bounds(books.length, len(books.books))

    def run(batches):
        total: dict[tuple[int, int], list[int]] = {}
        for b, x in _slices(batches, books.length):
            code = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            for p in range(len(books.books)):
                order = np.argsort(code[:, p], kind="stable")
                own, entry = x[order, cut[p] : cut[p + 1]], code[order, p]
                starts = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
                sums = np.add.reduceat(own, starts, axis=0) if own.shape[1] else np.zeros((len(starts), 0), np.int64)
                for e, s, n in zip(entry[starts].tolist(), sums.tolist(), np.diff([*starts, len(entry)]).tolist(), strict=True):
                    got = total.setdefault((p, e), [0] * (own.shape[1] + 1))
                    got[:] = [a + int(v) for a, v in zip(got, [n, *s], strict=True)]
        out = []
        for (p, e), values in total.items():
            for i, v in enumerate(values):
                limb, sign, v = 0, (v > 0) - (v < 0), abs(v)
                while v:
                    out.append((p, e, i, limb, sign * (v & ((1 << LIMB) - 1))))
                    limb, v = limb + 1, v >> LIMB
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k < 4 else pa.int64()) for k in range(5)], ["p", "e", "i", "limb", "value"])

    partial = rows.select("vec_id", "label", "v", "code").mapInArrow(run, "p int, e int, i int, limb int, value bigint")
    sums: dict[tuple[int, int], dict[int, int]] = {}
    for r in partial.groupBy("p", "e", "i", "limb").agg(F.sum("value").alias("value")).collect():  # as many rows as the codebooks have numbers
        own = sums.setdefault((r["p"], r["e"]), {})
        own[r["i"]] = own.get(r["i"], 0) + (r["value"] << (LIMB * r["limb"]))
    new = [[list(e) for e in book] for book in books.books]
    for (p, e), own in sums.items():
        new[p][e] = [own.get(i + 1, 0) // own[0] for i in range(len(new[p][e]))]
    return Codebooks(new, books.length)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding") -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, v, code, error, looked), codebooks): every usable vector with its code, written; 256 entries at most."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    rows = usable(spread(vectors), vector).select("vec_id", "label", F.col(vector).alias("v"))
    books = first_books(rows, parts, entries)
    rows = rows.where(F.size("v") == books.length)
    for _ in range(rounds):
        rows = settled(assigned(rows, books), "assigned")
        books = moved(rows, books)
    return settled(assigned(rows, books), "coded"), books


def report(vectors: DataFrame) -> DataFrame:
    """The columns of the contract."""
    coded, books = compressed(vectors)
    capped = lambda c: F.least(c, F.lit(Decimal(MOST))).cast("long")
    labels = settled(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    rows = join_same(coded.select("vec_id", "label", "code", "error"), labels, ["label"])
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), capped(F.col("error")).alias("error"), capped(F.col("label_error")).alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """a{k}: each part's nearest entry of c{k}; c{k+1}: the entries moved."""
    return f"""
a{k} AS MATERIALIZED (SELECT row, part, e AS entry, d FROM (SELECT row, p.part, e, d, row_number() OVER (PARTITION BY row, p.part ORDER BY d, e) AS place FROM (SELECT p.row, p.part, c.entry AS e, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::HUGEINT AS d FROM parts p JOIN c{k} c USING (part)) p) WHERE place = 1),
m{k} AS (SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM a{k} a JOIN parts USING (row, part)) GROUP BY ALL),
f{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM m{k} GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(f.v, c.v) AS v FROM c{k} c LEFT JOIN f{k} f USING (part, entry)),"""


#: DuckDB's twin of report(), for vectors of one length that parts divide.
SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v FROM kept, (SELECT unnest(range({PARTS})) AS part)),
c0 AS MATERIALIZED (SELECT part, row AS entry, v FROM parts WHERE row < {ENTRIES}),
{"".join(_round_sql(k) for k in range(ROUNDS))}
a AS ({_round_sql(ROUNDS).partition("m2 AS")[0].partition("(")[2].rstrip().rstrip(",").rstrip(")")}),
books AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(range(len(v))) AS i, unnest(v)::VARCHAR AS x FROM c{ROUNDS})),
codes AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM codes JOIN kept USING (row), books"""
