"""Exact search for the k most similar vectors with whole blocks of slots left out.

Slots are dealt to pivots, a bounded sample of their own: a block is the slots whose nearest pivot is the same, cut by their angle to
it into rings. Angles obey the triangle inequality, so no slot of a ring [low, high] around a pivot can be nearer to a query than
max(low - t, t - high, 0), t being the query's angle to the pivot. Each query first meets its most promising rings, which gives
it a k-th score already; then only rings whose bound reaches that score are met, by a join on the ring's number. Rows are the
same as without pruning, whatever the pivots; the pairs left out are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import vector as V
from corpusmill.sources.shared import settled

#: Pivots (a table of them is sent with the tasks), rings of a pivot, rings that a query meets first, slots that are scored at once.
PIVOTS, RINGS, FIRST, TOGETHER = 64, 8, 4, 4096
#: Angles are compared with this much room, and scores are rounded to so many digits as those of the full search.
ROOM, DIGITS = 1e-6, 9


@dataclass
class Found:
    """rows: (query_id, slot_id, score, rank); pairs of queries and rings, and those that were met."""

    rows: DataFrame
    pairs: int
    met: int


def _units(vectors: DataFrame, key: str, value: str) -> DataFrame:
    return vectors.select(F.col(key).cast("bigint").alias("id"), V.doubles(F.col(value)).alias("v")).where("id is not null and v is not null")


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of vectors of no length, which have no direction, the angle to every pivot is a right one, as their cosine is 0."""
    return np.arccos(np.clip(_unit(m) @ pivots.T, -1.0, 1.0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def dealt(slots: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, p, angle): each slot with its nearest pivot. Slots without direction are of pivot -1."""
    width = pivots.shape[1]

    def run(batches):
        for b in batches:
            m = _matrix(b.column(1), width)
            a = _angles(m, pivots)
            p = a.argmin(axis=1)
            none = (m * m).sum(axis=1) < 1e-24
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(none, -1, p).astype(np.int32)), pa.array(np.where(none, 0.0, a[np.arange(len(m)), p]))], ["id", "v", "p", "angle"])

    return slots.where(F.size("v") == width).mapInArrow(run, "id bigint, v array<double>, p int, angle double")


def rings(placed: DataFrame, n: int) -> DataFrame:
    """placed with `ring` and `part`: rings of a pivot are of equal width, parts of a ring of about TOGETHER slots."""
    widths = placed.groupBy("p").agg(F.min("angle").alias("a"), F.max("angle").alias("b"))
    ring = F.least(F.floor(n * (F.col("angle") - F.col("a")) / F.greatest(F.col("b") - F.col("a"), F.lit(1e-12))), F.lit(n - 1)).cast("int")
    return placed.join(F.broadcast(widths), "p").withColumn("ring", ring).drop("a", "b")  # a row a pivot


def _scored(queries: DataFrame, slots: DataFrame, wanted: DataFrame, k: int, parts: int) -> DataFrame:
    """(query_id, slot_id, score): the k best slots of each query in each part of the rings it is to meet (query_id, p, ring)."""
    left = queries.join(wanted.withColumnRenamed("query_id", "id"), "id").select("p", "ring", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "id", "v")
    right = slots.select("p", "ring", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "id", "v")
    right = right.join(wanted.select("p", "ring").distinct(), ["p", "ring"], "left_semi")

    def run(batches):
        at, ids, vectors, out = None, [], [], []

        def block():
            return np.array(ids, np.int64), _unit(np.array(vectors)) if vectors else np.zeros((0, 1))

        def score(qi, qv, sid, sm):
            sim = np.round((_unit(np.array(qv)) @ sm.T) / np.sqrt(sm.shape[1]), DIGITS)
            for i, row in zip(qi, sim, strict=True):
                near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                best = near[np.lexsort((sid[near], -row[near]))[:k]]
                out.append((np.full(len(best), i), sid[best], row[best]))

        def table():
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "slot_id", "score"])

        made, qi, qv = None, [], []
        for b in batches:
            for p, ring, part, kind, i, v in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (p, ring, part) != at or len(qi) >= 256:
                    if made is None:
                        made = block()
                    if qi and len(made[0]):
                        score(qi, qv, *made)
                    qi, qv = [], []
                    if len(out) > 4096:
                        yield table()
                    if (p, ring, part) != at:
                        at, ids, vectors, made = (p, ring, part), [], [], None
                if kind:
                    made = made or block()
                    qi.append(i)
                    qv.append(v)
                else:
                    ids.append(i)
                    vectors.append(v)
        if qi and len(made[0]):
            score(qi, qv, *made)
        yield table()

    keys = ["p", "ring", "part"]
    both = right.unionByName(left).repartition(*keys).sortWithinPartitions(*keys, "kind")
    return both.mapInArrow(run, "query_id bigint, slot_id bigint, score double")


def _best(scores: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "slot_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(queries: DataFrame, slots: DataFrame, k: int, key: str = "vec_id", value: str = "embedding", pivots: int = PIVOTS, first: int = FIRST, rings_each: int = RINGS) -> Found:
    """What operators.retrieval.top_k gives: the k slots of greatest cosine over the root of the dimension; ties to the lesser id.

    Vectors are of one length, that of the pivots; others have no cosine with them and are left out.
    """
    s, q = _units(slots, key, value), settled(_units(queries, key, value), "queries")
    head = s.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()
    if not head:
        from corpusmill.operators.retrieval import top_k

        return Found(top_k(queries, slots, k, key, value), 0, 0)
    width = len(head[0]["v"])
    centre = _unit(np.array([r["v"] for r in head if len(r["v"]) == width]))
    q = q.where(F.size("v") == width)
    placed = settled(rings(dealt(s, centre), rings_each), "rings")
    sizes = placed.groupBy("p", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()  # pivots x rings at most
    parts = max(1, -(-max(r["n"] for r in sizes) // TOGETHER))
    p, ring, n, low, high = (np.array([r[c] for r in sizes]) for c in ("p", "ring", "n", "low", "high"))
    root = np.sqrt(width)

    def bounds(batches):
        for b in batches:
            m = _matrix(b.column(1), width)
            t = _angles(m, centre)[:, p]  # pivot -1 takes the last one's angles, which do not count
            least = np.maximum(np.maximum(low - t, t - high), 0.0) - ROOM
            most = np.where(p == -1, 0.0, np.cos(np.clip(least, 0.0, np.pi)) / root) + 10.0**-DIGITS
            blank = (m * m).sum(axis=1) < 1e-24
            most[blank] = 10.0**-DIGITS
            rows = np.argsort(-most, axis=1, kind="stable")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(rows.astype(np.int32)), pa.list_(pa.int32())), pa.array([x[o] for x, o in zip(most, rows, strict=True)], pa.list_(pa.float64()))], ["query_id", "block", "bound"])

    order = settled(q.mapInArrow(bounds, "query_id bigint, block array<int>, bound array<double>"), "bounds")
    name = q.sparkSession.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(p, ring, strict=True))], "block int, p int, ring int")
    # of the first rings as many as hold k slots, and `first` at least
    held = F.array(*[F.lit(int(x)) for x in n])
    until = F.aggregate("block", F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("n")), lambda a, b: F.struct((a["i"] + F.when((a["n"] < k) | (a["i"] < first), 1).otherwise(0)).alias("i"), (a["n"] + F.when((a["n"] < k) | (a["i"] < first), F.get(held, b)).otherwise(0)).cast("long").alias("n")))["i"]
    ahead = order.withColumn("until", until)
    pick = lambda rows: rows.join(F.broadcast(name), "block").select("query_id", "p", "ring")
    one = pick(ahead.select("query_id", F.explode(F.slice("block", F.lit(1), F.col("until"))).alias("block")))
    near = settled(_best(_scored(q, placed, one, k, parts), k), "near")
    worst = near.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("worst"))
    rest = ahead.join(worst, "query_id", "left").withColumn("x", F.slice(F.arrays_zip("block", "bound"), F.col("until") + 1, F.size("block")))
    rest = rest.select("query_id", F.explode(F.filter("x", lambda x: F.col("worst").isNull() | (F.col("c") < k) | (x["bound"] >= F.col("worst")))).alias("x")).select("query_id", F.col("x.block").alias("block"))
    two = settled(pick(rest), "met")
    more = _scored(q, placed, two, k, parts)
    rows = _best(near.drop("rank").unionByName(more), k)
    pairs = q.count() * len(sizes)
    met = ahead.agg(F.sum("until")).first()[0] or 0
    return Found(rows, pairs, int(met) + two.count())
