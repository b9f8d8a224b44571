"""Top-k retrieval of vectors, its quality measures, and pooling.

Exact search compares blocks of queries with blocks of slots, so work spreads over both; each block keeps k rows a query before
anything is shuffled, and neither side is broadcast. Random-plane codes give candidates by an equi-join for larger tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import vector as V
from corpusmill.operators.packing import numbered
from corpusmill.sources.shared import settled

QUERY_BLOCK, SLOT_BLOCK = 512, 8192
#: Scores further apart than this do not see each other in a softmax: exp(-STRETCH) is a double still, its square is not.
STRETCH = 500.0
#: Slots that a code should have on average, and the bits of a code.
BUCKET, LEAST_BITS, MOST_BITS = 8, 6, 24


def _blocked(vectors: DataFrame, key: str, value: str, block: int) -> DataFrame:
    n = max(1, -(-vectors.count() // block))
    return vectors.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("b"), F.col(key).cast("bigint").alias("id"), V.doubles(F.col(value)).alias("v")).where("id is not null and v is not null")


def top_k(queries: DataFrame, slots: DataFrame, k: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(query_id, slot_id, score, rank): the k slots of greatest cosine over the square root of the dimension; ties to the lesser id."""
    q, s = _blocked(queries, key, value, QUERY_BLOCK), _blocked(slots, key, value, SLOT_BLOCK)
    qb, sb = q.select("b").distinct(), s.select("b").distinct()
    pairs = qb.withColumnRenamed("b", "qb").crossJoin(sb.withColumnRenamed("b", "sb"))  # names of blocks only
    left = q.join(pairs.withColumnRenamed("qb", "b"), "b").select("b", "sb", F.lit(1).alias("kind"), "id", "v").withColumnRenamed("b", "qb")
    right = s.join(pairs.withColumnRenamed("sb", "b"), "b").select("qb", F.col("b").alias("sb"), F.lit(0).alias("kind"), "id", "v")

    def run(batches):
        at, sides, out = None, ([], []), []

        def scored():
            if not sides[0] or not sides[1]:
                return []
            ids = [np.array([i for i, _ in x], np.int64) for x in sides]
            m = [np.array([v for _, v in x]) for x in sides]
            m = [x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12) for x in m]
            sim = np.round((m[1] @ m[0].T) / np.sqrt(m[0].shape[1]), 9)
            rows = []
            for i, row in enumerate(sim):
                near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                best = near[np.lexsort((ids[0][near], -row[near]))[:k]]
                rows.append((np.full(len(best), ids[1][i]), ids[0][best], row[best]))
            return rows

        def table():
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "slot_id", "score"])

        for b in batches:
            for qb, sb, kind, i, v in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (qb, sb) != at:
                    out += scored()
                    at, sides = (qb, sb), ([], [])
                    if len(out) > 4096:
                        yield table()
                        out = []
                sides[kind].append((i, v))
        out += scored()
        yield table()

    found = left.unionByName(right).repartition("qb", "sb").sortWithinPartitions("qb", "sb", "kind").mapInArrow(run, "query_id bigint, slot_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "slot_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def weighted(found: DataFrame) -> DataFrame:
    """(query_id, slots, weights): the softmax of each query's k scores, best first."""
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "slot_id", "score"))).alias("r"))
    return rows.select("query_id", F.transform("r", lambda x: x["slot_id"]).alias("slots"), V.softmax(F.transform("r", lambda x: x["score"])).alias("weights"))


def gathered(found: DataFrame, slots: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(query_id, pos, value): the weighted sum of the slots' raw vectors, in long form."""
    w = weighted(found).select("query_id", F.explode(F.arrays_zip("slots", "weights")).alias("x")).select("query_id", F.col("x.slots").alias("id"), F.col("x.weights").alias("w"))
    v = slots.select(F.col(key).cast("bigint").alias("id"), F.posexplode(V.doubles(F.col(value))).alias("pos", "y"))
    return w.join(v, "id").groupBy("query_id", "pos").agg(F.sum(F.col("w") * F.col("y")).alias("value"))


def measures(found: DataFrame, k: int) -> DataFrame:
    """Means over queries of the mass of the first 1, 5 and 10 weights, entropy and its share of the most possible."""
    e = V.entropy(F.col("weights"))
    w = weighted(found).select(*[V.mass(F.col("weights"), n).alias(f"top{n}") for n in (1, 5, 10)], e.alias("e"))
    return w.agg(*[F.avg(f"top{n}").alias(f"top{n}_mass") for n in (1, 5, 10)], F.lit(min(10, k) / k).alias("uniform_top10"), F.avg("e").alias("entropy"), (F.avg("e") / float(np.log(max(k, 2)))).alias("entropy_share"))


def codes(vectors: DataFrame, planes: list[list[list[float]]], key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(id, tab, code): for each table of planes the bits of the signs."""
    v = V.doubles(F.col(value))
    one = lambda table: sum((F.when(V.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in p])) > 0, 1 << i).otherwise(0) for i, p in enumerate(table)), F.lit(0))
    rows = vectors.select(F.col(key).alias("id"), v.alias("v"))
    return rows.select("id", F.posexplode(F.array(*[one(t).cast("int") for t in planes])).alias("tab", "code"))


def bits_for(n: int) -> int:
    """Bits of the codes of n slots: buckets do not grow with the table, so candidates grow as the queries do."""
    return max(LEAST_BITS, min(MOST_BITS, sum(n > BUCKET << b for b in range(MOST_BITS))))


def candidates(queries: DataFrame, slots: DataFrame, planes, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(query_id, slot_id) that share a code in some table."""
    q = codes(queries, planes, key, value).withColumnRenamed("id", "query_id")
    s = codes(slots, planes, key, value).withColumnRenamed("id", "slot_id")
    return q.join(s, ["tab", "code"]).select("query_id", "slot_id").distinct()


def capped(found: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most so many candidates of each query, a seeded choice; the window is pruned before its shuffle."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.sha1(F.concat_ws(":", F.lit(seed), "query_id", "slot_id").cast("binary")), "slot_id"))
    return found.withColumn("__n", turn).where(F.col("__n") <= most).drop("__n")


def filled(queries: DataFrame, slots: DataFrame, found: DataFrame, least: int, seed: int = 0, key: str = "vec_id") -> DataFrame:
    """(query_id, slot_id, drawn): `found`, and for queries with fewer than `least` of it as many other slots drawn at random as they lack.

    Slots are numbered 0..n-1 by id, without collecting them. A query walks over 0..m-1, m the least prime from n on, in steps of its
    own from a place of its own, both seeded: it comes to each number once, so it has `least` different slots (or all there are)
    after as many steps as it lacks, has and skips. Numbers meet slots in a join; reruns draw the same.
    """
    ids = slots.select(F.col(key).cast("bigint").alias("slot_id")).where("slot_id is not null").distinct()
    dense = settled(numbered(ids.withColumn("part", F.lit("")), "part", "slot_id", "number").select("slot_id", "number"), "numbers")
    n = dense.count()
    m = next(x for x in range(max(2, n), 2 * max(2, n) + 1) if all(x % f for f in range(2, int(x**0.5) + 1)))
    have = found.select("query_id", "slot_id").distinct()
    short = short_lists(queries, have, min(least, n), key)
    number = lambda what: F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), F.lit(what), F.col("query_id")).cast("binary")), 1, 12), 16, 10).cast("bigint")
    turns = F.sequence(F.lit(0).cast("bigint"), F.lit(min(least, n) + m - n - 1).cast("bigint"))  # lacking + candidates + skipped
    walk = short.select("query_id", "candidates", number("place").alias("a"), (F.lit(1) + number("step") % (m - 1)).alias("s"), F.explode(turns).alias("turn"))
    drawn = walk.withColumn("number", ((F.col("a") % m + F.col("turn") * F.col("s")) % m)).join(dense, "number").join(have, ["query_id", "slot_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("turn"))
    more = drawn.withColumn("place", place).where(F.col("place") <= min(least, n) - F.col("candidates")).select("query_id", "slot_id", F.lit(True).alias("drawn"))
    return have.withColumn("drawn", F.lit(False)).unionByName(more)


def short_lists(queries: DataFrame, found: DataFrame, least: int, key: str = "vec_id") -> DataFrame:
    """(query_id, candidates): the queries that have fewer than `least` candidates, none included; filled() gives them others."""
    per = found.groupBy("query_id").agg(F.count("*").alias("candidates"))
    return queries.select(F.col(key).alias("query_id")).join(per, "query_id", "left").select("query_id", F.coalesce("candidates", F.lit(0)).alias("candidates")).where(F.col("candidates") < least)


def span_means(rows: DataFrame, seq: str, order: str, value: str, span: int) -> DataFrame:
    """(seq, span_idx, pos, mean) over consecutive spans of `span` rows of each sequence; a short tail is dropped."""
    n = F.row_number().over(Window.partitionBy(seq).orderBy(order)) - 1
    placed = rows.select(seq, F.floor(n / span).cast("int").alias("span_idx"), V.doubles(F.col(value)).alias("v"))
    long = placed.select(seq, "span_idx", F.posexplode("v").alias("pos", "x"))
    return long.groupBy(seq, "span_idx", "pos").agg(F.avg("x").alias("mean"), F.count("*").alias("n")).where(F.col("n") == span).drop("n")


def running_mean(rows: DataFrame, seq: str, order: str, value: str) -> DataFrame:
    by = Window.partitionBy(seq).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_mean", F.avg(value).over(by))


def running_softmax(rows: DataFrame, seq: str, order: str, score: str, value: str) -> DataFrame:
    """The softmax-weighted mean of the values so far.

    Rows go by the epoch of the greatest score so far, STRETCH wide; sums run within an epoch, shifted by its upper end, so the
    greatest score always counts. Of earlier epochs only the last one's whole sums can still be seen beside it.
    """
    by = Window.partitionBy("__q").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    w = F.exp(F.col("__s") - (F.col("__e") + 1) * STRETCH)
    named = rows.withColumns({"__q": F.col(seq), "__o": F.col(order), "__s": F.col(score).cast("double"), "__v": F.col(value).cast("double")})
    named = named.withColumn("__e", F.floor(F.max("__s").over(by) / STRETCH)).withColumn("__w", w)
    sums = named.groupBy("__q", "__e").agg(F.sum(F.col("__w") * F.col("__v")).alias("__n1"), F.sum("__w").alias("__d1"))
    last = sums.select(F.col("__q").alias("__p"), (F.col("__e") + 1).alias("__f"), "__n1", "__d1")
    within = Window.partitionBy("__q", "__e").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    run = named.withColumns({"__n": F.sum(F.col("__w") * F.col("__v")).over(within), "__d": F.sum("__w").over(within)})
    run = run.join(last, F.col("__q").eqNullSafe(F.col("__p")) & (F.col("__e") == F.col("__f")), "left")
    both = lambda c: F.col(f"__{c}") + F.coalesce(F.col(f"__{c}1"), F.lit(0.0)) * float(np.exp(-STRETCH))
    return run.withColumn("running_softmax", both("n") / both("d")).drop(*[c for c in run.columns if c.startswith("__")])


def in_batch_contrast(pairs: DataFrame, order: str, query: str, target: str, size: int, tau: float) -> DataFrame:
    """(n, loss): cross-entropy of each row's own target among all targets of its batch, `size` rows by `order` (a whole number), by cosine over tau.

    A batch is a row for each pair of its members, so size squared; batches are as many as the table needs.
    """
    unit = pairs.select(F.col(order).cast("bigint").alias("i"), F.floor(F.col(order) / size).alias("b"), V.unit(V.doubles(F.col(query))).alias("q"), V.unit(V.doubles(F.col(target))).alias("k"))
    logits = unit.select("b", "i", "q").join(unit.select("b", F.col("i").alias("j"), "k"), "b").select("b", "i", "j", (V.dot(F.col("q"), F.col("k")) / tau).alias("x"))
    rows = logits.groupBy("b", "i").agg(F.max("x").alias("m"), F.max(F.when(F.col("i") == F.col("j"), F.col("x"))).alias("own"), F.sum(F.exp("x")).alias("all"))
    return rows.agg(F.count("*").alias("n"), F.avg(F.log("all") - F.col("own")).alias("loss"))  # a cosine over tau is small enough to exponentiate


def off_diagonal(vectors: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """(group..., n, cosine): the mean absolute cosine between different vectors of each group, 0 for one alone. A group is a few branches."""
    rows = vectors.select(*group, order, V.unit(V.doubles(F.col(value))).alias("u"))
    other = rows.select(*group, F.col(order).alias("__j"), F.col("u").alias("__w"))
    pairs = rows.join(other, group).groupBy(*group).agg(F.countDistinct(order).alias("n"), F.sum(F.when(F.col(order) != F.col("__j"), F.abs(V.dot(F.col("u"), F.col("__w")))).otherwise(0.0)).alias("s"))
    return pairs.select(*group, "n", F.when(F.col("n") > 1, F.col("s") / F.greatest(F.lit(1), F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("cosine"))


def validation(vectors: DataFrame, value: str) -> DataFrame:
    """Mean, deviation, mean length, NaN and infinite counts of a vector column, and whether it may be used."""
    v = vectors.select(V.doubles(F.col(value)).alias("v"))
    long = v.select(F.explode("v").alias("x"))
    bad_nan, bad_inf = F.count_if(F.isnan("x")), F.count_if(F.abs("x") == float("inf"))
    a = long.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), bad_nan.alias("nan_count"), bad_inf.alias("inf_count"))
    n = v.agg(F.avg(V.norm(F.col("v"))).alias("mean_norm"))
    return a.crossJoin(F.broadcast(n)).withColumn("decision", F.when((F.col("nan_count") == 0) & (F.col("inf_count") == 0), "PASS").otherwise("FAIL"))  # one row each


def edge_softmax(edges: DataFrame) -> DataFrame:
    """edges (src, dst, logit) with p, the softmax over each src."""
    by = Window.partitionBy("src")
    e = F.exp(F.col("logit") - F.max("logit").over(by))
    return edges.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(by)).drop("__e")


def graph_measures(edges: DataFrame) -> DataFrame:
    p = edge_softmax(edges)
    rows = p.groupBy("src").agg((-F.sum(F.col("p") * F.log(F.greatest("p", F.lit(1e-12))))).alias("e"), F.max("p").alias("m"), F.count("*").alias("n"), *[F.count_if(F.col("p") > t).alias(f"c{i}") for i, t in enumerate((0.02, 0.05, 0.10))])
    return rows.agg(F.avg("e").alias("entropy"), F.avg("m").alias("mean_max"), *[(F.sum(f"c{i}") / F.sum("n")).alias(name) for i, name in enumerate(("over_002", "over_005", "over_010"))])


def forget_edges(edges: DataFrame, rate: float, prune: float) -> DataFrame:
    """Each src's softmax moved towards uniform, small edges cut, the rest rescaled (uniform if none is left), as logits again."""
    by = Window.partitionBy("src")
    mixed = (1 - rate) * F.col("p") + rate / F.count("*").over(by)
    rows = edge_softmax(edges).withColumn("q", mixed).withColumn("q", F.when(F.col("q") < prune, 0.0).otherwise(F.col("q")))
    total = F.sum("q").over(by)
    rows = rows.withColumn("q", F.when(total > 0, F.col("q") / F.greatest(total, F.lit(1e-300))).otherwise(1 / F.count("*").over(by)))
    return rows.select("src", "dst", F.log(F.greatest("q", F.lit(1e-8))).alias("logit"))
