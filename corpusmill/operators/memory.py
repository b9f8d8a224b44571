"""Measures of a slot memory and its graph, over tables of retrievals, vectors and edges.

Rows are numbered by ranges of their order, so no task sees a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import vector as V
from corpusmill.operators.retrieval import edge_softmax
from corpusmill.sources.shared import settled


#: Nodes of a graph, whose vectors are broadcast: 16 MB at 512 numbers each.
MOST_NODES = 4096


def write_threshold(step: Column, initial: float, target: float, every: int, amount: float) -> Column:
    """Falls by `amount` every so many steps, down to the target."""
    return F.greatest(F.lit(target), F.lit(initial) - F.floor(step / max(1, every)) * F.lit(amount))


def skip_rate(rows: DataFrame, surprise: str, step: str, **threshold) -> DataFrame:
    """(step, rows, skip_rate): the share of rows not surprising enough to be written."""
    theta = write_threshold(F.col(step), **threshold)
    return rows.groupBy(step).agg(F.count("*").alias("rows"), F.avg((F.col(surprise) <= theta).cast("double")).alias("skip_rate"))


def slot_counts(found: DataFrame, slots: DataFrame, key: str = "vec_id") -> DataFrame:
    """(slot_id, retrieved) of every slot, 0 included."""
    counts = found.groupBy("slot_id").agg(F.count("*").alias("retrieved"))
    return slots.select(F.col(key).cast("bigint").alias("slot_id")).join(counts, "slot_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(0)))


def reusable(counts: DataFrame, ratio: float) -> DataFrame:
    """Slots retrieved less often than the ratio of the mean, the mean counting as 1 at least."""
    mean = counts.agg(F.greatest(F.lit(1.0), F.avg("retrieved")).alias("mean"))  # one row
    return counts.crossJoin(F.broadcast(mean)).where(F.col("retrieved") < F.col("mean") * ratio).select("slot_id", "retrieved")


def _affinity(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, node, p): softmax over nodes of the cosine; both sides are (id, v). Nodes are a model's few hundred: more than MOST_NODES are refused."""
    if nodes.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    n = nodes.select(F.col("id").alias("node"), V.unit(F.col("v")).alias("nv"))
    q = queries.select(F.col("id").alias("query"), V.unit(F.col("v")).alias("qv"))
    logits = q.crossJoin(F.broadcast(n)).select("query", F.col("node"), V.dot(F.col("qv"), F.col("nv")).alias("logit"))
    return edge_softmax(logits.withColumnsRenamed({"query": "src", "node": "dst"})).select(F.col("src").alias("query"), F.col("dst").alias("node"), "p")


def overview(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query, pos, value): node affinities moved along the edges' transition, then the mean of the nodes' vectors by them."""
    step = edge_softmax(edges).select(F.col("src").alias("node"), "dst", F.col("p").alias("t"))
    moved = _affinity(queries, nodes).join(step, "node").groupBy("query", "dst").agg(F.sum(F.col("p") * F.col("t")).alias("w"))
    long = nodes.select(F.col("id").alias("dst"), F.posexplode("v").alias("pos", "x"))
    return moved.join(long, "dst").groupBy("query", "pos").agg(F.sum(F.col("w") * F.col("x")).alias("value"))


def _numbered(rows: DataFrame, seq: str, order: str, name: str) -> DataFrame:
    """rows with their place by (seq, order), from 0: the rows of the ranges before, and the place in the range."""
    ranged = settled(rows.repartitionByRange(seq, order).withColumn("__p", F.spark_partition_id()), "ranges")
    before = F.sum("c").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    bases = ranged.groupBy(F.col("__p").alias("__r")).agg(F.count("*").alias("c")).select("__r", F.coalesce(before, F.lit(0)).alias("__base"))
    at = F.row_number().over(Window.partitionBy("__p").orderBy(seq, order)) - 1
    return ranged.withColumn("__at", at).join(bases, F.col("__p") == F.col("__r")).withColumn(name, F.col("__base") + F.col("__at")).drop("__p", "__r", "__base", "__at")


def adjacent_contrast(rows: DataFrame, seq: str, order: str, value: str, tau: float, negatives: int) -> DataFrame:
    """(n, loss) of a batch: each vector against the next of its sequence and against cyclically shifted vectors of the batch."""
    unit = rows.select(seq, order, V.unit(V.doubles(F.col(value))).alias("u"))
    placed = _numbered(unit, seq, order, "i")
    pool = placed.select("i", F.col("u").alias("n"))
    after = placed.select((F.col("i") - 1).alias("i"), F.col(seq).alias("__next"), F.col("u").alias("next"))
    pairs = placed.join(after, "i").where(F.col(seq).eqNullSafe(F.col("__next"))).select(seq, order, "u", "next")
    pairs = _numbered(pairs, seq, order, "m")
    size = pool.agg(F.count("*").alias("p"))  # one row
    shifted = pairs.crossJoin(F.broadcast(size)).select("m", "u", "next", F.explode(F.sequence(F.lit(2), F.lit(1 + max(1, negatives)))).alias("s"), "p").withColumn("i", (F.col("m") + F.col("s")) % F.col("p"))
    logits = shifted.join(pool, "i").groupBy("m").agg(F.sum(F.exp(V.dot(F.col("u"), F.col("n")) / tau)).alias("others"), F.max(V.dot(F.col("u"), F.col("next")) / tau).alias("own"))
    return logits.agg(F.count("*").alias("n"), F.avg(F.log(F.col("others") + F.exp("own")) - F.col("own")).alias("loss"))


def coactivation(queries: DataFrame, nodes: DataFrame, edges: DataFrame, seq: str, order: str) -> DataFrame:
    """(seq, order, p): how likely the graph leads from each vector's nodes to the next one's. queries: (seq, order, id, v)."""
    a = _affinity(queries, nodes)
    nexts = queries.select("id", seq, order, F.lead("id").over(Window.partitionBy(seq).orderBy(order)).alias("next")).where("next is not null")
    step = edge_softmax(edges).select(F.col("src").alias("node"), F.col("dst"), F.col("p").alias("t"))
    moved = a.join(step, "node").groupBy(F.col("query").alias("id"), "dst").agg(F.sum(F.col("p") * F.col("t")).alias("w"))
    target = a.select(F.col("query").alias("next"), F.col("node").alias("dst"), F.col("p").alias("b"))
    return nexts.join(moved, "id").join(target, ["next", "dst"]).groupBy(seq, order).agg(F.least(F.greatest(F.sum(F.col("w") * F.col("b")), F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p"))


def branch_weights(rows: DataFrame, similarity: str, diversity: str, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """rows (seq, branch, pos, similarity, diversity) with weight: softmax over branches of the running mean similarity and the diversity."""
    so_far = Window.partitionBy("seq", "branch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    score = weights[0] * F.avg(similarity).over(so_far) + weights[1] * F.col(diversity)
    at = Window.partitionBy("seq", "pos")
    scored = rows.withColumn("__s", score).withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(at)))
    return scored.withColumn("weight", F.col("__e") / F.sum("__e").over(at)).drop("__s", "__e")
