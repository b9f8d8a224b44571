"""Mixing sources to target weights by fitting a subset sum to each source's budget.

Documents are counted by exact length. Of each length a proportional share is taken; a bounded knapsack over what is left
fills the remaining budget to the word; which documents of a length are taken is decided by a seeded hash of their ids.

The histogram of a source has a row for each distinct length, so a source with a third of all rows is as small as another.
Documents of one source and length, however many, are ranked in chunks of about the square root of their number. Null source
is a source of its own and comes last; null text has size 0; repeated rows count each; an empty table gives an empty table;
other columns are ignored. Reruns agree, whatever the partitioning. The knapsack of a source looks at budgets up to twice its
longest document's words, with a byte and a number for each word of that: 100 MB for a document of ten million words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, join_same, settled

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 20240601


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, so one task sees them all.

    Sharing the excess of full sources among the others by weight ends where every source has the least of its cap and a
    common level times its weight; the level is read off the sources sorted by cap over weight.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))))
    rows = sources.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rows = rows.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    open_ = F.when(F.col("cap") / F.col("w") > F.col("level"), F.col("cap") / F.col("w"))
    rows = rows.withColumn("level", F.min_by("level", open_).over(whole))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def fit_budget(length: np.ndarray, count: np.ndarray, budget: float, each: int = 1) -> np.ndarray:
    """How many documents of each length to take, each up to `each` times, so that their words come nearest to `budget` from below.

    A proportional share first, then the knapsack over a few times the longest document: a sum is first reached by the
    earliest part that can reach it, which is enough to walk back.
    """
    take = np.zeros(len(length), np.int64)
    total = float((length * count).sum())
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return np.where(length > 0, count, 0)
    reserve = min(budget, 2.0 * float(length.max()))
    expected = count * ((budget - reserve) / total)
    steps = np.floor(np.cumsum(expected) + 1e-9)
    take = np.clip(np.diff(np.concatenate([[0], steps])).astype(np.int64), 0, count)  # rounding carries over to the next length
    for i in np.argsort(-length):
        if (over := (length * take).sum() - budget) > 0 and length[i]:
            take[i] -= min(take[i], int(-(-over // length[i])))
    room = int(budget - (length * take).sum())
    parts = []
    for left in (count - take, count * (each - 1)):  # second times only where first ones do not meet the budget
        for i in np.argsort(-length):
            n, k = (int(min(left[i], room // length[i])) if length[i] else 0), 1
            while n > 0:
                parts.append((int(i), min(k, n)))
                n -= parts[-1][1]
                k *= 2
    first = np.full(room + 1, -1, np.int32)
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    for j, (i, k) in enumerate(parts):
        w = int(length[i]) * k
        if w > room:
            continue
        new = reached[: room + 1 - w] & ~reached[w:]
        first[w:][new] = j
        reached[w:] |= new
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, k = parts[first[at]]
        take[i] += k
        at -= int(length[i]) * k
    return take


def quotas(histogram: DataFrame) -> DataFrame:
    """(source, size, n, base, extra) from (source, size, n, source_size, target): each document base times, and extra documents once more (twice, as far as extra exceeds n)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base = int(target // whole) if whole else 0
        extra = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), target - base * whole, MOST - base) if base < MOST else np.zeros(len(pdf), np.int64)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "base": base, "extra": extra})

    return histogram.groupBy("source").applyInPandas(one, "source string, size bigint, n bigint, base bigint, extra bigint")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, times): how often the mix takes each row of docs."""
    sized = settled(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of().alias("size")), "sized")
    counts = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = targets(sources, weights, share, most)
    q = settled(quotas(join_same(counts, goals, ["source"])), "quotas")
    goals = settled(goals, "targets")
    # chunks follow the order of h
    chunk = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * F.ceil(F.sqrt("n"))).cast("long")
    rows = join_same(sized, q, ["source", "size"]).withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("chunk", chunk)
    per = rows.groupBy("source", "size", "chunk").count()
    before = Window.partitionBy("source", "size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source", "size", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("source", "size", "chunk").orderBy("h", "doc_id")
    ranked = join_same(rows.withColumn("place", F.row_number().over(order)), per, ["source", "size", "chunk"]).withColumn("rank", F.col("place") + F.col("before"))
    times = F.col("base") + (F.col("rank") <= F.col("extra")).cast("long") + (F.col("rank") <= F.col("extra") - F.col("n")).cast("long")
    return join_same(ranked, goals, ["source"]).select("doc_id", "source", "size", "source_size", "target", times.alias("times"))


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Rows of one id, source and size are told apart by nothing that the mix knows: what it takes of them all is spread evenly
    over them, so that as many words stand here as report() says. Where they repeat they are counted in a window of their own.
    """
    taken = mix(docs, **how).groupBy("doc_id", "source", "size").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).where("times > 0")
    taken = settled(taken, "taken")
    keyed = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of().alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keys = ["doc_id", "source", "size"]
    once = join_same(keyed, taken.where("rows = 1"), keys).select("row", "times")
    if not taken.where("rows > 1").isEmpty():
        again = join_same(keyed, taken.where("rows > 1"), keys)
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row")))
        share = F.floor(F.col("times") / F.col("rows")) + (place <= F.pmod("times", "rows")).cast("long")
        once = once.unionByName(again.select("row", share.alias("times")).where("times > 0"))
    return once.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")
