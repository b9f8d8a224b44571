"""Documents up to a quota for each source, in source order, without reading what lies behind the row that fills it.

Sources are read in ranges of their order that grow: a range is projected, normalised, judged and hashed once and written; the
decisions are made on hashes alone, and texts are picked at the end. Sources whose quota is full are not read in the next range, so
the rows read grow with the quotas, not with the tables (a range of a sorted table is a matter of its row groups' statistics).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import dedup, quality
from corpusmill.sources.seen import Seen
from corpusmill.sources.shared import settled


@dataclass
class Collected:
    """docs: kept rows with text_hash; reasons: (source, reason, n) of the rows up to each quota's last; read: rows that were projected."""

    docs: DataFrame
    reasons: DataFrame
    kept: dict[str, int]
    read: int


def collected(rows: DataFrame, quotas: dict[str, int], seen: Seen | None = None, order: str = "ord", first: int | None = None, grow: int = 4) -> Collected:
    """The first quotas[source] usable rows of each source by `order` (unique in a source; a quota of 0 gives none).

    rows: (text, source, domain, order, ...). A row's reason is the first of: what the quality rules say, `excluded_previous_split`
    where `seen` has its hash, `duplicate` where an earlier usable row of its source has it, `ok`. The quotas are a registry's.
    """
    left = {s: n for s, n in quotas.items() if n > 0}
    first = first or max(1024, 2 * sum(left.values()))
    spark, low, high, read = rows.sparkSession, None, first, 0
    parts: list[DataFrame] = []
    used: DataFrame | None = None
    tally: dict[tuple[str, str], int] = {}
    while left:
        span = rows.where(F.col("source").isin(*left)).where((F.col(order) < high) if low is None else (F.col(order) >= low) & (F.col(order) < high))
        base = settled(dedup.hashed(quality.with_reason(span.withColumn("text", T.normalized(F.col("text"))))), "range")
        read += base.count()
        d = base.select("source", order, "text_hash", "reason")
        if seen is not None:
            d = seen.mark(d).withColumn("reason", F.when((F.col("reason") == "ok") & F.col("excluded"), "excluded_previous_split").otherwise(F.col("reason"))).drop("excluded")
        d = d.join(d.where("reason = 'ok'").groupBy("source", "text_hash").agg(F.min(order).alias("__first")), ["source", "text_hash"], "left")
        again = F.col(order) > F.col("__first")
        if used is not None:
            d = d.join(used.withColumn("__used", F.lit(True)), ["source", "text_hash"], "left")
            again = again | F.col("__used")
        d = settled(d.withColumn("reason", F.when((F.col("reason") == "ok") & again, "duplicate").otherwise(F.col("reason"))).select("source", order, "text_hash", "reason"), "decisions")
        kept = settled(dedup.quota(d.where("reason = 'ok'").select("source", order, "text_hash"), "source", left, order), "kept")
        ends = {r["source"]: r for r in kept.groupBy("source").agg(F.count("*").alias("n"), F.max(order).alias("last")).collect()}  # a row a source
        full = {s: ends[s]["last"] for s, n in left.items() if s in ends and ends[s]["n"] == n}
        if full:
            cuts = F.broadcast(spark.createDataFrame(list(full.items()), "source string, __last bigint"))
            d = d.join(cuts, "source", "left").where(F.col("__last").isNull() | (F.col(order) <= F.col("__last")))
        for r in d.groupBy("source", "reason").count().collect():
            tally[r["source"], r["reason"]] = tally.get((r["source"], r["reason"]), 0) + r["count"]
        parts.append(base.drop("reason").join(kept.select("source", order), ["source", order], "left_semi"))
        used = kept.select("source", "text_hash") if used is None else used.unionByName(kept.select("source", "text_hash"))
        left = {s: n - (ends[s]["n"] if s in ends else 0) for s, n in left.items() if s not in full}
        if left and rows.where(F.col("source").isin(*left)).where(F.col(order) >= high).select(order).isEmpty():
            break
        low, high = high, high * grow
    docs = parts[0] if parts else dedup.hashed(rows).where("false")
    for p in parts[1:]:
        docs = docs.unionByName(p)
    reasons = spark.createDataFrame([(s, r, n) for (s, r), n in tally.items()], "source string, reason string, n bigint")
    kept_n = {s: n - left.get(s, 0) for s, n in quotas.items()}
    return Collected(docs, reasons, kept_n, read)


def splits(rows: DataFrame, quotas: dict[str, dict[str, int]], order: str = "ord", seen: Seen | None = None) -> DataFrame:
    """The documents of splits one after another, with a column `split`; none has a text of an earlier one."""
    seen = seen or Seen(rows.sparkSession)
    out: DataFrame | None = None
    for split, wanted in quotas.items():
        docs = settled(collected(rows, wanted, seen, order).docs, "split")
        seen.add(docs)
        docs = docs.withColumn("split", F.lit(split))
        out = docs if out is None else out.unionByName(docs)
    return out
