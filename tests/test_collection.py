"""Collection by growing ranges and the table of seen keys."""

import hashlib

from pyspark.sql import functions as F

from corpusmill.operators import collection
from corpusmill.sources.seen import Seen


def rows(spark, n, sources=3):
    """Usable texts with copies, short ones and copies in other sources between; order is sparse."""
    same = F.col("id") - F.col("id") % 7 % 3
    word = lambda i: F.substring(F.sha1(F.concat_ws(" ", same.cast("string"), i.cast("string")).cast("binary")), 1, 6)
    text = F.when(F.col("id") % 11 == 0, "too short").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), word), " "))
    return spark.range(n).select(text.alias("text"), F.concat(F.lit("s"), F.col("id") % sources).alias("source"), F.lit("reasoning").alias("domain"), (F.col("id") * 3).alias("ord"))


def plain(spark, df, quotas, earlier=()):
    from corpusmill.functions import text as T
    from corpusmill.operators import quality

    table = quality.with_reason(df.withColumn("text", T.normalized(F.col("text")))).select("source", "ord", "text", "reason").orderBy("ord").collect()
    kept, tally, seen = {s: [] for s in quotas}, {}, {s: set() for s in quotas}
    for r in table:
        s = r["source"]
        if len(kept.get(s, ())) >= quotas.get(s, 0):
            continue
        h, reason = hashlib.sha1(r["text"].encode()).hexdigest(), r["reason"]
        if reason == "ok" and h in earlier:
            reason = "excluded_previous_split"
        elif reason == "ok" and h in seen[s]:
            reason = "duplicate"
        tally[s, reason] = tally.get((s, reason), 0) + 1
        if reason == "ok":
            seen[s].add(h)
            kept[s].append((r["ord"], h))
    return {(s, *x) for s, k in kept.items() for x in k}, tally


def told(found):
    return {(r["source"], r["ord"], r["text_hash"]) for r in found.docs.collect()}, {(r["source"], r["reason"]): r["n"] for r in found.reasons.collect()}


def test_equals_one_row_after_another_and_reads_little(spark):
    df = rows(spark, 6000)
    quotas = {"s0": 40, "s1": 5, "s2": 0, "none": 3}
    seen = Seen(spark)
    early = df.where("ord < 60").select("text").distinct()
    from corpusmill.functions import text as T

    seen.add(early.select(T.text_hash(T.normalized(F.col("text"))).alias("text_hash")))
    earlier = {r[0] for r in seen.table().collect()}
    for first in (8, 64, 10**6):
        found = collection.collected(df, quotas, seen, first=first)
        assert told(found) == plain(spark, df, quotas, earlier)
        assert found.kept == {"s0": 40, "s1": 5, "s2": 0, "none": 0}
    small = collection.collected(df.where("source <> 'none'"), {"s0": 40, "s1": 5}, seen, first=64)
    assert small.read < 600  # of 6000 rows
    whole = collection.collected(df, {"s0": 10**6}, first=64)
    assert whole.read == 2000 and told(whole) == plain(spark, df, {"s0": 10**6})
    assert told(collection.collected(df.where("false"), quotas)) == (set(), {})


def test_splits_share_no_text(spark):
    df = rows(spark, 900)
    got = collection.splits(df, {"a": {"s0": 30, "s1": 30}, "b": {"s0": 20, "s1": 300}, "c": {"s2": 15}}).collect()
    by = {}
    for r in got:
        by.setdefault(r["split"], set()).add(r["text_hash"])
    assert {k: len(v) for k, v in by.items()}.keys() == {"a", "b", "c"} and not (by["a"] & by["b"] or by["a"] & by["c"] or by["b"] & by["c"])
    want, earlier = set(), set()
    for split, q in (("a", {"s0": 30, "s1": 30}), ("b", {"s0": 20, "s1": 300}), ("c", {"s2": 15})):
        kept, _ = plain(spark, df, q, earlier)
        want |= {(split, *k) for k in kept}
        earlier |= {h for *_, h in kept}
    assert {(r["split"], r["source"], r["ord"], r["text_hash"]) for r in got} == want


def test_seen_keys_are_shuffled_once(spark):
    seen = Seen(spark)
    seen.add(spark.range(500).selectExpr("CAST(id % 100 AS string) AS text_hash"))
    seen.add(spark.createDataFrame([("5",), (None,), ("new",)], "text_hash string"))
    assert seen.table().count() == 101
    rows_ = spark.createDataFrame([("5", 1), ("x", 2), (None, 3)], "text_hash string, n int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = seen.mark(rows_)
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert {r["n"]: r["excluded"] for r in marked.collect()} == {1: True, 2: False, 3: False}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the rows looked up alone
    again = Seen(spark, seen.path)
    assert again.table().count() == 101 and {r["excluded"] for r in again.mark(rows_.where("n = 1")).collect()} == {True}
    again.drop()
