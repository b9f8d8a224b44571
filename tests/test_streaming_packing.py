"""Blocks packed online are those of the batch operator on the same order, a restart included."""

import random

import pytest

from corpusmill.operators import packing
from corpusmill.streaming import packing as online

SCHEMA = "part string, ord bigint, source string, ids array<int>"
KEYS = ["block", "chunk", "input_ids", "source", "valid_tokens", "doc_count", "block_hash"]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def told(df, part):
    return sorted(((r[part], *[tuple(r[c]) if c == "input_ids" else r[c] for c in KEYS]) for r in df.collect()), key=repr)


def test_online_equals_batch(rocks, tmp_path):
    spark, rng = rocks, random.Random(9)
    rows = [(rng.choice("ab"), i, rng.choice(["s", "t", None]), list(range(4, 4 + rng.choice([0, 1, 6, 12, 18, 33, 65])))) for i in range(240)]
    want = told(packing.pack(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("part", "domain"), 32, 10), "domain")
    given, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"

    def feed(part):
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(given)
        stream = online.packed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1000).parquet(given), 32, 10)
        stream.writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        return told(spark.read.schema(online.OUT).parquet(out), "part")

    for a, b in ((0, 90), (90, 91), (91, 240)):  # a query of its own each time: it starts again from the checkpoint
        got = feed(rows[a:b])
        assert set(got) <= set(want)
    assert len(want) - 2 <= len(got) <= len(want)  # the open blocks are missing
    got = feed([("a", 1000, None, None), ("b", 1000, None, None), ("c", 1, None, None)])
    assert got == want


def test_blocks_follow_the_order_of_documents(spark, tmp_path, monkeypatch):
    """Of files that were written last first, a trigger each: blocks are those of packing by doc_id, without the open ones."""
    from pyspark.sql.streaming import DataStreamReader

    from corpusmill.plans import catalog

    option = DataStreamReader.option
    monkeypatch.setattr(DataStreamReader, "option", lambda self, key, value: option(self, key, 1 if key == "maxBytesPerTrigger" else value))
    monkeypatch.setattr(online, "DELIVERY", 20_000, raising=False)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["to", "be", "or", "not"]) for _ in range(rng.choice([5, 11, 30]))), "en", f"src{i % 3}", 0) for i in range(1200)]
    for i in (800, 400, 0):
        spark.createDataFrame(rows[i : i + 400], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    told = lambda df: set(map(tuple, df.select("domain", "block", "chunk", "source", "valid_tokens", "doc_count", "block_hash").collect()))
    got, want = told(catalog.online_blocks(spark, str(tmp_path))), told(catalog.pack_blocks(spark, str(tmp_path)))
    assert len(got) > 20 and got <= want and len(got) >= len(want) - 3


def test_idle_parts_are_closed(rocks, tmp_path):
    spark = rocks
    given, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("a", 1, "s", [5, 6, 7, 8])], SCHEMA).write.parquet(given)
    stream = online.packed(spark.readStream.schema(SCHEMA).parquet(given), 32, 4, idle=300)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="200 milliseconds").start(out)
    try:
        for _ in range(120):
            query.exception()
            if query.isActive and spark.read.schema(online.OUT).option("ignoreMissingFiles", True).parquet(out).count() if (tmp_path / "out").exists() else 0:
                break
            __import__("time").sleep(0.5)
    finally:
        query.stop()
    assert [(r["block"], r["valid_tokens"]) for r in spark.read.schema(online.OUT).parquet(out).collect()] == [(1, 6)]
