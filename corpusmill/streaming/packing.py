"""Blocks packed online: the open block of each part is state, what closes goes on at once.

The same next fit as operators.packing, document by document in the order they come: trigger by trigger, and by `ord` inside a
trigger. A part's state is its open block (at most `length` tokens), however long the stream runs; a restart goes on from the
checkpoint. A block closes when a document does not fit, when a row without ids (null) comes for its part, or, if `idle` is given,
when a part has been silent for so many milliseconds of processing time. A part is one key, handled by one task of a trigger:
streams of few hot domains deal documents to several parts of a domain.

A stream of files comes by the time they were written, not by `ord`. A table whose blocks are to follow `ord` is given in
deliveries, ranges of `ord`, each a trigger of its own (`run_in_order`).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators.packing import BOS, EOS, PAD, least_valid
from corpusmill.sources.shared import shared_dir, written

OUT = "part string, block bigint, chunk int, input_ids array<int>, source string, valid_tokens int, doc_count int, block_hash string"
#: Characters of a delivery, and the files that it is read from.
DELIVERY, FILES = 128 << 20, 8
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenBlocks(StatefulProcessor):
    def __init__(self, length: int, valid: int, idle: int | None):
        self.length, self.valid, self.idle = length, valid, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "used int, block bigint, timer bigint")
        self.docs = handle.getListState("docs", "source string, ids array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        used, block, timer = self.at.get() if self.at.exists() else (0, 0, None)
        docs = [(s, list(ids)) for s, ids in self.docs.get()] if used else []
        batch = sorted((r for pdf in rows for r in zip(pdf["ord"], pdf["source"], pdf["ids"], strict=True)), key=lambda r: r[0])
        out: list[tuple] = []
        for _, source, ids in batch:
            if ids is None:
                out += self.closed(block, docs)
                used, docs = 0, []
                continue
            source, ids = source or "", [int(x) for x in ids]
            cost = len(ids) + 2
            if not ids:
                continue
            if used == 0 or used + cost > self.length:
                out += self.closed(block, docs)
                used, docs, block = 0, [], block + 1
                if cost > self.length:
                    body = self.length - 2
                    out += [self.row(block, k, [BOS, *ids[i : i + body], EOS], source, 1) for k, i in enumerate(range(0, len(ids), body)) if min(body, len(ids) - i) + 2 >= self.valid]
                    continue
            used += cost
            docs.append((source, ids))
        if self.idle is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle if used else None
            if timer is not None:
                self.handle.registerTimer(timer)
        self.keep(used, block, timer, docs)
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        used, block, _ = self.at.get()
        docs = [(s, list(ids)) for s, ids in self.docs.get()] if used else []
        self.keep(0, block, None, [])
        yield self.frame(key, self.closed(block, docs))

    def close(self) -> None:
        pass

    def keep(self, used: int, block: int, timer: int | None, docs: list) -> None:
        self.at.update((used, block, timer))
        self.docs.put(docs) if docs else self.docs.clear()

    def closed(self, block: int, docs: list) -> list[tuple]:
        ids = [x for _, own in docs for x in (BOS, *own, EOS)]
        if len(ids) < self.valid or not docs:
            return []
        names = [s for s, _ in docs]
        return [self.row(block, 0, ids, max(names, key=lambda s: (names.count(s), -names.index(s))), len(docs))]

    def row(self, block: int, chunk: int, ids: list[int], source: str, count: int) -> tuple:
        whole = ids + [PAD] * (self.length - len(ids))
        return block, chunk, whole, source, len(ids), count, hashlib.sha1(",".join(map(str, whole)).encode()).hexdigest()

    def frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=[c.split()[0] for c in OUT.split(", ")])


def packed(tokens: DataFrame, length: int, valid: int | None = None, idle: int | None = None) -> DataFrame:
    """(part, block, chunk, input_ids, source, valid_tokens, doc_count, block_hash) from a stream (part, ord, source, ids).

    Needs the state store of PROVIDER (spark.sql.streaming.stateStore.providerClass).
    """
    made = OpenBlocks(length, least_valid(length) if valid is None else valid, idle)
    rows = tokens.select("part", "ord", "source", "ids")
    return rows.groupBy("part").transformWithStateInPandas(made, OUT, "Append", "None" if idle is None else "ProcessingTime")


def run(tokens: DataFrame, length: int, valid: int | None = None, folder: str | None = None) -> DataFrame:
    """What is there of a stream packed into a folder (a new one in the shared folder if not said), and all blocks closed so far."""
    spark = tokens.sparkSession
    folder = folder or f"{shared_dir(spark)}/online-{uuid.uuid4().hex}"
    # parts are few: more tasks than cores would only open empty state
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.shuffle.partitions": str(tasks)}
    before = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        writer = packed(tokens, length, valid).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        writer.start(f"{folder}/blocks").awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(OUT).parquet(f"{folder}/blocks")


def run_in_order(docs: DataFrame, tokens: Callable[[DataFrame], DataFrame], length: int, valid: int | None = None) -> DataFrame:
    """All blocks that a table (ord, text, ...) closes which comes by `ord`; `tokens` makes (part, ord, source, ids) of its rows.

    Rows of one `ord` come in one delivery. Each delivery goes on from the checkpoint of the one before.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = tokens(docs.repartitionByRange(FILES * (1 + chars // DELIVERY), "ord")).withColumn("delivery", F.floor(F.spark_partition_id() / FILES).cast("int"))
    path, folder = written(rows, "deliveries", "delivery"), f"{shared_dir(spark)}/online-{uuid.uuid4().hex}"
    numbers = spark.read.schema(rows.schema).parquet(path).select("delivery").distinct().collect()  # one for each DELIVERY of text
    out = spark.createDataFrame([], OUT)
    for n in sorted(r[0] for r in numbers):
        # a pattern, so that files of earlier deliveries, which are in the checkpoint, need not lie in the same folder
        out = run(spark.readStream.schema(rows.drop("delivery").schema).parquet(f"{path}/delivery={{{n}}}"), length, valid, folder)
    return out
