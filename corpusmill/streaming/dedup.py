"""Streams of documents: checked, hashed, and passed on once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import dedup, quality


def unseen(stream: DataFrame, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each text once; with an event time, state is kept for `delay` only."""
    rows = dedup.hashed(quality.keep_ok(stream))
    if time is None:
        return rows.dropDuplicates(["text_hash"])
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_hash"])


def counts(stream: DataFrame, time: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows by window and reason."""
    return quality.with_reason(stream).withWatermark(time, delay).groupBy(F.window(time, window), "reason").agg(F.count("*").alias("n"))
