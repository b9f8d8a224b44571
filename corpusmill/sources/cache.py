"""Read-through cache of collected documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path holds rows that were written to the end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def through(spark: SparkSession, path: str, make: Callable[[], DataFrame], reuse: bool = True, refresh: bool = False, usable: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, dict]:
    """(rows, report): what the path holds if it may be reused, else what make() returns, written there first.

    Rows of an earlier run go through usable(), for what has changed since then.
    """
    if reuse and refresh:
        raise ValueError("a cache is either reused or refreshed")
    hit = reuse and exists(spark, path)
    if not hit:
        make().write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    n = rows.count()
    if hit and usable is not None:
        rows = usable(rows)
    return rows, {"cache_hit": hit, "raw_cache_path": path, "records_loaded": n, "records_written": 0 if hit else n, "remote_accessed": not hit}
