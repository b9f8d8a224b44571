"""Tables that a query writes for itself in the folder that driver and executors share, and reads again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder on a single machine, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local") or "local-cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        import tempfile

        where = f"file://{tempfile.mkdtemp(prefix='corpusmill-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is run inside; what was set before comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str, *by: str) -> str:
    """The new folder in the shared folder that the rows were written to, in folders by the columns `by`.

    The shuffle files of the write go as it ends; nothing reads them again. The folder is the cluster's to clean.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.partitionBy(*by).parquet(path)
    return path


def settled(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage is cut, a lost executor costs nothing before this."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name, *by))


def settled_in_batches(df: DataFrame, name: str, rows: int, *by: str) -> DataFrame:
    """settled(), with at most so many rows at a time on their way to Python: for rows that are large."""
    spark = df.sparkSession
    most = int(spark.conf.get(BATCH))
    with setting(spark, BATCH, str(min(most, rows) if most > 0 else rows)):
        return settled(df, name, *by)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are too few to be read by as many tasks; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
