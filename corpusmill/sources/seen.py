"""Keys that earlier steps have used, in a table that is bucketed by key: later steps meet it bucket by bucket, without shuffling it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.shared import shared_dir


class Seen:
    """Keys under a path (a new one in the shared folder if not said). Each is stored once, sorted within its bucket.

    A key is shuffled once, when it is added; a look-up shuffles the keys looked up only, or nothing where Spark's size check lets
    it broadcast one side. Opened again by its path, with the same number of buckets, the table is as it was left.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, key: str = "text_hash", kind: str = "string", buckets: int | None = None):
        self.spark, self.key = spark, key
        self.path = path or f"{shared_dir(spark)}/seen-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"seen_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (`{key}` {kind}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Keys that are not there yet; null is none."""
        new = rows.select(self.key).where(F.col(self.key).isNotNull()).repartition(self.buckets, self.key).dropDuplicates()
        new.join(self.table(), self.key, "left_anti").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def mark(self, rows: DataFrame, name: str = "excluded") -> DataFrame:
        """rows and whether their key is there."""
        known = self.table().withColumn(name, F.lit(True))
        return rows.join(known, self.key, "left").withColumn(name, F.coalesce(name, F.lit(False)))

    def drop(self) -> None:
        """Forgets the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
