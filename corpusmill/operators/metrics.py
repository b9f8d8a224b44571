"""Summaries of metric logs in long form (step, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(log: DataFrame, step: str, metrics: list[str]) -> DataFrame:
    return log.unpivot([step], metrics, "metric", "value").withColumnRenamed(step, "step").withColumn("value", F.col("value").cast("double"))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def summary(log: DataFrame) -> DataFrame:
    """First and last by step, least, greatest and mean of the finite values of each metric, and the relative drop."""
    rows = log.where(finite(F.col("value")))
    out = rows.groupBy("metric").agg(F.count("*").alias("n"), F.min_by("value", "step").alias("first"), F.max_by("value", "step").alias("last"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.avg("value").alias("mean"))
    drop = (F.col("first") - F.col("last")) / F.greatest(F.abs("first"), F.lit(1e-12))
    return out.withColumn("drop", drop).withColumn("decision", F.when(drop >= 0.05, "PASS").otherwise("REVIEW"))


def report_bits(found: DataFrame) -> DataFrame:
    """(decision, drop, recon_drop_ge_5pct, retrieval_entropy_decreased, retrieval_top10_over_0_18) of a memory run's summary(), one row.

    Fixed values: the metrics' names and the mass that the ten best should have.
    """
    of = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c)))
    yes = lambda test: F.coalesce(test, F.lit(False))
    first = of("recon_loss", "first")
    row = found.agg(
        F.when(first != 0, of("recon_loss", "drop")).alias("drop"),
        yes(of("retrieval_entropy_div_logtopk", "last") < of("retrieval_entropy_div_logtopk", "first")).alias("retrieval_entropy_decreased"),
        yes(of("retrieval_top10_mass", "last") > 0.18).alias("retrieval_top10_over_0_18"),
    )
    enough = yes(F.col("drop") >= 0.05)
    return row.select(F.when(enough, "PASS").otherwise("REVIEW").alias("decision"), "drop", enough.alias("recon_drop_ge_5pct"), "retrieval_entropy_decreased", "retrieval_top10_over_0_18")


def averages_after(log: DataFrame, warmup: int) -> DataFrame:
    return log.where((F.col("step") >= warmup) & finite(F.col("value"))).groupBy("metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
