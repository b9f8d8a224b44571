"""The queries of this subpackage, each over its whole table with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, fingerprint, media, minhash, mixing, packing, phrases, pii, preference, quality, repeats, search, secrets
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secrets": lambda spark, d: secrets.report(documents(spark, d)),
        "op2_packing": lambda spark, d: packing.pack(documents(spark, d)),
        "op3_minhash": lambda spark, d: minhash.report(documents(spark, d)),
        "op4_search": lambda spark, d: search.report(documents(spark, d)),
        "op5_preference": lambda spark, d: preference.report(spark.read.parquet(f"{d}/conversations.parquet")),
        "op6_repeats": lambda spark, d: repeats.report(documents(spark, d)),
        "op7_quality": lambda spark, d: quality.report(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op8_fingerprint": lambda spark, d: fingerprint.report(documents(spark, d)),
        "op9_mixing": lambda spark, d: mixing.report(documents(spark, d)),
        "op10_pii": lambda spark, d: pii.report(documents(spark, d)),
        "op11_codes": lambda spark, d: codes.report(spark.read.parquet(f"{d}/embeddings.parquet")),
        "op12_phrases": lambda spark, d: phrases.report(documents(spark, d)),
        "op13_media": lambda spark, d: media.report(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secrets": secrets.sql(),
        "op4_search": search.SQL,
        "op5_preference": preference.SQL,
        "op6_repeats": repeats.SQL,
        "op11_codes": codes.SQL,
        "op12_phrases": phrases.sql(),
    }
