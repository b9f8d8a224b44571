"""Rule-based quality: the first rule that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# The thresholds of the rules, in their order.
LEAST_CHARS = 128
MOST_REPEATED_CHARS = 0.20
MOST_REPEATED_5GRAMS = 0.30
MOST_URLS = 0.25
LEAST_ALPHA = 0.35
LONGEST_LINE = 4000


def reason(text: Column, domain: Column) -> Column:
    """Cheap rules guard the dear ones: nothing is measured on texts that are too short."""
    return (
        F.when(F.length(text) < LEAST_CHARS, "too_short_chars")
        .when(T.repeated_chars(text) > MOST_REPEATED_CHARS, "repeated_chars")
        .when(T.repeated_ngrams(text) > MOST_REPEATED_5GRAMS, "repeated_5grams")
        .when(T.url_rate(text) > MOST_URLS, "too_many_urls")
        .when((F.coalesce(domain, F.lit("general")) != "reasoning") & (T.alpha_share(text) < LEAST_ALPHA), "low_alpha_ratio")
        .when(T.longest_line(text) > LONGEST_LINE, "very_long_line")
        .otherwise("ok")
    )


def with_reason(docs: DataFrame, mock: bool = False) -> DataFrame:
    """mock: rows made for tests are kept (mock_kept) whatever they hold, if they are long enough."""
    domain = F.col("domain") if "domain" in docs.columns else F.lit("general")
    text = F.coalesce("text", F.lit(""))
    found = reason(text, domain)
    return docs.withColumn("reason", F.when(F.length(text) >= LEAST_CHARS, "mock_kept").otherwise("too_short_chars") if mock else found)


def keep_ok(docs: DataFrame) -> DataFrame:
    return with_reason(docs).where("reason = 'ok'").drop("reason")


def reasons(docs: DataFrame, mock: bool = False) -> DataFrame:
    """How many rows each reason has, over all rows."""
    return with_reason(docs, mock).groupBy("reason").agg(F.count("*").alias("n"))


def measures(docs: DataFrame) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.length(t).alias("chars"), T.repeated_chars(t).alias("repeated_chars"), T.repeated_ngrams(t).alias("repeated_5grams"), T.alpha_share(t).alias("alpha"), T.url_rate(t).alias("urls"), T.longest_line(t).alias("longest_line"),
    )
