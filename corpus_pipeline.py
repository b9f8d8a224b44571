"""From documents to packed sequences: quality, near-duplicates, personal data, mixture, packing.

Each stage is written as Parquet in the shared folder and read again as the next one's input. All stages take empty tables, null
ids and texts, rows that repeat, very long texts and other columns, whatever their names; each says what it makes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import minhash, mixing, packing, pii, quality
from corpusmill.llm.common import documents, settled


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for bad go. It is fitted on the labels of the documents given.

    Null and empty texts have the score of a difference of 0 and go or stay alike; rows that repeat go or stay alike.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of every class of near-duplicates stays, a row that repeats once.

    Null and empty texts are classes of their own, each id's; null is the least id. Two texts of one id are told apart.
    """
    return minhash.first_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become <KIND> and n_chars follows; every row stays. A null text stays null, with n_chars null."""
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them: words and sources are those of the rows given, null is a source, a null text has no words.

    Of rows that repeat with id, source and size each gets its even share; a row without words is taken as its source's target says.
    """
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every row in a sequence; a null or empty text is one piece, the end id. Repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("near_dedup", one_of_each_class),
    ("pii", without_personal_data),
    ("mixing", mixture),
    ("packing", sequences),
]

#: SQL cannot express trained dictionaries or the linear program; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
