"""The text measures, quality rules, tokens and chunks as functions of SQL.

    register(spark)
    spark.sql("SELECT doc_id, quality_reason(text, 'general') FROM documents")
    spark.sql("SELECT d.doc_id, c.* FROM tokens d, LATERAL token_chunks(d.ids, 512) c")

They are SQL functions, which Spark puts into the plan as expressions: pushdown and code generation work as if they were written out.
token_chunks is a table function of one row's ids; null has no chunks. Rows are left out by null ids rather than by a filter, which
would be pushed below what makes the ids and make them twice. Blocks of many documents are operators.packing's: a table function would
handle a whole domain in one task.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusmill.functions.text import BLANK, LINE_END, URL, WORD
from corpusmill.operators import quality as Q
from corpusmill.operators.packing import BOS, EOS, PAD

_RAW = lambda pattern: "r'" + pattern.replace("'", "\\x{27}") + "'"
#: (signature, result, body).
FUNCTIONS = (
    ("text_words(t STRING)", "ARRAY<STRING>", f"regexp_extract_all(t, {_RAW(WORD)}, 0)"),
    ("repeated_chars(t STRING)", "DOUBLE", r"CASE WHEN length(t) = 0 THEN 1.0D ELSE (length(t) - length(regexp_replace(t, r'(?s)(.)\1{2,}', r'$1$1'))) / length(t) END"),
    ("ngram_share(w ARRAY<STRING>)", "DOUBLE", "CASE WHEN size(w) < 10 THEN 0D ELSE 1D - size(array_distinct(transform(sequence(1, greatest(size(w) - 4, 1)), i -> xxhash64(slice(w, i, 5))))) / (size(w) - 4) END"),
    ("repeated_5grams(t STRING)", "DOUBLE", "ngram_share(text_words(lower(t)))"),
    ("url_rate(t STRING)", "DOUBLE", f"CASE WHEN length(t) = 0 THEN 0D ELSE regexp_count(t, {_RAW(URL)}) / greatest(1D, length(t) / 100) END"),
    # by what is left: regexp_count makes a string of each match
    ("solid_chars(t STRING)", "INT", f"length(regexp_replace(t, {_RAW('[' + BLANK + ']+')}, ''))"),
    # letters are no blanks, so there are none where nothing is solid
    ("alpha_share(t STRING)", "DOUBLE", r"(length(t) - length(regexp_replace(t, r'\p{L}+', ''))) / greatest(solid_chars(t), 1)"),
    ("longest_line(t STRING)", "INT", f"array_max(transform(split(t, {_RAW(LINE_END)}, -1), x -> length(x)))"),
    ("hash_tokens(t STRING)", "ARRAY<INT>", "transform(text_words(t), w -> CAST(4 + aggregate(split(w, ''), 2166136261L, (h, c) -> ((h ^ CAST(ascii(c) AS BIGINT)) * 16777619L) & 4294967295L) % 31996 AS INT))"),
    ("ids_hash(ids ARRAY<INT>)", "STRING", "sha1(CAST(array_join(CAST(ids AS ARRAY<STRING>), ',') AS BINARY))"),
    (
        "quality_reason(t STRING, domain STRING)", "STRING",
        f"CASE WHEN length(t) < {Q.LEAST_CHARS} THEN 'too_short_chars' WHEN repeated_chars(t) > {Q.MOST_REPEATED_CHARS}D THEN 'repeated_chars' WHEN repeated_5grams(t) > {Q.MOST_REPEATED_5GRAMS}D THEN 'repeated_5grams' "
        f"WHEN url_rate(t) > {Q.MOST_URLS}D THEN 'too_many_urls' WHEN coalesce(domain, 'general') <> 'reasoning' AND alpha_share(t) < {Q.LEAST_ALPHA}D THEN 'low_alpha_ratio' WHEN longest_line(t) > {Q.LONGEST_LINE} THEN 'very_long_line' ELSE 'ok' END",
    ),
    (
        "token_chunks(ids ARRAY<INT>, length INT)", "TABLE(chunk INT, input_ids ARRAY<INT>, valid_tokens INT)",
        f"SELECT pos, concat(array({BOS}), col, array({EOS}), array_repeat({PAD}, length - 2 - size(col))), size(col) + 2 FROM posexplode(CASE WHEN ids IS NOT NULL THEN transform(sequence(0, greatest(size(ids) - 1, 0), length - 2), i -> slice(ids, i + 1, length - 2)) END)",
    ),
)


def register(spark: SparkSession) -> None:
    """The functions, for this session; again replaces them."""
    for signature, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
