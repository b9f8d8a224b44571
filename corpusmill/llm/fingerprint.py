"""Canonical exact digests by DataFrame functions alone: compatibility composition, full case folding and folded white space,
then two seeds of xxhash64 as one 128-bit bucket, and a comparison of bytes inside equal buckets.

The fingerprint depends on the text only. Null text counts as empty. Two documents are alike (1.0) if bucket and canonical
bytes are equal, else 0.0: an exact digest knows nothing between. Repeated rows and ids keep their own rows; documents of one
id are ordered by text. A null id comes first. A very long text is a row like any other. An empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settled, text_or_empty

SEED = 0x5EED
#: Documents of a range of ids that one window handles, while there are fewer than MOST_RANGES ranges; their bounds, one number
#: each, are what the driver collects and sends with the plan (half a megabyte at most). Beyond that, ranges grow.
RANGE_ROWS = 4096
MOST_RANGES = 65_536


def canonical(text: Column) -> Column:
    """Equal for texts that differ in Unicode form, case or white space only. ICU's static methods run inside the JVM."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))  # folding can undo composition
    return F.trim(F.regexp_replace(again, r"[\s\x{85}\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(SEED), canon)), 16, "0")))


def alike(a: str, b: str, fa: str, fb: str) -> Column:
    """1.0 if buckets are equal and so are the canonical bytes of texts a and b, which are made again only where buckets are equal."""
    same = F.when(F.col(fa) == F.col(fb), canonical(F.col(a)).cast("binary") == canonical(F.col(b)).cast("binary")).otherwise(False)
    return F.when(same, 1.0).otherwise(0.0)


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, first_id, copies): each row with the least id of its group and the group's size.

    Grouping is by bucket and canonical bytes, combined on the map side, so a group with a third of all rows is a row for
    each task. Only ids and buckets are joined back; a bucket of more than one canonical text (a collision of 128 bits) is
    told apart by joining its texts too.
    """
    keyed = docs.select("doc_id", canonical(text_or_empty()).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    exact = keyed.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    buckets = exact.groupBy("fingerprint").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"), F.count("*").alias("texts"))
    buckets = settled(buckets, "buckets")  # texts move once, then only this
    found = keyed.select("doc_id", "fingerprint").join(buckets.where("texts = 1"), "fingerprint").select("doc_id", "fingerprint", "first_id", "copies")
    collided = buckets.where("texts > 1").select("fingerprint")
    if not collided.isEmpty():
        told = keyed.join(exact.join(collided, "fingerprint", "left_semi"), ["fingerprint", "canon"])
        found = found.unionByName(told.select("doc_id", "fingerprint", "first_id", "copies"))
    return found


def _bounds(docs: DataFrame) -> list[int]:
    """The least id of each range of about RANGE_ROWS documents; Spark's range partitioning samples them, only ids move."""
    ids = docs.select(_key().alias("k"))
    n = min(MOST_RANGES, max(1, -(-ids.count() // RANGE_ROWS)))
    rows = ids.repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).select("k").collect()
    return sorted({r["k"] for r in rows})


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))


def _numbers(levels: list) -> Column:
    """Nested lists of numbers as one literal, however many they are."""
    return F.from_json(F.lit(json.dumps(levels)), "array<array<bigint>>")


def _range_of(bounds: list[int], fan: int = 64) -> Column:
    """The number of bounds up to the id, less one: found level by level, so it looks at a few hundred bounds whatever their number."""
    levels = [bounds]
    while len(levels[-1]) > fan:
        levels.append(levels[-1][::fan])
    at = F.lit(0)
    for level in reversed(levels):
        chunks = [level] if level is levels[-1] else [level[i : i + fan] for i in range(0, len(level), fan)]
        here = F.lit(0) if len(chunks) == 1 else at
        inside = F.size(F.filter(F.get(_numbers(chunks), here), lambda b: b <= F.col("k")))
        at = here * fan + F.greatest(inside - 1, F.lit(0))
    return at


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, f_text, next_text, f_next_text) by ascending doc_id, the first after the last; f: fingerprints.

    Ranges of ids are windows of their own; the documents at a range's least id also stand at the end of the range before,
    so the text of each document moves once and no window holds the whole table.
    """
    bounds = _bounds(docs) or [0]
    n = len(bounds)
    rows = docs.select("doc_id", text_or_empty().alias("text"), _key().alias("k")).withColumn("r", _range_of(bounds)).withColumn("f_text", digest(canonical(F.col("text"))))
    own = F.struct(F.col("r").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(((F.col("r") + n - 1) % n).alias("r"), F.lit(True).alias("guest"))
    first = F.get(F.get(_numbers([bounds]), F.lit(0)), F.col("r")) == F.col("k")
    placed = rows.select("doc_id", "text", "f_text", "k", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("at"))
    by = Window.partitionBy("at.r").orderBy("at.guest", "k", "text")
    following = {f"next_{c}": F.lead(c).over(by) for c in ("text", "f_text")}
    return placed.withColumns(following).where(~F.col("at.guest")).select("doc_id", "text", "f_text", "next_text", F.col("next_f_text").alias("f_next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by as many first ones of the next text, or all it has."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, with the group of equal canonical texts that each document is in."""
    texts = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("f_edited", digest(canonical(F.col("edited"))))
    rows = texts.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), F.col("f_text").alias("fingerprint"), F.col("f_edited").alias("edited_fingerprint"),
        alike("text", "edited", "f_text", "f_edited").alias("near_edited"), alike("text", "next_text", "f_text", "f_next_text").alias("near_next"),
    )
    found = groups(docs).distinct().select(F.col("doc_id").alias("g_id"), F.col("fingerprint").alias("g_f"), "first_id", "copies")
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("fingerprint") == F.col("g_f")), "left").drop("g_id", "g_f")
