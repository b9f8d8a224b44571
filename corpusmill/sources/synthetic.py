"""Seeded rows for tests and smoke runs, made by expressions over a range: the same on every machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = ("rivers", "metals", "orchards", "bridges", "stars", "ferns", "markets", "clocks", "tides", "maps", "seeds", "lamps")
OBJECTS = ("brick", "paper clip", "bucket", "rope", "bottle", "blanket", "ladder", "spoon", "basket", "mirror", "wheel", "button", "candle", "box", "pipe", "net", "cup", "stick", "sheet", "coin")


def _pick(names: tuple[str, ...], *key: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.pmod(F.xxhash64(*key), F.lit(len(names))).cast("int"))


def documents(spark: SparkSession, name: str, domain: str, n: int, seed: int) -> DataFrame:
    """n documents of one source, several lines each; reasoning ones are worked sums."""
    rows = spark.range(n).withColumnRenamed("id", "ord")
    seeded = lambda i, salt: (F.lit(f"{name}:{seed}:{salt}"), F.col("ord"), i)
    number = lambda i, salt: F.pmod(F.xxhash64(*seeded(i, salt)), F.lit(97)) + 1
    if domain == "reasoning":
        line = lambda i: F.concat(F.lit("Step "), i.cast("string"), F.lit(": "), number(i, "a").cast("string"), F.lit(" and "), number(i, "b").cast("string"), F.lit(" together make "), (number(i, "a") + number(i, "b")).cast("string"), F.lit("."))
    else:
        line = lambda i: F.concat(F.lit("Note "), i.cast("string"), F.lit(" on "), _pick(TOPICS, *seeded(i, "t")), F.lit(" compares "), _pick(OBJECTS, *seeded(i, "o")), F.lit(" with "), _pick(TOPICS, *seeded(i, "u")), F.lit(" in "), number(i, "n").cast("string"), F.lit(" places."))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(24)), line), "\n")
    return rows.select(text.alias("text"), F.lit(name).alias("source"), F.lit(domain).alias("domain"), F.lit("mock").alias("subdomain"), "ord")


def divergent(spark: SparkSession, n: int, seed: int, lines: int = 48) -> DataFrame:
    """Lists of uses of an object; objects take turns."""
    thing = F.get(F.array(*[F.lit(o) for o in OBJECTS]), F.pmod(F.col("ord"), F.lit(len(OBJECTS))).cast("int"))
    line = lambda i: F.concat(i.cast("string"), F.lit(". use the "), F.col("object"), F.lit(" for "), _pick(TOPICS, F.lit(seed), F.col("ord"), i), F.lit(" and "), _pick(OBJECTS, F.lit(seed + 1), F.col("ord"), i))
    rows = spark.range(n).withColumnRenamed("id", "ord").withColumn("object", thing)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(lines)), line), "\n")
    return rows.select(text.alias("text"), F.lit("synthetic_divergent").alias("source"), F.lit("divergent").alias("domain"), F.lit("uses").alias("prompt_type"), "object", F.array(F.lit("list"), F.lit("uses")).alias("category_labels"), "ord")


def write_divergent(spark: SparkSession, path: str, n: int, seed: int) -> int:
    """divergent() as JSON lines; returns the number of rows."""
    from corpusmill.sources.io import write_jsonl

    return write_jsonl(divergent(spark, n, seed).drop("ord"), path)


def token_rows(spark: SparkSession, n: int, vocabulary: int, length: int, seed: int = 0) -> DataFrame:
    """Rows that take turns: hashed ids, an arithmetic progression, a repeated 8-gram."""
    room = vocabulary - 3
    at = F.sequence(F.lit(0), F.lit(length - 1))
    hashed = F.transform(at, lambda i: (F.lit(3) + F.pmod(F.xxhash64(F.lit(seed), F.col("ord"), i), F.lit(room))).cast("int"))
    stepped = F.transform(at, lambda i: F.pmod(F.col("ord") + i * (1 + F.pmod(F.col("ord"), F.lit(7))), F.lit(vocabulary)).cast("int"))
    stepped = F.transform(stepped, lambda x: F.when(x < 3, x + 3).otherwise(x))
    again = F.transform(at, lambda i: (F.lit(3) + F.pmod(F.xxhash64(F.lit(seed), F.col("ord"), i % 8), F.lit(room))).cast("int"))
    kind = F.pmod(F.col("ord"), F.lit(3))
    return spark.range(n).withColumnRenamed("id", "ord").select("ord", F.when(kind == 0, hashed).when(kind == 1, stepped).otherwise(again).alias("input_ids"))


def features(spark: SparkSession, samples: int, spans: int, width: int, span_size: int, length: int, seed: int = 0) -> DataFrame:
    """(sample_id, span_idx, z_query, z_fused) of normal deviates."""
    if spans * span_size > length:
        raise ValueError("the spans do not fit the sequence")
    rows = spark.range(samples).withColumnRenamed("id", "sample_id").withColumn("span_idx", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
    uniform = lambda i, salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("sample_id"), F.col("span_idx"), i), F.lit(1_000_003)) + 1) / 1_000_004.0
    normal = lambda salt: F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.sqrt(-2 * F.log(uniform(i, salt))) * F.cos(6.283185307179586 * uniform(i, salt + 1))).cast("float"))
    return rows.select("sample_id", "span_idx", normal(0).alias("z_query"), normal(2).alias("z_fused"))
