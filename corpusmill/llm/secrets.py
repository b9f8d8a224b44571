"""Secret scans over an incremental ledger of blobs, by DataFrame functions alone.

Every version of every path is addressed by its content (SHA-256). The ledger is a table of rows (blob, rules, spans): which rule
versions a scan has applied to a blob and what they found. Only (blob, rule version) pairs that the ledger has not seen are
scanned, each distinct blob once however many paths hold it; what is new is appended, and the findings are joined back to all paths.

Equal texts meet in one blob before the scan by a grouping that combines on the map side, so a group of copies with a third
of all rows costs no more than its share of one row for each task; the join back carries an id and a hash for each path and
adaptive execution splits it where a blob has very many. Of the ledger, only rows of the blobs at hand go beyond a semi-join of hashes, and its spans are read for them alone.
Pairs that the ledger has twice (two scans at once) give each span once; what it has of other rules or versions stays unused.

Null text counts as empty; an empty table gives an empty table; repeated rows are repeated paths; other columns are ignored. A
very long text is one row, its time is linear in its length and its findings, which meet again in one row of the ledger.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import joined, shared_dir, text_or_empty


@dataclass(frozen=True)
class Rule:
    """pattern: Java syntax, its matches are leftmost and do not overlap. A match of which group `measured` is shorter than `least` is dropped."""

    kind: str
    version: int
    pattern: str
    measured: int = 0
    least: int = 1


#: The base rules in their listed order. Where the measured group is a whole maximal run, the least length stands in the
#: pattern itself: it then matches the same runs and skips the many short ones.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: What this scanner adds: formats that carry their own mark.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
SPAN = "struct<rule:string,start:bigint,end:bigint>"
LEDGER = f"blob string, rules array<string>, spans array<{SPAN}>"
FINDING = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
_PLACE = "array<struct<rank:int,i:int,gap:int,hit:int,measured:int>>"


def name(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def gaps_and_hits(text: Column, rule: Rule, rank: int) -> Column:
    """For each match the length of what stands before it (since the last), its own, and that of the measured group."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.measured)) if rule.measured else hits
    found = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), measured.alias("measured"))
    struct = lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), *[F.length(x[c]).alias(c) for c in ("gap", "hit", "measured")])
    return F.filter(F.transform(found, struct), lambda x: x["hit"].isNotNull()).cast(_PLACE)  # the last gap has no match after it


def blobs(versions: DataFrame, text: str = "text") -> DataFrame:
    """(blob, text): each distinct text once."""
    return versions.select(F.sha2(text_or_empty(text), 256).alias("blob"), text_or_empty(text).alias("text")).distinct()


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, rules, spans): one for each blob of versions that `ledger` has not seen under all rules; spans may be empty."""
    todo = blobs(versions)
    names = F.array(*[F.lit(name(r)) for r in rules])
    if ledger is None:
        lacking = todo.withColumn("rules", names)
    else:
        own = versions.select(F.sha2(text_or_empty(), 256).alias("blob")).distinct()
        have = ledger.join(own, "blob", "left_semi").select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin(*[name(r) for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("have"))  # one entry for each rule at most
        lacking = todo.join(have, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("have", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    none = F.array().cast(_PLACE)
    found = [F.when(F.array_contains("rules", name(r)) & F.col("text").rlike(r.pattern), gaps_and_hits(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    # a row for each match, and one for each blob without any
    rows = lacking.select("blob", "rules", F.explode_outer(F.flatten(F.array(*found))).alias("x")).select("blob", "rules", "x.*").repartition("blob")
    by = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("hit")).over(by)
    rule = F.get(names, F.col("rank"))
    least = F.get(F.array(*[F.lit(r.least) for r in rules]), F.col("rank"))
    span = F.when(F.col("measured") >= least, F.struct(rule.alias("rule"), (F.col("end") - F.col("hit")).alias("start"), F.col("end").alias("end")))
    return rows.withColumn("end", end).groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(span).cast(f"array<{SPAN}>").alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none where nothing has been written yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at `path` has not seen and appends it; returns the whole ledger. A scan that fails appends nothing."""
    spark = versions.sparkSession
    scan(versions, rules, read_ledger(spark, path)).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, paths: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(paths..., blob, spans): all spans of each row of versions by start and rule, from the ledger."""
    keyed = versions.select(*paths, F.sha2(text_or_empty(), 256).alias("blob"))
    ranks = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(name(r)), F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind")))])
    current = F.filter("spans", lambda s: s["rule"].isin(*[name(r) for r in rules]))
    known = ledger.where(F.size("spans") > 0).join(keyed.select("blob").distinct(), "blob", "left_semi")
    once = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(current))).alias("spans"))
    ordered = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), ranks[s["rule"]]["rank"].alias("rank"), ranks[s["rule"]]["kind"].alias("kind"), s["end"].alias("end"))).cast(FINDING)
    hits = once.select("blob", F.array_sort(ordered).alias("spans"))
    return keyed.join(hits, "blob", "left").select(*paths, "blob", F.coalesce("spans", F.array().cast(FINDING)).alias("spans"))


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest columns of the contract, from what findings() returns, after the ledger at `path` (else a new one) has been updated."""
    path = path or f"{shared_dir(docs.sparkSession)}/secrets-ledger-{uuid.uuid4().hex}"
    kinds = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return findings(docs, update_ledger(docs, path)).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "blob",
    )


def _rule_sql(r: Rule, rank: int) -> str:
    p = r.pattern.replace("'", "''")
    measured = f"length(regexp_extract(h[i], '{p}', {r.measured}))" if r.measured else "length(h[i])"
    return f"""
  SELECT doc_id, n, {rank} AS rank, '{r.kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS start, length(h[i]) AS size
  FROM (SELECT doc_id, n, g, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, n, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS h FROM d WHERE regexp_matches(text, '{p}')))
  WHERE {measured} >= {r.least}"""


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB's twin of report()."""
    span = "kind || ':' || start || ':' || (start + size)"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
f AS ({" UNION ALL ".join(_rule_sql(r, i) for i, r in enumerate(rules))}),
s AS (SELECT n, {counts}, string_agg({span}, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg({span}, ',' ORDER BY start, rank) AS spans FROM f GROUP BY n)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob FROM d LEFT JOIN s USING (n)"""
