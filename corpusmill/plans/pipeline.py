"""From source tables to audited token blocks: collection with quotas and exclusion, tokens, blocks, audit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import allocation, audit, collection, dedup, formatting, packing
from corpusmill.sources import cache
from corpusmill.sources.io import write_jsonl
from corpusmill.sources.seen import Seen


@dataclass
class Config:
    """Sources: name: {domain, subdomain, default_weight, formatter or text fields}."""

    sources: dict[str, dict]
    train_blocks: int
    out: str
    length: int = 512
    vocabulary: int = 32_000
    seed: int = 1234
    valid: int | None = None
    shares: dict[str, float] = field(default_factory=lambda: dict(allocation.DOMAIN_SHARES))


class TooFew(RuntimeError):
    """A source or domain cannot fill its quota; says what was found."""


def _seen(earlier: Seen | DataFrame | None) -> Seen | None:
    """Rows of earlier splits as a table of their hashes."""
    if isinstance(earlier, DataFrame):
        rows, earlier = earlier, Seen(earlier.sparkSession)
        earlier.add(rows)
    return earlier


def _projected(raw: DataFrame, spec: dict, name: str) -> DataFrame:
    rows = formatting.stamped(formatting.selected_text(raw, spec), name, spec["domain"], spec.get("subdomain", ""))
    return rows.select("text", "source", "domain", "subdomain", "selected_text_field", "ord")


def _united(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole


def collect(raw: DataFrame, spec: dict, name: str, n: int, earlier: Seen | DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, reasons) of one source with an order `ord`: text selected, normalised, checked, not in earlier splits, first of its copies, at most n."""
    found = collection.collected(_projected(raw, spec, name), {name: n}, _seen(earlier))
    return found.docs, found.reasons.select("reason", "n")


def sample(raw: DataFrame, spec: dict, name: str, n: int, path: str, out: str, **cache_flags) -> tuple[int, dict]:
    """n usable documents of one source as JSON lines at `out`, through the cache at `path`; how many, and the cache's report."""
    docs, found = cache.through(raw.sparkSession, path, lambda: collect(raw, spec, name, n)[0], usable=lambda rows: dedup.first_usable(rows, n), **cache_flags)
    written = write_jsonl(docs, out)
    if written < n:
        raise TooFew(f"{name}: {written} of {n} documents")
    return written, found


def split_documents(tables: dict[str, DataFrame], cfg: Config, split: str, blocks: int, earlier: Seen | DataFrame | None) -> DataFrame:
    """The documents of one split, written by source; quotas by domain and source."""
    earlier, spark = _seen(earlier), next(iter(tables.values())).sparkSession
    wanted = {name: n for name, n in allocation.source_quotas(blocks, cfg.sources).items() if n and name in tables}
    path = lambda name: f"{cfg.out}/raw/{split}/{name}"
    new = {name: n for name, n in wanted.items() if not cache.exists(spark, path(name))}
    found = collection.collected(_united([_projected(tables[name], cfg.sources[name], name) for name in new]), new, earlier) if new else None
    parts = []
    for name, n in wanted.items():
        docs, report = cache.through(spark, path(name), lambda name=name: found.docs.where(F.col("source") == name), usable=lambda rows, n=n: dedup.first_usable(rows, n, earlier and earlier.table()))
        usable = docs.count() if report["cache_hit"] else report["records_loaded"]
        if usable < n:
            reasons = (found if name in new else collection.collected(_projected(tables[name], cfg.sources[name], name), {name: n}, earlier)).reasons
            raise TooFew(f"{split}/{name}: {usable} of {n} documents; { {r['reason']: r['n'] for r in reasons.where(F.col('source') == name).collect()} }")
        parts.append(docs)
    return _united(parts).withColumn("split", F.lit(split))


def split_blocks(docs: DataFrame, cfg: Config, blocks: int) -> DataFrame:
    """Packed blocks of one split: first of equal ones, the domain's count each, in a seeded order."""
    order = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(cfg.seed)), "text_hash").cast("binary")), 1, 7), 16, 10).cast("bigint")
    rows = packing.known_domains(docs, list(cfg.shares)).select("domain", "source", T.hash_tokens(F.col("text"), cfg.vocabulary).alias("ids"), order.alias("h"), "text_hash")
    ranked = packing.numbered(rows.withColumn("at", F.struct("h", "text_hash", "source")).drop("h", "text_hash"), "domain", "at", "ord").drop("at")
    packed = packing.first_blocks(packing.pack(ranked, cfg.length, cfg.valid), list(cfg.shares))
    counts = allocation.allocate(blocks, cfg.shares)
    return packing.mix(packed, counts, 12345 + blocks)


def run(tables: dict[str, DataFrame], cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks with split, audit, overlaps). Tables by source name; each needs an order `ord`. Written under cfg.out."""
    spark = next(iter(tables.values())).sparkSession
    earlier, out = Seen(spark), []
    for split, n in allocation.split_counts(cfg.train_blocks).items():
        docs = split_documents(tables, cfg, split, n, earlier)
        earlier.add(docs)
        path = f"{cfg.out}/blocks/{split}"
        split_blocks(docs, cfg, n).withColumn("split", F.lit(split)).write.mode("overwrite").parquet(path)
        out.append(spark.read.parquet(path))
    blocks = out[0].unionByName(out[1]).unionByName(out[2])
    return blocks, audit.audit(blocks, cfg.vocabulary, cfg.length, mix=cfg.shares, splits=("train", "val", "test")), dedup.common_keys(blocks, "block_hash", "split")
