"""Checks of token blocks, as one aggregate a split, and the decision they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import ids_hash
from corpusmill.operators.packing import BOS, EOS, PAD, least_valid
from corpusmill.sources.shared import settled

# How much an audit forgives.
MOST_DUPLICATES = 0.01
MIX_TOLERANCE = 0.01


def tail_padded(ids: Column) -> Column:
    """No token stands after the first pad."""
    first = F.array_position(ids, F.lit(PAD))
    return (first == 0) | F.forall(F.slice(ids, F.greatest(first, F.lit(1)).cast("int"), F.greatest(F.size(ids), F.lit(1))), lambda x: x == PAD)


def measured(blocks: DataFrame, vocabulary: int, length: int) -> DataFrame:
    ids = F.col("input_ids")
    valid = F.size(F.filter(ids, lambda x: x != PAD))
    head = F.slice(ids, 1, F.greatest(valid, F.lit(1)))
    return blocks.withColumns({
        "bad_length": F.size(ids) != length, "invalid": F.size(F.filter(ids, lambda x: (x < 0) | (x >= vocabulary))), "bad_pad": ~tail_padded(ids), "valid": valid,
        "no_bos": F.get(ids, F.lit(0)) != BOS, "no_eos": ~F.array_contains(head, EOS), "hash": F.coalesce(F.col("block_hash") if "block_hash" in blocks.columns else F.lit(None).cast("string"), ids_hash(ids)),
    })


def _counts(measures: DataFrame, split: str) -> DataFrame:
    """(split, domain_counts, source_counts): maps from each value ("unknown" for null) to its blocks; a split has a few domains and sources.

    One aggregate by split, domain and source; the maps are made of its rows.
    """
    cells = measures.groupBy(split, "domain", "source").agg(F.count("*").alias("c"))
    sums = cells.groupingSets([[split, "domain"], [split, "source"]], split, "domain", "source").agg(F.sum("c").alias("n"), F.grouping_id().alias("g"))
    of = lambda name, g: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("g") == g, F.struct(F.col(name).alias("k"), F.col("n").alias("c")))))).alias(f"{name}_counts")
    return sums.groupBy(split).agg(of("domain", 1), of("source", 2))


def audit(blocks: DataFrame, vocabulary: int, length: int, split: str = "split", mix: dict[str, float] | None = None, mixed: tuple[str, ...] = ("train",), splits: tuple[str, ...] = ()) -> DataFrame:
    """One row a split: counts, the duplicate ratio, domains and sources, and the reasons that block it.

    The shares of `mix` are held against the splits named in `mixed`. A split named in `splits` without any block is blocked as empty.
    """
    yes = lambda c: F.count_if(F.col(c))
    name = lambda c: (F.coalesce(F.col(c), F.lit("unknown")) if c in blocks.columns else F.lit("unknown")).alias(c)
    # blocks are made once; what the checks need of them is a few numbers and a hash
    measures = settled(measured(blocks, vocabulary, length).select(split, name("domain"), name("source"), "bad_length", "invalid", "bad_pad", "valid", "no_bos", "no_eos", "hash"), "measures")
    sums = measures.groupBy(split).agg(
        F.count("*").alias("num_blocks"), (F.count("*") * length).alias("num_tokens"), yes("bad_length").alias("bad_length"), F.sum("invalid").alias("invalid_token_count"), yes("bad_pad").alias("bad_pad"),
        F.min("valid").alias("min_valid_tokens"), F.count_if(F.col("valid") > 1).alias("labelled"), yes("no_bos").alias("missing_bos"), yes("no_eos").alias("missing_eos"), F.countDistinct("hash").alias("distinct"),
    )
    other = _counts(measures, split).withColumnRenamed(split, "__split")
    sums = sums.join(other, F.col(split).eqNullSafe(F.col("__split"))).drop("__split")  # a row a split
    if splits:
        named = blocks.sparkSession.createDataFrame([(s,) for s in splits], f"{split} string")
        sums = sums.join(named, split, "full")
    empty = F.col("num_blocks").isNull()
    sums = sums.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("num_blocks", "num_tokens", "bad_length", "invalid_token_count", "bad_pad", "min_valid_tokens", "labelled", "missing_bos", "missing_eos", "distinct")})
    n = F.greatest(F.col("num_blocks"), F.lit(1))
    ratio = F.when(F.col("num_blocks") > 0, 1 - F.col("distinct") / n).otherwise(0.0)
    few = lambda share: F.greatest(F.lit(1), F.floor(n * share))
    found = [
        ("empty", empty | (F.col("num_blocks") == 0)), ("wrong_length", F.col("bad_length") > 0), ("invalid_tokens", F.col("invalid_token_count") > 0), ("padding", F.col("bad_pad") > 0), ("no_labels", F.col("labelled") == 0),
        ("min_valid", (F.col("num_blocks") > 0) & (F.col("min_valid_tokens") < least_valid(length))), ("bos", F.col("missing_bos") > few(0.01)), ("eos", F.col("missing_eos") > few(0.10)), ("duplicates", ratio > MOST_DUPLICATES),
    ]
    for domain, share in (mix or {}).items():
        actual = F.coalesce(F.col("domain_counts")[domain], F.lit(0)) / n
        found.append((f"mix:{domain}", F.col(split).isin(*mixed) & (F.col("num_blocks") > 0) & (F.abs(actual - share) > MIX_TOLERANCE)))
    reasons = F.filter(F.array(*[F.when(test, name) for name, test in found]), lambda x: x.isNotNull())
    shares = F.transform_values("domain_counts", lambda _, c: c / n)
    return sums.withColumn("mix_ratio", shares).withColumn("duplicate_block_ratio", ratio).withColumn("blocked_reasons", F.array_join(reasons, ",")).withColumn("decision", F.when(F.size(reasons) == 0, "PASS").otherwise("BLOCKED"))


def mix_shares(blocks: DataFrame, expected: dict[str, float]) -> DataFrame:
    """(domain, n, share, expected, within) over the domains found or expected."""
    session = blocks.sparkSession
    want = session.createDataFrame([(k, float(v)) for k, v in expected.items()], "domain string, expected double")
    counts = blocks.groupBy("domain").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    rows = counts.join(F.broadcast(want), "domain", "full").crossJoin(F.broadcast(total))
    share = F.coalesce("n", F.lit(0)) / F.col("total")
    return rows.select("domain", F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"), "expected", (F.col("expected").isNull() | (F.abs(share - F.col("expected")) <= MIX_TOLERANCE)).alias("within"))


def id_range(rows: DataFrame, first: int, order: str, ids: str = "ids") -> DataFrame:
    """Least and greatest id, negative ids, rows and ids of the first rows by order."""
    return ids_measured(rows.orderBy(order).limit(first), ids)


def ids_measured(head: DataFrame, ids: str = "ids") -> DataFrame:
    return head.agg(F.min(F.array_min(ids)).alias("least"), F.max(F.array_max(ids)).alias("greatest"), F.sum(F.size(F.filter(ids, lambda x: x < 0))).alias("negative"), F.count("*").alias("rows"), F.sum(F.size(ids)).alias("ids"))


def check_vocabulary(rows: DataFrame, vocabulary: int, first: int = 256, order: str = "ord") -> None:
    r = id_range(rows, first, order).first()
    if r["rows"] and (r["negative"] or (r["greatest"] or 0) >= vocabulary):
        raise ValueError(f"ids from {r['least']} to {r['greatest']} do not fit a vocabulary of {vocabulary}")
