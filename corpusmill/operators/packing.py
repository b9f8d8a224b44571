"""Fixed-length token blocks by next fit in document order.

Next fit is a state machine over the tokens used in the open block, so it is a function from 0..length to 0..length for any
run of documents. Runs of RUN consecutive documents are summarised in parallel by that function (from every start at once),
the functions of FAN runs are composed, and so on up; starts are then chained down again, and each run is replayed from its
known start. No task ever holds more than a run of lengths or FAN functions. Runs are cut from dense numbers, so sparse orders
make no more runs than documents fill.

What was packed can be kept as the function's value at its end, so documents that come later are placed without reading
those before (`Packed`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import ids_hash
from corpusmill.sources.shared import settled

# Ids with a meaning.
PAD, UNK, BOS, EOS = 0, 1, 2, 3
RUN = 4096
#: Functions of runs that one task chains: 2 MB at 512 tokens each.
FAN = 256


def least_valid(length: int) -> int:
    return min(480, length)


def _summary(cost: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens used at the end, blocks opened) for every number of tokens used at the start."""
    used, opened = np.arange(length + 1), np.zeros(length + 1, np.int64)
    for c in cost:
        if c > length:  # a long document closes the block and stands alone
            opened += 1
            used[:] = 0
        else:
            new = (used == 0) | (used + c > length)
            opened += new
            used = np.where(new, c, used + c)
    return used, opened


def _replay(cost: np.ndarray, length: int, used: int) -> np.ndarray:
    """The number of blocks opened up to each document."""
    out, opened = np.zeros(len(cost), np.int64), 0
    for i, c in enumerate(cost.tolist()):
        if c > length:
            opened, used = opened + 1, 0
        elif used == 0 or used + c > length:
            opened, used = opened + 1, c
        else:
            used += c
        out[i] = opened
    return out


def _composed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The function of runs one after another."""
    used, opened = None, None
    for u, o in zip(pdf["used"], pdf["opened"], strict=True):
        u, o = np.asarray(u), np.asarray(o)
        used, opened = (u, o) if used is None else (u[used], opened + o[used])
    return used, opened


def _starts(functions: DataFrame, part: str, last: int, begin: dict[str, tuple[int, int]]) -> DataFrame:
    """(part, run, start, base): the tokens used and blocks opened before each run, from the runs' functions; the last run is `last`.

    FAN runs together are a function again, so a task holds FAN functions whatever the number of documents. begin: what
    stands before the first run of a part, (0, 0) where it is not named; there are as few parts as domains and splits.
    """

    def compose(key, pdf: pd.DataFrame) -> pd.DataFrame:
        used, opened = _composed(pdf.sort_values("run"))
        return pd.DataFrame({part: [key[0]], "run": [key[1]], "used": [used.tolist()], "opened": [opened.tolist()]})

    def chained(pdf: pd.DataFrame, used: int, base: int) -> pd.DataFrame:
        pdf, starts, bases = pdf.sort_values("run"), [], []
        for ends, opened in zip(pdf["used"], pdf["opened"], strict=True):
            starts.append(used)
            bases.append(base)
            used, base = int(ends[used]), base + int(opened[used])
        return pd.DataFrame({part: pdf[part], "run": pdf["run"], "start": starts, "base": bases})

    out = f"{part} string, run bigint, start bigint, base bigint"
    if last < FAN:
        return functions.groupBy(part).applyInPandas(lambda pdf: chained(pdf, *begin.get(pdf[part].iloc[0], (0, 0))), out)
    group = F.floor(F.col("run") / FAN).alias("group")
    upper = functions.groupBy(part, group).applyInPandas(compose, f"{part} string, run bigint, used array<bigint>, opened array<bigint>")
    known = _starts(settled(upper, "runs"), part, last // FAN, begin)

    def inside(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return chained(left, int(right["start"].iloc[0]), int(right["base"].iloc[0])) if len(left) else pd.DataFrame({part: [], "run": [], "start": [], "base": []})

    return functions.groupBy(part, group).cogroup(known.withColumnRenamed("run", "group").groupBy(part, "group")).applyInPandas(inside, out)


def numbered(rows: DataFrame, part: str, order: str, name: str = "n") -> DataFrame:
    """rows, written, with dense numbers from 0 by order in each part: ranges of orders are counted, then ranked each by itself.

    The counts are a row for each range and part; no window holds more than a range.
    """
    ranged = settled(rows.repartitionByRange(part, order).withColumn("__range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(part, "__range").count().select(part, "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy("__range", part).orderBy(order))
    return ranged.withColumn("__rank", rank).join(counts, [part, "__range"]).withColumn(name, F.col("__base") + F.col("__rank") - 1).drop("__base", "__rank", "__range")


def ends(placed: DataFrame, length: int, part: str = "domain") -> DataFrame:
    """(part, used, opened): tokens in the open block of each part, 0 where the last document stands alone, and blocks opened so far.

    From the last block's documents alone, so it is an aggregate over what assign() gave.
    """
    last = placed.groupBy(part).agg(F.max("block").alias("block"))
    inside = placed.join(last, [part, "block"]).groupBy(part, "block").agg(F.sum(F.col("n_tokens") + 2).alias("used"))
    return inside.select(part, F.when(F.col("used") > length, 0).otherwise(F.col("used")).alias("used"), F.col("block").alias("opened"))


def assign(sizes: DataFrame, length: int, part: str = "domain", order: str = "ord", after: DataFrame | None = None) -> DataFrame:
    """(part, order, n_tokens, block), written: sizes (part, order bigint, n_tokens) with the block each document opens or joins.

    Documents of no tokens are to be left out before. after: ends() of what was packed before; these documents go on from there.
    """
    runs = settled(numbered(sizes.select(part, order, "n_tokens"), part, order).withColumn("cost", F.col("n_tokens") + 2).withColumn("run", F.floor(F.col("n") / RUN)), "runs")

    def summarise(key, pdf: pd.DataFrame) -> pd.DataFrame:
        used, opened = _summary(pdf.sort_values("n")["cost"].to_numpy(), length)
        return pd.DataFrame({part: [key[0]], "run": [key[1]], "used": [used.tolist()], "opened": [opened.tolist()]})

    def replay(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({part: [], order: [], "n_tokens": [], "block": []})
        left = left.sort_values("n")
        block = _replay(left["cost"].to_numpy(), length, int(right["start"].iloc[0])) + int(right["base"].iloc[0])
        return pd.DataFrame({part: left[part], order: left[order], "n_tokens": left["n_tokens"], "block": block})

    functions = runs.groupBy(part, "run").applyInPandas(summarise, f"{part} string, run bigint, used array<bigint>, opened array<bigint>")
    last = runs.agg(F.max("run")).first()[0] or 0
    begin = {} if after is None else {r[part]: (r["used"], r["opened"]) for r in after.collect()}  # a row a part
    starts = _starts(settled(functions, "functions"), part, int(last), begin)
    placed = runs.groupBy(part, "run").cogroup(starts.groupBy(part, "run")).applyInPandas(replay, f"{part} string, {order} bigint, n_tokens bigint, block bigint")
    return settled(placed, "placed")


def chunks(ids: Column, length: int) -> Column:
    """The pieces of a long document, each between BOS and EOS."""
    body = length - 2
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(body)), lambda i: F.slice(ids, i + 1, body))
    return F.transform(cut, lambda c: F.concat(F.array(F.lit(BOS)), c, F.array(F.lit(EOS))))


def padded(ids: Column, length: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def long_chunks(tokens: DataFrame, length: int, valid: int | None = None) -> DataFrame:
    """(part columns..., chunk, input_ids, valid_tokens) of the documents that do not fit a block.

    Others are left out in the generator: a filter would be pushed below whatever makes the ids, which would make them twice.
    """
    valid = least_valid(length) if valid is None else valid
    long = F.when(F.size("ids") + 2 > length, chunks(F.col("ids"), length))
    rows = tokens.select(*[c for c in tokens.columns if c != "ids"], F.posexplode(long).alias("chunk", "c"))
    return rows.where(F.size("c") >= valid).withColumn("valid_tokens", F.size("c")).withColumn("input_ids", padded(F.col("c"), length)).drop("c")


def made(rows: DataFrame, placed: DataFrame, length: int, valid: int | None = None, part: str = "domain", order: str = "ord") -> DataFrame:
    """The blocks of documents (part, order, source, ids) that stand where `placed` says."""
    return formed(rows.select(part, order, "source", "ids").join(placed.select(part, order, "block"), [part, order]), length, valid, part, order)


def formed(full: DataFrame, length: int, valid: int | None = None, part: str = "domain", order: str = "ord") -> DataFrame:
    """The blocks of documents (part, order, source, ids, block)."""
    valid = least_valid(length) if valid is None else valid
    wrapped = F.concat(F.array(F.lit(BOS)), F.col("ids"), F.array(F.lit(EOS)))
    short = full.where(F.size("ids") + 2 <= length)
    # a block holds at most length / 3 documents
    blocks = short.groupBy(part, "block").agg(F.array_sort(F.collect_list(F.struct(order, "source", wrapped.alias("w")))).alias("docs"))
    body = F.flatten(F.transform("docs", lambda d: d["w"]))
    blocks = blocks.withColumn("c", body).where(F.size("c") >= valid)
    names = F.transform("docs", lambda d: F.coalesce(d["source"], F.lit("")))
    tally = F.transform(F.array_distinct(names), lambda s: F.struct(F.size(F.filter(names, lambda x: x == s)).alias("n"), (-F.array_position(names, s)).alias("first"), s.alias("s")))
    short_rows = blocks.select(part, "block", F.lit(0).alias("chunk"), padded(F.col("c"), length).alias("input_ids"), F.array_max(tally)["s"].alias("source"), F.size("c").alias("valid_tokens"), F.size("docs").alias("doc_count"))
    long_rows = long_chunks(full.where(F.size("ids") + 2 > length), length, valid).select(part, "block", "chunk", "input_ids", F.coalesce("source", F.lit("")).alias("source"), "valid_tokens", F.lit(1).alias("doc_count"))
    return short_rows.unionByName(long_rows).withColumn("block_hash", ids_hash(F.col("input_ids")))


def usable(tokens: DataFrame, part: str = "domain", order: str = "ord") -> DataFrame:
    """Documents that have tokens, written, with their number of tokens: made once, read twice. All are written, lest a filter makes ids twice."""
    rows = tokens.select(part, F.col(order).cast("bigint").alias(order), "source", "ids")
    return settled(rows.withColumn("n_tokens", F.size("ids").cast("bigint")), "tokens").where("n_tokens > 0")


def pack(tokens: DataFrame, length: int, valid: int | None = None, part: str = "domain", order: str = "ord") -> DataFrame:
    """(part, block, chunk, input_ids, source, valid_tokens, doc_count, block_hash) from tokens (part, order, source, ids).

    Blocks below `valid` tokens are given up with their documents. A block's source is its most common, of equals the first.
    """
    rows = usable(tokens, part, order)
    return made(rows, assign(rows, length, part, order), length, valid, part, order)


class Packed:
    """Packing that documents are added to: what is kept for each addition are its tokens and places, and the parts' ends.

    An addition reads the ends and its own documents, and of those before only the ones in the blocks that were still open.
    Its orders follow those before. `blocks` is what pack() gives for all documents together.
    """

    def __init__(self, length: int, valid: int | None = None, part: str = "domain", order: str = "ord"):
        self.how, self.length = {"part": part, "order": order}, length
        self.valid = valid
        self.closed: list[DataFrame] = []  # blocks that nothing joins any more
        self.ends: DataFrame | None = None
        self.open: DataFrame | None = None  # documents of the open blocks, with their places

    def add(self, tokens: DataFrame) -> DataFrame:
        """The blocks that this addition closed."""
        part, order = self.how.values()
        rows = usable(tokens, **self.how)
        placed = assign(rows, self.length, part, order, self.ends)
        own = rows.join(placed.select(part, order, "block"), [part, order])
        if self.open is not None:
            own = own.unionByName(self.open)
        new = ends(own, self.length, part)
        if self.ends is not None:  # parts without new documents keep their ends
            new = new.unionByName(self.ends.join(new, part, "left_anti"))
        self.ends = settled(new, "ends")
        still = F.col("used") > 0
        opened = self.ends.select(part, F.col("opened").alias("block"), "used").where(still).drop("used")
        own = settled(own, "own")
        self.open = settled(own.join(opened, [part, "block"], "left_semi").select(*own.columns), "open")
        done = own.join(opened, [part, "block"], "left_anti")
        out = settled(formed(done, self.length, self.valid, part, order), "blocks")
        self.closed.append(out)
        return out

    def blocks(self) -> DataFrame:
        part, order = self.how.values()
        out = formed(self.open, self.length, self.valid, part, order)
        for c in self.closed:
            out = out.unionByName(c)
        return out


def known_domains(docs: DataFrame, domains: list[str]) -> DataFrame:
    """Documents of the domains that blocks are made for; others and null go."""
    return docs.where(F.col("domain").isin(*domains))


def first_blocks(blocks: DataFrame, domains: list[str]) -> DataFrame:
    """Blocks whose hash no earlier block has, in the order of domains, block and chunk."""
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain"))
    keyed = blocks.withColumn("__at", F.struct(place.alias("p"), "block", "chunk"))
    first = keyed.groupBy("block_hash").agg(F.min("__at").alias("__at"))
    return keyed.join(first, ["block_hash", "__at"], "left_semi").drop("__at")


def mix(blocks: DataFrame, counts: dict[str, int], seed: int, key: str = "block_hash") -> DataFrame:
    """The first counts[domain] blocks of each domain in a seeded order; the order is the hash of seed and key."""
    shuffled = F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(key)).cast("binary"))
    ranked = blocks.withColumn("__n", F.row_number().over(Window.partitionBy("domain").orderBy(shuffled, key))).where(F.col("__n") <= max(counts.values(), default=0))
    limit = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    return ranked.where(F.col("__n") <= F.coalesce(limit[F.col("domain")], F.lit(0))).drop("__n")
