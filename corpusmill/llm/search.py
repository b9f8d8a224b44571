"""Exact BM25 top-k: an inverted index with block maxima for each shard, block-max WAND inside it, merged by global statistics.

Documents are dealt to shards of about SHARD_DOCS, of about SHARD_WORDS where texts are long, by a hash of id and text. A shard orders its documents so that like ones share
a block of BLOCK documents, the same blocks for all terms, and keeps each term's largest contribution to each block. As blocks are
the same for all terms, a block is a pivot if the maxima of the query's terms in it add up to the threshold (the k-th score so
far). These sums are taken for all blocks of a shard at once, which reads every block entry of the query's terms but no posting; a
block that is no pivot is never scored. A query that knows no score yet scores those of the greatest bounds first and then the pivots that are left.
Queries are searched some at a time, those that are alike together: bounds and scores are sums of products, of which those of a term that many of them and many
documents have are a matrix product, others are added one by one; blocks that are a pivot of none of them are left out. Each shard returns k rows for a query, and
the k best of all are exact because document frequencies, their number and their mean length are those of the whole table.

Shards are searched in waves, each GROWTH times as many as before: a query takes the threshold that it reached in all earlier
shards along, so the more there are, the less of each is scored. Queries are rows too and may grow with the corpus: their terms
are sent to every shard, never broadcast or collected, which is queries times shards rows; more than QUERIES meet a copy of the
shard in as many tasks as it takes, fewer where a wave has fewer shards than there are cores. All waves together thus send the square of the corpus, so a wave has no more shards than
send about SENT of the index's terms: what lies on disk at once grows as the input. Words are taken as they stand. Scores are rounded to six digits; ties go to the smaller doc_id (null
first). Null and empty texts match nothing and ask nothing; a very long text is a row, and its shard has few others. Equal texts
are searched for once and answer all rows that ask them, equal rows once; rows of one id with different texts are queries of their own; equal rows are documents each. Empty tables
give an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from math import gcd

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.sources.shared import settled_in_batches

from .common import NULL_ID, grouped, settled, text_or_empty

K1, B = 1.2, 0.75
TOP = 10
SHARD_DOCS, SHARD_WORDS = 16_384, 8 << 20
BLOCK = 128
GROWTH, QUERIES, SENT = 6, 65_536, 0.5
#: Queries for which another copy of a shard is worth while where cores would be idle, and what share of all shards the copies of a wave may be.
COPY, COPIES = 2048, 0.07
#: Documents are dealt to so many places; shards, and folders of about FOLDER shards where their terms are kept, are ranges of them.
PLACES, FOLDER = 1 << 20, 8
#: Blocks that are scored first where no score is known yet: those of the greatest bounds.
FIRST = 8
#: Queries that are searched together, blocks that are scored together, and multiplications of a matrix product in the time of adding one value.
ASKED, WIDE, PRODUCT = 256, 16, 200
#: Rows with their texts or terms that are sent to Python at a time.
BATCH_ROWS = 1024
#: Postings that are worked out at a time while an index is built.
SLICE = 1 << 18


def terms(docs: DataFrame) -> DataFrame:
    """(id, d, size, terms array<bigint>, counts array<int>): hashed distinct words of each row; size counts repeats."""

    def run(batches):
        for b in batches:
            for part in grouped(b, 2):
                found = [Counter(t.split()) for t in part.column(2).to_pylist()]
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                flat = pa.array(np.fromiter((xxhash.xxh3_64_intdigest(w) for c in found for w in c), np.uint64).astype(np.int64))
                counts = pa.array(np.fromiter((n for c in found for n in c.values()), np.int32))
                sizes = pa.array([sum(c.values()) for c in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes, pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, counts)], ["id", "d", "size", "terms", "counts"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_or_empty()).alias("d"), text_or_empty().cast("binary").alias("body"))
    return rows.mapInArrow(run, "id bigint, d bigint, size bigint, terms array<bigint>, counts array<int>")


class Shard:
    """The index of some documents: ids and sizes one each, how many distinct terms each has, those one after another, their counts."""

    def __init__(self, parts: list[np.ndarray], mean: float):
        """Empties the list `parts`: terms and counts go as soon as they have been taken in."""
        ids, sizes, lengths, terms, counts = parts
        parts.clear()
        n = len(ids)
        first = np.cumsum(lengths) - lengths
        some = np.flatnonzero(lengths)
        lead = np.zeros(n, np.int64)
        if len(some):  # the least of a document's most frequent terms
            most = np.repeat(np.maximum.reduceat(counts, first[some]), lengths[some])
            lead[some] = np.minimum.reduceat(np.where(counts == most, terms, np.iinfo(np.int64).max), first[some])
            del most
        order = np.lexsort((ids, sizes, lead))
        self.ids, self.blocks = ids[order], -(-n // BLOCK)
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        names = terms.copy()  # sorted in place: a sort of places would hold all terms twice more
        names.sort()
        names = names[np.diff(names, prepend=~names[:1]) != 0]
        term = np.empty(len(terms), np.int32)
        for i in range(0, len(terms), SLICE):
            term[i : i + SLICE] = np.searchsorted(names, terms[i : i + SLICE])
        del terms
        doc = np.repeat(place, lengths)
        # postings by term and document: one sort of packed numbers where they fit, else of indices
        tf_bits, doc_bits = int(counts.max(initial=1)).bit_length(), max(1, n).bit_length()
        if len(names).bit_length() + tf_bits + doc_bits < 63:
            packed = term.astype(np.int64)
            del term
            packed <<= doc_bits
            packed |= doc
            packed <<= tf_bits
            packed |= counts
            del doc, counts
            packed.sort()
            tf = (packed & ((1 << tf_bits) - 1)).astype(np.min_scalar_type((1 << tf_bits) - 1))
            packed >>= tf_bits
            doc = (packed & ((1 << doc_bits) - 1)).astype(np.int32)
            packed >>= doc_bits
            term = packed.astype(np.int32)
            del packed
        else:
            by = np.lexsort((doc, term))
            term, doc, tf = term[by], doc[by], counts[by]
            del by, counts
        norm = K1 * (1 - B + B * sizes[order].astype(float) / max(mean, 1e-9))
        self.doc, self.part = doc, np.empty(len(doc))
        for i in range(0, len(doc), SLICE):
            self.part[i : i + SLICE] = _part(tf[i : i + SLICE], norm[doc[i : i + SLICE]])
        del tf
        # one entry for each term and block: where its postings start, how many they are (a block's documents at most), a bound of their largest part
        block = (doc // BLOCK).astype(np.uint16 if self.blocks < 1 << 16 else np.int32)
        change = np.ones(len(term), bool)
        np.logical_or(term[1:] != term[:-1], block[1:] != block[:-1], out=change[1:])
        new = np.flatnonzero(change)
        del change
        self.most = np.zeros(0, np.float32)
        if len(new):
            self.most = np.nextafter(np.maximum.reduceat(self.part, new).astype(np.float32), np.float32(np.inf))
        self.start = new.astype(np.int32 if len(term) < 1 << 31 else np.int64)
        self.count = np.diff(new, append=len(term)).astype(np.uint8 if BLOCK < 1 << 8 else np.int32)
        self.block, self.names = block[new], names
        self.at = np.searchsorted(term[new], np.arange(len(names) + 1, dtype=np.int32)).astype(self.start.dtype)
        self.scored = self.skipped = 0  # blocks

    def top(self, wanted: np.ndarray, weight: np.ndarray, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores rounded to six digits) of the k best documents that have one of the terms and reach a score of `least`."""
        return self.best(np.zeros(len(wanted), np.int64), wanted, weight, np.array([least]), k)[1:]

    def best(self, who: np.ndarray, wanted: np.ndarray, weight: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) as top() has them for each of some queries, numbered from 0; `who` asks for a term, in ascending order."""
        asked, none = len(least), (np.zeros(0, np.int64), self.ids[:0], np.zeros(0))
        if not len(self.names) or not len(wanted):
            return none
        terms, column = np.unique(wanted, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.names, terms), len(self.names) - 1)
        has = self.names[slot] == terms
        here = has[column]
        slot, column, who, w = slot[has], (np.cumsum(has) - 1)[column[here]], who[here], weight[here]
        entries = _ranges(self.at[slot].astype(np.int64), (self.at[slot + 1] - self.at[slot]).astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(self.at[slot + 1] - self.at[slot], dtype=np.int64)])
        left = _product(who, column, w, asked, self.blocks, self.block.take(entries), self.most.take(entries), ends)
        threshold = np.maximum(0.0, least - 1e-6)
        found, seen = none, int(np.count_nonzero(left))
        # a query that knows no score yet starts with the blocks of its greatest bounds; then, or else at once, come all pivots
        pivots = left > threshold[:, None]
        if self.blocks > FIRST and not least.all():
            new = np.flatnonzero(least <= 0)
            greatest = np.zeros((len(new), self.blocks), bool)
            np.put_along_axis(greatest, np.argpartition(-left[new], FIRST, axis=1)[:, :FIRST], True, axis=1)
            pivots[new] &= greatest
        while pivots.any():
            self.scored += (scored := int(np.count_nonzero(pivots)))
            seen -= scored
            left[pivots] = 0
            found = tuple(np.concatenate(x) for x in zip(found, self._scored(pivots, threshold, who, column, w, entries, ends, k), strict=True))
            # by more than rounding below the k-th score: such a document or block cannot enter
            by = np.lexsort((-found[2], found[0]))
            q, score = found[0][by], found[2][by]
            start = np.searchsorted(q, np.arange(asked))
            full = np.flatnonzero(np.searchsorted(q, np.arange(asked), side="right") - start >= k)
            threshold[full] = np.maximum(threshold[full], score[start[full] + k - 1] - 1e-6)
            keep = found[2] >= threshold[found[0]]
            found = tuple(x[keep] for x in found)
            pivots = left > threshold[:, None]
        self.skipped += seen
        q, ids, scores = found[0], found[1], np.round(found[2], 6)
        by = np.lexsort((ids, -scores, q))
        q, ids, scores = q[by], ids[by], scores[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < k], ids[rank < k], scores[rank < k]

    def _scored(self, pivots: np.ndarray, threshold: np.ndarray, who: np.ndarray, column: np.ndarray, w: np.ndarray, entries: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of documents above the threshold in each query's pivots; where they are many, the k best and ties with them."""
        some = np.flatnonzero(pivots.any(axis=1))
        number = np.full(len(pivots), -1)
        number[some] = np.arange(len(some))
        mine = number[who] >= 0
        who, column, w, pivots, threshold = number[who[mine]], column[mine], w[mine], pivots[some], threshold[some]
        blocks, out = np.flatnonzero(pivots.any(axis=0)), []
        for at in range(0, len(blocks), WIDE):
            open_ = blocks[at : at + WIDE]
            place = np.full(self.blocks, -1, np.int32)
            place[open_] = np.arange(len(open_))
            place = place.take(self.block.take(entries))
            kept = np.flatnonzero(place >= 0)
            n = self.count[entries[kept]].astype(np.int64)
            postings = _ranges(self.start[entries[kept]].astype(np.int64), n)
            docs = self.doc.take(postings)
            docs %= BLOCK
            docs += np.repeat(place[kept] * np.int32(BLOCK), n)
            until = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(kept, ends)]
            total = _product(who, column, w, len(some), len(open_) * BLOCK, docs, self.part.take(postings), until)
            total.reshape(len(some), len(open_), BLOCK)[~pivots[:, open_]] = 0  # a block is scored for those whose pivot it is
            hits = np.flatnonzero((total > threshold[:, None]).ravel())
            q, scores = hits // total.shape[1], total.take(hits)
            many = np.bincount(q, minlength=len(some))
            if (many > 4 * k).any():
                enough = np.zeros(len(some))
                for i in np.flatnonzero(many > 4 * k):
                    enough[i] = np.partition(total[i], -k)[-k] - 1e-6
                keep = scores >= enough[q]
                hits, q, scores = hits[keep], q[keep], scores[keep]
            x = hits % total.shape[1]
            out.append((some[q], self.ids[open_[x // BLOCK] * BLOCK + x % BLOCK], scores))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _product(who: np.ndarray, column: np.ndarray, w: np.ndarray, asked: int, width: int, places: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """asked x width: each `who` adds, w times, the values of its `column` at their places; column c has those from ends[c] to ends[c + 1].

    A column that many ask for and that has many values is a row of a matrix product; others are added value by value.
    """
    n = np.diff(ends)
    m = np.bincount(column, minlength=len(n))
    out = np.zeros((asked, width))
    dense = np.flatnonzero((m > 0) & (m * n > n + width * (1 / 16 + asked / PRODUCT)))
    row = np.full(len(n), -1)
    row[dense] = np.arange(len(dense))
    pairs = row[column]
    step = max(1, SLICE * 8 // max(1, width))
    for low in range(0, len(dense), step):
        some = dense[low : low + step]
        matrix, weights = np.zeros((len(some), width)), np.zeros((asked, len(some)))
        at = _ranges(ends[some], n[some])
        matrix.ravel()[np.repeat(np.arange(len(some)) * width, n[some]) + places.take(at)] = values.take(at)
        here = np.flatnonzero((pairs >= low) & (pairs < low + step))
        weights[who[here], pairs[here] - low] = w[here]
        out += weights @ matrix
    rest = np.flatnonzero((pairs < 0) & (n[column] > 0))
    who, start, w, n = who[rest], ends[column[rest]], w[rest], n[column[rest]]
    until = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(who, np.arange(asked + 1))]  # values of each query
    first, low = np.searchsorted(who, np.arange(asked + 1)), 0
    while low < asked:  # some queries at a time
        high = max(low + 1, int(np.searchsorted(until, until[low] + SLICE // 2, side="right")) - 1)
        if until[high] > until[low]:
            these = slice(first[low], first[high])
            at = _ranges(start[these], n[these])
            to = np.repeat((who[these] - low) * width, n[these])
            to += places.take(at)
            much = np.repeat(w[these], n[these])
            much *= values.take(at)
            out[low:high] += np.bincount(to, much, (high - low) * width).reshape(-1, width)
        low = high
    return out


def _part(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term adds to documents, but for its weight."""
    tf = tf.astype(float)
    return tf * (K1 + 1) / (tf + norm)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges of n from start, one after another."""
    out = np.repeat(start - np.cumsum(n) + n, n)
    out += np.arange(len(out))
    return out


def shards_at_once(terms: int, asked: int, shards: int, parts: int) -> int:
    """How many shards a wave may have: each is sent once for every part of the queries, and all terms that are asked for go to it."""
    return max(1, int(SENT * terms / max(1.0, parts * terms / shards + 1.25 * asked)))  # a term of a query comes with its frequency


def search(docs: DataFrame, queries: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best rows of docs for each row of docs that `queries` (over id) selects."""
    total = docs.count()
    if not total:
        return docs.sparkSession.createDataFrame([], "query_id bigint, rank int, doc_id bigint, score double")
    seen, folders, cores = Observation(), -(-total // (FOLDER * SHARD_DOCS)), docs.sparkSession.sparkContext.defaultParallelism
    place = F.pmod(F.xxhash64("id", "d"), F.lit(PLACES))
    rows = terms(docs).observe(seen, F.avg("size").alias("mean"), F.sum(F.size("terms")).alias("terms")).withColumn("folder", F.floor(place * folders / PLACES).cast("int"))
    rows = settled_in_batches(rows, "terms", BATCH_ROWS, *["folder"] * (folders > 1))
    df = settled(rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").cast("int").alias("df")), "df")
    mean = float(seen.get["mean"] or 0)
    shards = max(1, -(-total // SHARD_DOCS), int(total * mean) // SHARD_WORDS + 1)
    asking_rows = rows.where(queries).select("id", "d").distinct()
    asked = rows.where(queries).dropDuplicates(["d"]).select("id", "d", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("id", "d", F.col("x.terms").alias("t"), F.col("x.counts").alias("c"))
    q = asked.join(df, "t").groupBy("id", "d").agg(F.array_sort(F.collect_list(F.struct("t", "c", "df"))).alias("x"))  # the distinct words of one text
    lead = F.array_max(F.transform("x", lambda x: F.struct(x["c"].alias("c"), F.bitwise_not(x["t"]).alias("t"))))["t"]  # as a shard orders its documents
    q = settled(q.select("id", "d", lead.alias("lead"), F.transform("x", lambda x: x["t"]).alias("terms"), F.transform("x", lambda x: x["c"]).alias("counts"), F.transform("x", lambda x: x["df"]).alias("df")), "queries")
    count, asked_for = q.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    least_parts = max(1, -(-count // QUERIES))
    most = shards_at_once(seen.get["terms"] or 0, asked_for, shards, least_parts)
    turn = cores // gcd(cores, least_parts)  # shards whose tasks keep all cores busy
    most -= most % turn if most > turn else 0
    shard = F.floor(place * shards / PLACES).cast("int").alias("shard")
    order = F.desc("score"), "doc_id"

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "d").orderBy(*order))).where(F.col("rank") <= k)

    def wave(low: int, high: int, so_far: DataFrame | None) -> DataFrame:
        """What the shards from low to high find that can be among the best; the fewer they are, the more parts have the queries."""
        parts = max(least_parts, min(-(-cores // (high - low)), count // COPY, int(COPIES * shards / (high - low))))
        if so_far is None:
            asking = q.withColumn("least", F.lit(0.0))
        else:
            reached = so_far.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "d", F.col("score").alias("least"))
            asking = q.join(reached, ["id", "d"], "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        sent = asking.select(F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("shard"), F.pmod(F.xxhash64("id", "d"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "d", "lead", F.size("terms").cast("bigint").alias("size"), "terms", "counts", "df", "least")
        near = rows.where(F.col("folder").between(low * folders // shards, high * folders // shards))
        here = near.where((shard >= low) & (shard < high)).select(shard, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "id", "d", F.lit(0).cast("bigint").alias("lead"), "size", "terms", "counts", F.lit(None).cast("array<int>").alias("df"), F.lit(0.0).alias("least"))
        # a task for each shard and part; queries that are alike come together
        keys = ["shard", "part", "kind", "lead", "size"]
        return here.unionByName(sent).repartitionById((high - low) * parts, (F.col("shard") - low) * parts + F.col("part")).sortWithinPartitions(*keys).mapInArrow(run, "query_id bigint, d bigint, doc_id bigint, score double")

    def run(batches):
        at_shard, held, index, waiting = None, [], None, []

        def built():
            columns = [list(c) for c in zip(*held, strict=True)] or [[np.zeros(0, np.int64)]] * 4 + [[np.zeros(0, np.int32)]]
            held.clear()
            return Shard([np.concatenate(columns.pop(0)) for _ in range(5)], mean)

        def answered():
            if waiting:
                ids, d, least, n, terms_, weights = (np.concatenate(c) for c in zip(*waiting, strict=True))
                waiting.clear()
                who, found, scores = index.best(np.repeat(np.arange(len(n)), n), terms_, weights, least, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[who], d[who], found, scores)], ["query_id", "d", "doc_id", "score"])

        for b in batches:
            plain = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "part", "kind", "id", "d", "size", "least")}
            flat = {n: b.column(n).values.to_numpy(zero_copy_only=False) for n in ("terms", "counts", "df")}
            at = {n: b.column(n).offsets.to_numpy() for n in flat}
            # runs of rows of one shard, part and kind
            changes = [np.diff(plain[n], prepend=-1) != 0 for n in ("shard", "part", "kind")]
            edges = np.append(np.flatnonzero(changes[0] | changes[1] | changes[2]), b.num_rows)
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (plain["shard"][i], plain["part"][i]) != at_shard:
                    yield from answered()
                    at_shard, index = (plain["shard"][i], plain["part"][i]), None
                    held.clear()
                if plain["kind"][i] == 0:  # documents come first; one copy for each run
                    low, high = at["terms"][i], at["terms"][j]
                    held.append((plain["id"][i:j].copy(), plain["size"][i:j].copy(), np.diff(at["terms"][i : j + 1]).astype(np.int64), flat["terms"][low:high].copy(), flat["counts"][low:high].copy()))
                    continue
                index = built() if index is None else index
                for low in range(i, j, ASKED):
                    to = min(low + ASKED, j)
                    terms_, counts, found_in = (flat[n][at[n][low] : at[n][to]] for n in ("terms", "counts", "df"))
                    weights = counts * np.log(1 + (total - found_in + 0.5) / (found_in + 0.5))
                    waiting.append((plain["id"][low:to].copy(), plain["d"][low:to].copy(), plain["least"][low:to].copy(), np.diff(at["terms"][low : to + 1]), terms_.copy(), weights))
                    if sum(len(x[0]) for x in waiting) >= ASKED:
                        yield from answered()
        yield from answered()

    top, low, step = None, 0, 1
    while low < shards:
        high = min(shards, low + step)
        found = wave(low, high, top)
        top = settled_in_batches(best(found if top is None else found.unionByName(top.drop("rank"))), "best", BATCH_ROWS)
        low, step = high, min(most, step * GROWTH)
    top = top.drop("query_id").join(asking_rows, "d")  # each row that asks, also those whose text another row has too
    return top.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "score")


def report(docs: DataFrame) -> DataFrame:
    return search(docs, (F.col("id") % 50 == 0) & (F.col("id") != NULL_ID))


SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS c FROM words GROUP BY ALL),
size AS (SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, sum(c) AS n FROM tf GROUP BY 1) USING (doc_id)),
whole AS (SELECT count(*) AS total, avg(n) AS mean FROM size),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(q.c * ln(1 + (total - df + 0.5) / (df + 0.5)) * d.c * 2.2 / (d.c + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
  FROM tf q JOIN df USING (t) JOIN tf d USING (t) JOIN size ON size.doc_id = d.doc_id, whole
  WHERE q.doc_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
