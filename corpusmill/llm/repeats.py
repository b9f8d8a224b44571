"""Removal of passages that repeat: recurring passages are confirmed, compiled into sharded Aho-Corasick automata, and every
document is streamed through the automata that may match it, to locate all occurrences.

A window is SPAN consecutive words. Its anchor is the GRAM-word sequence with the least hash in it, so equal windows have equal
anchors, and only windows whose anchor stands in two places can recur. Each document is split and hashed once, for its anchors.
The windows of an anchor that recurs are one stretch of text; stretches and no others are sent to the shard of their anchor:

- A shard takes the whole keys of anchors of up to COMMON places, about UNITS windows at a time. It confirms the windows that
  recur in it, compiles them over word numbers with pyahocorasick, streams its stretches and reports every place but the first.
- The windows of a more common anchor are confirmed by an aggregate that combines on the map side (their first places too).
  What is confirmed is compiled in each of as many parts as the anchor's places need, and a part streams its share of them.

So no task meets all places of a passage that a third of all documents share. Words are letters of a small alphabet in an automaton. Texts
that are equal as wholes are one document to all this: the first keeps what it keeps, the others repeat it from their first word.

Documents are ordered by doc_id (null first); rows of one id but different texts by a hash of the text; equal rows are one
document and lose the same words. Null text has no words. A very long text is held by itself, its stretches go their own ways.
Empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_128_digest

from .common import NULL_ID, grouped, settled, text_or_empty
from .minhash import shingle_hashes

SPAN = 20
GRAM = 6
COMMON = 512
UNITS = 60_000
_REACH = 1 << 24


def owners(h: np.ndarray, width: int = SPAN - GRAM + 1) -> np.ndarray:
    """For each window of `width` hashes the place of the least, the leftmost of equals."""
    out = []
    for at in range(0, max(0, len(h) - width + 1), _REACH - width):
        part = h[at : at + _REACH - 1]
        low = (part & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach < width:
            step = min(reach, width - reach)
            low = np.minimum(low[:-step], low[step:])
            reach += step
        out.append((low & np.uint64(_REACH - 1)).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def numbered(docs: DataFrame) -> DataFrame:
    """(o, doc_id, body, d1, d2): o orders documents and is one for equal rows only; it is doc_id itself unless an id has several texts. d1, d2: the text's hash."""
    text = text_or_empty()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("k"), text.cast("binary").alias("body"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(7), text).alias("d2"))
    ids = rows.select("k", F.col("d1").alias("d"))
    if ids.groupBy("k").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b").isEmpty():
        return rows.select(F.col("k").alias("o"), F.col("k").alias("doc_id"), "body", "d1", "d2")
    ids = settled(ids.distinct().repartitionByRange("k", "d").withColumn("p", F.spark_partition_id()), "ids")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ids.groupBy("p").count().select("p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))  # a row for each partition
    o = ids.join(offsets, "p").select("k", F.col("d").alias("d1"), (F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("k", "d"))).alias("o"))
    return rows.join(settled(o, "order"), ["k", "d1"]).select("o", F.col("k").alias("doc_id"), "body", "d1", "d2")


def anchors(texts: DataFrame) -> DataFrame:
    """(o, anchor array, s array, e array): for each text the hash of every anchor and the windows it owns, start to end (exclusive)."""

    def run(batches):
        for b in batches:
            for part in grouped(b, 1):
                split = [t.split() for t in part.column(1).to_pylist()]
                flat = [w for ws in split for w in ws]
                h = shingle_hashes(flat, GRAM) if len(flat) >= GRAM else np.zeros(0, np.uint64)
                own = owners(h)
                columns: list[list[np.ndarray]] = [[], [], []]
                sizes, at = [], 0
                for ws in split:
                    n = max(0, len(ws) - SPAN + 1)
                    mine = own[at : at + n]
                    start = np.flatnonzero(np.diff(mine, prepend=-1))
                    for c, x in zip(columns, (h[mine[start]].view(np.int64), start, np.append(start[1:], n)[: len(start)]), strict=True):
                        c.append(x)
                    sizes.append(len(start))
                    at += len(ws)
                offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c), t)) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["o", "anchor", "s", "e"])

    return texts.select("o", "body").mapInArrow(run, "o bigint, anchor array<bigint>, s array<int>, e array<int>")


def _hits(found: DataFrame) -> DataFrame:
    """(o, anchor, s, e, n) of anchors that stand in two places; n: places.

    An anchor of more than its share of all places is joined in parts: fewer anchors than parts have so many.
    """
    places = found.select("o", F.explode(F.arrays_zip("anchor", "s", "e")).alias("x")).select("o", F.col("x.anchor").alias("anchor"), F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    twice = settled(places.groupBy("anchor").agg(F.count("*").cast("int").alias("n")).where("n > 1"), "twice")
    total = twice.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // (4 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = F.floor(F.col("n") / share).cast("int") + 1
    heavy = F.broadcast(twice.where(F.col("n") > share).select("anchor", parts.alias("parts")))  # fewer rows than four times the partitions
    salted = places.join(heavy, "anchor", "left").withColumn("salt", F.pmod(F.xxhash64("o"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return salted.join(twice.select("anchor", "n", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")), ["anchor", "salt"]).drop("salt")


def _words_at(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts and ends."""
    blank = np.isin(np.frombuffer(text, np.uint8), np.frombuffer(b" \t\n\v\f\r", np.uint8))
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    return edge[::2], edge[1::2]


def stretches(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """(anchor, n, o, s, e, body): windows s to e (exclusive) of o, with their words."""

    def run(batches):
        for b in batches:
            for part in grouped(b, 1, 1000):
                found = part.column(2).flatten()
                anchor, n, s, e = (found.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "n", "s", "e"))
                counts = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                bodies, at = [], 0
                for body, k in zip(part.column(1).to_pylist(), counts.tolist(), strict=True):
                    start, end = _words_at(body)
                    low, high = start[s[at : at + k]].tolist(), end[e[at : at + k] + SPAN - 2].tolist()
                    bodies += [body[i:j] for i, j in zip(low, high, strict=True)]
                    at += k
                o = np.repeat(part.column(0).to_numpy(zero_copy_only=False), counts)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor, n, o, s, e)] + [pa.array(bodies, pa.binary())], ["anchor", "n", "o", "s", "e", "body"])

    per = hits.groupBy("o").agg(F.collect_set(F.struct("anchor", "n", "s", "e")).alias("found"))  # fewer than the words of one document
    return texts.select("o", "body").join(per, "o").select("o", "body", "found").mapInArrow(run, "anchor bigint, n int, o bigint, s int, e int, body binary")


class Shard:
    """An automaton over windows of words, with the first place of each."""

    def __init__(self, bodies: list[bytes]):
        split = [b.split() for b in bodies]
        self.number: dict[bytes, int] = {}
        for words in split:
            for w in words:
                if w not in self.number:
                    self.number[w] = len(self.number)
        # a word is `digits` letters, each place with letters of its own: nodes have few children, matches begin at words
        self.digits = max(1, -(-len(self.number).bit_length() // 6))
        self.size = SPAN * self.digits
        self.first: list[tuple[int, int]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.text, self.at = self.coded(split)

    def coded(self, split: list[list[bytes]]) -> tuple[str, list[int]]:
        """All texts in one, and where each starts; words without a number are one letter that no phrase has."""
        none = len(self.number)
        ids = np.fromiter((self.number.get(w, none) for words in split for w in words), np.uint32)
        letters = np.stack([((ids >> np.uint32(6 * d)) & np.uint32(63)) + np.uint32(256 + 64 * d) for d in range(self.digits)], axis=1)
        at = np.cumsum([0, *map(len, split)]) * self.digits
        return letters.astype("<u4").tobytes().decode("utf-32-le"), at.tolist()

    def add(self, phrase: str, place: tuple[int, int] | None) -> None:
        self.automaton.add_word(phrase, len(self.first))
        self.first.append(place)

    def ranges(self, text: str, o: int, s: int) -> Iterator[tuple[int, int, int]]:
        """(o, low, high) of the words of one stretch that repeat; places come in order, so one without a first place is the first."""
        first, size, digits = self.first, self.size, self.digits
        low = high = None
        for last, phrase in self.automaton.iter(text):
            place = (o, s + (last + 1 - size) // digits)
            if first[phrase] is None:
                first[phrase] = place
            if first[phrase] == place:
                continue
            if low is None or place[1] > high:
                if low is not None:
                    yield o, low, high
                low = place[1]
            high = place[1] + SPAN
        if low is not None:
            yield o, low, high


def locate(units: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(o, low, high) of words to remove, from stretches (o, first window, end of windows, words) that hold every place of their windows."""
    units.sort()
    shard = Shard([u[3] for u in units])
    text, at, digits, size = shard.text, shard.at, shard.digits, shard.size
    times: dict[str, int] = {}
    for (_, s, e, _), a in zip(units, at, strict=False):
        for i in range(a, a + (e - s) * digits, digits):
            w = text[i : i + size]
            times[w] = times.get(w, 0) + 1
    for w, t in times.items():
        if t > 1:
            shard.add(w, None)
    if not shard.first:
        return
    shard.automaton.make_automaton()
    for j, (o, s, _, _) in enumerate(units):
        yield from shard.ranges(text[at[j] : at[j + 1]], o, s)


_FOUND = "o bigint, low int, high int"


def _table(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["o", "low", "high"])


def rare(rows: DataFrame) -> DataFrame:
    """(o, low, high) of words that repeat, from the stretches of anchors of few places."""

    def run(batches):
        units, key, size = [], None, 0
        for b in batches:
            for k, o, s, e, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if k != key and size > UNITS:
                    yield _table(list(locate(units)))
                    units, size = [], 0
                key = k
                units.append((o, s, e, body))
                size += e - s
        if units:
            yield _table(list(locate(units)))

    return rows.select("anchor", "o", "s", "e", "body").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _FOUND)


def confirmed(rows: DataFrame) -> DataFrame:
    """(anchor, parts, words, o, s) of windows that recur, with their first place, from the stretches of common anchors."""

    def run(batches):
        seen: dict[tuple, list] = {}

        def table():
            columns = list(zip(*[(k[0], n, k[1], w, o, s, t) for k, (n, w, o, s, t) in seen.items()], strict=True)) or [[]] * 7
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["anchor", "n", "d", "words", "o", "s", "times"])

        for b in batches:
            for anchor, n, o, s, e, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
                words = body.split()
                for i in range(e - s):
                    w = b" ".join(words[i : i + SPAN])
                    key = (anchor, xxh3_128_digest(w))
                    if (x := seen.get(key)) is None:
                        seen[key] = [n, w, o, s + i, 1]
                    else:
                        x[4] += 1
                        if (o, s + i) < (x[2], x[3]):
                            x[2], x[3] = o, s + i
                if len(seen) > 50_000:
                    yield table()
        yield table()

    per = rows.select("anchor", "n", "o", "s", "e", "body").mapInArrow(run, "anchor bigint, n int, d binary, words binary, o bigint, s int, times bigint")
    # the digest names the words: they move once for each task that has them
    found = per.groupBy("anchor", "d").agg(F.sum("times").alias("times"), F.max("n").alias("n"), F.min(F.struct("o", "s")).alias("at"), F.min("words").alias("words")).where("times > 1")
    return found.select("anchor", _parts(), "words", "at.o", "at.s")


def _parts():
    return (F.floor(F.col("n") / COMMON) + 1).cast("int").alias("parts")


def common(rows: DataFrame) -> DataFrame:
    """(o, low, high) of words that repeat, from the stretches of anchors of many places: phrases go to every part of their anchor, a stretch to one."""
    rows = rows.select("anchor", _parts(), "n", "o", "s", "e", "body")
    phrases = settled(confirmed(rows), "phrases")
    # an automaton holds about UNITS phrases of an anchor
    chunks = phrases.groupBy("anchor").agg((F.floor(F.count("*") / UNITS) + 1).cast("int").alias("chunks"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    each = phrases.join(chunks, "anchor").select("anchor", upto("parts").alias("part"), F.pmod(F.xxhash64("words"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("kind"), "o", "s", F.col("words").alias("body"))
    own = rows.join(chunks, "anchor").select("anchor", F.pmod(F.xxhash64("o", "s"), F.col("parts")).cast("int").alias("part"), upto("chunks").alias("chunk"), F.lit(1).alias("kind"), "o", "s", "body")

    def run(batches):
        out, key, phrases, units = [], None, [], []

        def flush():
            if phrases and units:
                shard = Shard([w for _, _, w in phrases])
                for (o, s, _), a in zip(phrases, shard.at, strict=False):
                    shard.add(shard.text[a : a + shard.size], (o, s))
                shard.automaton.make_automaton()
                text, at = shard.coded([b.split() for _, _, b in units])
                for j, (o, s, _) in enumerate(units):
                    out.extend(shard.ranges(text[at[j] : at[j + 1]], o, s))

        for b in batches:
            for *at, kind, o, s, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if at != key:
                    flush()
                    key, phrases, units = at, [], []
                (units if kind else phrases).append((o, s, body))
            if len(out) > 50_000:
                yield _table(out)
                out = []
        flush()
        yield _table(out)

    dealt = each.unionByName(own).repartition("anchor", "part", "chunk").sortWithinPartitions("anchor", "part", "chunk", "kind")
    return dealt.select("anchor", "part", "chunk", "kind", "o", "s", "body").mapInArrow(run, _FOUND)


def copies(texts: DataFrame) -> DataFrame:
    """(o, low, high): documents whose whole text an earlier document has."""
    ids = texts.select("o", "d1", "d2")
    first = ids.groupBy("d1", "d2").agg(F.min("o").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = ids.join(first, ["d1", "d2"]).where(F.col("o") > F.col("first")).select("o").distinct()
    return later.select("o", F.lit(0).alias("low"), F.lit(2**31 - 1).alias("high"))


def occurrences(texts: DataFrame) -> DataFrame:
    """(o, low, high): words low to high of document o repeat what started earlier; a whole text that repeats is one range."""
    later = settled(copies(texts), "copies")
    hits = _hits(settled(anchors(texts), "anchors").join(later.select("o"), "o", "left_anti"))
    rows = settled(stretches(texts, hits), "stretches")
    return rare(rows.where(F.col("n") <= COMMON)).unionByName(common(rows.where(F.col("n") > COMMON))).unionByName(later)


def _finish(texts: DataFrame, removed: DataFrame, with_text: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            for part in grouped(b, 1, 1000):
                counts, gone, sums, kept_texts, at = [], [], [], [], 0
                flat = part.column(2).flatten()
                low, high = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("low", "high"))
                for body, k in zip(part.column(1).to_pylist(), pc.fill_null(part.column(2).value_lengths(), 0).to_pylist(), strict=True):
                    words = body.split()
                    n = len(words)
                    if k and n >= SPAN:
                        step = np.bincount(low[at : at + k], minlength=n + 1) - np.bincount(np.minimum(high[at : at + k], n), minlength=n + 1)
                        kept = (np.cumsum(step[:-1]) == 0).tolist()
                        words = list(compress(words, kept))
                    at += k
                    text = b" ".join(words)
                    counts.append(n)
                    gone.append(n - len(words))
                    sums.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        kept_texts.append(text)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept_texts, pa.binary())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    per = removed.groupBy("o").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))  # fewer than the words of one document
    rows = texts.select("o", "doc_id", "body").join(per, "o", "left").select("doc_id", "body", "ranges")
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept binary" * with_text)


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): kept holds the words that stay."""
    texts = numbered(docs)
    return _finish(texts, occurrences(texts), with_text)


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, False).select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s + 1:s + 20], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM w)),
again AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s + 1, s + 21)) AS i FROM again) GROUP BY 1),
kept AS (SELECT doc_id, w, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS k FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
