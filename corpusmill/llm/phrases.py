"""Phrase collocations by counted n-grams, exact, for each language.

1. N-grams of 1 to max_n words become rows (lang, phrase, count) and are summed by a hash aggregate for each language. A task
   adds up what its own slices of text hold first, so a phrase with a third of all places is a few rows a task.
2. Levels go up: an n-gram of which one part of n - 1 words occurs fewer than `least` times occurs fewer times itself, is no
   candidate, and is in no count that a candidate needs. Level n therefore makes rows only of n-grams whose two parts may occur often
   enough, by a Bloom filter over the level below: of at most MOST_BITS bits whatever the table's size, so at worst it lets
   more rows through. All counts are sums over all places; nothing is estimated.
3. Each cut of a candidate is joined with the counts of its two parts, scored in Decimal, and the lowest score stays.
4. One-word extensions that are frequent enough drop a phrase (an anti-join). A longer phrase that would is in a one-word
   extension that is at least as frequent, so these are enough.
5. Windows rank parts of each language, then the language; Spark keeps the first rows in every task before it shuffles them, so the
   last window has at most RANKED times the rows that are asked for, however many tasks there are.

Null text counts as empty, a null lang is `und` and joins rows that say so. Repeated rows count each. Very long texts are cut into
slices at the ends of pieces, where no phrase goes on. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settled, text_or_empty

MAX_N, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: Parts of a language that are ranked by themselves before the language is.
RANKED = 64
#: Bytes of text that are cut into words together, words whose n-grams are counted together, and rows that are sent together.
SLICE, TOGETHER, SENT = 1 << 20, 1 << 20, 1 << 16
#: Bits of the filter for each frequent phrase of the level below, its places for each, its greatest size (64 MB), and a block's.
BITS, PLACES, MOST_BITS, BLOCK = 16, 3, 1 << 29, 1 << 19
#: What ends a piece, and what stands between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_FOLD = bytes(46 if i in ENDS else 32 if i in BLANKS else i + 32 if 65 <= i <= 90 else i for i in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(data: bytes) -> list[bytes]:
    """Lower-case words in order, and `.` where a piece ends. A full stop is no part of a word, and other blanks are none."""
    return data.translate(_FOLD).replace(b".", b" . ").split()


def slices(data: bytes) -> Iterator[bytes]:
    """data in parts of about SLICE bytes that end where a piece does, or whole where no piece ends."""
    at = 0
    while len(data) - at > SLICE:
        end = max(data.rfind(bytes([c]), at, at + SLICE) for c in ENDS) + 1
        if end <= at:
            end = min((i + 1 for c in ENDS if (i := data.find(bytes([c]), at + SLICE)) >= 0), default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chained(parts: list[np.ndarray], lang: str) -> np.ndarray:
    """A hash of each phrase from its words' hashes, the same wherever the phrase stands."""
    with np.errstate(over="ignore"):
        h = np.full(len(parts[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
        for p in parts:
            h = h * _ODD + p
        return mixed(h)


def places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        step = mixed(h ^ _ODD) | np.uint64(1)
        for k in range(PLACES):
            yield (h + np.uint64(k) * step) & np.uint64(bits - 1)


class Filter:
    """bits: a power of two; `may` has no false negative."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits, data = bits, bytearray(bits // 8)
        for k, b in blocks.items():
            data[k * BLOCK // 8 : k * BLOCK // 8 + len(b)] = b
        self.cells = np.frombuffer(bytes(data), np.uint8)

    def may(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in places(h, self.bits):
            out &= (self.cells[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def filter_of(frequent: DataFrame) -> Filter:
    """A filter over (lang, phrase); its cells of 64 bits are combined on the map side, and meet in blocks of BLOCK bits."""
    bits = 1 << max(10, min(MOST_BITS, BITS * frequent.count()).bit_length() - 1)

    def cells(batches):
        for b in batches:
            found = []
            for lang in pc.unique(b.column(0)).to_pylist():
                own = b.column(1).filter(pc.equal(b.column(0), lang)).cast(pa.binary()).to_pylist()
                hashes = np.array([[xxhash.xxh64_intdigest(w) for w in p.split(b" ")] for p in own], np.uint64)
                found += [*places(chained(list(hashes.T), lang), bits)]
            at = np.concatenate(found) if found else np.zeros(0, np.uint64)
            cell, masks = (at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(masks)], ["cell", "mask"])

    size = BLOCK // 64  # cells of a block
    made = frequent.select("lang", "phrase").mapInArrow(cells, "cell bigint, mask bigint").groupBy("cell").agg(F.bit_or("mask").alias("mask"))

    def block(table: pa.Table) -> pa.Table:
        k = table["block"][0].as_py()
        data = np.zeros(size, np.int64)
        data[table["cell"].to_numpy() - k * size] = table["mask"].to_numpy()
        return pa.table({"block": pa.array([k], pa.int64()), "data": pa.array([data.tobytes()[: bits // 8]], pa.binary())})

    blocks = made.withColumn("block", F.floor(F.col("cell") / size)).groupBy("block").applyInArrow(block, "block bigint, data binary").collect()  # MOST_BITS at most
    return Filter(bits, {r["block"]: r["data"] for r in blocks})


def _dense(code: np.ndarray) -> tuple[np.ndarray, int]:
    values, inverse = np.unique(code, return_inverse=True)
    return inverse, len(values)


class Counter:
    """Counts of n-grams of one language in what it is given; `take` gives them and forgets."""

    def __init__(self, lang: str, n: int, below: Filter | None):
        self.lang, self.n, self.below = lang, n, below
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.known[b"."]  # 0
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        for part in slices(data):
            found = words(part)
            found.append(b".")
            self.ids.append(np.fromiter(map(self.known.__getitem__, found), np.int32, len(found)))
            self.size += len(found)

    def take(self) -> Iterator[pa.RecordBatch]:
        ids, names = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32), pa.array(list(self.known), pa.binary())
        n, starts = self.n, self._starts(ids)
        if n == 1:
            counts = np.bincount(ids[starts], minlength=1)
            rows = np.flatnonzero(counts)
            grams, counts = [rows], counts[rows]
        else:
            grams, counts = self._grams(ids, starts, len(names))
        self.clear()
        for i in range(0, len(counts), SENT):
            words_of = [names.take(pa.array(g[i : i + SENT])) for g in grams]
            phrase = (pc.binary_join_element_wise(*words_of, b" ") if n > 1 else words_of[0]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(phrase), pa.string()), phrase, pa.array(counts[i : i + SENT].astype(np.int64))], ["lang", "phrase", "c"])

    def _starts(self, ids: np.ndarray) -> np.ndarray:
        """Where an n-gram begins that stays within a piece and whose parts of n - 1 words may be frequent."""
        n, places_of = self.n, len(ids) - self.n + 1
        if places_of <= 0:
            return np.zeros(0, np.int64)
        fine = np.ones(places_of, bool)
        for k in range(n):
            fine &= ids[k : k + places_of] != 0
        if self.below is None:
            return np.flatnonzero(fine)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.known), np.uint64, len(self.known))
        if n == 2:
            often = self.below.may(chained([hashes], self.lang))
            return np.flatnonzero(fine & often[ids[:places_of]] & often[ids[1 : places_of + 1]])
        at = np.flatnonzero(fine)
        whole = hashes[ids]
        for first in (0, 1):
            at = at[self.below.may(chained([whole[at + first + k] for k in range(n - 1)], self.lang))]
        return at

    def _grams(self, ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
        code, most = ids[starts].astype(np.int64), size
        for k in range(1, self.n):
            if most * size >= 1 << 62:
                code, most = _dense(code)
            code, most = code * size + ids[starts + k], most * size
        _, at, counts = np.unique(code, return_index=True, return_counts=True)
        return [ids[starts[at] + k] for k in range(self.n)], counts


def counted(docs: DataFrame, n: int, below: Filter | None = None) -> DataFrame:
    """(lang, phrase, f): how often each n-gram occurs; those that `below` rules out are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(below)

    def run(batches):
        counters: dict[str, Counter] = {}
        for b in batches:
            for lang, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if lang not in counters:
                    if len(counters) >= 16:  # of many languages in a task none waits for long
                        for c in counters.values():
                            yield from c.take()
                        counters.clear()
                    counters[lang] = Counter(lang, n, sent.value)
                counters[lang].add(data.as_py())
                if counters[lang].size > TOGETHER:
                    yield from counters[lang].take()
        for c in counters.values():
            yield from c.take()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, phrase string, c bigint").groupBy("lang", "phrase").agg(F.sum("c").alias("f"))


def frequent(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, n), (lang, phrase, f, size)): word occurrences by language, and every phrase of 1 to max_n words that occurs `least` times, written."""
    first = settled(counted(docs, 1), "words")
    levels = [first.where(F.col("f") >= least).withColumn("size", F.lit(1))]
    for n in range(2, max_n + 1):
        level = counted(docs, n, filter_of(levels[-1])).where(F.col("f") >= least)
        levels.append(settled(level.withColumn("size", F.lit(n)), f"phrases{n}"))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return first.groupBy("lang").agg(F.sum("f").alias("n")), whole


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of phrases of two words and more: the cut with the lowest score, of equals the earliest."""
    split = F.split("phrase", " ")
    cut = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumns({"left": F.array_join(F.slice(split, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(split, F.col("k") + 1, F.col("size")), " ")})
    count = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    rows = cut.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    rows = rows.withColumns({"above": F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), "under": wide("l") * wide("r")}).withColumn("score", F.expr("above div under"))
    return rows.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "size", "a", "x.l", "x.r", "x.score")


def extended(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): of each phrase, how often its most frequent one-word extension occurs."""
    words_of = F.split("phrase", " ")
    parts = F.array_distinct(F.array(F.array_join(F.slice(words_of, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words_of, F.lit(2), F.col("size") - 1), " ")))
    return phrases.where("size > 2").select("lang", F.explode(parts).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language; one that has an extension with `share` % of its places goes."""
    totals, phrases = frequent(docs, max_n, least)
    longer = extended(phrases).withColumnsRenamed({"lang": "of", "phrase": "part"})
    rows = scored(phrases)
    kept = rows.join(longer, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")) & (100 * F.col("longer") >= share * F.col("a")), "left_anti")
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)))
    for by in (("lang", "part"), ("lang",)):
        first = first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def report(docs: DataFrame) -> DataFrame:
    return collocations(docs)


def sql(max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    """DuckDB's twin of report()."""
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM w WHERE len(w) >= {k}" for k in range(1, max_n + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, size, f AS a, {k} AS k, array_to_string(string_split(phrase, ' ')[:{k}], ' ') AS pl, array_to_string(string_split(phrase, ' ')[{k + 1}:], ' ') AS pr FROM g WHERE size > {k} AND f >= {least}" for k in range(1, max_n))
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang),
s AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM ({cuts}) c JOIN g l ON l.lang = c.lang AND l.phrase = pl JOIN g r ON r.lang = c.lang AND r.phrase = pr),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM s) WHERE place = 1),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM b x WHERE x.lang = b.lang AND x.size > b.size AND 100 * x.a >= {share} * b.a AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' '))),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= {top}"""
