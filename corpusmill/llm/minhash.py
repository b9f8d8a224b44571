"""Near-duplicates by ProbMinHash, banding and verification.

Shingles are five consecutive words (all words of a shorter text); one that occurs c times weighs 1 + ln c. Each shingle is a
Poisson process with its weight as rate, whose points fall on random registers; a register keeps the shingle that reaches it
first, and a shingle stops when its next point is later than every register's. Two texts agree in a register with probability
J, the probability Jaccard similarity of their weighted shingles (Jaccard similarity where nothing repeats); J is what is
verified too, on whole texts.

1. Equal texts become one (a 128-bit hash of the text, combined on the map side), so copies cost nothing further.
2. Registers are banded. In a bucket the pairs that may reach the threshold by their signatures are a graph; a spanning forest of
   the most similar, fewer pairs than members, is verified. Links (J at least 0.8) make components.
3. Where a bucket has such pairs outside its forest and members of different components still, each member outside the
   largest component is compared with all members of others by an index over their shingles, and links that join two
   components are kept: fewer rows than members again, and no pair of a bucket that could join two classes is left out.
4. Links make classes by spreading the least id; rounds are written tables.

With 24 bands of 4 registers a pair at 0.8 is missed by all bands with probability 3e-6. A bucket is met in parts of bounded size: in
step 2 large ones are dealt by hash, with a common member in each part; in step 3 each two parts of which one holds members outside
the largest component meet, so memory is bounded while time grows with members outside it times members.

Null and empty texts have no shingle and stay alone, each distinct id its own class (equal ids share one). A null doc_id is
handled as the least id and returned as null with its class. Rows of one id and text share a class; an id with two texts has two
classes if they differ; a very long text is held by itself. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, grouped, settled, text_or_empty

WORDS = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 4
#: By signature: below MAYBE a pair does not reach THRESHOLD (five standard deviations).
MAYBE = 0.6
#: Members of one part of a bucket in step 2, words of one in step 3.
SUB, SUB_WORDS = 1024, 400_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x + _M1).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], n: int = WORDS) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    w = mixed_bits(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))
    n = min(n, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = mixed_bits(h + w[j : len(w) - n + 1 + j])
    return h


def weighted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, ascending, and their weights."""
    h, n = np.unique(shingle_hashes(text.split()), return_counts=True)
    return h, 1 + np.log(n)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity: the sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][i], b[1][j]
    t = x / y
    order = np.argsort(t)
    x, y, t = x[order], y[order], t[order]
    only_a, only_b = max(0.0, a[1].sum() - x.sum()), max(0.0, b[1].sum() - y.sum())
    from_here = x[::-1].cumsum()[::-1]  # of those with a ratio as great or greater
    before = np.concatenate([[0.0], y.cumsum()[:-1]]) if len(y) else y
    return float((x / (only_a + from_here + t * (only_b + before))).sum())


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """(texts, registers): the winning shingle of each register, 0 where a text has none. All texts run their rounds together."""
    first = np.full(len(sets) * registers, np.inf)
    winner = np.zeros(len(sets) * registers, np.uint64)
    if not sets:
        return winner.reshape(0, registers)
    d = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    x, w = (np.concatenate(c) for c in zip(*sets, strict=True))
    at, turn = np.zeros(len(x)), 0
    while len(x):
        turn += 1
        with np.errstate(over="ignore"):
            r = mixed_bits(x + np.uint64(turn) * _M2)
        at = at - np.log((r >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / w
        to = d * registers + (mixed_bits(r) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, to, at)
        won = first[to] == at
        winner[to[won]] = x[won]
        go = at < first.reshape(-1, registers).max(axis=1)[d]
        d, x, w, at = d[go], x[go], w[go], at[go]
    return winner.reshape(-1, registers)


def bands_of(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    h = np.zeros((len(sig), bands), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            h = mixed_bits(h + sig[:, j::rows][:, :bands])
    return h.astype(np.int64)


def _digest() -> list[Column]:
    return [F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(0xD16E57), "text").alias("d2")]


def keyed(docs: DataFrame) -> DataFrame:
    """(k, text, d1, d2): id with nulls replaced, text, its hash."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("k"), text_or_empty().alias("text"))
    return rows.select("k", "text", *_digest())


def sketches(docs: DataFrame) -> DataFrame:
    """(k, d1, d2, n_words, sig binary, bands array<bigint>)."""

    def run(batches):
        for b in batches:
            for part in grouped(b, 1):
                texts = [t.encode() for t in part.column(1).to_pylist()]
                sig = signatures([weighted(t) for t in texts])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(bands_of(sig).ravel()))
                small = pa.array([row.tobytes() for row in (sig & np.uint64(255)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([len(t.split()) for t in texts], pa.int64()), small, bands], ["k", "d1", "d2", "n_words", "sig", "bands"])

    return keyed(docs).mapInArrow(run, "k bigint, d1 bigint, d2 bigint, n_words bigint, sig binary, bands array<bigint>")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures cut to a byte, chance agreement taken off."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def sets_of(texts: DataFrame) -> DataFrame:
    """(rep, h, w) from (rep, text): weighted shingles as bytes; w is empty where all weigh 1."""

    def run(batches):
        for b in batches:
            for part in grouped(b, 1):
                found = [weighted(t.encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([w.tobytes() if (w > 1).any() else b"" for _, w in found], pa.binary())], ["rep", "h", "w"])

    return texts.select("rep", "text").mapInArrow(run, "rep bigint, h binary, w binary")


def _set(h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(h, np.uint64)
    return h, np.frombuffer(w, np.float64) if w else np.ones(len(h))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold."""
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("h").alias(f"h{c}"), F.col("w").alias(f"w{c}"))

    def run(batches):
        for b in (part for whole in batches for part in grouped(whole, 2)):
            columns = [b.column(c).to_pylist() for c in ("ha", "wa", "hb", "wb")]
            linked = [similarity(_set(ha, wa), _set(hb, wb)) >= THRESHOLD for ha, wa, hb, wb in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(linked, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(run, "a bigint, b bigint")


def _runs(batches, keys: int):
    """(key, rows) of rows sorted by their first `keys` columns."""
    at, rows = None, []
    for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def forest(sig: np.ndarray) -> tuple[list[tuple[int, int]], bool]:
    """A spanning forest of the most similar pairs that may reach the threshold, and whether there are such pairs outside it."""
    n = len(sig)
    left = np.ones(n, bool)
    best, via = np.full(n, -1.0), np.zeros(n, np.int64)
    edges, pairs = [], 0
    for _ in range(n):
        i = int(np.where(left, best, -2.0).argmax())
        left[i] = False
        if best[i] >= MAYBE:
            edges.append((i, int(via[i])))
        est = agreement(sig, sig[i])
        pairs += int((est[left] >= MAYBE).sum())
        nearer = left & (est > best)
        best[nearer], via[nearer] = est[nearer], i
    return edges, pairs > len(edges)


def _forests(roster: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b) pairs of the forests of all buckets, and (band, key) of those to be looked at again."""

    def run(batches):
        pairs, again = set(), set()

        def table():
            rows = [(a, b, None, None) for a, b in pairs] + [(None, None, *k) for k in again]
            pairs.clear()
            again.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["a", "b", "band", "key"])

        for (band, key, _, parts), rows in _runs(batches, 4):
            edges, more = forest(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1))
            pairs.update((max(rows[i][0], rows[j][0]), min(rows[i][0], rows[j][0])) for i, j in edges)
            if more or parts > 1:
                again.add((band, key))
            if len(pairs) + len(again) > 50_000:
                yield table()
        yield table()

    parts = F.ceil(F.col("n") / SUB).cast("int")
    own = F.array(F.pmod(F.xxhash64("a", "band"), F.col("parts")).cast("int"))
    placed = roster.withColumn("parts", parts).withColumn("part", F.explode(F.when(F.col("a") == F.col("b"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    placed = placed.select("band", "key", "part", "parts", "a").join(sigs.select(F.col("rep").alias("a"), "sig"), "a")
    n = int(roster.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the rows are few and small, the comparisons take time
    dealt = placed.repartition(n, "band", "key", "part").sortWithinPartitions("band", "key", "part", "a")
    return dealt.select("band", "key", "part", "parts", "a", "sig").mapInArrow(run, "a bigint, b bigint, band int, key bigint")


def joining(members: list[tuple], main) -> list[tuple[int, int]]:
    """Links between members (id, label, h, w) of different labels, as many as it takes to join all that links join."""
    sets = [_set(h, w) for _, _, h, w in members]
    label = np.unique([m[1] for m in members], return_inverse=True)[1]
    sizes = np.array([len(h) for h, _ in sets])
    mass = np.array([w.sum() for _, w in sets])
    plain = np.array([not m[3] for m in members])
    owner = np.repeat(np.arange(len(sets)), sizes)
    shingles, inverse = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    holder, share = owner[by], np.concatenate([w / max(w.sum(), 1e-300) for _, w in sets])[by]
    start = np.searchsorted(inverse[by], np.arange(len(shingles) + 1))
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i, (id_, own, *_) in enumerate(members):
        if own == main:
            continue
        mine = inverse[first[i] : first[i + 1]]
        n = start[mine + 1] - start[mine]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start[mine], n)
        common = np.bincount(holder[at], minlength=len(sets))
        jaccard = common / np.maximum(sizes + sizes[i] - common, 1)
        # the similarity is at most what the two distributions share
        shared = np.bincount(holder[at], np.minimum(share[at], np.repeat(sets[i][1] / mass[i], n)), len(sets)) if not plain.all() else jaccard
        both = plain & plain[i]
        likely = np.where(both, jaccard, shared) >= THRESHOLD - 1e-9 * ~both
        for j in np.flatnonzero(likely & (label != label[i])):
            if label[j] != label[i] and (both[j] or similarity(sets[i], sets[j]) >= THRESHOLD):
                out.append((max(id_, members[j][0]), min(id_, members[j][0])))
                label[label == label[j]] = label[i]
    return out


def _joined(roster: DataFrame, again: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components of the buckets `again` (band, key). Members without a set have no likely partner."""
    sized = sets.select(F.col("rep").alias("a"), "h", "w")
    rows = roster.select("band", "key", "a").join(again, ["band", "key"]).join(labels.withColumnRenamed("id", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    rows = settled(rows.join(sized.select("a", (F.length("h") / 8).alias("words")), "a"), "unsettled")
    sizes = rows.groupBy("band", "key", "label").agg(F.sum("words").alias("c"))
    buckets = sizes.groupBy("band", "key").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda words: F.ceil(words / SUB_WORDS).cast("int")
    buckets = buckets.select("band", "key", F.col("main.label").alias("main"), blocks(F.col("main.c")).alias("m"), blocks(F.col("all") - F.col("main.c")).alias("r"), (F.col("all") <= SUB_WORDS).alias("small"))
    # parts of the largest component meet parts of the rest, those meet each other; what is small meets at once
    of = lambda k: F.pmod(F.xxhash64("a", "band"), F.col(k)).cast("int")
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    place = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    of_main = F.transform(upto("r"), lambda j: place(1, of("m"), j))
    of_rest = F.concat(F.transform(upto("m"), lambda i: place(1, i, of("r"))), F.transform(upto("r"), lambda j: place(2, F.least(j, of("r")), F.greatest(j, of("r")))))
    places = F.when(F.col("small"), F.array(place(0, F.lit(0), F.lit(0)))).when(F.col("label") == F.col("main"), of_main).otherwise(of_rest)
    placed = rows.join(buckets, ["band", "key"]).select("band", "key", F.explode(places).alias("p"), "a", "label", "main").join(sized, "a")

    def run(batches):
        out: list[tuple[int, int]] = []

        def table():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for (*_, main), members in _runs(batches, 6):
            out += joining(members, main)
            if len(out) > 50_000:
                yield table()
                out = []
        yield table()

    n = int(roster.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["band", "key", "p"]
    dealt = placed.repartition(n, *keys).sortWithinPartitions(*keys, "a")
    return dealt.select("band", "key", "p.kind", "p.x", "p.y", "main", "a", "label", "h", "w").mapInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, sk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, k, d1, d2) of each distinct text, its number and least id, and (id, label) of the numbers that verified links join.

    Texts have numbers of their own since an id may have several texts; they are fixed when the table is written.
    """
    per_id = sk.groupBy("d1", "d2", "k").agg(F.count("*").alias("rows"))
    reps = settled(per_id.groupBy("d1", "d2").agg(F.min(F.struct("k", "rows")).alias("x")).select("d1", "d2", "x.k", "x.rows").withColumn("rep", F.monotonically_increasing_id()), "reps")
    sigs = settled(sk.where("n_words > 0").join(reps, ["k", "d1", "d2"]).dropDuplicates(["rep"]).select("rep", "sig", "bands"), "sigs")
    rows = sigs.select(F.col("rep").alias("a"), F.posexplode("bands").alias("band", "key"))
    led = rows.groupBy("band", "key").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    roster = settled(rows.join(led, ["band", "key"]), "roster")
    found = settled(_forests(roster, sigs), "forests")
    pairs = found.where("a is not null").select("a", "b").distinct()
    again = found.where("band is not null").select("band", "key").distinct()
    # whole texts of those that may have a partner, by id and digest: an id may have other texts too
    likely = pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(roster.where(F.col("n") > SUB).select(F.col("a").alias("rep"))).distinct()
    texts = keyed(docs).select("k", "text", "d1", "d2").join(reps.join(likely, "rep", "left_semi"), ["k", "d1", "d2"])
    once = texts.where("rows = 1")
    if not reps.where("rows > 1").isEmpty():  # rows that repeat with id and text
        once = once.unionByName(texts.where("rows > 1").dropDuplicates(["rep"]))
    sets = settled(sets_of(once), "sets")
    linked = settled(verified(pairs, sets), "verified")
    more = settled(_joined(roster, again, components(linked), sets), "joined")
    return reps, components(linked.unionByName(more))


def components(found: DataFrame) -> DataFrame:
    """(id, label): the least id of each component of links (a, b). Each round halves distances at least; rounds are written tables."""
    both = settled(found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = settled(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "label")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hop = label.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = label.join(near, "id").join(hop, "label").select("id", F.least("label", "near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved"))
        new = settled(new, "label")
        if new.where("moved").isEmpty():
            return new.select("id", "label")
        label = new.select("id", "label")


def classes(docs: DataFrame) -> DataFrame:
    """(k, d1, d2, class_id, text_id): each row's class and the least id with its text; both least ids of what they name."""
    sk = settled(sketches(docs), "sketches")
    reps, labels = links(docs, sk)
    joined = settled(reps.join(labels.withColumnRenamed("id", "rep"), "rep"), "joined")
    least = joined.groupBy("label").agg(F.min("k").alias("class_id"))
    of = joined.join(least, "label").select("rep", "class_id")
    named = reps.join(of, "rep", "left").select("d1", "d2", F.col("k").alias("text_id"), F.coalesce("class_id", "k").alias("class_id"))
    rows = sk.select("k", "d1", "d2", "n_words").join(named, ["d1", "d2"])
    alone = F.col("n_words") == 0
    return rows.select("k", "d1", "d2", F.when(alone, F.col("k")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("k")).otherwise(F.col("text_id")).alias("text_id"))


def report(docs: DataFrame) -> DataFrame:
    return classes(docs).select(F.nullif("k", F.lit(NULL_ID)).alias("doc_id"), "class_id", "text_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is their class's least, once each; its columns stay."""
    keep = settled(classes(docs).where("k = class_id").select("k", "d1", "d2").distinct(), "keep")
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("k"), F.xxhash64(text_or_empty()).alias("d1"), F.xxhash64(F.lit(0xD16E57), text_or_empty()).alias("d2")]
    rows = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # whatever the columns' names
    kept = rows.join(keep, ["k", "d1", "d2"], "left_semi")
    once = Window.partitionBy("k", "d1", "d2").orderBy("k")
    return kept.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")
