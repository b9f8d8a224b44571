"""Fingerprints, near-duplicates, repeated passages, quality."""

import hashlib
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard

from corpusmill.llm import fingerprint, minhash, quality, repeats

from .conftest import ROWS, texts_of


def edited(t, following):
    h = len(t) // 2
    return t[: len(t) - h] + following[:h]


def canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub("[ \t\n\x0b\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", t).strip(" ")


def fingerprint_of(t):
    """Two seeds of 64 bits: 42, and what 42 makes of the operator's own."""
    data = canonical(t).encode()
    seeds = 42, xxhash.xxh64_intdigest(struct.pack("<i", fingerprint.SEED), 42)
    return "".join(f"{xxhash.xxh64_intdigest(data, s):016x}" for s in seeds)


def test_fingerprints(docs):
    got = {r["doc_id"]: r for r in fingerprint.report(docs).collect()}
    rows = sorted(texts_of())
    by_text = {}
    for j, (i, t) in enumerate(rows):
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited(t, rows[(j + 1) % len(rows)][1]).encode()).hexdigest()
        by_text.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    for j, (i, t) in enumerate(rows):
        following = rows[(j + 1) % len(rows)][1]
        assert got[i]["fingerprint"] == fingerprint_of(t) and got[i]["edited_fingerprint"] == fingerprint_of(edited(t, following))
        assert got[i]["near_edited"] == float(canonical(t) == canonical(edited(t, following))) and got[i]["near_next"] == float(canonical(t) == canonical(following))
        assert got[i]["copies"] == sum(t == u for _, u in rows) and got[i]["first_id"] == min(k for k, u in rows if u == t)


def test_fingerprint_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    rows = [(i * i - 50, f"text {i} " * (i % 5 + 1)) for i in range(300)]
    random.Random(1).shuffle(rows)
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    rows.sort()
    assert got == {i: rows[(j + 1) % len(rows)][1] for j, (i, _) in enumerate(rows)}


def test_canonical_forms_and_odd_rows(spark, odd, none):
    same = ["Ｃａｆｅ́  au lait", "CAFÉ au\tLAIT ", "café au lait"]
    rows = fingerprint.report(spark.createDataFrame(list(enumerate(same)), "doc_id bigint, text string")).collect()
    assert len({r["fingerprint"] for r in rows}) == 1 and {r["near_next"] for r in rows} == {1.0}
    got = fingerprint.report(odd).collect()
    assert len(got) == len(ROWS) and sorted(r["n_chars"] for r in got) == sorted(len(t or "") for _, t in ROWS)
    assert fingerprint.report(none).count() == 0
    one = fingerprint.report(spark.createDataFrame([(9, "abc")], "doc_id bigint, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"aba").hexdigest() and one["near_next"] == 1.0


def shingle_list(t, n=5):
    w = t.split()
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([tuple(w)] if w else [])


def counted(text):
    return {x: 1 + math.log(n) for x, n in Counter(shingle_list(text)).items()}


def probability_jaccard(a, b):
    """By its definition, term by term."""
    names = list(a | b)
    x, y = (np.array([s.get(n, 0.0) for n in names]) for s in (a, b))
    return sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(len(names)) if x[i] and y[i])


def true_classes(rows):
    sets = {i: counted((t or "").encode()) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < i}:
            if probability_jaccard(s, sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def near_copies(seed=3, base=30, copies=12):
    rng = random.Random(seed)
    rows, boiler = [], [f"common{i}" for i in range(60)]
    for d in range(base):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))]
        if d % 2:
            words[5:5] = boiler
        for _ in range(copies if d % 3 == 0 else 1):
            w = list(words)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    return rows


def test_near_duplicates(spark):
    rows = texts_of() + [(10_000 + i, t) for i, t in near_copies()]
    got = {r["doc_id"]: r["class_id"] for r in minhash.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == true_classes(rows)


def test_recall_of_a_whole_table(spark):
    """Classes of a thousand documents with their planted copies: the same as by brute force, so no link is lost."""
    rows = texts_of("/root/testdata/sf0.01/documents.parquet")
    want = true_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in minhash.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert len(set(want.values())) < len(rows) and got == want


@pytest.mark.parametrize("small", [(1024, 400_000), (16, 1500)], ids=["one part", "many parts"])
def test_a_large_group_of_near_copies(spark, monkeypatch, small):
    """Copies of one text, some of which are alike only to few others; buckets in one part and in many."""
    monkeypatch.setattr(minhash, "SUB", small[0])
    monkeypatch.setattr(minhash, "SUB_WORDS", small[1])
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w + w[-8:] * (i % 3))))
    want = true_classes(rows)
    assert 3 < len(set(want.values())) < 140
    got = minhash.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_probability_jaccard_is_estimated():
    rng = random.Random(0)
    a = [b"w%d" % rng.randrange(10**6) for _ in range(400)]
    b = a[:300] + [b"v%d" % rng.randrange(10**6) for _ in range(100)] + a[:20] * 9
    sets = [minhash.weighted(t) for t in (b" ".join(a), b" ".join(b), b"", b"one")]
    sig = minhash.signatures(sets, 4096)
    true = probability_jaccard(counted(b" ".join(a)), counted(b" ".join(b)))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    assert abs(minhash.similarity(sets[0], sets[1]) - true) < 1e-9 and minhash.similarity(sets[0], sets[2]) == 0.0
    assert minhash.similarity(sets[1], sets[1]) == pytest.approx(1.0)
    assert (sig[2] == 0).all() and len(set(sig[3].tolist())) == 1


def test_near_copies_with_a_repeated_passage(spark):
    """What repeats weighs more, in the signatures and in the verified similarity alike."""
    rng = random.Random(5)
    rows = []
    for i, times in enumerate([1, 2, 3, 5, 9, 20, 50] * 3):
        w = [f"r{rng.randrange(10**6)}" for _ in range(120)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + w[-8:] * times))]
    want = true_classes(rows)
    assert {want[1], want[3]} == {0, 2} and want[13] == 13
    got = {r["doc_id"]: r["class_id"] for r in minhash.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_near_copy_of_one_text_of_an_id(spark):
    rng = random.Random(6)
    a, b = ([f"t{rng.randrange(10**6)}" for _ in range(100)] for _ in range(2))
    rows = [(3, " ".join(a)), (6, " ".join(a[:-1] + ["other"])), (6, " ".join(b)), (9, " ".join(b[:-1] + ["other"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["class_id"]) for r in minhash.report(docs).collect())
    assert got == [(3, 3), (6, 3), (6, 6), (9, 6)]
    assert {(r["doc_id"], r["text"]) for r in minhash.first_of_each(docs).collect()} == {rows[0], rows[2]}


def test_near_duplicates_odd_rows(odd, none):
    got = minhash.report(odd).collect()
    assert len(got) == len(ROWS)
    cls = {}
    for r in got:
        cls.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert cls[50] == cls[5] == {5} and cls[1] == {1} and cls[2] == {2} and cls[3] == {3}
    kept = minhash.first_of_each(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids[5] == 1 and ids[50] == 0 and ids[6] == 2 and ids[None] == 1
    assert minhash.report(none).count() == 0 and minhash.first_of_each(none).count() == 0


def without_repeats(rows, span=20):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for s in range(len(w) - span + 1):
            x = tuple(w[s : s + span])
            if seen.setdefault(x, (i, s)) != (i, s):
                keep[s : s + span] = [False] * span
        kept = b" ".join(a for a, b in zip(w, keep, strict=True) if b)
        out[i] = (len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("small", [(512, 60_000), (16, 60_000), (3, 40)], ids=["rare", "common", "many parts"])
def test_repeats(spark, docs, monkeypatch, small):
    """Through automata of rare and of common anchors, whose phrases fill one automaton or many."""
    monkeypatch.setattr(repeats, "COMMON", small[0])
    monkeypatch.setattr(repeats, "UNITS", small[1])
    want = without_repeats(texts_of())
    assert {r["doc_id"]: tuple(r)[1:] for r in repeats.report(docs).collect()} == want
    located = repeats.occurrences(repeats.numbered(docs)).collect()
    whole = {r["o"] for r in located if r["high"] == 2**31 - 1}
    texts = dict(texts_of())
    firsts = {t: min(i for i, u in texts.items() if u == t) for t in texts.values()}
    assert whole == {i for i, t in texts.items() if i != firsts[t]}  # equal texts alone are told without an automaton
    by_automaton = {}
    for r in located:
        if r["o"] not in whole:
            by_automaton.setdefault(r["o"], set()).update(range(r["low"], r["high"]))
    assert by_automaton and {i: len(w) for i, w in by_automaton.items()} == {i: n for i, (_, n, _) in want.items() if n and i not in whole}
    rng = random.Random(5)
    phrase = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(150):  # a passage far more common than COMMON, periodic texts, short vocabularies
        w = [f"v{rng.randrange(4)}" for _ in range(60)] if i % 5 == 0 else [f"w{rng.randrange(10**6)}" for _ in range(40)]
        w[10:10] = phrase[rng.randrange(0, 30) :]
        rows.append((i, " ".join(w + ["a", "b"] * (15 if i % 7 == 0 else 0))))
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == without_repeats(rows)


def test_repeats_odd_rows(spark, odd, none):
    got = repeats.report(odd).collect()
    assert len(got) == len(ROWS) and sorted(r["n_words"] for r in got) == sorted(len((t or "").split()) for _, t in ROWS)
    assert repeats.report(none).count() == 0
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(1, t), (1, t), (1, t + " more"), (None, t)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in repeats.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(0, 30, 0), (1, 30, 30), (1, 30, 30), (1, 31, 30)]


def test_owners_are_leftmost_minima():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 400).astype(np.uint64) << np.uint64(40)
    want = [s + int(np.argmin(h[s : s + 15])) for s in range(len(h) - 14)]
    assert repeats.owners(h).tolist() == want and len(repeats.owners(h[:14])) == 0


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.report(spark.read.parquet(f"{d}/documents.parquet"), labels).collect()}
    rows = [(r["quality"], got[r["doc_id"]]) for r in labels.collect()]
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1) for _, g in rows)
    held = [(q, g) for q, g in rows if g["held_out"]]
    good, bad = [g["score"] for q, g in held if q], [g["score"] for q, g in held if not q]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got.values())


def plain_score(model, text):
    """From the model's dictionaries and weights alone, each piece with a compressor of its own."""
    data = text.encode()
    shares = []
    for i in range(0, len(data), 2048):
        piece = data[i : i + 2048]
        good, bad = (len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(piece)) for d in (model.good, model.bad))
        shares.append((bad - good, max(len(piece), 256)))
    x = [1.0, 10 * sum(d for d, _ in shares) / max(len(data), 256), 10 * min((d / n for d, n in shares), default=0.0)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, x, strict=True))))


def test_quality_scores_by_brute_force(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs, labels)
    assert model.trained and len(model.good) and model.good != model.bad
    got = {r["doc_id"]: r["score"] for r in quality.report(docs, labels).collect()}
    assert got.keys() == dict(texts_of()).keys()
    for i, t in texts_of():
        assert got[i] == pytest.approx(plain_score(model, t), abs=1e-9)
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == {i for i, x in got.items() if x >= 0.5}


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.report(odd, labels).count() == len(ROWS) and quality.report(none, labels).count() == 0
    assert quality.report(odd, labels.where("false")).where("score = 0.5").count() == len(ROWS)
    assert quality.keep_good(odd, labels).columns == odd.columns
