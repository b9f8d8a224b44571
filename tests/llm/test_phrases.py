"""Phrase collocations against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusmill.llm import phrases

from .conftest import ROWS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, max_n=3, least=10, share=50, top=2000):
    """rows of (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]], p))
        beaten = set()
        for q, b in found.items():
            for size in range(2, len(q)):
                beaten |= {q[i : i + size] for i in range(len(q) - size + 1) if 100 * b >= share * c[q[i : i + size]]}
        kept = sorted(x for x in kept if x[-1] not in beaten)[:top]
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right, _) in enumerate(kept, 1)]
    return sorted(out)


def told(df, **how):
    return sorted(map(tuple, phrases.collocations(df, **how).collect()))


def test_equals_plain_counting_on_documents(docs):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["lang", "text"])
    assert told(docs) == plain(list(zip(t["lang"].to_pylist(), t["text"].to_pylist(), strict=True)))


@pytest.mark.parametrize("max_n", [1, 2, 3, 5])
def test_longer_phrases_ties_and_cuts(spark, max_n):
    rng = np.random.default_rng(max_n)
    rows = [("ab"[i % 2] if i % 5 else None, "".join(str(x) for x in rng.choice(["x ", "y ", "Z ", "w\t", "v  ", "u, ", "u\n", "é ", " q "], 60, p=[0.3, 0.2, 0.2, 0.1, 0.05, 0.05, 0.03, 0.04, 0.03]))) for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert told(df, max_n=max_n, least=4) == plain(rows, max_n, 4)
    assert told(df, max_n=max_n, least=2, share=80, top=7) == plain(rows, max_n, 2, 80, 7)


def test_odd_rows(spark, odd, none):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert told(odd) == plain(rows)
    assert told(odd, least=1, top=10**6) == plain(rows, least=1, top=10**6)
    assert len(ROWS) == len(rows) and phrases.report(none).collect() == []
    und = [(None, "a b " * 30), ("und", "a b." * 9), ("", "a b;" * 12), ("x", None), ("x", ""), ("x", " .. ,\t")]
    assert told(spark.createDataFrame(und, "lang string, text string")) == plain(und)


def test_a_hot_phrase_and_copies(spark):
    """A third of all places are one phrase, in copies of one text; slices end in the middle of texts."""
    rows = [("en", "to be or not to be, " * 20)] * 500 + [("en", f"word{i} is here. to go {i % 3}") for i in range(1000)]
    assert told(spark.createDataFrame(rows, "lang string, text string").repartition(5)) == plain(rows)


def test_slices_and_filters_change_nothing(spark, docs, monkeypatch):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    data = "\n".join(x or "" for x in t).encode()
    whole = phrases.words(data)
    monkeypatch.setattr(phrases, "SLICE", 1000)
    parts = list(phrases.slices(data))
    assert b"".join(parts) == data and len(parts) > 100 and [w for p in parts for w in phrases.words(p)] == whole
    assert list(phrases.slices(b"x" * 5000)) == [b"x" * 5000, b""]
    want = told(docs)
    monkeypatch.setattr(phrases, "MOST_BITS", 1024)  # a filter that lets nearly everything through
    assert told(docs) == want


def test_filter_has_no_false_negative(spark):
    rows = [("en", f"w{i} w{i * i % 91}") for i in range(2000)] + [("und", "w1 w1")]
    made = phrases.filter_of(spark.createDataFrame(rows, "lang string, phrase string"))
    h = lambda p, lang: phrases.chained([np.array([phrases.xxhash.xxh64_intdigest(w.encode())], np.uint64) for w in p.split(" ")], lang)
    assert all(made.may(h(p, lang))[0] for lang, p in rows)
    assert sum(made.may(h(f"v{i} w{i}", "en"))[0] for i in range(2000)) < 100
