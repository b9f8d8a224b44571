"""Vector codes against plain Python."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import codes


def plain(rows, parts=16, entries=64, rounds=2):
    """{position: (code, error)}, digest: rows of (vec_id, label, vector)."""
    good = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = len(good[0][2])
    good = [r for r in good if len(r[2]) == length]
    cut = codes.bounds(length, parts)
    whole = [[math.floor(Fraction(x) * 256) for x in r[2]] for r in good]
    split = [[w[a:b] for a, b in zip(cut, cut[1:], strict=False)] for w in whole]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    find = lambda x, book: min((dist(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        at = [[find(s[p], books[p])[1] for p in range(parts)] for s in split]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [s[p] for s, a in zip(split, at, strict=True) if a[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for r, s in zip(good, split, strict=True):
        found = [find(s[p], books[p]) for p in range(parts)]
        out.append((r[0], r[1], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    sums = {}
    for r in out:
        sums[r[1]] = sums.get(r[1], 0) + r[3]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    most = 2**63 - 1
    return [(i, c, min(e, most), min(sums[lb], most), digest) for i, lb, c, e in out]


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, label int, embedding array<{kind}>")


def told(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.report(df).collect()), key=repr)


def test_equals_plain_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 7 == 0 else i % 3, [float(np.float32(x)) for x in rng.normal(0, 0.2, 34)]) for i in range(300)]
    rows += [(1000 + i, 0, [float(x) for x in rng.integers(-1, 2, 34) / 256]) for i in range(60)]  # many ties
    assert told(table(spark, rows)) == sorted(plain(rows), key=repr)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5 * k for k in range(16)]
    rows = [(3, 1, v), (3, 1, v), (3, 2, [-x for x in v]), (None, None, [0.1] * 16), (4, None, None), (5, 1, []), (6, 1, [None] * 16), (7, 1, [nan, *v[1:]]), (8, 1, [*v[1:], -inf]), (9, 1, v[:9]), (1, 1, [-0.001] * 16)]
    assert told(table(spark, rows)) == sorted(plain(rows), key=repr)
    assert told(table(spark, [(1, 1, []), (2, None, [])])) == [(i, "00" * 16, 0, 0, hashlib.sha256(b"").hexdigest()) for i in (1, 2)]
    assert codes.report(table(spark, [])).collect() == []
    more = table(spark, rows).selectExpr("*", "1 AS v", "'x' AS code", "2 AS error", "3 AS looked")
    assert told(more) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("size", [1e5, 1e9, 3e38, 1e300])
def test_exact_at_any_size(spark, size):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [float(x) for x in rng.normal(0, size, 16)]) for i in range(90)]
    assert told(table(spark, rows, "double")) == sorted(plain(rows), key=repr)


def test_a_label_with_most_rows(spark):
    rows = spark.range(6000).selectExpr("id AS vec_id", "CAST(if(id % 10 = 0, id, 1) AS int) AS label", "transform(sequence(1, 32), i -> CAST(sin(id * i) AS float)) AS embedding")
    got = codes.report(rows).toPandas()
    assert len(got) == 6000
    labels = {r["vec_id"]: r["label"] for r in rows.collect()}
    sums = got.groupby(got["vec_id"].map(labels))["error"].sum()
    assert (got["label_error"] == got["vec_id"].map(labels).map(sums)).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(-4, 4), min_size=2, max_size=2), min_size=1, max_size=20), st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=20), st.integers(0, 19), st.booleans())
def test_exponion_finds_the_nearest(entries, points, start, fresh):
    book, x = codes.Codebook(entries), np.array(points, np.int64)
    before = None if fresh else np.full(len(x), start % len(entries))
    index, distance, _ = book.nearest(x, before)
    want = [min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), i) for i, e in enumerate(entries)) for p in points]
    assert list(zip(distance.tolist(), index.tolist(), strict=True)) == want


def test_the_radius_spares_most_distances(spark):
    """Where entries lie apart, a part that starts at its own looks at few others."""
    rows = spark.range(3000).selectExpr("id AS vec_id", "CAST(0 AS int) AS label", "transform(sequence(1, 16), i -> CAST((id * 37 % 64) + sin(id * i) / 8 AS float)) AS embedding")
    coded, _ = codes.compressed(rows)
    looked = coded.selectExpr("sum(looked)").first()[0]
    assert looked < 3000 * 16 * 64 / 8
