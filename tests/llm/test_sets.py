"""Packing, mixing, search, preference pairs, the pipeline."""

import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import mixing, packing, preference, queries, search, tokens

from .conftest import ROWS, texts_of


def test_ids_are_those_of_the_vocabulary_file():
    from tokenizers import Tokenizer

    slow, enc = Tokenizer.from_file(tokens.public("byte_bpe_50k.json")), tokens.Encoder()
    odd = ["", "  two  blanks \n\n x 　y", "a<|endoftext|>b <|endoftext|>", "x  <|endoftext|>  y", "don't 😀 ½ ١٢٣ \r\n\t", " ", "a\x1c \x1d b\x85 c᠎ d​ e  f  \t g\xa0 h", " \t\n x\t\t y\n\n\nz  "]
    texts = [t for _, t in texts_of()] + odd
    for t, ids in zip(texts * 2, enc.batch(texts * 2), strict=True):
        assert ids.tolist() == slow.encode(t, add_special_tokens=False).ids, t[:80]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r\x1c\x85᠎　.,'ab1éß😀<|>"), max_size=40))
def test_ids_of_any_text(text):
    enc = tokens.encoder()
    assert enc.ids(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "ab \n" * 250_000], ids=["blanks", "line ends", "letters", "short lines"])
def test_ids_of_long_runs(text):
    enc = tokens.Encoder()
    assert enc.ids(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def packed_well(rows, texts, padding):
    enc = tokens.encoder()
    ids = [np.append(enc.ids(t or ""), 1).astype("<u4") for _, t in texts]
    by_key = {}
    for (i, _), x in zip(texts, ids, strict=True):
        by_key.setdefault(i, []).append(x)
    fill, pieces = {}, {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SIZE
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    for (i, n), parts in pieces.items():
        whole = [x for x in by_key[i] if len(x) == n]
        crcs = sorted((s, m, zlib.crc32(x[s : s + m].tobytes())) for x in whole for s, m, _ in set((p[0], p[1], 0) for p in parts))
        assert sorted(set(parts)) == sorted(set(crcs))
    assert len(fill) * packing.SIZE <= sum(map(len, ids)) * (1 + padding) + packing.SIZE


def test_packing(docs, odd, none):
    packed_well(packing.pack(docs).collect(), texts_of(), 0.02)
    packed_well(packing.pack(odd).collect(), ROWS, 0.05)
    assert packing.pack(none).count() == 0
    with_ids = packing.pack(odd, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in with_ids)


def test_column_generation_reaches_the_bound():
    rng = np.random.default_rng(1)
    histogram = {int(c): int(n) for c, n in zip(rng.choice(np.arange(1, 257), 60, replace=False), rng.integers(1, 500, 60), strict=True)}
    plan = packing.plan(histogram)
    used = dict.fromkeys(histogram, 0)
    for p, times in plan:
        assert sum(c * a for c, a in p.items()) <= 256
        for c, a in p.items():
            used[c] += a * times
    assert used == histogram
    weight = np.array(sorted(histogram))
    bound = packing.column_generation(weight, np.array([histogram[c] for c in weight], float), 256)[2]
    assert sum(t for _, t in plan) <= 1.02 * bound + 2


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if w[s] * level > most * sizes[s]]
        if not full:
            return target | {s: w[s] * level for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing(docs):
    rows = mixing.report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = water(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert {s: (want[s], taken[s]) for s in sizes if not 0 <= want[s] + 1e-6 - taken[s] < 0.02 * want[s] + 2} == {}
    again = mixing.report(docs.repartition(5)).select("doc_id", "taken").collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in rows}


def test_mixing_odd_rows(odd, none):
    rows = mixing.report(odd).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.report(none).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and mixing.mixed(none).count() == 0
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == sum(r["taken"] for r in rows)


@pytest.mark.parametrize("copies", [1, 2, 7])
def test_mixed_rows_hold_what_is_taken(spark, copies):
    rows = [(1, "a b c d e f g h i j k l", "x")] * copies + [(2, "a b c", "y"), (3, "a b c d", "z"), (None, None, None)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, source string, __times int, size int, row int")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == sum(r["taken"] for r in mixing.report(df).collect()) > 0


def test_budgets_are_met_to_the_word():
    rng = np.random.default_rng(2)
    for _ in range(30):
        length = np.unique(rng.integers(1, 900, 50))
        count = rng.integers(1, 30, len(length))
        budget = float(rng.uniform(0, (length * count).sum()))
        take = mixing.fit_budget(length, count, budget)
        assert (take >= 0).all() and (take <= count).all() and 0 <= budget - (length * take).sum() < 30


@pytest.mark.parametrize("name", ["op1_secrets", "op4_search", "op5_preference", "op6_repeats"])
def test_sql_twins(spark, name):
    import duckdb

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = queries.queries()[name](spark, d).toPandas()
    want = con.execute(queries.oracle_sql()[name]).df()[list(got.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_search_prunes_without_loss(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 32)
    rng = np.random.default_rng(0)
    n, k = 3000, 10
    lists = [np.unique(rng.zipf(1.3, rng.integers(5, 60)) % 2000).astype(np.int64) for _ in range(n)]
    counts = [rng.integers(1, 5, len(t)) for t in lists]
    sizes = [int(c.sum()) for c in counts]
    flat = [np.arange(n), np.array(sizes), np.array([len(t) for t in lists]), np.concatenate(lists), np.concatenate(counts).astype(np.int32)]
    shard = search.Shard(flat, float(np.mean(sizes)))
    for q in range(0, n, 300):
        w = rng.uniform(0.1, 5, len(lists[q]))
        exact = np.zeros(n)
        for t, x in zip(lists[q], w, strict=True):
            for i in range(n):
                at = np.searchsorted(lists[i], t)
                if at < len(lists[i]) and lists[i][at] == t:
                    tf = counts[i][at]
                    exact[i] += x * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sizes[i] / np.mean(sizes)))
        exact = np.round(exact, 6)
        ids, scores = shard.top(lists[q], w, k)
        want = np.lexsort((np.arange(n), -exact))[:k]
        assert ids.tolist() == want.tolist() and np.allclose(scores, exact[want])
    assert shard.skipped > 0 and shard.scored + shard.skipped == shard.blocks * len(range(0, n, 300))
    # a rare term and a common one: at a threshold from documents with both, blocks without the rare one are never scored
    shard.scored = shard.skipped = 0
    df = np.bincount(np.concatenate(lists))
    rare = int(np.flatnonzero((df > k) & (df < 25))[0])
    shard.top(np.array([1, rare]), np.array([0.5, 5.0]), k)
    assert shard.skipped > shard.scored


def test_search_index_is_built_in_few_bytes_a_posting():
    rng = np.random.default_rng(0)
    n, each = 8000, 250
    terms = rng.integers(-(2**62), 2**62, 300_000)[rng.zipf(1.2, n * each) % 300_000]
    parts = [np.arange(n), np.full(n, each), np.full(n, each), terms, np.ones(n * each, np.int32)]
    del terms
    tracemalloc.start()
    search.Shard(parts, float(each))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * n * each, peak / (n * each)


def test_search_answers_queries_together(monkeypatch):
    """Queries searched at once, with and without scores from elsewhere: the results of each alone, by matrix products and value by value."""
    monkeypatch.setattr(search, "BLOCK", 32)
    monkeypatch.setattr(search, "WIDE", 5)
    monkeypatch.setattr(search, "SLICE", 64)
    rng = np.random.default_rng(1)
    n, k, asked = 1500, 5, 40
    lists = [np.unique(rng.zipf(1.3, rng.integers(1, 60)) % 1000).astype(np.int64) for _ in range(n)]
    flat = [np.arange(n), np.array([len(t) for t in lists]), np.array([len(t) for t in lists]), np.concatenate(lists), np.ones(sum(map(len, lists)), np.int32)]
    shard = search.Shard(flat, float(np.mean([len(t) for t in lists])))
    wanted = [np.append(lists[q], 5000) if q % 7 else np.zeros(0, np.int64) for q in range(asked)]  # of none and of terms that no document has, too
    weights = [rng.uniform(0.1, 5, len(t)) for t in wanted]
    who = np.repeat(np.arange(asked), [len(t) for t in wanted])
    alone = [shard.top(t, w, k) for t, w in zip(wanted, weights, strict=True)]
    known = np.array([s[2] if len(s) == k and q % 2 else 0.0 for q, (_, s) in enumerate(alone)])
    for product in (0, 1, 200, 10**9):
        monkeypatch.setattr(search, "PRODUCT", max(product, 1e-9))
        for least in (np.zeros(asked), known):
            q, ids, scores = shard.best(who, np.concatenate(wanted), np.concatenate(weights), least, k)
            for i, (want, s) in enumerate(alone):
                near = s >= least[i]
                assert ids[q == i][: near.sum()].tolist() == want[near].tolist() and np.allclose(scores[q == i][: near.sum()], s[near])


def test_search_builds_an_index_for_all_queries(spark, docs, monkeypatch):
    """A shard is sent and its index built once for tens of thousands of queries, not once for every 8,192."""
    tasks, deal = [], type(docs).repartitionById
    monkeypatch.setattr(type(docs), "repartitionById", lambda self, n, by: tasks.append(n) or deal(self, n, by))
    assert -(-61_500 // search.QUERIES) == 1
    monkeypatch.setattr(search, "SHARD_DOCS", max(1, docs.count() // 24))
    whole = sorted(map(tuple, search.report(docs).collect()))
    assert sum(tasks) == -(-docs.count() // search.SHARD_DOCS)
    monkeypatch.setattr(search, "COPY", 1)  # where cores are idle, the first shards have copies
    monkeypatch.setattr(search, "COPIES", 0.2)
    before = sum(tasks)
    assert sorted(map(tuple, search.report(docs).collect())) == whole and sum(tasks) > 2 * before


def test_search_in_waves(spark, docs, monkeypatch):
    """Thresholds of earlier shards, queries in parts: the same result as from one shard."""
    whole = sorted(map(tuple, search.report(docs).collect()))
    monkeypatch.setattr(search, "SHARD_DOCS", 23)
    monkeypatch.setattr(search, "GROWTH", 2)
    monkeypatch.setattr(search, "QUERIES", 2)
    assert sorted(map(tuple, search.report(docs).collect())) == whole and len(whole) == 40


def test_search_sends_no_wave_that_grows_with_the_square(spark, docs, monkeypatch):
    """Shards times parts of the queries: a wave sends about half the terms, however many shards and parts there are."""
    whole = sorted(map(tuple, search.report(docs).collect()))
    tasks, deal = [], type(docs).repartitionById
    monkeypatch.setattr(type(docs), "repartitionById", lambda self, n, by: tasks.append(n) or deal(self, n, by))
    monkeypatch.setattr(search, "SHARD_DOCS", max(1, docs.count() // 24))
    monkeypatch.setattr(search, "QUERIES", 2)
    assert sorted(map(tuple, search.report(docs).collect())) == whole
    assert max(tasks) < 12  # 25 shards in two parts were waves of 2, 12 and 36 tasks
    for n in (1, 10, 100):  # a fiftieth of the terms is asked for
        shards, parts, asked = 18 * n, n, 20_000 * n
        sent = search.shards_at_once(1_000_000 * n, asked, shards, parts) * (parts * 1_000_000 * n / shards + 1.25 * asked)
        assert sent <= 500_000 * n + parts * 1_000_000 * n / shards + 1.25 * asked


def test_search_asks_equal_texts_once(spark, monkeypatch):
    """Rows that ask with the same text are one query, sent to the shards once; each has its results."""
    batches, best = [], search.settled_in_batches
    monkeypatch.setattr(search, "settled_in_batches", lambda df, name, *a: best(df, name, *a) if name != "best" else batches.append(x := best(df, name, *a)) or x)
    rows = [(50 * i, "a text that many rows have") for i in range(30)] + [(7, "a text of its own"), (5000, "a text of its own that asks")]
    found = search.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len({r["query_id"] for r in found}) == 31 and len(found) == 310
    assert all([r["doc_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 50 * i] == [50 * j for j in range(10)] for i in range(30))
    assert batches[-1].count() == 20  # two texts


def test_search_odd_rows(odd, none):
    rows = search.report(odd).collect()
    assert {r["query_id"] for r in rows} == {50, 100}
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 50][:3] == [5, 5, 50]
    assert search.report(none).count() == 0


SIDES = "pair_id bigint, rejected boolean, turn bigint, role string, text string, part string, cut bigint"


def test_preference_pairs_odd_rows(spark):
    rows = [
        (0, False, 0, "user", "hi"), (0, False, 1, "assistant", "a"), (0, False, 2, "user", "more"), (0, True, 0, "user", "hi"), (0, True, 1, "assistant", "b"),
        (1, False, 0, None, None), (1, True, 0, None, None), (2, False, 0, "user", "alone"), (None, False, 0, "user", "x"), (3, False, None, "user", "n"), (3, True, None, "user", "n"), (3, True, 1, "GPT", "😀"),
        (4, False, 0, "user", "r"), (4, False, 0, "user", "r"), (4, True, 0, "user", "r"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SIDES)
    found = preference.format_pairs(df).collect()
    got = sorted((r["pair_id"], r["part"], -1 if r["turn"] is None else r["turn"], r["rendered"], r["masked_chars"]) for r in found)
    assert got == sorted([
        (0, "prompt", 0, "<|user|>\nhi\n", 12), (0, "chosen", 1, "<|assistant|>\na\n", 14), (0, "chosen", 2, "<|user|>\nmore\n", 14), (0, "rejected", 1, "<|assistant|>\nb\n", 14),
        (1, "prompt", 0, "<||>\n\n", 6), (3, "prompt", -1, "<|user|>\nn\n", 11), (3, "rejected", 1, "<|gpt|>\n😀\n", 8),
        (4, "chosen", 0, "<|user|>\nr\n", 11), (4, "chosen", 0, "<|user|>\nr\n", 11), (4, "rejected", 0, "<|user|>\nr\n", 11),
    ])
    other = {"chosen": "rejected", "rejected": "chosen"}
    for r in found:
        want = (None, None) if r["part"] == "prompt" else (f"{r['pair_id']}:{r['part']}", f"{r['pair_id']}:{other[r['part']]}")
        assert (r["completion"], r["other"]) == want
    assert preference.format_pairs(df.where("false")).count() == 0


def test_preference_sides_of_conversations(spark):
    rows = [
        (0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (0, 2, "user", "q1"), (0, 3, "assistant", "a1"), (1, 0, "user", "p"), (1, 1, "gpt", None), (2, 0, "user", "no reply"), (3, 0, "user", "x"), (3, 1, "bot", "y"),
        (5, 0, "user", "no neighbour"), (5, 1, "bot", "z"), (None, 0, "user", "x"), (6, None, "bot", "same"), (6, None, "bot", "same"), (7, 0, None, "same"), (7, 4, "Bot", "same"),
    ]
    schema = "conv_id bigint, turn bigint, role string, text string, pair_id bigint, rejected boolean, reply string"
    df = spark.createDataFrame([(*r, 1, True, "x") for r in rows], schema)
    got = sorted((r["pair_id"], r["part"], -1 if r["turn"] is None else r["turn"], r["rendered"]) for r in preference.report(df).collect())
    assert got == sorted([
        (0, "prompt", 0, "<|user|>\nq0\n"), (0, "prompt", 1, "<|assistant|>\na0\n"), (0, "prompt", 2, "<|user|>\nq1\n"), (0, "chosen", 3, "<|assistant|>\na1\n"), (0, "rejected", 3, "<|assistant|>\n\n"),
        (1, "prompt", 0, "<|user|>\np\n"), (1, "chosen", 1, "<|gpt|>\n\n"), (1, "rejected", 1, "<|gpt|>\na1\n"),
        (6, "prompt", -1, "<|bot|>\nsame\n"), (6, "prompt", -1, "<|bot|>\nsame\n"), (7, "prompt", 0, "<||>\nsame\n"), (7, "prompt", 4, "<|bot|>\nsame\n"),
    ])
    assert preference.report(df.where("false")).count() == 0
