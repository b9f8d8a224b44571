"""Operators on rows made by hand, against plain Python where that is the clearer statement."""

import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import schedule, subword
from corpusmill.functions import text as T
from corpusmill.functions import vector as V
from corpusmill.operators import allocation, audit, dedup, formatting, metrics, packing, quality, retrieval
from corpusmill.plans import pipeline
from corpusmill.sources import cache, io, synthetic
from corpusmill.streaming import dedup as stream


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def normalized(t):
    t = unicodedata.normalize("NFKC", t or "")
    t = "".join(c for c in t if c in "\t\n\r" or not (ord(c) < 32 or ord(c) == 127))
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    lines = [" ".join(x for x in line.replace("\t", " ").split(" ") if x).strip() for line in t.split("\n")]
    out = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


@pytest.mark.parametrize("t", ["a\r\nb\rc", " 　x  y\t z 　\n  w ", "a\n\n\n\n\nb", "a\n \n\t\n 　\nb", "\x00a\x0bb\x7f", "ﬁ ① Ａ ½ ㎏", "é", "a\u0085b", "", None, "\n\n x"])
def test_normalized(spark, t):
    assert one(spark, T.normalized, t) == normalized(t)


def test_ratios(spark):
    assert one(spark, T.repeated_chars, "aaaa bb") == pytest.approx(2 / 7) and one(spark, T.repeated_chars, "") == 1.0
    assert one(spark, T.repeated_ngrams, "a b c d e a b c d e") == pytest.approx(1 / 6)
    assert one(spark, T.repeated_ngrams, "a b c d e a b c d") == 0.0
    assert one(spark, T.alpha_share, "ab 12") == 0.5 and one(spark, T.alpha_share, " \n") == 0.0
    assert one(spark, T.url_rate, "HTTP://x www.y") == 2.0 and one(spark, T.url_rate, "") == 0.0
    assert one(spark, T.longest_line, "ab cdef\r\ng") == 4
    assert one(spark, T.number_of, "x") == int(__import__("hashlib").sha1(b"x").hexdigest()[:8], 16)
    with pytest.raises(ValueError):
        T.hash_tokens(F.col("text"), 16)


def test_reasons_in_order(spark):
    pad = "lorem ipsum dolor sit amet " * 40
    words = " ".join(f"word{i}" for i in range(60))
    cases = [
        ("x" * 127, "general", "too_short_chars"), ("z" * 60 + " " + words[:150], "general", "repeated_chars"), (pad, "general", "repeated_5grams"), (" ".join(f"www.a{i}.b" for i in range(30)), "general", "too_many_urls"),
        (" ".join(str(10**6 + i * 7) for i in range(60)), "general", "low_alpha_ratio"), (" ".join(str(10**6 + i * 7) for i in range(60)), "reasoning", "ok"), (" ".join(f"word{i}" for i in range(700)), None, "very_long_line"), (words, "general", "ok"),
    ]
    df = spark.createDataFrame([(t, d) for t, d, _ in cases], "text string, domain string")
    assert [r["reason"] for r in quality.with_reason(df).collect()] == [r for _, _, r in cases]
    assert quality.keep_ok(df).count() == 2 and quality.reasons(df.where("false")).count() == 0


def test_formatters(spark):
    rows = spark.createDataFrame([("do", "it", "done", "p", "s", "http://x", [("Human", "hi"), ("gpt", " yo "), ("system", None)])], "instruction string, input string, output string, problem string, generated_solution string, url string, conversations array<struct<`from`:string,value:string>>")
    of = lambda **spec: tuple(formatting.selected_text(rows, spec).select("text", "selected_text_field").first())
    assert of(formatter="instruction_response") == ("<|user|>\ndo\nit\n<|assistant|>\ndone", "instruction+response")
    assert of(formatter="problem_solution") == ("Problem:\np\n\nSolution:\ns", "problem+generated_solution")
    assert of(formatter="conversation") == ("<|user|>\nhi\n<|assistant|>\nyo", "conversation")
    assert of(text_field="missing") == ("", "missing")
    assert of(text_field_priority=["missing", "output"]) == ("done", "output")
    assert of() == ("", None)
    wide = spark.createDataFrame([("a text of more than twenty characters", "short", "http://a-long-address.example.com")], "a string, b string, url string")
    assert tuple(formatting.selected_text(wide, {}).select("text", "selected_text_field").first()) == ("a text of more than twenty characters", "__concat_text_like__")


def test_examples(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([1, 2, 3, 4, 5],)], "ids array<int>")
    got = df.select(*[c.alias(n) for n, c in formatting.example(F.col("ids"), 4, formatting.crop_start(F.col("ids"), 4, F.lit("k"), 1)).items()]).collect()
    assert got[0]["input_ids"] == [5, 6, 7, 0] and got[0]["labels"] == [5, 6, 7, -100] and got[0]["attention_mask"] == [1, 1, 1, 0] and len(got[1]["input_ids"]) == 4


def test_allocation():
    shares = allocation.DOMAIN_SHARES
    for total, want in ((4, [2, 1, 1, 0]), (20, [12, 4, 3, 1]), (102, [61, 21, 15, 5]), (819, [491, 164, 123, 41]), (2048, [1229, 410, 307, 102]), (12288, [7373, 2458, 1843, 614]), (409600, [245760, 81920, 61440, 20480])):
        assert list(allocation.allocate(total, shares).values()) == want
    assert allocation.allocate(5, {}) == {} and allocation.split_counts(4096) == {"train": 4096, "val": 40, "test": 40} and allocation.split_counts(100)["val"] == 4
    assert allocation.weights({"a": {"domain": "x", "default_weight": 3}, "b": {"domain": "x"}, "c": {"domain": "y"}}, "x") == {"a": 0.75, "b": 0.25}


def next_fit(docs, length, valid):
    blocks, cur = [], []

    def close():
        nonlocal cur
        if cur and sum(len(i) for _, i in cur) >= valid:
            flat = [x for _, i in cur for x in i]
            names = [s for s, _ in cur]
            blocks.append((flat + [0] * (length - len(flat)), max(dict.fromkeys(names), key=lambda s: (names.count(s), -names.index(s))), len(cur)))
        cur = []

    for source, ids in docs:
        if not ids:
            continue
        if len(ids) + 2 > length:
            close()
            for i in range(0, len(ids), length - 2):
                part = [2, *ids[i : i + length - 2], 3]
                if len(part) >= valid:
                    blocks.append((part + [0] * (length - len(part)), source, 1))
            continue
        if cur and sum(len(i) for _, i in cur) + len(ids) + 2 > length:
            close()
        cur.append((source, [2, *ids, 3]))
    close()
    return blocks


@pytest.mark.parametrize("valid", [20, 32])
def test_packing_equals_next_fit(spark, monkeypatch, valid):
    monkeypatch.setattr(packing, "RUN", 16)
    rng = np.random.default_rng(4)
    docs = [(int(i), f"s{rng.integers(3)}", rng.integers(4, 99, int(rng.choice([0, 3, 9, 20, 30, 31, 70]))).tolist()) for i in range(200)]
    df = spark.createDataFrame([("general", i, s, ids) for i, s, ids in docs], "domain string, ord bigint, source string, ids array<int>")
    got = packing.pack(df, 32, valid).orderBy("block", "chunk").collect()
    assert [(r["input_ids"], r["source"], r["doc_count"]) for r in got] == next_fit([(s, ids) for _, s, ids in docs], 32, valid)
    assert packing.pack(df.where("false"), 32).count() == 0


def test_audit_blocks_bad_splits(spark):
    good = [2, 7, 8, 3]
    df = spark.createDataFrame([("a", good), ("a", [2, 9, 9, 3]), ("b", [2, 0, 7, 3]), ("b", [2, 99, 3]), ("c", good), ("c", good)], "split string, input_ids array<int>")
    got = {r["split"]: r for r in audit.audit(df, 50, 4).collect()}
    assert got["a"]["decision"] == "PASS" and got["b"]["decision"] == "BLOCKED"
    assert set(got["b"]["blocked_reasons"].split(",")) == {"wrong_length", "invalid_tokens", "padding", "min_valid"} and got["c"]["blocked_reasons"] == "duplicates"
    audit.check_vocabulary(df.withColumnRenamed("input_ids", "ids").withColumn("ord", F.lit(1)), 100)
    with pytest.raises(ValueError):
        audit.check_vocabulary(df.withColumnRenamed("input_ids", "ids").withColumn("ord", F.lit(1)), 50)


def test_quota_and_exclusion(spark):
    df = spark.createDataFrame([("a", i, str(i % 4)) for i in range(10)] + [("b", 100, "9")], "source string, ord bigint, text_hash string")
    got = sorted(tuple(r) for r in dedup.quota(df, "source", {"a": 3, "b": 0}, "ord").select("source", "ord").collect())
    assert got == [("a", 0), ("a", 1), ("a", 2)] and dedup.quota(df, "source", {}, "ord").count() == 0
    assert sorted(r["ord"] for r in dedup.keep_first(df, ["text_hash"], "ord").collect()) == [0, 1, 2, 3, 100]
    assert dedup.without(df, df.where("ord < 2"), "text_hash").count() == 5


def test_retrieval_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "SLOT_BLOCK", 50)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(230, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in retrieval.top_k(df.where("vec_id < 20"), df, 8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["slot_id"]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(u[:20] @ u.T), axis=1)[:, :8]
    assert all([got[i][k + 1] for k in range(8)] == want[i].tolist() for i in range(20))
    assert retrieval.top_k(df.where("false"), df, 3).count() == 0


def test_vectors_and_graph(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    r = df.select(V.norm(F.col("v")).alias("n"), V.unit(F.col("v")).alias("u"), V.softmax(F.col("v")).alias("s"), V.entropy(F.array(F.lit(0.5), F.lit(0.5))).alias("e"), V.binary_entropy(F.lit(0.5)).alias("b")).first()
    assert r["n"] == 5 and r["u"] == pytest.approx([0.6, 0.8]) and sum(r["s"]) == pytest.approx(1) and r["e"] == pytest.approx(math.log(2)) == r["b"]
    edges = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0), (1, 0, 9.0), (1, 1, 0.0)], "src int, dst int, logit double")
    g = retrieval.graph_measures(edges).first()
    assert 0 < g["entropy"] < math.log(2) and g["over_010"] == 0.75
    back = {(r["src"], r["dst"]): math.exp(r["logit"]) for r in retrieval.forget_edges(edges, 0.1, 0.2).collect()}
    assert back[0, 0] == pytest.approx(0.5) and back[1, 0] == pytest.approx(1.0)
    seq = spark.createDataFrame([(0, i, float(i), float(i)) for i in range(4)], "s int, i int, x double, z double")
    assert [r["running_mean"] for r in retrieval.running_mean(seq, "s", "i", "x").orderBy("i").collect()] == [0, 0.5, 1, 1.5]
    last = retrieval.running_softmax(seq, "s", "i", "z", "x").orderBy("i").collect()[-1]["running_softmax"]
    assert last == pytest.approx(np.average(range(4), weights=np.exp(range(4))))
    assert retrieval.validation(seq.select(F.array("x").alias("v")), "v").first()["decision"] == "PASS"


def test_metrics(spark):
    log = spark.createDataFrame([(1, 2.0, float("nan")), (2, 1.0, 5.0), (3, 1.8, float("inf"))], "step int, loss double, other double")
    got = {r["metric"]: r for r in metrics.summary(metrics.long_form(log, "step", ["loss", "other"])).collect()}
    assert got["loss"]["first"] == 2.0 and got["loss"]["last"] == 1.8 and got["loss"]["decision"] == "PASS" and got["other"]["n"] == 1
    s = spark.range(3).select(schedule.ramp(F.col("id"), 0, 2).alias("r")).collect()
    assert [r["r"] for r in s] == [0, 0.5, 1]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 0), ("ü", 1), ("ccc", 2)], "text string, ord bigint")
    assert io.write_jsonl(df, f"{tmp_path}/j") == 3
    assert sorted(r["text"] for r in io.read_jsonl(spark, f"{tmp_path}/j", "text string, ord bigint").collect()) == ["a\nb", "ccc", "ü"]
    assert [r["value"] for r in io.training_text(df, 4).collect()] == ["a b", "ü"] and io.training_text(df).count() == 3
    assert [r["text_len"] for r in io.probe(df, {"text_field": "text"})["rows"]] == [3, 1, 3] and '"ord": 0' in io.report(df, f"{tmp_path}/r/x.json")
    calls = []
    make = lambda: calls.append(1) or df
    _, miss = cache.through(spark, f"{tmp_path}/c", make)
    rows, hit = cache.through(spark, f"{tmp_path}/c", make)
    assert len(calls) == 1 and not miss["cache_hit"] and hit == {"cache_hit": True, "raw_cache_path": f"{tmp_path}/c", "records_loaded": 3, "records_written": 0, "remote_accessed": False}
    with pytest.raises(ValueError):
        cache.through(spark, "x", make, reuse=True, refresh=True)
    with pytest.raises(ValueError):
        io.check_processed(f"{tmp_path}/none.jsonl", str(tmp_path))
    with pytest.raises(ValueError):
        subword.load("x.bin")
    a, b = (synthetic.documents(spark, "n", "reasoning", 5, 1).collect() for _ in range(2))
    assert a == b and synthetic.divergent(spark, 3, 1).count() == 3 and all(min(r["input_ids"]) >= 3 for r in synthetic.token_rows(spark, 9, 50, 20).collect())
    assert synthetic.features(spark, 2, 3, 4, 5, 15).count() == 6


def test_streaming(spark, tmp_path):
    df = synthetic.documents(spark, "n", "general", 4, 1)
    df.unionByName(df).select("text").write.parquet(f"{tmp_path}/in")
    q = stream.unseen(spark.readStream.schema("text string").parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 4


def test_pipeline(spark, tmp_path):
    names = {"gen": "general", "dia": "dialogue", "rea": "reasoning", "div": "divergent"}
    sources = {n: {"domain": d, "text_field": "text"} for n, d in names.items()}
    tables = {n: synthetic.documents(spark, n, d, 400, 3) for n, d in names.items()}
    cfg = pipeline.Config(sources, 40, f"{tmp_path}/out", length=128, valid=100)
    blocks, checked, overlaps = pipeline.run(tables, cfg)
    counts = {(r["split"], r["domain"]): r["count"] for r in blocks.groupBy("split", "domain").count().collect()}
    assert {d: counts["train", d] for d in names.values()} == allocation.allocate(40, allocation.DOMAIN_SHARES)
    assert overlaps.count() == 0 and all(r["invalid_token_count"] == 0 and r["bad_pad"] == 0 for r in checked.collect())
    with pytest.raises(pipeline.TooFew):
        pipeline.run({n: t.limit(5) for n, t in tables.items()}, pipeline.Config(sources, 40, f"{tmp_path}/few"))


def test_added_documents_are_packed_as_all_together(spark):
    rng = __import__("random").Random(4)
    sizes = [rng.choice([1, 5, 9, 14, 30, 31, 40, 70]) for _ in range(400)]
    rows = [("ab"[rng.random() < 0.3], 10**12 * i, f"s{i % 3}", list(range(4, 4 + n))) for i, n in enumerate(sizes)]  # orders far apart
    schema = "domain string, ord bigint, source string, ids array<int>"
    key = lambda df: sorted((r["domain"], r["block"], r["chunk"], tuple(r["input_ids"]), r["source"], r["valid_tokens"], r["doc_count"], r["block_hash"]) for r in df.collect())
    want = key(packing.pack(spark.createDataFrame(rows, schema), 32, 10))
    p = packing.Packed(32, 10)
    closed = []
    for a, b in ((0, 150), (150, 151), (151, 300), (300, 400)):
        part = rows[a:b] if a != 150 else [r for r in rows[a:b] if r[0] == "a"] or rows[a:b]
        closed += key(p.add(spark.createDataFrame(part, schema)))
    assert key(p.blocks()) == want and set(closed) <= set(want)


def test_sparse_orders_make_full_runs(spark):
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 'x', 'y') AS domain", "id * 1000003 AS ord", "id % 7 + 1 AS n_tokens")
    n = packing.numbered(rows, "domain", "ord")
    got = n.groupBy("domain").agg(F.min("n"), F.max("n"), F.countDistinct("n"), F.count("*")).collect()
    assert sorted(map(tuple, got)) == [("x", 0, 2999, 3000, 3000), ("y", 0, 5999, 6000, 6000)]
    assert n.selectExpr("domain", "ord", "n").exceptAll(rows.selectExpr("domain", "ord", "row_number() over (partition by domain order by ord) - 1L AS n")).count() == 0


def test_long_runs_of_blanks_take_linear_time(spark):
    import time

    texts = [" " * 200_000 + "x", "x" + "\u2028" * 200_000 + "y", "a" + "  " * 100_000, " " * 100_000 + "\n" + " " * 100_000, "\n " * 100_000 + "z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    df.select(T.normalized(F.lit("warm"))).collect()
    began = time.time()
    got = [r[0] for r in df.select(T.normalized(F.col("t"))).collect()]
    assert time.time() - began < 10
    assert got == ["x", "x" + "\u2028" * 200_000 + "y", "a", "", "z"]
