"""Operators on rows made by hand: quotas, running measures, packing in levels, audits, sources and caches."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import allocation, audit, dedup, formatting, memory, metrics, packing, quality, retrieval
from corpusmill.plans import pipeline
from corpusmill.sources import cache, io, shared, synthetic

from .test_operators import next_fit


def test_quotas_of_a_table_equal_the_drivers(spark):
    rows = [(p, n, i, s, total) for p, total in (("a", 819), ("b", 4), ("c", 0)) for i, (n, s) in enumerate(allocation.DOMAIN_SHARES.items())]
    got = allocation.allocated(spark.createDataFrame(rows, "part string, name string, pos int, share double, total int")).collect()
    for p, total in (("a", 819), ("b", 4), ("c", 0)):
        assert {r["name"]: r["quota"] for r in got if r["part"] == p} == allocation.allocate(total, allocation.DOMAIN_SHARES)
    assert allocation.weights({"a": {"domain": "x", "default_weight": 0}}, "x") == {} and allocation.weights({}, "x") == {}


def test_mixes_and_stages():
    assert allocation.parsed_mix(" a = 0.5,b=0.25, ,") == {"a": 0.5, "b": 0.25} and allocation.parsed_mix("") == {}
    assert allocation.stage_name("local_v3", 20) == "local_v3_20m" and allocation.stage_paths("r", "s")["val"] == "r/data/processed/s.val.jsonl"
    with pytest.raises(ValueError):
        allocation.stage_name("local_v2", 20)


@pytest.mark.parametrize("scores", [[0.0, 800.0], [800.0, 0.0, 1e4, 1e4 - 1], [499.0, 501.0, 500.5, -3.0], [-2000.0, -2000.5, -1200.0, -1199.0], [3.0] * 4, [0.0, 499.9, 1000.1, 999.0, 1700.0]])
def test_running_softmax_of_far_scores(spark, scores):
    values = [float((i * 7) % 5) for i in range(len(scores))]
    seq = spark.createDataFrame([(s, i, x, v, "e") for s in (0, None) for i, (x, v) in enumerate(zip(scores, values, strict=True))], "s int, i int, x double, v double, e string")
    out = retrieval.running_softmax(seq, "s", "i", "x", "v")
    assert out.columns == [*seq.columns, "running_softmax"]
    for s in (0, None):
        got = [r["running_softmax"] for r in sorted((r for r in out.collect() if r["s"] == s), key=lambda r: r["i"])]
        want = [np.average(values[: i + 1], weights=np.exp(np.array(scores[: i + 1]) - max(scores[: i + 1]))) for i in range(len(scores))]
        assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("fan", [2, 3])
def test_packing_in_levels(spark, monkeypatch, fan):
    monkeypatch.setattr(packing, "RUN", 4)
    monkeypatch.setattr(packing, "FAN", fan)
    rng = np.random.default_rng(fan)
    docs = [("s", list(range(5, 5 + int(n)))) for n in rng.integers(0, 26, 120)]
    tokens = spark.createDataFrame([(d, i, s, ids) for d in "ab" for i, (s, ids) in enumerate(docs)], "domain string, ord bigint, source string, ids array<int>")
    got = packing.pack(tokens, 20, 10).orderBy("domain", "block", "chunk").collect()
    want = sorted(next_fit(docs, 20, 10))
    for d in "ab":
        assert sorted((list(r["input_ids"]), r["source"], r["doc_count"]) for r in got if r["domain"] == d) == want


def test_audit_of_mixes_and_empty_splits(spark):
    ids = lambda n: [2, *range(4, 4 + n - 2), 3]
    rows = [("train", "general", "s1", ids(8), "h1"), ("train", "general", None, ids(8), "h2"), ("train", None, "s1", ids(8), "h3"), ("val", "general", "s1", [1, -1, 0, 5], "h4")]
    blocks = spark.createDataFrame(rows, "split string, domain string, source string, input_ids array<int>, block_hash string")
    found = {r["split"]: r for r in audit.audit(blocks, 100, 8, mix={"general": 0.6, "dialogue": 0.0}, splits=("train", "val", "test")).collect()}
    assert found["train"]["domain_counts"] == {"general": 2, "unknown": 1} and found["train"]["source_counts"] == {"s1": 2, "unknown": 1}
    assert found["train"]["blocked_reasons"] == "mix:general" and found["train"]["mix_ratio"]["general"] == pytest.approx(2 / 3)
    assert found["val"]["blocked_reasons"] == "wrong_length,invalid_tokens,padding,min_valid" and found["val"]["num_tokens"] == 8
    assert found["test"]["blocked_reasons"] == "empty,no_labels" and found["test"]["num_blocks"] == 0 and found["test"]["duplicate_block_ratio"] == 0
    audit.check_vocabulary(blocks.withColumn("ids", F.array(F.lit(1))).withColumn("ord", F.lit(1)), 100)
    with pytest.raises(ValueError):
        audit.check_vocabulary(blocks.withColumn("ids", F.array(F.lit(100))).withColumn("ord", F.lit(1)), 100)


def test_nested_values_as_text(spark):
    df = spark.createDataFrame([({"b": [1, None], "a": None}, True, 2.5, [["x", None], []]), (None, None, None, None)], "m map<string,array<int>>, b boolean, d double, a array<array<string>>")
    text = [formatting.stringified(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]
    assert [tuple(r) for r in df.select(*text).collect()] == [("a: \nb: 1\n", "True", "2.5", "x\n\n"), ("", "", "", "")]


def test_loader_records(spark):
    encode = lambda c: F.transform(F.split(c, " "), lambda x: F.length(x))
    df = spark.createDataFrame([([9], None, None, None, None), (None, "a bb", None, "c", None), (None, "a", " ", "c", None), (None, None, None, None, "t"), (None, None, None, None, None)], "input_ids array<int>, prompt string, separator string, response string, text string")
    got = [r["x"] for r in df.select(formatting.loader_ids(df, encode).alias("x")).collect()]
    assert got == [[9, 0, 0], [1, 4, 3], [1, 1, 3], [1, 3], [0, 3]]
    bare = df.select("input_ids")
    assert bare.select(formatting.loader_ids(bare, encode, None).alias("x")).collect()[1]["x"] == [0, 0, 0]
    ids = spark.createDataFrame([([],), ([2, 5],), ([5],)], "i array<int>")
    assert [r["x"] for r in ids.select(formatting.prompt_ids(F.col("i")).alias("x")).collect()] == [[2], [2, 5], [2, 5]]


def test_probes_and_their_gate(spark, tmp_path):
    df = spark.createDataFrame([("some text", None), (None, "other")], "text string, body string")
    spec = {"text_field_priority": ["body", "text"]}
    assert io.probe(df, spec) == {"status": "ok", "selected_text_field": "text", "rows": [{"fields": ["text", "body"], "selected_field": "text", "text_len": 9}, {"fields": ["text", "body"], "selected_field": "body", "text_len": 5}]}
    assert io.probe(df.where("false"), spec)["error"] == "no rows returned"
    missing = lambda: spark.read.parquet(f"{tmp_path}/none")
    assert io.probe(missing, spec)["status"] == "error"
    with pytest.raises(KeyError):  # not Spark's to say
        io.probe(lambda: {}["x"], spec)
    ok = io.probe_all({"a": spec, "b": {}}, {"a": df, "b": missing})
    assert ok["decision"] == "PASS" and io.gate(ok) is None
    bad = io.probe_all({"a": spec, "b": {"required": True}, "c": {"required": True}}, {"a": df, "b": missing})
    assert len(bad["blocked_reasons"]) == 2
    with pytest.raises(SystemExit) as e:
        io.gate(bad)
    assert e.value.code == 2


def test_registries_and_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"sources": {"a": {"domain": "x"}}}))
    assert io.registry(f"{tmp_path}/r.json") == {"a": {"domain": "x"}}
    df = spark.createDataFrame([(1, "a,b")], "x int, y string")
    io.write_csv(df, f"{tmp_path}/c")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()] == [("1", "a,b")]
    assert io.markdown("T", {"s": "{}"}) == "# T\n\n## s\n\n```json\n{}\n```\n"
    assert synthetic.write_divergent(spark, f"{tmp_path}/d", 5, 1) == 5 and "uses" in io.read_jsonl(spark, f"{tmp_path}/d", "text string, prompt_type string").first()["prompt_type"]


def test_sources_by_their_registry(spark, tmp_path):
    spark.createDataFrame([("x" * 30, 1)], "body string, n int").write.json(f"{tmp_path}/s/en/train")
    df = io.load_source(spark, "s", {"path": f"{tmp_path}/s", "format": "json", "subset": "en", "split": "train", "text_field": "body", "domain": "dialogue"})
    r = df.first()
    assert (r["text"], r["source"], r["domain"], r["subdomain"], r["selected_text_field"]) == ("x" * 30, "s", "dialogue", "unknown", "body")


def test_cached_rows_are_filtered_again(spark, tmp_path):
    rows = [("a  text", 0, None), ("a text", 1, None), ("", 2, None), ("x\x00", 3, "stored"), ("y", 4, "gone"), ("z", 5, "")]
    df = spark.createDataFrame(rows, "text string, ord bigint, text_hash string")
    gone = spark.createDataFrame([("gone",)], "text_hash string")
    got = dedup.first_usable(df, 10, gone).collect()
    assert [(r["ord"], r["text"]) for r in got] == [(0, "a text"), (3, "x"), (5, "z")] and got[1]["text_hash"] == "stored"
    usable = lambda r: dedup.first_usable(r, 2, gone)
    assert cache.through(spark, f"{tmp_path}/c", lambda: df, usable=usable)[0].count() == 6
    again, report = cache.through(spark, f"{tmp_path}/c", lambda: df, usable=usable)
    assert [r["ord"] for r in again.collect()] == [0, 3] and report["cache_hit"] and report["records_loaded"] == 6


def test_a_rerun_leaks_nothing_between_splits(spark, tmp_path):
    names = {"gen": "general", "dia": "dialogue", "rea": "reasoning", "div": "divergent"}
    sources = {n: {"domain": d, "text_field": "text"} for n, d in names.items()}
    tables = {n: synthetic.documents(spark, n, d, 400, 3) for n, d in names.items()}
    cfg = pipeline.Config(sources, 8, f"{tmp_path}/out", length=128, valid=100)
    train = pipeline.split_documents(tables, cfg, "train", 8, None)
    first = pipeline.split_documents(tables, cfg, "val", 4, None)  # cached without a look at train
    assert first.join(train, "text_hash", "left_semi").count() > 0
    with pytest.raises(pipeline.TooFew):
        pipeline.split_documents(tables, cfg, "val", 4, train)
    n, report = pipeline.sample(tables["gen"], sources["gen"], "gen", 7, f"{tmp_path}/s", f"{tmp_path}/s.jsonl")
    assert n == 7 and not report["cache_hit"] and pipeline.sample(tables["gen"], sources["gen"], "gen", 7, f"{tmp_path}/s", f"{tmp_path}/s.jsonl")[1]["cache_hit"]


def test_feature_tables(spark):
    f = synthetic.features(spark, 4, 3, 5, 2, 10)
    assert io.read_features(f, "z_query", "z_fused").count() == 12 and io.read_features(f, "z_query", "z_fused", 2).count() == 6
    for bad in (f.withColumn("z_query", F.slice("z_query", 1, 2)), f.where("not (sample_id = 1 and span_idx = 0)"), f.drop("z_fused"), f.withColumn("z_fused", F.lit("x"))):
        with pytest.raises(ValueError):
            io.read_features(bad, "z_query", "z_fused")


def test_contrast_in_a_batch_and_cosines(spark):
    rng = np.random.default_rng(3)
    q, k = rng.normal(size=(10, 6)), rng.normal(size=(10, 6))
    df = spark.createDataFrame([(i, q[i].tolist(), k[i].tolist()) for i in range(10)], "i int, q array<double>, k array<double>")
    u = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for lo in (0, 4, 8):
        x = u(q)[lo : lo + 4] @ u(k)[lo : lo + 4].T / 0.1
        want += (np.log(np.exp(x).sum(axis=1)) - np.diag(x)).tolist()
    got = retrieval.in_batch_contrast(df, "i", "q", "k", 4, 0.1).first()
    assert got["n"] == 10 and got["loss"] == pytest.approx(np.mean(want))
    off = {r["g"]: r["cosine"] for r in retrieval.off_diagonal(df.withColumn("g", F.floor(F.col("i") / 9)), ["g"], "i", "q").collect()}
    c = np.abs(u(q)[:9] @ u(q)[:9].T)
    assert off[1] == 0.0 and off[0] == pytest.approx((c.sum() - np.trace(c)) / 72)


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(s, o) for s in ("b", None, "a") for o in (5, 10**12, -3)], "s string, o bigint")
    got = {(r["s"], r["o"]): r["i"] for r in memory._numbered(df.repartition(5), "s", "o", "i").collect()}
    assert got == {k: i for i, k in enumerate((s, o) for s in (None, "a", "b") for o in (-3, 5, 10**12))}
    with pytest.raises(ValueError):
        memory._affinity(df, spark.range(memory.MOST_NODES + 1))


def test_bits_of_a_report(spark):
    log = [(i, "recon_loss", 2.0 - i / 10) for i in range(5)] + [(i, "retrieval_entropy_div_logtopk", 1.0 + i) for i in range(2)]
    r = metrics.report_bits(metrics.summary(spark.createDataFrame(log, "step int, metric string, value double"))).first()
    assert (r["decision"], r["recon_drop_ge_5pct"], r["retrieval_entropy_decreased"], r["retrieval_top10_over_0_18"]) == ("PASS", True, False, False) and math.isclose(r["drop"], 0.2)
    empty = metrics.report_bits(metrics.summary(spark.createDataFrame([], "step int, metric string, value double"))).first()
    assert empty["decision"] == "REVIEW" and empty["drop"] is None
    assert quality.reasons(spark.createDataFrame([("x" * 200,), ("y",)], "text string"), mock=True).count() == 2
    assert metrics.averages_after(spark.createDataFrame(log, "step int, metric string, value double"), 1).where("metric = 'recon_loss'").first()["n"] == 4


def test_few_files_are_spread_over_all_cores(spark):
    one = spark.range(10).coalesce(1)
    assert shared.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 64)
    assert shared.spread(many) is many


def test_first_usable_normalises_once(spark):
    """The rows are joined with a table of hashes that was written, not with texts that are normalised again."""
    from corpusmill.operators import dedup

    docs = spark.createDataFrame([(i, f"  text {i % 7}　  \n") for i in range(20)] + [(20, " 　\n"), (21, None)], "ord bigint, text string")
    got = dedup.first_usable(docs, 5, dedup.hashed(spark.createDataFrame([("text 2",)], "text string")).select("text_hash"))
    assert [(r["ord"], r["text"]) for r in got.collect()] == [(i, f"text {i}") for i in (0, 1, 3, 4, 5)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Normalizer") == 1


def test_functions_of_sql_make_tokens_once_and_no_string_of_each_letter(spark):
    from corpusmill.functions import sql
    from corpusmill.plans import catalog

    plan = catalog.queries()["q_sql_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("16777619") == 1 and "\\p{L}, 0" not in plan
    sql.register(spark)
    assert spark.sql("SELECT c.chunk FROM VALUES (CAST(NULL AS ARRAY<INT>)), (array(4)), (array()) AS t(ids), LATERAL token_chunks(t.ids, 8) c").count() == 2
    shares = spark.sql("SELECT alpha_share(t) AS a FROM VALUES (''), (' \n'), ('ab 1é'), ('..') AS x(t)").collect()
    assert [r["a"] for r in shares] == [0.0, 0.0, 0.75, 0.0]


def test_added_documents_are_joined_with_their_places_once(spark, monkeypatch):
    """An addition and the open blocks at the end form blocks of rows that have their places."""
    monkeypatch.setattr(packing, "made", lambda *a, **k: pytest.fail("joined with their places again"))
    rows = spark.createDataFrame([("a", i, "s", [7] * 20) for i in range(6)], "domain string, ord bigint, source string, ids array<int>")
    packed = packing.Packed(64, 1)
    for low in (0, 3):
        packed.add(rows.where((rows.ord >= low) & (rows.ord < low + 3)))
    assert sorted((r["block"], r["doc_count"]) for r in packed.blocks().collect()) == [(1, 2), (2, 2), (3, 2)]
