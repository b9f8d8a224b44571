"""Every query of the engine by name, with its DuckDB twin.

The tables have no domain; here a document's is decided by the number in its source's name. Its order is doc_id.
"""

from __future__ import annotations

from math import cos
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import schedule, sql, subword
from corpusmill.functions import text as T
from corpusmill.operators import allocation, audit, collection, dedup, formatting, memory, metrics, nearest, packing, quality, retrieval
from corpusmill.plans import pipeline
from corpusmill.sources import cache, shards
from corpusmill.sources.io import load_source, probe_all, read_jsonl, table, training_text, write_jsonl
from corpusmill.sources.shared import settled, shared_dir
from corpusmill.streaming import packing as online

LENGTH = 512
MIX = "general=0.60, dialogue=0.20, reasoning=0.15, divergent=0.05"
#: SQL of Spark and DuckDB alike: letters with their marks apart.
DECOMPOSED = "replace(replace(replace(text, 'é', 'é'), 'ü', 'ü'), 'ö', 'ö')"
DOMAINS = list(allocation.DOMAIN_SHARES)
QUOTAS = allocation.allocate(205, {f"src{i}": 1 / 20 for i in range(20)})
BITS = ("recon_loss", "retrieval_entropy_div_logtopk", "retrieval_top10_mass")
PLANES = [[[round(cos(1.7 + 13 * t + 5.3 * b + 0.9 * d * (b + 1)), 6) for d in range(64)] for b in range(retrieval.MOST_BITS)] for t in range(2)]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int") % 4
    return table(spark, d, "documents").withColumn("domain", F.get(F.array(*[F.lit(x) for x in DOMAINS]), n)).withColumn("ord", F.col("doc_id"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "ord", "domain", "source", "lang", T.hash_tokens(F.coalesce("text", F.lit(""))).alias("ids"))


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def quality_measures(spark, d):
    return _longs(quality.measures(table(spark, d, "documents")), "chars", "longest_line")


def exact_dedup(spark, d):
    return dedup.keep_first(dedup.hashed(table(spark, d, "documents")).select("doc_id", "source", "text_hash"), ["text_hash"], "doc_id").select("doc_id", "source", "text_hash")


def split_exclusion(spark, d):
    rows = dedup.hashed(table(spark, d, "documents")).select("doc_id", "text_hash")
    return dedup.without(rows.where("doc_id % 10 >= 8"), rows.where("doc_id % 10 < 8"), "text_hash").select("doc_id", "text_hash")


def split_overlap(spark, d):
    return dedup.common_keys(dedup.hashed(table(spark, d, "documents")).select("text_hash", (F.col("doc_id") % 3).cast("string").alias("part")), "text_hash", "part")


def hash_tokens(spark, d):
    return _tokens(spark, d).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), T.ids_hash(F.col("ids")).alias("ids_hash"))


def token_stats(spark, d):
    return _tokens(spark, d).withColumn("n", F.size("ids")).groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most"))


def long_chunks(spark, d):
    rows = packing.long_chunks(_tokens(spark, d).select("doc_id", "ids"), LENGTH)
    return rows.select("doc_id", F.col("chunk").cast("long"), F.col("valid_tokens").cast("long"), T.ids_hash(F.col("input_ids")).alias("block_hash"))


def _packed(spark, d):
    return packing.pack(_tokens(spark, d).select("domain", "ord", "source", "ids"), LENGTH)


def pack_blocks(spark, d):
    return _longs(_packed(spark, d).drop("input_ids"), "block", "chunk", "valid_tokens", "doc_count")


def pack_appended(spark, d):
    """The blocks of documents that came in three deliveries."""
    tokens = settled(_tokens(spark, d).select("domain", "ord", "source", "ids"), "tokens")
    third = tokens.agg(F.max("ord")).first()[0] // 3 + 1
    packed = packing.Packed(LENGTH)
    for i in range(3):
        packed.add(tokens.where((F.col("ord") >= i * third) & (F.col("ord") < (i + 1) * third)))
    return _longs(packed.blocks().drop("input_ids"), "block", "chunk", "valid_tokens", "doc_count")


def block_dedup(spark, d):
    return _longs(packing.first_blocks(_packed(spark, d), DOMAINS).select("domain", "block", "chunk", "block_hash"), "chunk")


def domain_mix(spark, d):
    return audit.mix_shares(_docs(spark, d), allocation.DOMAIN_SHARES)


def mixed_blocks(spark, d):
    return packing.mix(_docs(spark, d).select("domain", "doc_id", F.col("doc_id").cast("string").alias("key")), allocation.allocate(102, allocation.DOMAIN_SHARES), 7, "key").select("domain", "doc_id")


def audit_blocks(spark, d):
    """Of the packed blocks; documents are split first, and each split is packed by domain."""
    part = F.concat_ws(":", F.col("doc_id") % 3, "domain")
    blocks = packing.pack(_tokens(spark, d).select(part.alias("domain"), "ord", "source", "ids"), LENGTH)
    blocks = blocks.withColumn("split", F.substring_index("domain", ":", 1))
    blocks = blocks.withColumn("domain", F.substring_index("domain", ":", -1))
    found = audit.audit(blocks, 32_000, LENGTH, mix=allocation.parsed_mix(MIX), mixed=("0", "1", "2"), splits=("0", "1", "2", "empty"))
    listed = lambda name: F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    found = found.select("split", "num_blocks", "num_tokens", "invalid_token_count", "min_valid_tokens", "missing_bos", "missing_eos", "duplicate_block_ratio", listed("domain_counts").alias("domains"), listed("source_counts").alias("sources"), "blocked_reasons", "decision")
    return _longs(found, "invalid_token_count", "min_valid_tokens")


def vocab_scan(spark, d):
    head = table(spark, d, "documents").orderBy("doc_id").limit(256)  # before anything is made of texts
    return _longs(audit.ids_measured(head.select(T.hash_tokens(F.coalesce("text", F.lit(""))).alias("ids"))), "least", "greatest", "negative", "rows", "ids")


def field_priority(spark, d):
    pages = table(spark, d, "pages")
    text, name = formatting.by_priority(pages.columns, ["title", "html", "url"])
    return pages.select("page_id", F.sha1(text.cast("binary")).alias("text_hash"), name.alias("field"))


def normalize(spark, d):
    """Of texts that are no longer composed."""
    return table(spark, d, "documents").select("doc_id", T.text_hash(T.normalized(F.expr(DECOMPOSED))).alias("text_hash"))


def pad_labels(spark, d):
    e = formatting.example(F.col("ids"), LENGTH, formatting.crop_start(F.col("ids"), LENGTH, F.col("doc_id"), 7))
    return _tokens(spark, d).select("doc_id", T.ids_hash(e["input_ids"]).alias("ids_hash"), T.ids_hash(e["labels"]).alias("labels_hash"), F.aggregate(e["attention_mask"], F.lit(0).cast("long"), lambda s, x: s + x).alias("valid"))


def _found(spark, d):
    v = table(spark, d, "embeddings")
    return retrieval.top_k(v.where("vec_id % 50 = 0"), v, 10)


def span_pool(spark, d):
    return _rounded(_longs(retrieval.span_means(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 4), "span_idx", "pos"), 6, "mean")


def metric_summary(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value")
    return _rounded(metrics.summary(log), 6, "mean", "drop", "first", "last", "least", "greatest")


def schedule_trace(spark, d):
    """What each event would have been trained with, its number being the step."""
    step = F.col("step")
    rows = table(spark, d, "events").select(F.col("event_id").alias("step"))
    return _rounded(rows.select("step", schedule.warmup_stable_decay(step, 0.001, 2000, 200, 400).alias("rate"), schedule.ramp(step, 300, 900, 0.1, 0.7).alias("ramp")), 9, "rate", "ramp")


def lsh_candidates(spark, d):
    """Codes have as many bits as the table's size asks for."""
    v = table(spark, d, "embeddings")
    bits = retrieval.bits_for(v.count())
    return retrieval.candidates(v.where("vec_id % 50 = 0"), v, [t[:bits] for t in PLANES])


def lsh_short(spark, d):
    """Queries whose candidates, at most 60 each, are fewer than 50."""
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0")
    return retrieval.short_lists(q, retrieval.capped(lsh_candidates(spark, d), 60), 50)


def _quotas() -> dict[str, dict[str, int]]:
    """Documents for 40 training blocks and the held-out splits, by source: every fourth number is of one domain."""
    sources = {f"src{i}": {"domain": DOMAINS[i % 4], "default_weight": 1 + i % 3} for i in range(20)}
    return {split: allocation.source_quotas(n, sources) for split, n in allocation.split_counts(40).items()}


def split_documents(spark, d):
    """Documents of three splits by quotas of their sources, none of which has a text of an earlier one."""
    return collection.splits(_docs(spark, d), _quotas()).select("split", "source", "doc_id", "text_hash")


def split_blocks(spark, d):
    """From documents to the mixed blocks of three splits: collection with exclusion, tokens, packing, first of equal blocks, domain counts."""
    cfg = pipeline.Config({}, 40, "", LENGTH)
    docs, out = settled(collection.splits(_docs(spark, d), _quotas()), "docs"), None
    for split, n in allocation.split_counts(40).items():
        made = pipeline.split_blocks(docs.where(F.col("split") == split), cfg, n).withColumn("split", F.lit(split))
        out = made if out is None else out.unionByName(made)
    return _longs(out.select("split", "domain", "source", "chunk", "valid_tokens", "doc_count", "block_hash"), "chunk", "valid_tokens", "doc_count")


def collect_reasons(spark, d):
    """What became of the rows that were looked at for the training split."""
    return collection.collected(_docs(spark, d), _quotas()["train"]).reasons


def lsh_filled(spark, d):
    """Candidates by planes, at most 60 each, filled up at random to 50."""
    v = table(spark, d, "embeddings")
    return retrieval.filled(v.where("vec_id % 50 = 0"), v, retrieval.capped(lsh_candidates(spark, d), 60), 50, 11)


def knn_pruned(spark, d):
    v = table(spark, d, "embeddings")
    return _rounded(nearest.search(v.where("vec_id % 50 = 0"), v, 10).rows, 6, "score")


def selected(spark, d):
    """Documents as records of four sources, each with its own formatter; the text that is chosen, and from where."""
    docs = table(spark, d, "documents")
    own = lambda k, *columns: docs.where(F.col("doc_id") % 4 == k).select("doc_id", *columns)
    text, lang = F.col("text"), F.col("lang")
    sources = {
        "solved": ({"formatter": "problem_solution", "domain": "reasoning"}, own(0, F.when(F.col("doc_id") % 8 == 0, lang).alias("problem"), text.alias("answer"))),
        "told": ({"formatter": "instruction_response", "domain": "dialogue"}, own(1, F.col("source").alias("prompt"), F.when(F.col("doc_id") % 3 == 0, lang).alias("input"), text.alias("output"))),
        "plain": ({"text_field": "body", "domain": "general", "subdomain": "web"}, own(2, text.alias("body"), lang.alias("note"))),
        "any": ({"domain": "general"}, own(3, text.alias("a"), F.concat(lang, F.lit(" is the language of this one")).alias("b"), F.col("source").alias("c"), F.lit("https://an.address.that.is.no.text").alias("url"))),
    }
    parts = [formatting.stamped(formatting.selected_text(rows, spec), name, spec["domain"], spec.get("subdomain", "unknown"), "train") for name, (spec, rows) in sources.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.select("doc_id", "source", "domain", "subdomain", "split", "selected_text_field", T.text_hash(F.col("text")).alias("text_hash"))


def source_scan(spark, d):
    """Documents through the data source of shards by a registry entry, checked by a filter that reaches it."""
    shards.register(spark)
    rows = load_source(spark, "shard_docs", {"path": f"{d}/documents.parquet", "format": "shards", "domain": "general", "text_field": "text"})
    return rows.where("ord >= 0").select("doc_id", "source", "domain", "subdomain", "selected_text_field", T.text_hash(F.col("text")).alias("text_hash"))


def probed(spark, d):
    """Reports of a registry's sources, one a row, and what they lead to."""
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages")
    sources = {"docs": {"text_field": "text", "required": True}, "pages": {"text_field_priority": ["title", "html"]}, "gone": {"required": True}}
    found = probe_all(sources, {"docs": docs.orderBy("doc_id"), "pages": pages.orderBy("page_id")}, 2)
    rows = [(name, r["status"], r.get("selected_text_field"), [x["text_len"] for x in r.get("rows", [])], found["decision"]) for name, r in found["sources"].items()]
    return spark.createDataFrame(rows, "name string, status string, field string, lengths array<bigint>, decision string").select("name", "status", "field", F.array_join(F.col("lengths").cast("array<string>"), ",").alias("lengths"), "decision")


def cached_source(spark, d):
    """Hashes of documents through the read-through cache twice: what it holds, and both reports."""
    path = f"{shared_dir(spark)}/cache-{uuid4().hex}"
    make = lambda: dedup.hashed(table(spark, d, "documents")).select("source", "text_hash")
    first, second = cache.through(spark, path, make), cache.through(spark, path, make)
    seen = lambda i, r: F.struct(F.lit(i).alias("turn"), *[F.lit(r[c]).alias(c) for c in ("cache_hit", "records_written", "remote_accessed")])
    return second[0].agg(F.count("*").alias("rows"), F.countDistinct("text_hash").alias("texts")).select("rows", "texts", F.explode(F.array(seen(1, first[1]), seen(2, second[1]))).alias("r")).select("rows", "texts", "r.*")


def jsonl_round_trip(spark, d):
    """Documents written as JSON lines and read again."""
    path = f"{shared_dir(spark)}/lines-{uuid4().hex}"
    docs = table(spark, d, "documents")
    write_jsonl(docs, path)
    return read_jsonl(spark, path, docs.schema).select("doc_id", "lang", "source", "n_chars", T.text_hash(F.col("text")).alias("text_hash"))


def online_blocks(spark, d):
    """Blocks that the stream of documents has closed, which come by doc_id; the last one of each domain is open still."""
    docs = _docs(spark, d).select(F.col("domain").alias("part"), "ord", "source", F.coalesce("text", F.lit("")).alias("text"))
    found = online.run_in_order(docs, lambda rows: rows.select("part", "ord", "source", T.hash_tokens(F.col("text")).alias("ids")), LENGTH)
    return _longs(found.select(F.col("part").alias("domain"), "block", "chunk", "source", "valid_tokens", "doc_count", "block_hash"), "chunk", "valid_tokens", "doc_count")


def by_sql(spark, d):
    """Quality, tokens and chunks by functions of SQL alone: every reason, and the hash of every chunk."""
    sql.register(spark)
    _docs(spark, d).select("domain", "ord", "source", F.coalesce("text", F.lit("")).alias("text")).createOrReplaceTempView("sql_docs")
    spark.sql("SELECT domain, ord, source, hash_tokens(text) AS ids FROM sql_docs").createOrReplaceTempView("sql_tokens")
    return spark.sql(f"""SELECT 'chunk' AS kind, t.source AS name, t.ord AS n, CAST(c.chunk AS BIGINT) AS chunk, ids_hash(c.input_ids) AS hash FROM sql_tokens t, LATERAL token_chunks(if(size(t.ids) + 2 > {LENGTH}, t.ids, NULL), {LENGTH}) c
        UNION ALL SELECT 'reason', quality_reason(text, domain), ord, 0, NULL FROM sql_docs""")


def known(spark, d):
    """Documents of three domains, counted by domain."""
    return packing.known_domains(_docs(spark, d), ["general", "reasoning", "divergent"]).groupBy("domain").agg(F.count("*").alias("n"))


def _edges(spark: SparkSession, d) -> DataFrame:
    """The hours of a day as a graph: how often a user's next event falls into which hour, as logits, all pairs of hours included."""
    following = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, d, "events").select(F.hour("ts").alias("src"), F.hour(F.lead("ts").over(following)).alias("dst")).where("dst is not null")
    n = steps.groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.count("*").alias("n"))
    grid = spark.range(24 * 24).select(F.floor(F.col("id") / 24).cast("long").alias("src"), (F.col("id") % 24).alias("dst"))
    return grid.join(n, ["src", "dst"], "left").select("src", "dst", F.log(F.coalesce("n", F.lit(0)) + 1.0).alias("logit"))


def _nodes(spark, d):
    return table(spark, d, "embeddings").where("vec_id < 24").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _sequences(spark, d):
    return table(spark, d, "embeddings").where("vec_id >= 24").select("label", "vec_id", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def write_skips(spark, d):
    rows = table(spark, d, "events").select((F.col("event_id") % 10 * 100).alias("step"), F.col("value").alias("surprise"))
    return _rounded(memory.skip_rate(rows, "surprise", "step", initial=60.0, target=20.0, every=200, amount=12.5), 9, "skip_rate")


def running(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_id") % 7).cast("double").alias("score"))
    out = retrieval.running_softmax(retrieval.running_mean(rows, "user_id", "event_id", "value"), "user_id", "event_id", "score", "value")
    return _rounded(out.select("user_id", "event_id", "running_mean", "running_softmax"), 9, "running_mean", "running_softmax")


def branches(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), (F.col("l_linenumber") % 2).cast("long").alias("branch"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_discount").alias("s"), F.col("l_tax").alias("t"))
    rows = rows.groupBy("seq", "branch", F.floor(F.col("line") / 2).alias("pos")).agg(F.max("s").alias("s"), F.max("t").alias("t"))
    return _rounded(memory.branch_weights(rows, "s", "t", (2.0, 3.0)).select("seq", "branch", "pos", "weight"), 9, "weight")


def batch_contrast(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding", F.reverse("embedding").alias("turned"))
    return _rounded(retrieval.in_batch_contrast(v, "vec_id", "embedding", "turned", 64, 0.5), 6, "loss")


def branch_cosines(spark, d):
    v = table(spark, d, "embeddings").withColumn("place", F.floor(F.col("vec_id") / 8))
    return _rounded(retrieval.off_diagonal(v, ["place"], "vec_id", "embedding"), 6, "cosine")


def loader_ids(spark, d):
    """Documents as records of three shapes in turn."""
    docs, kind = table(spark, d, "documents"), F.col("doc_id") % 3
    rows = docs.select(
        "doc_id", F.when(kind == 0, F.array((F.col("doc_id") % 7).cast("int"))).alias("input_ids"), F.when(kind == 1, F.col("lang")).alias("prompt"),
        F.when((kind == 1) & (F.col("doc_id") % 2 == 0), " : ").alias("separator"), F.when(kind == 1, F.col("text")).alias("response"), F.when(kind == 2, F.col("text")).alias("text"),
    )
    ids = formatting.loader_ids(rows, T.hash_tokens)
    return rows.select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n"), T.ids_hash(F.col("ids")).alias("ids_hash"))


def prompt_ids(spark, d):
    ids = table(spark, d, "conversations").select("conv_id", "turn", T.hash_tokens(F.coalesce("text", F.lit(""))).alias("ids"))
    made = ids.select("conv_id", "turn", formatting.prompt_ids(formatting.prompt_ids(F.col("ids"))).alias("ids"))
    return made.select("conv_id", "turn", F.size("ids").cast("long").alias("n"), T.ids_hash(F.col("ids")).alias("ids_hash"), T.ids_hash(formatting.spoken_ids(F.col("ids"))).alias("spoken_hash"))


def stringified(spark, d):
    docs = table(spark, d, "documents")
    record = F.struct(F.col("text").alias("text"), F.struct(F.lit(True).alias("ok"), F.col("n_chars").alias("n"), F.lit(None).cast("string").alias("gone")).alias("meta"), F.array("source", F.lit(None).cast("string"), "lang").alias("tags"), F.create_map(F.lit("z"), F.col("lang"), F.lit("b"), F.col("source")).alias("by"))
    rows = docs.select("doc_id", record.alias("r"))
    return rows.select("doc_id", F.sha1(formatting.stringified(F.col("r"), rows.schema["r"].dataType).cast("binary")).alias("text_hash"))


def cached_split(spark, d):
    """Of a cached table, half of whose hashes are stored, what the next split may use."""
    docs = table(spark, d, "documents").withColumn("text_hash", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("stored "), F.sha1("text"))))
    earlier = dedup.hashed(table(spark, d, "documents").where("doc_id % 5 = 0")).select("text_hash").unionByName(docs.where("doc_id % 10 = 4").select("text_hash"))
    return dedup.first_usable(docs, 500, earlier, "doc_id").select("doc_id", "text_hash")


def shares(spark, d):
    """Quotas of sources within their languages, by how many documents each has."""
    n = table(spark, d, "documents").groupBy(F.col("lang").alias("part"), F.col("source").alias("name")).agg(F.count("*").alias("n"))
    whole = n.groupBy("part").agg(F.sum("n").alias("all"))
    pos = F.substring("name", 4, 9).cast("int")
    return allocation.allocated(n.join(whole, "part").select("part", "name", pos.alias("pos"), (F.col("n") / F.col("all")).alias("share"), F.lit(1009).alias("total"))).select("part", "name", "quota")


def report_bits(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("step"), F.get(F.array(*[F.lit(x) for x in BITS]), F.col("event_id") % 3).alias("metric"), "value")
    return _rounded(metrics.report_bits(metrics.summary(log)), 6, "drop")


def averages(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value")
    return _rounded(metrics.averages_after(log, 1000), 6, "mean")


def pieces(spark, d):
    import public_tokenizers

    rows = subword.with_pieces(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("ids").alias("n_pieces"), T.ids_hash(F.col("ids")).alias("ids_hash"))


def queries() -> dict:
    return {
        "q_quality_reasons": lambda s, d: quality.reasons(_docs(s, d)),
        "q_quality_metrics": quality_measures,
        "q_exact_dedup": exact_dedup,
        "q_dup_groups": lambda s, d: dedup.groups(dedup.hashed(table(s, d, "documents")), "text_hash", "doc_id"),
        "q_source_quota": lambda s, d: dedup.quota(table(s, d, "documents").select("source", "doc_id"), "source", QUOTAS, "doc_id"),
        "q_reasons_until_full": lambda s, d: dedup.counted_until_full(quality.with_reason(_docs(s, d)).select("reason", "ord"), "reason", 300, "ord"),
        "q_split_exclusion": split_exclusion,
        "q_split_overlap": split_overlap,
        "q_hash_tokens": hash_tokens,
        "q_token_stats": token_stats,
        "q_long_chunks": long_chunks,
        "q_pack_blocks": pack_blocks,
        "q_block_hash_dedup": block_dedup,
        "q_domain_mix": domain_mix,
        "q_mixed_blocks": mixed_blocks,
        "q_audit": audit_blocks,
        "q_vocab_scan": vocab_scan,
        "q_chat_format": lambda s, d: formatting.chats(table(s, d, "conversations")),
        "q_prompt_response": lambda s, d: formatting.prompts(table(s, d, "conversations")),
        "q_field_priority": field_priority,
        "q_normalize": normalize,
        "q_pad_labels": pad_labels,
        "q_knn_exact": lambda s, d: _rounded(_found(s, d), 6, "score"),
        "q_knn_metrics": lambda s, d: _rounded(retrieval.measures(_found(s, d), 10), 6, "top1_mass", "top5_mass", "top10_mass", "entropy", "entropy_share"),
        "q_knn_gather": lambda s, d: _rounded(_longs(retrieval.gathered(_found(s, d), table(s, d, "embeddings")), "pos"), 5, "value"),
        "q_span_pool": span_pool,
        "q_metric_summary": metric_summary,
        "q_schedule_trace": schedule_trace,
        "q_lsh_candidates": lsh_candidates,
        "q_sentencepiece": pieces,
        "q_batch_contrast": batch_contrast,
        "q_branch_cosines": branch_cosines,
        "q_loader_ids": loader_ids,
        "q_prompt_ids": prompt_ids,
        "q_stringified": stringified,
        "q_cached_split": cached_split,
        "q_allocated": shares,
        "q_report_bits": report_bits,
        "q_averages": averages,
        "q_mock_reasons": lambda s, d: quality.reasons(_docs(s, d), mock=True),
        "q_corpus_size": lambda s, d: dedup.corpus_size(table(s, d, "documents")),
        "q_slot_reuse": lambda s, d: memory.reusable(memory.slot_counts(_found(s, d), table(s, d, "embeddings")), 0.75),
        "q_write_skips": write_skips,
        "q_running": running,
        "q_branch_weights": branches,
        "q_graph_measures": lambda s, d: _rounded(retrieval.graph_measures(_edges(s, d)), 9, "entropy", "mean_max", "over_002", "over_005", "over_010"),
        "q_edge_forgetting": lambda s, d: _rounded(retrieval.forget_edges(_edges(s, d), 0.2, 0.03), 6, "logit"),
        "q_graph_overview": lambda s, d: _rounded(_longs(memory.overview(_sequences(s, d), _nodes(s, d), _edges(s, d)), "pos"), 6, "value"),
        "q_coactivation": lambda s, d: _rounded(memory.coactivation(_sequences(s, d), _nodes(s, d), _edges(s, d), "label", "vec_id"), 9, "p"),
        "q_adjacent_contrast": lambda s, d: _rounded(memory.adjacent_contrast(_sequences(s, d), "label", "vec_id", "v", 0.1, 4), 6, "loss"),
        "q_vector_validation": lambda s, d: _rounded(retrieval.validation(table(s, d, "embeddings"), "embedding"), 6, "mean", "std", "mean_norm"),
        "q_training_text": lambda s, d: training_text(_docs(s, d)).select(F.sha1(F.col("value").cast("binary")).alias("line_hash"), F.length("value").cast("long").alias("n")),
        "q_dialogue_head": lambda s, d: _docs(s, d).where("domain = 'dialogue'").select("doc_id").orderBy("doc_id").limit(40),
        "q_lsh_short": lsh_short,
        "q_lsh_capped": lambda s, d: retrieval.capped(lsh_candidates(s, d), 5, 3),
        "q_known_domains": known,
        "q_pack_appended": pack_appended,
        "q_sql_functions": by_sql,
        "q_selected_text": selected,
        "q_source_scan": source_scan,
        "q_probe": probed,
        "q_cached_source": cached_source,
        "q_jsonl": jsonl_round_trip,
        "q_online_blocks": online_blocks,
        "q_lsh_filled": lsh_filled,
        "q_knn_pruned": knn_pruned,
        "q_split_documents": split_documents,
        "q_collect_reasons": collect_reasons,
        "q_split_blocks": split_blocks,
        "q_last_rows": lambda s, d: dedup.last_rows(table(s, d, "events").select("event_id", "event_type"), 30, "event_id"),
        "q_text_number": lambda s, d: table(s, d, "documents").select("doc_id", T.number_of(F.col("text")).alias("number")),
    }




def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{T.WORD}')"


DOCS = f"docs AS (SELECT *, ([{', '.join(repr(x) for x in DOMAINS)}])[(substr(source, 4)::INT % 4) + 1] AS domain FROM documents)"
MEASURED = f"""{DOCS},
parts AS (SELECT *, string_split(text, '') AS c, length(text) AS n, {_words('lower(text)')} AS w FROM docs),
grams AS (SELECT *, CASE WHEN len(w) < 10 THEN [] ELSE list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], chr(1))) END AS g FROM parts),
measured AS (
  SELECT doc_id, domain, n AS chars,
    CASE WHEN n = 0 THEN 1.0 ELSE coalesce(list_sum(list_transform(range(3, n + 1), lambda i: CASE WHEN c[i] = c[i - 1] AND c[i - 1] = c[i - 2] THEN 1 ELSE 0 END)), 0) / greatest(n, 1) END AS repeated_chars,
    CASE WHEN len(g) = 0 THEN 0.0 ELSE (len(g) - len(list_distinct(g))) / len(g) END AS repeated_5grams,
    len(regexp_extract_all(text, '\\p{{L}}')) / (n - len(regexp_extract_all(text, '[{T.BLANK}]'))) AS alpha,
    len(regexp_extract_all(text, '{T.URL}')) / greatest(1.0, n / 100) AS urls,
    list_max(list_transform(regexp_split_to_array(text, '{T.LINE_END}'), lambda x: length(x))) AS longest_line
  FROM grams),
reasoned AS (
  SELECT *, CASE WHEN chars < 128 THEN 'too_short_chars' WHEN repeated_chars > 0.2 THEN 'repeated_chars' WHEN repeated_5grams > 0.3 THEN 'repeated_5grams' WHEN urls > 0.25 THEN 'too_many_urls'
    WHEN domain <> 'reasoning' AND alpha < 0.35 THEN 'low_alpha_ratio' WHEN longest_line > 4000 THEN 'very_long_line' ELSE 'ok' END AS reason FROM measured)"""
IDS = f"""{DOCS},
tokens AS (
  SELECT doc_id, domain, source, lang, list_transform({_words("text")}, lambda w: (4 + list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(w, ''), lambda x: unicode(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) % 31996)::INT) AS ids
  FROM docs)"""
HASH = "sha1(array_to_string({0}, ','))"
PACKED = f"""{IDS},
d AS (SELECT domain, doc_id, source, ids, len(ids) AS n, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS rn FROM tokens WHERE len(ids) > 0),
walk AS (
  SELECT domain, rn, CASE WHEN n + 2 > {LENGTH} THEN 0 ELSE n + 2 END AS used, 1::BIGINT AS block FROM d WHERE rn = 1
  UNION ALL
  SELECT d.domain, d.rn, CASE WHEN n + 2 > {LENGTH} THEN 0 WHEN used = 0 OR used + n + 2 > {LENGTH} THEN n + 2 ELSE used + n + 2 END,
    CASE WHEN n + 2 > {LENGTH} OR used = 0 OR used + n + 2 > {LENGTH} THEN block + 1 ELSE block END
  FROM walk JOIN d ON d.domain = walk.domain AND d.rn = walk.rn + 1),
placed AS (SELECT d.*, block FROM d JOIN walk USING (domain, rn)),
short AS (SELECT domain, block, flatten(list([2] || ids || [3] ORDER BY rn)) AS c, count(*) AS doc_count FROM placed WHERE n + 2 <= {LENGTH} GROUP BY ALL),
tally AS (SELECT domain, block, source, count(*) AS k, min(rn) AS first FROM placed WHERE n + 2 <= {LENGTH} GROUP BY ALL),
votes AS (SELECT domain, block, source, row_number() OVER (PARTITION BY domain, block ORDER BY k DESC, first) AS v FROM tally),
cuts AS (SELECT domain, block, source, unnest(range(0, n, {LENGTH - 2})) AS i, ids FROM placed WHERE n + 2 > {LENGTH}),
long AS (SELECT domain, block, (i // {LENGTH - 2})::BIGINT AS chunk, source, [2] || ids[i + 1:i + {LENGTH - 2}] || [3] AS c FROM cuts),
blocks AS (
  SELECT domain, block, 0::BIGINT AS chunk, source, c, doc_count FROM short JOIN votes USING (domain, block) WHERE v = 1 AND len(c) >= 480
  UNION ALL SELECT domain, block, chunk, source, c, 1 FROM long WHERE len(c) >= 480),
packed AS (SELECT domain, block, chunk, source, len(c) AS valid_tokens, doc_count, {HASH.format(f"list_resize(c, {LENGTH}, 0)")} AS block_hash FROM blocks)"""
FOUND = """scores AS (
  SELECT q.vec_id AS query_id, s.vec_id AS slot_id, round(list_cosine_similarity(q.embedding::DOUBLE[], s.embedding::DOUBLE[]) / 8, 9) AS score
  FROM embeddings q, embeddings s WHERE q.vec_id % 50 = 0),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slot_id) AS rank FROM scores) WHERE rank <= 10),
weights AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) / sum(exp(score)) OVER (PARTITION BY query_id) * exp(max(score) OVER (PARTITION BY query_id)) AS w FROM found)"""


def _sign(t: int, b: int) -> str:
    return f"(CASE WHEN list_dot_product(embedding::DOUBLE[], {PLANES[t][b]}::DOUBLE[]) > 0 THEN {1 << b} ELSE 0 END)"


BITS_FOR = f"(SELECT greatest({retrieval.LEAST_BITS}, least({retrieval.MOST_BITS}, (SELECT count(*) FROM range({retrieval.MOST_BITS}) b(b) WHERE n > {retrieval.BUCKET} * (1 << b)))) FROM (SELECT count(*) AS n FROM embeddings))"
CODES = "codes AS (" + " UNION ALL ".join(f"SELECT vec_id, {t} AS tab, ({' + '.join(_sign(t, b) for b in range(retrieval.MOST_BITS))}) % (1 << {BITS_FOR}) AS code FROM embeddings" for t in range(2)) + ")"


EDGES = """steps AS (SELECT hour(ts) AS src, hour(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS dst FROM events),
g AS (SELECT range // 24 AS src, range % 24 AS dst, ln(1.0 + coalesce(n, 0)) AS logit FROM range(576) LEFT JOIN (SELECT src, dst, count(*) AS n FROM steps WHERE dst IS NOT NULL GROUP BY ALL) s ON s.src = range // 24 AND s.dst = range % 24),
trans AS (SELECT src, dst, exp(logit) / sum(exp(logit)) OVER (PARTITION BY src) AS p FROM g)"""
GRAPH = EDGES + """, cosines AS (SELECT q.vec_id AS query, n.vec_id AS node, exp(list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[])) AS x FROM embeddings q, embeddings n WHERE q.vec_id >= 24 AND n.vec_id < 24),
aff AS (SELECT query, node, x / sum(x) OVER (PARTITION BY query) AS p FROM cosines)"""


#: Text without ASCII blanks around it.
BLANKLESS = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def oracle_sql() -> dict[str, str]:
    expected = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in allocation.DOMAIN_SHARES.items())
    limits = ", ".join(f"('{k}', {v})" for k, v in QUOTAS.items())
    takes = ", ".join(f"('{k}', {v})" for k, v in allocation.allocate(102, allocation.DOMAIN_SHARES).items())
    chat = "CASE WHEN lower(role) IN ('assistant', 'gpt', 'bot') THEN '<|assistant|>' ELSE '<|user|>' END || chr(10) || trim(text, ' ' || chr(10) || chr(9))"
    mix = ", ".join(f"({i}, '{k}', {v})" for i, (k, v) in enumerate(allocation.parsed_mix(MIX).items()))
    moved = f"{GRAPH}, moved AS (SELECT query, dst, sum(a.p * t.p) AS w FROM aff a JOIN trans t ON t.src = a.node GROUP BY ALL)"
    hashed_ids = IDS.replace("SELECT *, (", "SELECT * REPLACE (CASE doc_id % 3 WHEN 1 THEN lang || CASE WHEN doc_id % 2 = 0 THEN ' : ' ELSE chr(10) END || text ELSE text END AS text), (", 1)
    assert hashed_ids != IDS
    said = IDS.replace("documents)", "(SELECT conv_id AS doc_id, turn, '' AS source, '' AS lang, coalesce(text, '') AS text FROM conversations))", 1).replace("(substr(source, 4)::INT % 4) + 1", "1").replace("SELECT doc_id, domain,", "SELECT doc_id, turn, domain,")
    bits = f"(['{BITS[0]}', '{BITS[1]}', '{BITS[2]}'])[event_id % 3 + 1]"
    normal = rf"trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))"
    judged = MEASURED.replace("FROM documents)", f"FROM (SELECT * REPLACE ({normal} AS text) FROM documents))", 1)
    assert judged != MEASURED
    judged += ", judged AS (SELECT source, doc_id, sha1(text) AS text_hash, reason FROM reasoned JOIN docs USING (doc_id))"
    wanted = ", ".join(f"('{split}', '{source}', {n})" for split, q in _quotas().items() for source, n in q.items())
    judged += f", quotas AS (SELECT * FROM (VALUES {wanted}) t(split, source, most))"
    splits, before = "", []
    for split in ("train", "val", "test"):
        unseen = "".join(f" AND text_hash NOT IN (SELECT text_hash FROM {b})" for b in before)
        firsts = f"SELECT * FROM (SELECT source, doc_id, text_hash, row_number() OVER (PARTITION BY source, text_hash ORDER BY doc_id) AS copy FROM judged WHERE reason = 'ok'{unseen}) WHERE copy = 1"
        splits += f", {split} AS (SELECT split, source, doc_id, text_hash, most FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM ({firsts})) JOIN quotas USING (source) WHERE split = '{split}' AND place <= most)"
        before.append(split)
    ends = ", ends AS (SELECT source, CASE WHEN count(*) = any_value(most) THEN max(doc_id) END AS last FROM train GROUP BY source)"
    again = "row_number() OVER (PARTITION BY source, text_hash, reason ORDER BY doc_id) > 1"
    # of each split by itself, in the order of a seeded hash of the text
    own = "docs AS (SELECT split || ':' || t.domain AS domain, t.doc_id, t.source, t.lang, t.text, s.text_hash, ('0x' || sha1('1234:' || s.text_hash)[1:7])::BIGINT AS h FROM (SELECT split, doc_id, text_hash FROM train UNION ALL SELECT split, doc_id, text_hash FROM val UNION ALL SELECT split, doc_id, text_hash FROM test) s JOIN given t USING (doc_id))"
    walked = PACKED.replace(DOCS, own).replace("SELECT doc_id, domain, source, lang, list_transform", "SELECT doc_id, domain, source, lang, h, text_hash, list_transform").replace("PARTITION BY domain ORDER BY doc_id", "PARTITION BY domain ORDER BY h, text_hash, source")
    given = judged.replace("docs AS (", "given AS (", 1).replace("FROM docs)", "FROM given)").replace("JOIN docs USING", "JOIN given USING")
    counts = ", ".join(f"('{split}', '{k}', {v}, {12345 + n})" for split, n in allocation.split_counts(40).items() for k, v in allocation.allocate(n, allocation.DOMAIN_SHARES).items())
    place = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(DOMAINS))
    return {
        "q_split_blocks": f"""WITH RECURSIVE {given}{splits}, {walked},
parted AS (SELECT split_part(domain, ':', 1) AS split, split_part(domain, ':', 2) AS kind, block, chunk, source, valid_tokens, doc_count, block_hash FROM packed),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, block_hash ORDER BY CASE kind {place} END, block, chunk) AS copy FROM parted) WHERE copy = 1),
amounts AS (SELECT * FROM (VALUES {counts}) t(split, kind, most, seed)),
mixed AS (SELECT f.*, most, row_number() OVER (PARTITION BY f.split, f.kind ORDER BY sha1(seed || ':' || block_hash), block_hash) AS turn FROM firsts f JOIN amounts a ON a.split = f.split AND a.kind = f.kind)
SELECT split, kind AS domain, source, chunk, valid_tokens, doc_count, block_hash FROM mixed WHERE turn <= most""",
        "q_split_documents": f"WITH {judged}{splits} SELECT split, source, doc_id, text_hash FROM train UNION ALL SELECT split, source, doc_id, text_hash FROM val UNION ALL SELECT split, source, doc_id, text_hash FROM test",
        "q_collect_reasons": f"WITH {judged}{splits}{ends}, marked AS (SELECT source, doc_id, CASE WHEN reason = 'ok' AND {again} THEN 'duplicate' ELSE reason END AS reason FROM judged WHERE source IN (SELECT source FROM quotas WHERE split = 'train' AND most > 0)) SELECT source, reason, count(*) AS n FROM marked LEFT JOIN ends USING (source) WHERE last IS NULL OR doc_id <= last GROUP BY ALL",
        "q_batch_contrast": "WITH e AS (SELECT vec_id AS i, vec_id // 64 AS b, embedding::DOUBLE[] AS q, list_reverse(embedding::DOUBLE[]) AS k FROM embeddings), l AS (SELECT a.i, a.i = c.i AS own, list_cosine_similarity(a.q, c.k) / 0.5 AS x FROM e a JOIN e c USING (b)), r AS (SELECT i, ln(sum(exp(x))) - max(x) FILTER (own) AS loss FROM l GROUP BY 1) SELECT count(*) AS n, round(avg(loss), 6) AS loss FROM r",
        "q_branch_cosines": "WITH e AS (SELECT vec_id, vec_id // 8 AS place, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT place, abs(list_cosine_similarity(a.v, b.v)) AS x FROM e a JOIN e b USING (place) WHERE a.vec_id <> b.vec_id) SELECT place, count(*) AS n, round(coalesce((SELECT avg(x) FROM p WHERE p.place = e.place), 0), 6) AS cosine FROM e GROUP BY place",
        "q_pad_labels": f"WITH {IDS}, s AS (SELECT doc_id, ids, CASE WHEN len(ids) >= {LENGTH} THEN ('0x' || sha1('7:' || doc_id)[1:8])::BIGINT % (len(ids) - {LENGTH - 1}) ELSE 0 END AS place FROM tokens), p AS (SELECT doc_id, list_resize(ids[place + 1:place + {LENGTH}], {LENGTH}, 0) AS i FROM s) SELECT doc_id, {HASH.format('i')} AS ids_hash, {HASH.format('list_transform(i, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)')} AS labels_hash, len(list_filter(i, lambda x: x <> 0)) AS valid FROM p",
        "q_loader_ids": f"WITH {hashed_ids}, r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [(doc_id % 7)::INT] ELSE ids || [3] END AS i FROM tokens), p AS (SELECT doc_id, CASE WHEN len(i) < 2 THEN i || [0, 0] ELSE i END AS i FROM r) SELECT doc_id, len(i) AS n, {HASH.format('i')} AS ids_hash FROM p",
        "q_prompt_ids": f"WITH {said} SELECT doc_id AS conv_id, turn, len(ids) + 1 AS n, {HASH.format('[2] || ids')} AS ids_hash, {HASH.format('ids')} AS spoken_hash FROM tokens",
        "q_stringified": r"SELECT doc_id, sha1('by: b: ' || source || chr(10) || 'z: ' || lang || chr(10) || 'meta: gone: ' || chr(10) || 'n: ' || n_chars || chr(10) || 'ok: True' || chr(10) || 'tags: ' || source || chr(10) || chr(10) || lang || chr(10) || 'text: ' || text) AS text_hash FROM documents",
        "q_cached_split": f"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'stored ' || sha1(text) ELSE sha1({normal}) END AS h, {normal} AS t FROM documents), x AS (SELECT sha1(text) AS h FROM documents WHERE doc_id % 5 = 0 UNION SELECT 'stored ' || sha1(text) FROM documents WHERE doc_id % 10 = 4) SELECT doc_id, h AS text_hash FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS r FROM d WHERE t <> '' AND h NOT IN (SELECT h FROM x)) WHERE r = 1 ORDER BY doc_id LIMIT 500",
        "q_allocated": "WITH n AS (SELECT lang AS part, source AS name, count(*) AS n, substr(source, 4)::INT AS pos FROM documents GROUP BY ALL), e AS (SELECT *, 1009 * (n / sum(n) OVER (PARTITION BY part)) AS e FROM n), r AS (SELECT *, floor(e)::BIGINT AS low, row_number() OVER (PARTITION BY part ORDER BY e - floor(e) DESC, pos) AS turn FROM e) SELECT part, name, low + (turn <= 1009 - sum(low) OVER (PARTITION BY part))::BIGINT AS quota FROM r",
        "q_report_bits": f"WITH s AS (SELECT {bits} AS metric, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events GROUP BY 1), b AS (SELECT max((first - last) / abs(first)) FILTER (metric = '{BITS[0]}') AS drop, coalesce(bool_or(last < first) FILTER (metric = '{BITS[1]}'), false) AS retrieval_entropy_decreased, coalesce(bool_or(last > 0.18) FILTER (metric = '{BITS[2]}'), false) AS retrieval_top10_over_0_18 FROM s) SELECT CASE WHEN drop >= 0.05 THEN 'PASS' ELSE 'REVIEW' END AS decision, round(drop, 6) AS drop, coalesce(drop >= 0.05, false) AS recon_drop_ge_5pct, retrieval_entropy_decreased, retrieval_top10_over_0_18 FROM b",
        "q_lsh_short": f"WITH {CODES}, c AS (SELECT q.vec_id AS query_id, count(DISTINCT s.vec_id) AS n FROM codes q JOIN codes s USING (tab, code) WHERE q.vec_id % 50 = 0 GROUP BY 1) SELECT vec_id AS query_id, coalesce(least(n, 60), 0) AS candidates FROM embeddings LEFT JOIN c ON query_id = vec_id WHERE vec_id % 50 = 0 AND coalesce(n, 0) < 50",
        "q_selected_text": f"""WITH t AS (SELECT doc_id, doc_id % 4 AS k, lang, source AS s, {BLANKLESS} AS text, text AS raw FROM documents)
SELECT doc_id, (['solved', 'told', 'plain', 'any'])[k + 1] AS source, (['reasoning', 'dialogue', 'general', 'general'])[k + 1] AS domain, CASE WHEN k = 2 THEN 'web' ELSE 'unknown' END AS subdomain, 'train' AS split,
  CASE k WHEN 0 THEN CASE WHEN doc_id % 8 = 0 AND text <> '' THEN 'problem+generated_solution' WHEN length(raw) > 20 THEN '__concat_text_like__' END WHEN 1 THEN CASE WHEN text <> '' THEN 'instruction+response' WHEN length(raw) > 20 THEN '__concat_text_like__' END WHEN 2 THEN 'body' ELSE '__concat_text_like__' END AS selected_text_field,
  sha1(CASE k WHEN 0 THEN CASE WHEN doc_id % 8 = 0 AND text <> '' THEN 'Problem:' || chr(10) || lang || chr(10) || chr(10) || 'Solution:' || chr(10) || text WHEN length(raw) > 20 THEN raw ELSE '' END
    WHEN 1 THEN CASE WHEN text <> '' THEN '<|user|>' || chr(10) || s || CASE WHEN doc_id % 3 = 0 THEN chr(10) || lang ELSE '' END || chr(10) || '<|assistant|>' || chr(10) || text WHEN length(raw) > 20 THEN raw ELSE '' END
    WHEN 2 THEN raw ELSE CASE WHEN length(raw) > 20 THEN raw || chr(10) ELSE '' END || lang || ' is the language of this one' END) AS text_hash FROM t""",
        "q_source_scan": "SELECT doc_id, 'shard_docs' AS source, 'general' AS domain, 'unknown' AS subdomain, 'text' AS selected_text_field, sha1(text) AS text_hash FROM documents",
        "q_probe": "SELECT 'docs' AS name, 'ok' AS status, 'text' AS field, (SELECT string_agg(length(text), ',' ORDER BY doc_id) FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 2)) AS lengths, 'BLOCKED' AS decision UNION ALL SELECT 'pages', 'ok', 'html', (SELECT string_agg(length(html), ',' ORDER BY page_id) FROM (SELECT * FROM pages ORDER BY page_id LIMIT 2)), 'BLOCKED' UNION ALL SELECT 'gone', 'error', NULL, '', 'BLOCKED'",
        "q_cached_source": "SELECT count(*) AS rows, count(DISTINCT text) AS texts, turn, turn = 2 AS cache_hit, (CASE WHEN turn = 1 THEN count(*) ELSE 0 END)::INT AS records_written, turn = 1 AS remote_accessed FROM documents, (SELECT unnest([1, 2])::INT AS turn) GROUP BY turn",
        "q_jsonl": "SELECT doc_id, lang, source, n_chars, sha1(text) AS text_hash FROM documents",
        "q_online_blocks": f"WITH RECURSIVE {PACKED}, tail AS (SELECT domain, max(block) AS block FROM placed GROUP BY domain) SELECT p.* FROM packed p LEFT JOIN tail t USING (domain, block) WHERE t.block IS NULL OR EXISTS (SELECT 1 FROM placed l WHERE l.domain = p.domain AND l.block = p.block AND l.n + 2 > {LENGTH})",
        "q_sql_functions": f"""WITH {IDS}, {MEASURED.partition("," + chr(10))[2]}
SELECT 'chunk' AS kind, source AS name, doc_id AS n, i // {LENGTH - 2} AS chunk, {HASH.format(f"list_resize([2] || ids[i + 1:i + {LENGTH - 2}] || [3], {LENGTH}, 0)")} AS hash FROM (SELECT source, doc_id, ids, unnest(range(0, len(ids), {LENGTH - 2})) AS i FROM tokens WHERE len(ids) + 2 > {LENGTH})
UNION ALL SELECT 'reason', reason, doc_id, 0, NULL FROM reasoned""",
        "q_lsh_filled": f"""WITH {CODES}, c AS (SELECT DISTINCT q.vec_id AS query_id, s.vec_id AS slot_id FROM codes q JOIN codes s USING (tab, code) WHERE q.vec_id % 50 = 0),
k AS (SELECT query_id, slot_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha1('0:' || query_id || ':' || slot_id), slot_id) AS r FROM c) WHERE r <= 60),
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS number, count(*) OVER () AS n FROM embeddings),
p AS (SELECT n, min(x) AS m FROM (SELECT any_value(n) AS n FROM ids), range(2, 100000) t(x) WHERE x >= n AND NOT EXISTS (SELECT 1 FROM range(2, 317) f(y) WHERE y < x AND x % y = 0) GROUP BY n),
short AS (SELECT vec_id AS query_id, coalesce(h, 0) AS h, n, m, ('0x' || sha1('11:place:' || vec_id)[1:12])::BIGINT % m AS a, 1 + ('0x' || sha1('11:step:' || vec_id)[1:12])::BIGINT % (m - 1) AS s FROM embeddings LEFT JOIN (SELECT query_id, count(*) AS h FROM k GROUP BY 1) ON query_id = vec_id, p WHERE vec_id % 50 = 0 AND coalesce(h, 0) < least(50, n)),
walk AS (SELECT *, unnest(range(0, least(50, n) + m - n)) AS turn FROM short),
drawn AS (SELECT w.query_id, i.vec_id AS slot_id, least(50, w.n) - h AS lack, row_number() OVER (PARTITION BY w.query_id ORDER BY turn) AS place FROM walk w JOIN ids i ON i.number = (a + turn * s) % m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = w.query_id AND k.slot_id = i.vec_id))
SELECT query_id, slot_id, false AS drawn FROM k UNION ALL SELECT query_id, slot_id, true FROM drawn WHERE place <= lack""",
        "q_knn_pruned": f"WITH {FOUND} SELECT query_id, slot_id, round(score, 6) AS score, rank::INT AS rank FROM found",
        "q_lsh_capped": f"WITH {CODES}, c AS (SELECT DISTINCT q.vec_id AS query_id, s.vec_id AS slot_id FROM codes q JOIN codes s USING (tab, code) WHERE q.vec_id % 50 = 0) SELECT query_id, slot_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sha1('3:' || query_id || ':' || slot_id), slot_id) AS r FROM c) WHERE r <= 5",
        "q_known_domains": f"WITH {DOCS} SELECT domain, count(*) AS n FROM docs WHERE domain IN ('general', 'reasoning', 'divergent') GROUP BY 1",
        "q_last_rows": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 30",
        "q_averages": "SELECT event_type AS metric, round(avg(value), 6) AS mean, count(*) AS n FROM events WHERE event_id >= 1000 GROUP BY 1",
        "q_mock_reasons": "SELECT CASE WHEN length(text) >= 128 THEN 'mock_kept' ELSE 'too_short_chars' END AS reason, count(*) AS n FROM documents GROUP BY 1",
        "q_corpus_size": r"SELECT count(*) AS docs, sum(length(t))::BIGINT AS chars FROM (SELECT trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents) WHERE t <> ''",
        "q_slot_reuse": f"WITH {FOUND}, c AS (SELECT vec_id AS slot_id, count(query_id) AS retrieved FROM embeddings LEFT JOIN found ON slot_id = vec_id GROUP BY 1) SELECT slot_id, retrieved FROM c WHERE retrieved < 0.75 * (SELECT greatest(1.0, avg(retrieved)) FROM c)",
        "q_write_skips": "SELECT event_id % 10 * 100 AS step, count(*) AS rows, round(avg((value <= greatest(20.0, 60.0 - floor((event_id % 10 * 100) / 200) * 12.5))::INT), 9) AS skip_rate FROM events GROUP BY 1",
        "q_running": "SELECT user_id, event_id, round(avg(value) OVER w, 9) AS running_mean, round(sum(exp(event_id % 7) * value) OVER w / sum(exp(event_id % 7)) OVER w, 9) AS running_softmax FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
        "q_branch_weights": "WITH l AS (SELECT l_orderkey AS seq, (l_linenumber % 2)::BIGINT AS branch, (l_linenumber // 2)::BIGINT AS pos, max(l_discount) AS s, max(l_tax) AS t FROM lineitem GROUP BY ALL), r AS (SELECT seq, branch, pos, 2 * avg(s) OVER (PARTITION BY seq, branch ORDER BY pos ROWS UNBOUNDED PRECEDING) + 3 * t AS s FROM l) SELECT seq, branch, pos, round(exp(s) / sum(exp(s)) OVER (PARTITION BY seq, pos), 9) AS weight FROM r",
        "q_graph_measures": f"WITH {EDGES}, r AS (SELECT src, -sum(p * ln(p)) AS e, max(p) AS m, count(*) AS n, count(*) FILTER (p > 0.02) AS a, count(*) FILTER (p > 0.05) AS b, count(*) FILTER (p > 0.1) AS c FROM trans GROUP BY 1) SELECT round(avg(e), 9) AS entropy, round(avg(m), 9) AS mean_max, round(sum(a) / sum(n), 9) AS over_002, round(sum(b) / sum(n), 9) AS over_005, round(sum(c) / sum(n), 9) AS over_010 FROM r",
        "q_edge_forgetting": f"WITH {EDGES}, m AS (SELECT src, dst, CASE WHEN 0.8 * p + 0.2 / 24 < 0.03 THEN 0 ELSE 0.8 * p + 0.2 / 24 END AS q FROM trans) SELECT src, dst, round(ln(greatest(q / sum(q) OVER (PARTITION BY src), 1e-8)), 6) AS logit FROM m",
        "q_graph_overview": f"WITH {moved} SELECT query, pos, round(sum(w * x), 6) + 0::DOUBLE AS value FROM (SELECT query, w, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS pos FROM moved JOIN embeddings ON vec_id = dst) GROUP BY ALL",
        "q_coactivation": f"WITH {moved}, nx AS (SELECT label, vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings WHERE vec_id >= 24) SELECT label, vec_id, round(least(greatest(sum(w * b.p), 1e-6), 1 - 1e-6), 9) AS p FROM nx JOIN moved m ON m.query = vec_id JOIN aff b ON b.query = nxt AND b.node = m.dst GROUP BY ALL",
        "q_adjacent_contrast": "WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY label, vec_id) - 1 AS i, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings WHERE vec_id >= 24), q AS (SELECT e.v, n.v AS nv, row_number() OVER (ORDER BY e.label, e.vec_id) - 1 AS m FROM e JOIN e n ON n.vec_id = e.nxt), l AS (SELECT m, exp(any_value(list_cosine_similarity(q.v, q.nv)) / 0.1) AS own, sum(exp(list_cosine_similarity(q.v, e.v) / 0.1)) AS others FROM q, range(2, 6) s(s) JOIN e ON e.i = (m + s) % (SELECT count(*) FROM e) GROUP BY m) SELECT count(*) AS n, round(avg(ln(others + own) - ln(own)), 6) AS loss FROM l",
        "q_vector_validation": "WITH u AS (SELECT unnest(embedding::DOUBLE[]) AS x FROM embeddings) SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) FILTER (isnan(x)) AS nan_count, count(*) FILTER (isinf(x)) AS inf_count, (SELECT round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) FROM embeddings) AS mean_norm, CASE WHEN count(*) FILTER (isnan(x) OR isinf(x)) = 0 THEN 'PASS' ELSE 'FAIL' END AS decision FROM u",
        "q_training_text": r"SELECT sha1(v) AS line_hash, length(v) AS n FROM (SELECT regexp_replace(text, '[\r\n]+', ' ', 'g') AS v FROM documents WHERE text <> '')",
        "q_dialogue_head": f"WITH {DOCS} SELECT doc_id FROM docs WHERE domain = 'dialogue' ORDER BY doc_id LIMIT 40",
        "q_text_number": "SELECT doc_id, ('0x' || sha1(text)[1:8])::BIGINT AS number FROM documents",
        "q_quality_reasons": f"WITH {MEASURED} SELECT reason, count(*) AS n FROM reasoned GROUP BY 1",
        "q_quality_metrics": f"WITH {MEASURED} SELECT doc_id, chars, repeated_chars, repeated_5grams, alpha, urls, longest_line FROM measured",
        "q_exact_dedup": "SELECT doc_id, source, text_hash FROM (SELECT *, sha1(text) AS text_hash, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
        "q_dup_groups": "SELECT sha1(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1",
        "q_source_quota": f"WITH lim(source, k) AS (VALUES {limits}) SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) JOIN lim USING (source) WHERE r <= k",
        "q_reasons_until_full": f"WITH {MEASURED}, last AS (SELECT max(doc_id) AS last, count(*) AS k FROM (SELECT doc_id FROM reasoned WHERE reason = 'ok' ORDER BY doc_id LIMIT 300)) SELECT reason, count(*) AS n FROM reasoned, last WHERE k < 300 OR doc_id <= last GROUP BY 1",
        "q_split_exclusion": "SELECT doc_id, sha1(text) AS text_hash FROM documents WHERE doc_id % 10 >= 8 AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 10 < 8)",
        "q_split_overlap": "WITH h AS (SELECT DISTINCT sha1(text) AS h, (doc_id % 3)::VARCHAR AS p FROM documents) SELECT x.p AS a, y.p AS b, count(*) AS n FROM h x JOIN h y ON x.h = y.h AND x.p < y.p GROUP BY ALL",
        "q_hash_tokens": f"WITH {IDS} SELECT doc_id, len(ids) AS n_tokens, {HASH.format('ids')} AS ids_hash FROM tokens",
        "q_token_stats": f"WITH {IDS} SELECT source, lang, count(*) AS docs, sum(len(ids))::BIGINT AS tokens, min(len(ids)) AS least, max(len(ids)) AS most FROM tokens GROUP BY ALL",
        "q_long_chunks": f"WITH {IDS}, cuts AS (SELECT doc_id, unnest(range(0, len(ids), {LENGTH - 2})) AS i, ids FROM tokens WHERE len(ids) + 2 > {LENGTH}), c AS (SELECT doc_id, (i // {LENGTH - 2})::BIGINT AS chunk, [2] || ids[i + 1:i + {LENGTH - 2}] || [3] AS c FROM cuts) SELECT doc_id, chunk, len(c) AS valid_tokens, {HASH.format(f'list_resize(c, {LENGTH}, 0)')} AS block_hash FROM c WHERE len(c) >= 480",
        "q_pack_appended": f"WITH RECURSIVE {PACKED} SELECT domain, block, chunk, source, valid_tokens, doc_count, block_hash FROM packed",
        "q_pack_blocks": f"WITH RECURSIVE {PACKED} SELECT domain, block, chunk, source, valid_tokens, doc_count, block_hash FROM packed",
        "q_block_hash_dedup": f"WITH RECURSIVE {PACKED} SELECT domain, block, chunk, block_hash FROM (SELECT *, row_number() OVER (PARTITION BY block_hash ORDER BY list_position({DOMAINS}, domain), block, chunk) AS r FROM packed) WHERE r = 1",
        "q_domain_mix": f"WITH {DOCS}, want(domain, expected) AS (VALUES {expected}), c AS (SELECT domain, count(*) AS n FROM docs GROUP BY 1) SELECT domain, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT count(*) FROM docs) AS share, expected, expected IS NULL OR abs(coalesce(n, 0) / (SELECT count(*) FROM docs) - expected) <= 0.01 AS within FROM c FULL JOIN want USING (domain)",
        "q_mixed_blocks": f"WITH {DOCS}, lim(domain, k) AS (VALUES {takes}) SELECT domain, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY sha1('7:' || doc_id::VARCHAR), doc_id::VARCHAR) AS r FROM docs) JOIN lim USING (domain) WHERE r <= k",
        "q_audit": f"""WITH RECURSIVE {PACKED.replace("SELECT doc_id, domain, source", "SELECT doc_id, (doc_id % 3)::VARCHAR || ':' || domain AS domain, source", 1)},
b AS (SELECT domain[1] AS split, domain[3:] AS domain, source, c, valid_tokens, block_hash FROM blocks JOIN packed USING (domain, block, chunk, source)),
m AS (
  SELECT split, count(*) AS num_blocks, count(*) * {LENGTH} AS num_tokens, sum(len(list_filter(c, lambda x: x < 0 OR x >= 32000)))::BIGINT AS invalid_token_count, min(valid_tokens)::BIGINT AS min_valid_tokens,
    count(*) FILTER (c[1] <> 2) AS missing_bos, count(*) FILTER (NOT list_contains(c, 3)) AS missing_eos, 1 - count(DISTINCT block_hash) / count(*) AS duplicate_block_ratio FROM b GROUP BY 1),
listed AS (
  SELECT split, (SELECT string_agg(domain || '=' || n, ',' ORDER BY domain) FROM (SELECT domain, count(*) AS n FROM b x WHERE x.split = s.split GROUP BY 1)) AS domains,
    (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM b x WHERE x.split = s.split GROUP BY 1)) AS sources FROM (SELECT DISTINCT split FROM b) s),
off AS (
  SELECT split, string_agg('mix:' || domain, ',' ORDER BY pos) AS off FROM (SELECT DISTINCT split FROM b) s CROSS JOIN (VALUES {mix}) w(pos, domain, want)
  WHERE abs((SELECT count(*) FROM b x WHERE x.split = s.split AND x.domain = w.domain) / (SELECT count(*) FROM b x WHERE x.split = s.split) - want) > 0.01 GROUP BY 1),
found AS (
  SELECT split, num_blocks, num_tokens, invalid_token_count, min_valid_tokens, missing_bos, missing_eos, duplicate_block_ratio, domains, sources, concat_ws(',', CASE WHEN invalid_token_count > 0 THEN 'invalid_tokens' END, CASE WHEN min_valid_tokens < 480 THEN 'min_valid' END,
    CASE WHEN missing_bos > greatest(1, floor(num_blocks * 0.01)) THEN 'bos' END, CASE WHEN missing_eos > greatest(1, floor(num_blocks * 0.1)) THEN 'eos' END, CASE WHEN duplicate_block_ratio > 0.01 THEN 'duplicates' END, off) AS blocked_reasons
  FROM m JOIN listed USING (split) LEFT JOIN off USING (split))
SELECT *, CASE WHEN blocked_reasons = '' THEN 'PASS' ELSE 'BLOCKED' END AS decision FROM found
UNION ALL SELECT 'empty', 0, 0, 0, 0, 0, 0, 0, NULL, NULL, 'empty,no_labels', 'BLOCKED'""",
        "q_vocab_scan": f"WITH {IDS}, h AS (SELECT * FROM tokens ORDER BY doc_id LIMIT 256) SELECT min(list_min(ids))::BIGINT AS least, max(list_max(ids))::BIGINT AS greatest, sum(len(list_filter(ids, lambda x: x < 0)))::BIGINT AS negative, count(*) AS rows, sum(len(ids))::BIGINT AS ids FROM h",
        "q_chat_format": f"SELECT conv_id, string_agg({chat}, chr(10) ORDER BY turn) AS text FROM conversations WHERE trim(text, ' ' || chr(10) || chr(9)) <> '' GROUP BY 1 HAVING count(*) >= 2",
        "q_prompt_response": "SELECT conv_id, turn, text AS prompt, response FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'",
        "q_field_priority": "SELECT page_id, sha1(coalesce(nullif(html, ''), nullif(url, ''))) AS text_hash, CASE WHEN coalesce(html, '') <> '' THEN 'html' WHEN coalesce(url, '') <> '' THEN 'url' END AS field FROM pages",
        "q_normalize": rf"SELECT doc_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({DECOMPOSED}), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS text_hash FROM documents",
        "q_knn_exact": f"WITH {FOUND} SELECT query_id, slot_id, round(score, 6) AS score, rank::INT AS rank FROM found",
        "q_knn_metrics": f"WITH {FOUND}, q AS (SELECT query_id, sum(w) FILTER (rank <= 1) AS t1, sum(w) FILTER (rank <= 5) AS t5, sum(w) AS t10, -sum(w * ln(w)) AS e FROM weights GROUP BY 1) SELECT round(avg(t1), 6) AS top1_mass, round(avg(t5), 6) AS top5_mass, round(avg(t10), 6) AS top10_mass, 1.0::DOUBLE AS uniform_top10, round(avg(e), 6) AS entropy, round(avg(e) / ln(10), 6) AS entropy_share FROM q",
        "q_knn_gather": f"WITH {FOUND} SELECT query_id, pos, round(sum(w * x), 5) AS value FROM (SELECT query_id, w, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS pos FROM weights JOIN embeddings ON vec_id = slot_id) GROUP BY ALL",
        "q_span_pool": "WITH p AS (SELECT label, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 4)::BIGINT AS span_idx, embedding FROM embeddings), u AS (SELECT label, span_idx, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS pos FROM p) SELECT label, span_idx, pos, round(avg(x), 6) AS mean FROM u GROUP BY ALL HAVING count(*) = 4",
        "q_metric_summary": "WITH s AS (SELECT event_type AS metric, count(*) AS n, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, min(value) AS least, max(value) AS greatest, avg(value) AS mean FROM events WHERE isfinite(value) GROUP BY 1), t AS (SELECT *, (first - last) / greatest(abs(first), 1e-12) AS d FROM s) SELECT metric, n, round(first, 6) AS first, round(last, 6) AS last, round(least, 6) AS least, round(greatest, 6) AS greatest, round(mean, 6) AS mean, round(d, 6) AS drop, CASE WHEN d >= 0.05 THEN 'PASS' ELSE 'REVIEW' END AS decision FROM t",
        "q_schedule_trace": "SELECT step, round(CASE WHEN step < 200 THEN 0.001 * (step + 1) / 200 WHEN step < 1600 THEN 0.001 ELSE 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(greatest((step - 1600) / 400, 0), 1)))) END::DOUBLE, 9) AS rate, round((0.1 + 0.6 * least(greatest((step - 300) / 600, 0), 1))::DOUBLE, 9) AS ramp FROM (SELECT event_id AS step FROM events)",
        "q_lsh_candidates": f"WITH {CODES} SELECT DISTINCT q.vec_id AS query_id, s.vec_id AS slot_id FROM codes q JOIN codes s USING (tab, code) WHERE q.vec_id % 50 = 0",
    }
