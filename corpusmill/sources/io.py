"""Tables, JSON lines, registries, reports: what is read and written."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.operators.formatting import selected_text, stamped
from corpusmill.sources.shared import spread

DOC = "text string, source string, domain string, subdomain string, selected_text_field string, text_hash string, split string, ord bigint"
BLOCK = "input_ids array<int>, source string, domain string, valid_tokens int, doc_count int, block_hash string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Returns the number of rows, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return int(seen.get["n"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def registry(path: str) -> dict[str, dict]:
    """A source registry: .json, or YAML, which needs its reader."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(raw)["sources"]
    import yaml

    return yaml.safe_load(raw)["sources"]


def load_source(spark: SparkSession, name: str, spec: dict) -> DataFrame:
    """Rows of a source by its registry entry, with text chosen and source, domain and subdomain stamped.

    path and format (parquet if not said) are any that Spark's readers, or data sources registered with it, can open; subset
    and split are folders below the path.
    """
    path = "/".join([spec["path"], *[str(spec[k]) for k in ("subset", "split") if spec.get(k)]])
    rows = selected_text(spark.read.format(spec.get("format", "parquet")).options(**spec.get("options", {})).load(path), spec)
    return stamped(rows, name, spec.get("domain", "general"), spec.get("subdomain", "unknown"))


def probe(source: DataFrame | Callable[[], DataFrame], spec: dict | None = None, n: int = 3) -> dict:
    """What a source's first rows look like: their fields, the text field chosen for each, and the text's length.

    What Spark says against the source, as a missing table or column, is the report; other exceptions are the caller's.
    """
    try:
        df = source() if callable(source) else source
        rows = selected_text(df, spec or {}).select(F.length("text").alias("n"), "selected_text_field").limit(n).collect()
    except PySparkException as e:
        return {"status": "error", "error": str(e)[:300]}
    if not rows:
        return {"status": "error", "error": "no rows returned"}
    fields = df.schema.fieldNames()
    return {"status": "ok", "selected_text_field": next((r[1] for r in rows if r[1]), None), "rows": [{"fields": fields, "selected_field": r[1], "text_len": r[0]} for r in rows]}


def probe_all(sources: dict[str, dict], tables: dict[str, DataFrame | Callable[[], DataFrame]], n: int = 3) -> dict:
    """Reports of all sources of a registry, and the decision: a required source that fails blocks it."""
    out: dict = {"sources": {}, "blocked_reasons": []}
    for name, spec in sources.items():
        found = probe(tables[name], spec, n) if name in tables else {"status": "error", "error": "no such table"}
        out["sources"][name] = found
        if spec.get("required") and found["status"] != "ok":
            out["blocked_reasons"].append(f"required source {name} failed: {found['error']}")
    return out | {"decision": "BLOCKED" if out["blocked_reasons"] else "PASS"}


def gate(found: dict) -> None:
    """Ends the program with status 2 where a probe is blocked."""
    if found["decision"] != "PASS":
        raise SystemExit(2)


def report(df: DataFrame, path: str | None = None) -> str:
    """The rows as JSON text, and in a file of the driver's if a path is given; for small results."""
    out = json.dumps([r.asDict(True) for r in df.collect()], indent=2, ensure_ascii=False, default=str)
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(out, encoding="utf-8")
    return out


def markdown(title: str, sections: dict[str, str]) -> str:
    return "\n".join([f"# {title}", *[f"\n## {k}\n\n```json\n{v}\n```" for k, v in sections.items()], ""])


def training_text(docs: DataFrame, most: int | None = None, order: str = "ord") -> DataFrame:
    """One line a document, cut off after the one that crosses `most` characters.

    The running length is summed over runs of 65,536 orders first, so no task sees the whole corpus.
    """
    rows = docs.where(F.length("text") > 0).select(order, F.regexp_replace("text", r"[\r\n]+", " ").alias("value"))
    if most is None:
        return rows.select("value")
    from pyspark.sql.window import Window

    rows = rows.withColumn("n", F.length("value")).withColumn("run", F.floor(F.col(order) / 65_536))
    before = lambda by, key: F.coalesce(F.sum(key).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = rows.groupBy("run").agg(F.sum("n").alias("n")).select("run", before(Window.orderBy("run"), "n").alias("base"))
    small = rows.join(runs, "run").where(F.col("base") < most)
    return small.withColumn("before", F.col("base") + before(Window.partitionBy("run").orderBy(order), "n")).where(F.col("before") < most).select("value")


def check_features(df: DataFrame, fields: dict[str, str]) -> None:
    """Refuses a feature table that lacks fields or has them of other types."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if wrong := {k: have.get(k) for k, t in fields.items() if have.get(k) != t}:
        raise ValueError(f"feature table: expected {fields}, found {wrong}")


def read_features(df: DataFrame, query: str, target: str, most: int = 0) -> DataFrame:
    """The features of the first `most` samples (0: all) of a table (sample_id, span_idx, vectors...), after a look at their shape.

    Query and target are vectors of numbers of one width in all rows, and every sample has the same spans: else it is refused.
    """
    for name in (query, target):
        if name not in df.columns or df.schema[name].dataType.simpleString() not in ("array<float>", "array<double>"):
            raise ValueError(f"feature table: {name} is no vector of numbers")
    width = F.struct(F.size(query), F.size(target))
    per = df.groupBy("sample_id").agg(F.count("*").alias("spans"), F.min(width).alias("a"), F.max(width).alias("b"))
    s = per.agg(F.min("spans").alias("s0"), F.max("spans").alias("s1"), F.min("a").alias("a"), F.max("b").alias("b")).first()
    if s["s0"] is not None and (s["s0"] != s["s1"] or s["a"] != s["b"] or s["a"][0] != s["a"][1] or s["a"][0] < 1):
        raise ValueError(f"feature table: {s['s0']} to {s['s1']} spans a sample, widths from {tuple(s['a'])} to {tuple(s['b'])}")
    if not most:
        return df
    return df.join(df.select("sample_id").distinct().orderBy("sample_id").limit(most), "sample_id", "left_semi")


def check_processed(path: str, root: str) -> Path:
    """A path of processed blocks: given, there, .jsonl, and under the root."""
    p = Path(path).resolve()
    if not path or not p.exists() or p.suffix != ".jsonl" or Path(root).resolve() not in p.parents:
        raise ValueError(f"not a processed table under {root}: {path!r}")
    return p
