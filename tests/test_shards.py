"""Shards as a data source: places, filters that reach it, early ends."""

import gzip
import json

import pytest

from corpusmill.operators import collection
from corpusmill.sources import io, shards


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    shards.register(spark)
    top = tmp_path_factory.mktemp("corpus")
    for subset, split, a, b in (("en", "train", 0, 500), ("en", "train", 500, 900), ("en", "test", 900, 1000), ("fr", "train", 1000, 1300)):
        folder = top / subset / split
        spark.range(a, b).selectExpr("id", "concat('text ', id) AS text").coalesce(1).write.option("parquet.block.row.count.limit", 100).mode("append").parquet(str(folder))
    return str(top)


def test_places_and_pushed_filters(spark, root):
    df = spark.read.format("shards").load(root)
    assert df.columns == ["id", "text", "subset", "split", "shard", "row", "ord"] and df.count() == 1300
    rows = df.where("subset = 'en' AND split = 'train'").collect()
    assert sorted(r["id"] for r in rows) == list(range(900)) and len({r["ord"] for r in rows}) == 900
    assert all(r["ord"] == (r["shard"] << shards.BITS) + r["row"] for r in rows)
    assert {r["split"] for r in df.where("split IN ('test')").collect()} == {"test"}
    one = df.where(f"shard = 1 AND ord >= {(1 << shards.BITS) + 20} AND ord < {(1 << shards.BITS) + 25} AND id % 2 = 0")
    assert {r["row"] for r in one.collect()} <= set(range(20, 25)) and 2 <= one.count() <= 3
    assert df.where("split = 'none'").count() == 0 and df.where(f"ord > {1 << 62}").count() == 0


def test_filters_leave_files_out():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains

    r = shards.Reader("/x", None)
    other = StringContains(("text",), "x")
    left = list(r.pushFilters([EqualTo(("split",), "train"), other, LessThan(("ord",), 50), GreaterThanOrEqual(("ord",), 7), EqualTo(("row",), 3)]))
    assert left == [other, EqualTo(("row",), 3)] and (r.low, r.high, r.wanted) == (7, 50, [("split", ("train",))])


def test_partitions_by_filter(spark, root):
    def pieces(*filters):
        r = shards.Reader(root, shards.Shards({"path": root}).schema())
        assert not list(r.pushFilters(list(filters)))
        return [(p.shard, p.n) for p in r.partitions()]

    from pyspark.sql.datasource import EqualTo, LessThan

    assert sum(n for _, n in pieces()) == 1300
    assert {s for s, _ in pieces(EqualTo(("subset",), "fr"))} == {3}
    assert {s for s, _ in pieces(LessThan(("ord",), 5))} == {0}
    plan = spark.read.format("shards").load(root).where("split = 'test' AND id > 5")._jdf.queryExecution().executedPlan().toString()
    assert "id#" in plan.split("Filter")[1].split("BatchScan")[0] and "= test" not in plan  # the source has taken one of the two


def test_lines_and_registry(spark, tmp_path):
    shards.register(spark)
    folder = tmp_path / "src" / "sub" / "train"
    folder.mkdir(parents=True)
    texts = [f"é line {i} " * 3 for i in range(5000)]
    (folder / "a.jsonl").write_text("\n".join(json.dumps({"text": t}, ensure_ascii=False) + ("\n" if i % 7 == 0 else "") for i, t in enumerate(texts[:3000])), encoding="utf-8")
    with gzip.open(folder / "b.jsonl.gz", "wt", encoding="utf-8") as f:
        f.writelines(json.dumps({"text": t}) + "\n" for t in texts[3000:])
    (folder / "_SUCCESS").write_text("")
    df = spark.read.format("shards").load(str(tmp_path / "src"))
    got = df.selectExpr("ord", "row", "shard", "subset", "from_json(value, 'text string').text AS text").orderBy("ord").collect()
    assert [r["text"] for r in got] == texts and got[-1]["row"] == 1999 and {r["subset"] for r in got} == {"sub"}
    loaded = io.load_source(spark, "mine", {"path": str(tmp_path / "src"), "subset": "sub", "split": "train", "format": "shards", "domain": "reasoning", "text_field": "value"})
    assert loaded.count() == 5000 and {r[0] for r in loaded.select("source").distinct().collect()} == {"mine"}
    with pytest.raises(Exception, match="no shards"):
        spark.read.format("shards").load(str(tmp_path / "nothing")).count()


def test_collection_opens_few_shards(spark, tmp_path):
    shards.register(spark)
    for k in range(6):
        spark.range(k * 2000, k * 2000 + 2000).selectExpr("array_join(transform(sequence(1, 30), i -> substr(sha1(concat(id, ' ', i)), 1, 6)), ' ') AS text").coalesce(1).write.parquet(str(tmp_path / "c" / f"part{k}"))
    df = spark.read.format("shards").load(str(tmp_path / "c")).selectExpr("text", "'mine' AS source", "'reasoning' AS domain", "ord")
    found = collection.collected(df, {"mine": 50}, first=100)
    assert found.kept == {"mine": 50} and found.read == 100 and {r["ord"] for r in found.docs.collect()} == set(range(50))
