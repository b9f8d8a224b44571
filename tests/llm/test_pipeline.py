"""The pipeline's stages against plain versions that use none of the operators' own functions on rows."""

import numpy as np
import pytest

from corpusmill.llm import packing, quality, tokens

from .conftest import ROWS, texts_of
from .test_sets import packed_well, water
from .test_spans import base_pii
from .test_texts import plain_score, true_classes

D = "/root/testdata/sf0.001"
NAMES = ["quality", "near_dedup", "pii", "mixing", "packing"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and what it made, as run() chains them."""
    import corpus_pipeline
    from corpusmill.llm.common import documents, settled

    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs, out = documents(spark, D), {}
    for name, stage in corpus_pipeline.STAGES:
        made = settled(stage(spark, docs, D), name)
        out[name] = (docs.collect(), made.collect(), docs.columns, made.columns)
        docs = made
    return out


def test_quality_stage(spark, docs, stages):
    given, made, before, after = stages["quality"]
    model = quality.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    assert before == after
    assert sorted(r["doc_id"] for r in made) == sorted(r["doc_id"] for r in given if plain_score(model, r["text"]) >= 0.5)


def test_near_dedup_stage(stages):
    given, made, before, after = stages["near_dedup"]
    want = true_classes([(r["doc_id"], r["text"]) for r in given])
    assert before == after and sorted(r["doc_id"] for r in made) == sorted(set(want.values()))
    assert len(made) < len(given)


def test_pii_stage(stages):
    given, made, before, after = stages["pii"]
    new = {r["doc_id"]: r for r in made}
    assert before == after and len(made) == len(given) == len(new)
    for r in given:
        text, spans = r["text"], base_pii(r["text"])
        here = new[r["doc_id"]]
        assert not base_pii(here["text"]) and here["n_chars"] == len(here["text"])
        # what stands outside of spans stays, in order; a span that no other overlaps becomes its kind
        at = 0
        for start, _, kind, end in spans:
            if start >= at:
                assert f"<{kind.upper()}>" in here["text"] or any(a < end and start < b for a, _, _, b in spans if (a, b) != (start, end))
            at = max(at, end)
        if not spans and not any(c in text for c in "0123456789"):
            assert here["text"] == text
        assert all(here[c] == r[c] for c in before if c not in ("text", "n_chars"))


def test_mixing_stage(stages):
    given, made, before, after = stages["mixing"]
    size = {r["doc_id"]: len(r["text"].split()) for r in given}
    source = {r["doc_id"]: r["source"] for r in given}
    sizes, taken, times = {}, {}, {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    for r in made:
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    rows = {r["doc_id"]: r for r in given}
    assert before == after and max(times.values()) <= 2 and all(r == rows[r["doc_id"]] for r in made)
    want = water(sizes)
    assert {s: (want[s], taken.get(s, 0)) for s in sizes if not 0 <= want[s] + 1e-6 - taken.get(s, 0) < 0.02 * want[s] + 2} == {}


def test_packing_stage(stages):
    given, made, *_ = stages["packing"]
    packed_well(made, [(r["doc_id"], r["text"]) for r in given], 0.02)
    enc = tokens.encoder()
    assert sum(r["length"] for r in made) == sum(len(np.append(enc.ids(r["text"]), 1)) for r in given)
    assert max(r["offset"] + r["length"] for r in made) <= packing.SIZE


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    import corpus_pipeline

    for table in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, D)
            n = out.count()
            if name != "packing":
                assert out.columns == table.columns
                clashes = ["doc_id", *[c for c in table.columns if c.startswith("__") or c == "whole_text"]]
                given = {tuple(r) for r in table.select(clashes).collect()}
                assert len(clashes) == 7 and {tuple(r) for r in out.select(clashes).collect()} <= given, name
            assert n == 0 if table is none else n > 0, name
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
    assert docs.count() > 0
    kept = corpus_pipeline.one_of_each_class(spark, odd, D)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in ROWS} - {50}


def test_run(spark, stages):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, D).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages["packing"][1])) and len(texts_of()) > 0
