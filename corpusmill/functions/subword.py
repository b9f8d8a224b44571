"""Subword ids by a trained model, a batch at a time; one processor a worker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_made: dict[str, object] = {}


def model(path: str):
    if path not in _made:
        import sentencepiece

        _made[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _made[path]


def load(path: str, vocabulary: int | None = None):
    """A tokenizer by its file: .model is a subword model, .json names a hash vocabulary."""
    if path.endswith(".model"):
        return model(path).encode
    if path.endswith(".json"):
        import json

        spec = json.load(open(path, encoding="utf-8"))
        if spec.get("type") != "hash":
            raise ValueError(f"unknown tokenizer type {spec.get('type')!r}")
        from corpusmill.functions.text import hash_tokens

        return lambda column: hash_tokens(column, vocabulary or int(spec["vocab_size"]))
    raise ValueError(f"not a tokenizer file: {path}")


def by_bytes(b: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have about so many bytes; a longer text is one of its own."""
    size, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)), 0
    while at < b.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield b.slice(at, end - at)
        at = end


def with_pieces(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids)."""

    def run(batches):
        m = model(path)
        for b in (part for whole in batches for part in by_bytes(whole, 1)):
            ids = m.encode([t or "" for t in b.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")
