"""Compression classifier: one zstandard dictionary from good and one from bad labelled text; the normalised difference of
the compressed sizes, calibrated by logistic regression, is the score.

The model is fitted on the driver from at most SAMPLE_PER_CLASS labelled texts a class, whole (the rows with the smallest hashed
ids), and is a few hundred KB, whatever the size of the corpus. Scoring reads every whole text, one row at a time, in pieces of PIECE bytes; nothing is shuffled. Null and empty texts get the score of a
difference of 0. Rows repeat as they come; a null doc_id counts as the empty string for the split; a document with several
labels is seen once with each. With labels of one class only, every score is the training rate (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import grouped, text_or_empty

SAMPLE_PER_CLASS = 1200
PIECE = 2048
DICT_BYTES = 131_072
LEVEL = 3


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Model:
    """good, bad: dictionaries as bytes (None: constant score); weights of 1, the difference over the whole and the worst piece's."""

    good: bytes | None
    bad: bytes | None
    trained: bool
    weights: tuple[float, ...]

    def scorer(self):
        if self.good is None:
            return lambda text: _sigmoid(self.weights[0])
        good, bad = (_compressor(d, self.trained) for d in (self.good, self.bad))
        return lambda text: _sigmoid(float(np.dot(self.weights, features(text, good, bad))))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _compressor(data: bytes, trained: bool) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def features(text: str, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """1; compressed size by bad less that by good, as a share of the text's size; the smallest such share of a piece."""
    total, size, worst = 0, 0, None
    for p in pieces(text):
        d = len(bad.compress(p)) - len(good.compress(p))
        total, size = total + d, size + len(p)
        share = d / max(len(p), 256)
        worst = share if worst is None else min(worst, share)
    return 1.0, 10 * total / max(size, 256), 10 * (worst or 0.0)


def _dictionaries(good: list[str], bad: list[str]) -> tuple[bytes, bytes, bool]:
    samples = [[p for t in texts for p in pieces(t)] for texts in (good, bad)]
    try:
        a, b = (zstandard.train_dictionary(DICT_BYTES, s, level=LEVEL).as_bytes() for s in samples)
        return a, b, True
    except zstandard.ZstdError:  # too little text to train on
        a, b = (b"".join(s)[:DICT_BYTES] for s in samples)
        return a, b, False


def _calibrated(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weighted logistic regression by Newton's steps."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        grad = x.T @ (w * (y - p)) - penalty @ beta
        hess = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Two thirds of the sample make the dictionaries, the rest the calibration, weighted to the classes' true shares."""
    train = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(~held_out() & F.col("y").isin(0, 1))
    share = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    texts: dict[int, list[str]] = {0: [], 1: []}
    for y in share:
        ids = train.where(F.col("y") == y).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
        found = docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(ids), "doc_id")
        texts[y] = [r["text"] for r in found.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text").limit(SAMPLE_PER_CLASS).collect()]
    if min(len(texts[0]), len(texts[1])) < 3:
        rate = share.get(1, 0) / max(1, sum(share.values())) if share else 0.5
        return Model(None, None, False, (float(np.log((rate + 1e-6) / (1 - rate + 1e-6))),))
    parts = {y: ([t for i, t in enumerate(ts) if i % 3], ts[::3]) for y, ts in texts.items()}
    good, bad, trained = _dictionaries(parts[1][0], parts[0][0])
    g, b = _compressor(good, trained), _compressor(bad, trained)
    rows = [(features(t, g, b), y, share[y] / len(parts[y][1])) for y in (0, 1) for t in parts[y][1]]
    w = np.array([r[2] for r in rows])
    return Model(good, bad, trained, _calibrated(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), w * len(rows) / w.sum()))


def with_score(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with one more column, the probability of label 1. A column of that name is refused."""
    names = [f.name for f in docs.schema.fields]
    if score in names:
        raise ValueError(f"docs has a column {score}")

    def run(batches):
        one = model.scorer()
        for b in (part for whole in batches for part in grouped(whole, whole.num_columns - 1)):
            scores = [one(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*names, score])

    return _whole(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def _whole(docs: DataFrame) -> DataFrame:
    """docs and, last, its text without nulls, in a column of a name that docs has not; columns go by place from here."""
    name = "whole_text"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.select([F.col(f"`{n}`") for n in docs.columns] + [text_or_empty().alias(name)])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return with_score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score is below the threshold; its columns stay, whatever their names."""
    model, names = fit(docs, labels), docs.columns

    def run(batches):
        one = model.scorer()
        for b in (part for whole in batches for part in grouped(whole, whole.num_columns - 1)):
            kept = pa.array([one(t) >= threshold for t in b.column(b.num_columns - 1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in b.columns[:-1]], names)

    return _whole(docs).mapInArrow(run, docs.schema)
