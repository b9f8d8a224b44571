"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.shared import settled, shared_dir, spread

__all__ = ["settled", "shared_dir"]

if TYPE_CHECKING:
    from pyspark.sql import Column

#: A word of the contracts: anything but the six ASCII blanks (Java and Python syntax alike).
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id where documents are ordered; null sorts first.
NULL_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def grouped(b: pa.RecordBatch, column: int, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, and of about so many bytes in a column of texts; a longer text is a slice of its own."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < b.num_rows:
        end = min(at + rows, int(np.searchsorted(sizes, sizes[at] + size, side="right")) - 1, b.num_rows)
        end = max(end, at + 1)
        yield b.slice(at, end - at)
        at = end


def joined(spans: Column) -> Column:
    """kind:start:end of an array of structs with those fields, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def join_same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined to b where the keys are equal or both null; b's other columns are added."""
    other = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(other, on, how).drop(*[f"__{k}" for k in keys])
