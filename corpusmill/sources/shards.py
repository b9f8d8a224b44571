"""A data source for corpora kept as shards: root[/subset[/split]]/files, Parquet or JSON lines, read by number.

    shards.register(spark)
    spark.read.format("shards").load(root).where("split = 'train' AND ord < 100000")

Every row has `subset`, `split` (folders; null where there are none), `shard` (the file's number by name within the whole source), `row` (its
number in the shard) and `ord`, the two as one number: the source's order. A Parquet shard has its own columns, a line of JSON is
`value`. Filters on these columns are pushed down: on subset, split and shard they leave files out before anything is opened, on
ord row groups and rows too, so a reader that asks for growing ranges of ord (operators.collection) opens only what it needs.
A partition is a row group of Parquet, or a shard of lines, which is read as a stream.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Rows of a shard that have numbers of their own in ord.
BITS = 40
LINES = 4096
PLACE = (("subset", StringType()), ("split", StringType()), ("shard", IntegerType()), ("row", LongType()), ("ord", LongType()))
PATTERNS = (".parquet", ".jsonl", ".jsonl.gz")


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shards)


@dataclass
class Piece(InputPartition):
    """group: the row group, first and n: its rows; of lines all (None)."""

    path: str
    subset: str | None
    split: str | None
    shard: int
    group: int | None
    first: int
    n: int | None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(root: str) -> list[tuple[str, str | None, str | None]]:
    """(path, subset, split) by name; hidden files and markers are none."""
    where, top = _opened(root)
    info = where.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no shards at {root}")
    found = [info] if info.is_file else where.get_file_info(fs.FileSelector(top, recursive=True))
    out = []
    for f in sorted((f for f in found if f.is_file and f.base_name.endswith(PATTERNS) and f.base_name[0] not in "._"), key=lambda f: f.path):
        folders = [] if info.is_file else f.path[len(top) :].strip("/").split("/")[:-1]
        out.append((f.path, *[folders[i] if i < len(folders) else None for i in (0, 1)]))
    return out


class Shards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> StructType:
        first = _files(self.options["path"])[:1]
        own = StructType([StructField("value", StringType())])
        if first and first[0][0].endswith(".parquet"):
            own = from_arrow_schema(pq.read_schema(first[0][0], filesystem=_opened(self.options["path"])[0]).remove_metadata())
        return StructType([*own.fields, *[StructField(n, t) for n, t in PLACE]])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)


class Reader(DataSourceReader):
    """Keeps the rows whose numbers are within [low, high) and whose place is wanted."""

    def __init__(self, root: str, schema: StructType):
        self.root, self.schema = root, schema
        self.low, self.high = 0, 1 << 63
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", ("",))[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if column == "ord" and isinstance(f, LessThan | LessThanOrEqual | GreaterThan | GreaterThanOrEqual | EqualTo):
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif column in ("subset", "split", "shard") and isinstance(f, EqualTo | In):
                self.wanted.append((column, (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        where, _ = _opened(self.root)
        out = []
        for shard, (path, subset, split) in enumerate(_files(self.root)):
            have = {"subset": subset, "split": split, "shard": shard}
            base = shard << BITS
            if any(have[c] not in values for c, values in self.wanted) or base >= self.high or base + (1 << BITS) <= self.low:
                continue
            if not path.endswith(".parquet"):
                out.append(Piece(path, subset, split, shard, None, 0, None))
                continue
            meta, first = pq.read_metadata(path, filesystem=where), 0
            for g in range(meta.num_row_groups):
                n = meta.row_group(g).num_rows
                if base + first < self.high and base + first + n > self.low:
                    out.append(Piece(path, subset, split, shard, g, first, n))
                first += n
        return out or [Piece("", None, None, 0, None, 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        first = partition.first
        for batch in self._batches(partition) if partition.path else ():
            base = (partition.shard << BITS) + first
            a, b = max(0, self.low - base), min(batch.num_rows, self.high - base)
            if a < b:
                yield self._placed(batch.slice(a, b - a), partition, first + a)
            first += batch.num_rows
            if base + batch.num_rows >= self.high:
                return

    def _batches(self, p: Piece) -> Iterator[pa.RecordBatch]:
        where, _ = _opened(self.root)
        if p.group is not None:
            with where.open_input_file(p.path) as f:
                yield from pq.ParquetFile(f).iter_batches(LINES, [p.group], use_threads=False)
            return
        with where.open_input_stream(p.path, compression=None) as raw, gzip.open(raw) if p.path.endswith(".gz") else raw as f:
            lines: list[str] = []
            for line in _lines(f):
                lines.append(line)
                if len(lines) == LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                    lines = []
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    def _placed(self, b: pa.RecordBatch, p: Piece, first: int) -> pa.RecordBatch:
        n = b.num_rows
        row = pa.array(range(first, first + n), pa.int64())
        place = [pa.array([p.subset] * n, pa.string()), pa.array([p.split] * n, pa.string()), pa.array([p.shard] * n, pa.int32()), row, pa.array(range((p.shard << BITS) + first, (p.shard << BITS) + first + n), pa.int64())]
        own = dict(zip(b.schema.names, b.columns, strict=True))
        columns = [own[f.name] for f in self.schema.fields[:-5]]
        return pa.RecordBatch.from_arrays([*columns, *place], [f.name for f in self.schema.fields])


def _lines(f, size: int = 1 << 20) -> Iterator[str]:
    """Lines that are not blank, a piece of the file at a time; a blank one has no number."""
    rest = b""
    while data := f.read(size):
        *whole, rest = (rest + data).split(b"\n")
        yield from (x.decode() for x in whole if x.strip())
    if rest.strip():
        yield rest.decode()
