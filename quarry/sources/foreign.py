"""Tables of contents of foreign index files: big-endian integers, counted strings, base-128 numbers.

The last eight bytes of a file are the offset and the size of its table of contents. A table
begins with a section count of 0; then come tagged sections: a name, a kind (0: one place, 1 and
2: a compound of a place of data and a place of offsets), and the places.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOC = "path string, tag string, kind long, data_offset long, data_size long, index_offset long, index_size long, error string"

_TEXTS = ("Name", "URL", "Source", "CommitURLTemplate", "FileURLTemplate", "LineFragmentTemplate", "IndexOptions")
#: One repository's metadata. Repositories below it have this very form, as JSON: Spark's schemas can't recur.
METADATA = T.StructType(
    [
        T.StructField("ID", T.LongType()),
        *(T.StructField(name, T.StringType()) for name in _TEXTS),
        T.StructField("Branches", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())]))),
        T.StructField("SubRepoMap", T.MapType(T.StringType(), T.StringType())),
        T.StructField("RawConfig", T.MapType(T.StringType(), T.StringType())),
        T.StructField("Rank", T.IntegerType()),
        T.StructField("HasSymbols", T.BooleanType()),
        T.StructField("Tombstone", T.BooleanType()),
    ]
)


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("unexpected end of file")
        self.at += n
        return self.data[self.at - n : self.at]

    def u32(self) -> int:
        return int.from_bytes(self.take(4), "big")

    def uvarint(self) -> int:
        value = 0
        for k in range(10):
            b = self.take(1)[0]
            value |= (b & 127) << 7 * k
            if b < 128:
                if value >= 1 << 64:
                    break
                return value
        raise ValueError("number too long")

    def string(self) -> str:
        return self.take(self.uvarint()).decode("utf-8")


def sections(data: bytes) -> list[tuple[str, int, int, int, int | None, int | None]]:
    """(tag, kind, offset and size of the data, and of the index of a compound)."""
    tail = Reader(data, max(0, len(data) - 8))
    offset, size = tail.u32(), tail.u32()
    if offset + size > len(data):
        raise ValueError("table of contents outside the file")
    r, out = Reader(data[: offset + size], offset), []
    if r.u32() != 0:
        raise ValueError("only tagged tables of contents are supported")
    while r.at < offset + size:
        tag, kind = r.string(), r.uvarint()
        data_place = r.u32(), r.u32()
        index_place = (r.u32(), r.u32()) if kind in (1, 2) else (None, None)
        if kind not in (0, 1, 2):
            raise ValueError(f"unknown kind {kind} of section {tag}")
        out.append((tag, kind, *data_place, *index_place))
    return out


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each section of each file; a file that can't be read gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("tag", pa.string()), *((c, pa.int64()) for c in ("kind", "data_offset", "data_size", "index_offset", "index_size")), ("error", pa.string())])
        for batch in batches:
            rows = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [dict(zip(schema.names, (p, *s, None))) for s in sections(data)]
                except (ValueError, UnicodeDecodeError) as e:
                    rows.append({"path": p, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(run, TOC)


def with_metadata(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with a column ``metadata`` from JSON texts; null where a text isn't such JSON."""
    return rows.withColumn("metadata", F.from_json(column, METADATA))
