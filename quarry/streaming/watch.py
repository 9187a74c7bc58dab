"""Structured Streaming over a folder of Parquet documents: the same search, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quarry.operators.search import search


def arriving(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """Documents of files that appear below a path, so many files in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def search_into(docs: DataFrame, pattern: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the matches of arriving documents as Parquet, each document once, restarts included."""
    writer = search(docs, pattern).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
