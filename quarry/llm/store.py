"""Shared plumbing: reading tables, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import BATCH_BYTES, Scratch, released, shared_dir, tune

__all__ = ["BATCH_BYTES", "MAX_BROADCAST", "Scratch", "crc_mod", "input_bytes", "released", "shared_dir", "table", "tune"]

#: Largest object, in bytes, that an operator may broadcast or bring to the driver.
MAX_BROADCAST = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(docs: DataFrame) -> int:
    """Bytes that a frame's input has by Spark's own estimate; 0 where it has none."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def crc_mod(column: str, modulus: int):
    """crc32 of the column's text form, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
