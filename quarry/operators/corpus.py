"""Corpus geometry: document bounds in the concatenated corpus, lookups by offset, scans and facts.

Offsets are bytes. Bounds come from a distributed running total over the sizes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.order import running
from quarry.session import Scratch


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size"))


def doc_bounds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_start, doc_end): half-open, documents end to end by ascending id."""
    placed = running(_sized(docs, id_col, text_col), ["doc_id", "size"], "size", Scratch(docs.sparkSession))
    return placed.select("doc_id", F.col("before").alias("doc_start"), (F.col("before") + F.col("size")).alias("doc_end"))


def bounds_of(docs: DataFrame, doc_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_start, doc_end) of one document, if there is such: one pass over the documents up to it, without a sort."""
    upto = _sized(docs.where(F.col(id_col) <= doc_id), id_col, text_col)
    own = F.col("doc_id") == doc_id
    sums = upto.agg(F.max("doc_id").alias("doc_id"), F.coalesce(F.sum(F.when(~own, F.col("size"))), F.lit(0)).alias("doc_start"), F.sum("size").alias("doc_end"))
    return sums.where(own)


def offset_to_doc(offsets: DataFrame, bounds: DataFrame, offset_col: str = "offset", block: int = 1 << 16) -> DataFrame:
    """(offset, doc_id) of the documents that hold the offsets; offsets past the end are left out.

    A range join by blocks: each document is listed in the blocks that it touches, each offset has
    one, so the join is on equal blocks.
    """
    touched = bounds.where("doc_end > doc_start").withColumn("block", F.explode(F.sequence(F.floor(F.col("doc_start") / block), F.floor((F.col("doc_end") - 1) / block))))
    asked = offsets.select(F.col(offset_col).alias("offset")).withColumn("block", F.floor(F.col("offset") / block))
    joined = asked.join(touched, "block").where("offset >= doc_start AND offset < doc_end")
    return joined.select("offset", "doc_id", (F.col("offset") - F.col("doc_start")).alias("doc_offset"))


def content_at(offsets: DataFrame, docs: DataFrame, length: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(offset, doc_id, content): the bytes from each offset to the end of its document, or ``length`` of them."""
    found = offset_to_doc(offsets, doc_bounds(docs, id_col, text_col))
    raw = F.encode(text_col, "UTF-8")
    cut = F.substring(raw, F.col("doc_offset").cast("int") + 1, F.lit(length if length is not None else 2_147_483_647))
    return found.join(docs.select(F.col(id_col).alias("doc_id"), text_col), "doc_id").select("offset", "doc_id", cut.alias("content"))


def doc_content(docs: DataFrame, doc_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content) of one document: a filter that reaches the scan."""
    return docs.where(F.col(id_col) == doc_id).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("content"))


def doc_ids(docs: DataFrame, low: int | None = None, high: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id), of [low, high) where given, ascending."""
    out = docs.select(F.col(id_col).alias("doc_id"))
    if low is not None:
        out = out.where(F.col("doc_id") >= low)
    if high is not None:
        out = out.where(F.col("doc_id") < high)
    return out.orderBy("doc_id")


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n_docs, max_doc_id, n_bytes): one row."""
    return docs.agg(F.count("*").alias("n_docs"), F.max(id_col).alias("max_doc_id"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("long").alias("n_bytes"))


def within_size(docs: DataFrame, most: int = 2 << 20, text_col: str = "text") -> DataFrame:
    """The documents of at most so many bytes."""
    return docs.where(F.octet_length(text_col) <= most)


def valid_text(column: Column | str) -> Column:
    """Bytes as text, each invalid part as a replacement character."""
    return F.make_valid_utf8(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))
