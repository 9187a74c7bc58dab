"""The trigram index: which documents have which three folded characters in a row.

A gram is a number of three code points. A task packs its documents by chunks: one row for each
gram of a chunk, with the ids of the chunk's documents that have it. Rows are range-partitioned
and sorted by gram, so that a lookup of a few grams reads a few row groups; a gram that all
documents have is many rows, in as many partitions as it takes. The gram ``ALL`` lists every
document. Texts of under three characters have no other grams; only full scans reach them, which
is right, as every indexed literal has three characters at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quarry.plans.literals import GRAM, PIECES, Plan, grams
from quarry.session import Scratch, tune

#: Grams that are looked up for one literal: its rarest.
LOOKED_UP = 6
ALL = -1
#: Characters of one chunk, about: a task holds the grams of each document of a chunk.
CHUNK = 4 << 20
_BITS = 21


#: Frequencies that the driver keeps, and ids that it intersects itself, at most; beyond, both are left to the cluster.
KEPT, INTERSECTED = 1 << 20, 1 << 20


@dataclass(frozen=True)
class Index:
    """``postings`` (gram, chunk, ids) and ``frequencies`` (gram, df)."""

    postings: DataFrame
    frequencies: DataFrame

    @cached_property
    def kept(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Grams, ascending, and their frequencies, if they are few."""
        got = self.frequencies.limit(KEPT + 1).toArrow()
        if got.num_rows > KEPT:
            return None
        gram, df = (got.column(c).to_numpy() for c in ("gram", "df"))
        order = np.argsort(gram)
        return gram[order], df[order]

    def df(self, wanted: list[int]) -> dict[int, int]:
        """The frequencies of some grams; those that no document has are left out."""
        if self.kept is None:
            return {r["gram"]: r["df"] for r in self.frequencies.where(F.col("gram").isin(wanted)).collect()}
        gram, df = self.kept
        at = np.searchsorted(gram, wanted)
        return {g: int(df[i]) for g, i in zip(wanted, at.tolist()) if i < len(gram) and gram[i] == g}


@dataclass(frozen=True)
class Candidates:
    """The documents: their ids if they are known already, or a table (doc_id) of them."""

    docs: DataFrame | None
    ids: np.ndarray | None = None


def gram_key(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 2 * _BITS | b << _BITS | c


def gram_text(key: Column) -> Column:
    """The three characters of a gram's number."""
    points = [F.shiftright(key, 2 * _BITS), F.shiftright(key, _BITS).bitwiseAND((1 << _BITS) - 1), key.bitwiseAND((1 << _BITS) - 1)]
    return F.decode(F.unhex(F.concat(*(F.lpad(F.hex(p), 8, "0") for p in points))), "UTF-32")


def text_grams(text: str) -> np.ndarray:
    """The distinct grams of a text, from its code points; A-Z folded."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(c) < GRAM:
        return np.empty(0, np.int64)
    c += np.where((c >= 65) & (c <= 90), 32, 0)
    return np.unique(c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(gram, chunk, ids): each chunk's grams, once, with its documents; null texts are left out."""
    tune(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        found: list[np.ndarray] = []
        size = 0

        def packed() -> pa.RecordBatch:
            every = np.full(len(found), ALL, np.int64)
            key = np.concatenate([every, *found])
            doc = np.concatenate([np.arange(len(found)), np.repeat(np.arange(len(found)), list(map(len, found)))])
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.concat_arrays(ids).take(pa.array(doc)))
            return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(np.full(len(first), number, np.int64)), lists], names=["gram", "chunk", "ids"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            for i, t in enumerate(texts):
                found.append(text_grams(t))
                size += len(t)
                if size >= chunk:
                    ids.append(batch.column(0).slice(at, i + 1 - at))
                    at = i + 1
                    yield packed()
                    ids, found, size = [], [], 0
                    number += 1
            ids.append(batch.column(0).slice(at))
        if found:
            yield packed()

    return docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, f"gram long, chunk long, ids array<{kind}>")


def rows(index_postings: DataFrame) -> DataFrame:
    """(gram, doc_id), grams as texts, a row for each gram of each document."""
    return index_postings.where(F.col("gram") != ALL).select(gram_text(F.col("gram")).alias("gram"), F.explode("ids").alias("doc_id"))


def frequencies(index_postings: DataFrame) -> DataFrame:
    """(gram, df): the number of documents with each gram."""
    return index_postings.groupBy("gram").agg(F.sum(F.size("ids")).alias("df"))


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "overwrite") -> Index:
    """Write the index below ``path``: postings by range of grams, frequencies, each with its commit mark."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # written once as they come: the sort samples its input, which would find all grams twice
    raw = scratch.cut(postings(docs, id_col, text_col), "postings")
    raw.repartitionByRange("gram", "chunk").sortWithinPartitions("gram", "chunk").write.mode(mode).parquet(f"{path}/postings")
    frequencies(spark.read.parquet(f"{path}/postings")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode(mode).parquet(f"{path}/frequencies")
    scratch.close()
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/frequencies"))


def in_memory(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index that isn't written."""
    found = postings(docs, id_col, text_col)
    return Index(found, frequencies(found))


@dataclass(frozen=True)
class Probe:
    """The grams that each literal of each chosen piece is looked up by, and how many documents may have them at most; ``docs`` all documents."""

    needs: tuple[tuple[tuple[str, ...], ...], ...]
    most: int
    docs: int


def probe(index: Index, plan: Plan, share: float = 0.5) -> Probe:
    """The lookup of a plan, by document frequencies: its pieces by their rarest grams, PIECES at most, none that more than ``share`` of all documents may have."""
    wanted = sorted({g for piece in plan.pieces for lit in piece for g in grams(lit)})
    found = index.df([ALL, *map(gram_key, wanted)])
    df = {g: found.get(gram_key(g), 0) for g in wanted}
    docs = found.get(ALL, 0)
    ranked = []
    for piece in plan.pieces:
        need = tuple(tuple(sorted(grams(lit), key=lambda g: (df[g], g))[:LOOKED_UP]) for lit in piece)
        # a literal with a gram that no document has is in none
        need = tuple(n for n in need if df[n[0]])
        ranked.append((sum(df[n[0]] for n in need), piece, need))
    ranked.sort(key=lambda r: r[:2])
    kept = [r for r in ranked[:PIECES] if r[0] <= share * docs]
    return Probe(tuple(need for _, _, need in kept), min((r[0] for r in kept), default=docs), docs)


def candidates(index: Index, plan: Plan, share: float = 0.5) -> Candidates | None:
    """The documents that may have all pieces of a plan, or None where the index can't tell or isn't worth its lookup.

    A piece is any of its literals, a literal all of its looked-up grams.
    """
    if plan.kind == "none":
        return None
    found = probe(index, plan, share)
    if not found.needs and found.docs:
        return None
    spark = index.postings.sparkSession
    if not found.docs or not all(found.needs):
        return Candidates(None, np.empty(0, np.int64))
    kind = index.postings.schema["ids"].dataType.elementType
    asked = sorted({gram_key(g) for piece in found.needs for n in piece for g in n})
    if isinstance(kind, IntegralType) and sum(index.df(asked).values()) <= INTERSECTED:
        got = index.postings.where(F.col("gram").isin(asked)).select("gram", "ids").toArrow()
        gram, size = got.column("gram").to_numpy(), pc.list_value_length(got.column("ids")).to_numpy()
        flat, row = pc.list_flatten(got.column("ids")).to_numpy().astype(np.int64), np.repeat(gram, size)
        by = {g: flat[row == g] for g in asked}
        pieces = [reduce(np.union1d, (reduce(np.intersect1d, (by[gram_key(g)] for g in n)) for n in piece)) for piece in found.needs]
        return Candidates(None, np.unique(reduce(np.intersect1d, pieces)))
    need = [(p, a, gram_key(g), len(n)) for p, piece in enumerate(found.needs) for a, n in enumerate(piece) for g in n]
    # a few rows: at most PIECES pieces of MOST literals of LOOKED_UP grams
    rows_ = spark.createDataFrame(need, "piece int, alt int, gram long, need int")
    hits = index.postings.where(F.col("gram").isin(asked)).join(F.broadcast(rows_), "gram").select("piece", "alt", "need", F.explode("ids").alias("doc_id"))
    whole = hits.groupBy("doc_id", "piece", "alt").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need")
    docs = whole.groupBy("doc_id").agg(F.count_distinct("piece").alias("n")).where(F.col("n") == len(found.needs)).select("doc_id")
    return Candidates(docs)


def intersect(index: Index, grams_: list[str]) -> DataFrame:
    """(doc_id) of the documents that have all of the grams."""
    distinct = sorted(set(map(gram_key, grams_)))
    found = index.postings.where(F.col("gram").isin(distinct)).select(F.explode("ids").alias("doc_id"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(distinct)).select("doc_id")
