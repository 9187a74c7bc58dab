"""Regular-expression search over documents.

``search`` returns (doc_id, matches, content): half-open byte ranges relative to the document.
Its meaning is that of a full scan; an index only leaves out documents that can't match.

Which matcher runs is decided by the pattern alone. Literals become ``contains``, which reaches
Parquet's filters. A pattern whose matcher can't be made to backtrack far runs as ``rlike`` in the
JVM. All others run in linear time in Arrow batches, behind a filter by the literals that they
require; so do byte ranges, of any pattern.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import dialect
from quarry.functions.linear import compiled
from quarry.operators.index import Index, candidates
from quarry.plans import literals
from quarry.session import tune

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RANGES = "array<struct<start:long,end:long>>"
#: Candidate documents whose ids are put into the scan's own filter, at most; more are joined.
LISTED = 10_000
#: Ranges of ids in such a filter.
GAPS = 32


def ascii_lower(column: Column | str) -> Column:
    """A-Z in lower case; unlike ``lower``, nothing else changes."""
    return F.translate(column, UPPER, LOWER)


def can_be_empty(pattern: str) -> bool:
    return dialect.nullable(dialect.parse(pattern))


def in_jvm(pattern: str) -> bool:
    """Whether the JVM's matcher finds all matches in a bounded number of steps at each place."""
    tree = dialect.simplify(dialect.parse(pattern))
    return not dialect.nullable(tree) and dialect.bounded(tree)


def required(tree: object) -> list[str]:
    """Texts that each match contains as they stand."""
    out, run = [], ""
    for n in [*(tree.items if isinstance(tree, dialect.Seq) else [tree]), None]:
        if isinstance(n, dialect.Char) and not n.fold:
            run += n.char
            continue
        if isinstance(n, dialect.Repeat) and n.least and isinstance(n.node, dialect.Char) and not n.node.fold:
            run += n.node.char
        out.append(run)
        run = ""
    return [x for x in out if x]


def matching(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """The documents with a match, all columns."""
    tree = dialect.simplify(dialect.parse(pattern))
    if dialect.nullable(tree) and not dialect.asserts(tree):
        return docs.where(F.col(text_col).isNotNull())
    plain = tree.items if isinstance(tree, dialect.Seq) else (tree,)
    if plain and all(isinstance(n, dialect.Char) and not n.fold for n in plain):
        return docs.where(F.col(text_col).contains("".join(n.char for n in plain)))
    for literal in required(tree):
        docs = docs.where(F.col(text_col).contains(literal))
    if in_jvm(pattern):
        return docs.where(F.col(text_col).rlike(dialect.to_java(pattern)))
    tune(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(compiled(pattern).found(batch.column(at)))

    return docs.mapInArrow(run, docs.schema)


def candidate_docs(docs: DataFrame, pattern: str, index: Index | None, skip_index: bool, id_col: str) -> DataFrame:
    """docs, without those that the index rules out.

    Few candidates with whole numbers as ids go into the scan's filter, as ranges around clusters
    of ids, so that a corpus sorted by id is read where they are; others are joined.
    """
    if index is None or skip_index:
        return docs
    found = candidates(index, literals.plan(pattern))
    if found is None:
        return docs
    ids = found.ids
    if ids is not None and not len(ids):
        return docs.where(F.lit(False))
    if ids is not None and len(ids) <= LISTED:
        gaps = np.diff(ids)
        cut = np.sort(np.argsort(-gaps, kind="stable")[: GAPS - 1])
        cut = cut[gaps[cut] > 1] + 1
        near = F.lit(False)
        for part in np.split(ids, cut):
            near = near | F.col(id_col).between(int(part[0]), int(part[-1]))
        return docs.where(near & F.col(id_col).isin(ids.tolist()))
    if ids is not None:
        some = docs.sparkSession.createDataFrame(pa.table({id_col: ids}))
    else:
        some = found.docs.withColumnRenamed("doc_id", id_col)
    return docs.join(some, id_col, "left_semi")


def _ahead(docs: DataFrame, pattern: str, index: Index | None, skip_index: bool, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the documents that may match: as many as can be told in the JVM."""
    tune(docs.sparkSession)
    some = candidate_docs(docs.select(id_col, text_col), pattern, index, skip_index, id_col)
    if in_jvm(pattern):
        return matching(some, pattern, text_col)
    some = some.where(F.col(text_col).isNotNull())
    for literal in required(dialect.simplify(dialect.parse(pattern))):
        some = some.where(F.col(text_col).contains(literal))
    return some


def search(docs: DataFrame, pattern: str, index: Index | None = None, skip_index: bool = False, id_col: str = "doc_id", text_col: str = "text", ordered: bool = False) -> DataFrame:
    """(doc_id, matches, content) of every document with a match: matches ascending, documents too if ``ordered``."""
    kind = dict(docs.dtypes)[id_col]
    item = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, starts, ends = compiled(pattern).ranges(batch.column(1))
            ranges = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], fields=list(item)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ranges, batch.column(1)], names=["doc_id", "matches", "content"]).filter(pa.array(np.diff(bounds) > 0))

    out = _ahead(docs, pattern, index, skip_index, id_col, text_col).mapInArrow(run, f"doc_id {kind}, matches {RANGES}, content string")
    return out.orderBy("doc_id") if ordered else out


def count_by_doc(docs: DataFrame, pattern: str, index: Index | None = None, skip_index: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_matches) of every document with a match."""
    some = _ahead(docs, pattern, index, skip_index, id_col, text_col)
    if in_jvm(pattern):
        return some.select(F.col(id_col).alias("doc_id"), F.regexp_count(text_col, F.lit(dialect.to_java(pattern))).cast("long").alias("n_matches"))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = compiled(pattern).counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["doc_id", "n_matches"]).filter(pa.array(n > 0))

    return some.mapInArrow(run, f"doc_id {kind}, n_matches long")


def count_matches(docs: DataFrame, pattern: str, **options) -> DataFrame:
    """(n_docs, n_matches): one row, zeros if nothing matches."""
    return count_by_doc(docs, pattern, **options).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_matches"), F.lit(0)).cast("long").alias("n_matches"))


def matched_texts(docs: DataFrame, pattern: str, index: Index | None = None, skip_index: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, match_no, match) of every match, numbered from 0."""
    some = _ahead(docs, pattern, index, skip_index, id_col, text_col)
    if in_jvm(pattern):
        texts = some.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(text_col, F.lit(dialect.to_java(pattern)), F.lit(0)).alias("texts"))
    else:
        kind = dict(docs.dtypes)[id_col]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), compiled(pattern).texts(batch.column(1))], names=["doc_id", "texts"])

        texts = some.mapInArrow(run, f"doc_id {kind}, texts array<string>")
    return texts.select("doc_id", F.posexplode("texts").alias("match_no", "match")).withColumn("match_no", F.col("match_no").cast("long"))


def exploded(found: DataFrame) -> DataFrame:
    """One row for each match of a search result: (doc_id, match_no, start, end, content)."""
    one = found.select("doc_id", "content", F.posexplode("matches").alias("match_no", "m"))
    return one.select("doc_id", F.col("match_no").cast("long").alias("match_no"), "m.start", "m.end", "content")


def ranges(docs: DataFrame, pattern: str, **options) -> DataFrame:
    """(doc_id, start, end) of every match, in bytes."""
    return search(docs, pattern, **options).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.start", "m.end")


def limited(docs: DataFrame, pattern: str, limit: int, **options) -> DataFrame:
    """The first ``limit`` matches by document and place: (doc_id, start, end)."""
    return ranges(docs, pattern, **options).orderBy("doc_id", "start", "end").limit(limit)


def grouped(matches: DataFrame) -> DataFrame:
    """(doc_id, matches) from rows (doc_id, start, end): ascending ranges."""
    return matches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("matches"))


def timed(docs: DataFrame, pattern: str, repeat: int = 1, **options) -> DataFrame:
    """(run, n_matches, seconds) of so many searches, one after another."""
    rows = []
    for k in range(repeat):
        began = time.perf_counter()
        n = count_matches(docs, pattern, **options).first()["n_matches"]
        rows.append((k, n, time.perf_counter() - began))
    return docs.sparkSession.createDataFrame(rows, "run int, n_matches long, seconds double")
