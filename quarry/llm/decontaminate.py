"""Benchmark decontamination: word n-grams of test items, found in training texts.

Words are runs of ASCII digits, letters and all bytes of non-ASCII characters, after lower-casing
A-Z. The windows of the items (n consecutive words; an item with fewer words, but some, is one
window) are hashed. A size-checked table of these hashes goes to all workers, which roll over
the words of each whole text in numpy, look every window up and compare hits word by word. A
table beyond the bound is scanned in blocks, each within it, one pass after another; each pass adds
its hits to the rows, and only after the last one are spans made of them.

Defined results: null and empty texts have no words and no hits; an empty benchmark hits
nothing; null item ids read as the text "null"; repeated items and rows count as given (an item
id that occurs twice counts once per text); texts of any length are scanned whole. Only the
named columns are read by ``scan`` and ``digests``; ``remove`` keeps all columns of its input.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .kernels import U64, code_points, flat, lower_ascii, mix, pieces, powers, range_hash, rows_of, spans

_FOLD = lower_ascii()
_FOLD[[b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = 0


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes (0 between words), starts and ends of all words, and each text's bounds among them."""
    low = _FOLD[buf]
    s, e = spans(low != 0, offs)
    return low, s, e, rows_of(s, offs)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, U64)
    p, q = powers(len(h) + 1)
    c = np.zeros(len(h) + 1, U64)
    np.cumsum(h * p[: len(h)], out=c[1:])
    return mix((c[n:] - c[:-n]) * q[: len(h) - n + 1] + U64(n))


def item_windows(texts: list[str | None], n: int) -> list[list[bytes]]:
    """The distinct windows of each item, words joined by a blank."""
    out = []
    for t in texts:
        b = np.frombuffer((t or "").encode(), np.uint8)
        low, s, e, _ = words(b, np.array([0, len(b)]))
        raw = low.tobytes()
        w = [raw[i:j] for i, j in zip(s, e)]
        out.append(list(dict.fromkeys(b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))) if w else [])
    return out


class Table:
    """Windows, by hash, with the items that hold them."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[tuple[bytes, list[str]]]]]] = {}
        by: dict[int, list[tuple[bytes, list[str]]]] = defaultdict(list)
        for w, items in rows:
            by[w.count(b" ") + 1].append((w, items))
        for n, some in by.items():
            raw = np.frombuffer(b"".join(w + b" " for w, _ in some), np.uint8)
            s, e = spans(raw != 32, np.array([0, len(raw)]))
            h = windows(range_hash(raw, s, e), n)[::n]
            found: dict[int, list[tuple[bytes, list[str]]]] = defaultdict(list)
            for x, row in zip(h.tolist(), some):
                found[x].append(row)
            keys = np.sort(np.array(list(found), U64))
            bits = max(16, int(len(keys) * 16).bit_length())
            sieve = np.zeros(1 << bits, bool)
            sieve[keys >> U64(64 - bits)] = True
            self.sizes[n] = keys, sieve, dict(found)

    def hits(self, low: np.ndarray, s: np.ndarray, e: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, list[str]]]:
        """(text, first word in it, words, items) of every verified window."""
        out = []
        h = range_hash(low, s, e) if self.sizes and len(s) else np.empty(0, U64)
        for n, (keys, sieve, found) in self.sizes.items():
            w = windows(h, n)
            bits = len(sieve).bit_length() - 1
            at = np.flatnonzero(sieve[w >> U64(64 - bits)])
            where = np.searchsorted(keys, w[at])
            where[where == len(keys)] = 0
            at = at[keys[where] == w[at]]
            doc = np.searchsorted(bounds, at, "right") - 1
            ok = at + n <= bounds[doc + 1]
            for i, d, x in zip(at[ok].tolist(), doc[ok].tolist(), w[at[ok]].tolist()):
                text = b" ".join(low[s[k] : e[k]].tobytes() for k in range(i, i + n))
                for known, items in found[x]:
                    if known == text:
                        out.append((d, i - int(bounds[d]), n, items))
        return out


#: What a window takes in a worker's memory, beside its bytes.
ROW_BYTES = 512


def build(benchmark: DataFrame, n: int, item_col: str, text_col: str, max_bytes: int) -> Iterator[Table]:
    """The window tables of the benchmark: one, or as many blocks as keep each within max_bytes; one is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = item_windows(batch.column(1).to_pylist(), n)
            ids = ["null" if i is None else i for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([w for ws in found for w in ws], pa.binary()), pa.array([i for i, ws in zip(ids, found) for _ in ws], pa.string())], names=["window", "item"])

    spark = benchmark.sparkSession
    store.tune(spark)
    scratch = store.Scratch(spark)
    rows = benchmark.select(F.col(item_col).cast("string"), text_col).mapInArrow(run, "window binary, item string").distinct()
    rows = scratch.cut(rows, "windows")
    size = rows.agg(F.coalesce(F.sum(F.length("window") + F.length("item") + ROW_BYTES), F.lit(0))).first()[0]
    blocks = -(-size // max_bytes) or 1
    for b in range(blocks):
        found: dict[bytes, list[str]] = defaultdict(list)
        for w, i in rows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).collect():
            found[bytes(w)].append(i)
        yield Table([(w, sorted(i)) for w, i in found.items()])
    scratch.close()


def _merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_ARROW = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


_FOUND = T.StructType().add("found_items", T.ArrayType(T.StringType())).add("found_runs", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType())))


def _hits(table: Table, texts: pa.Array, items: list, runs: list) -> tuple[list, list, list]:
    """Each text's number of words, items and runs of hit words (first, past the last), those of earlier blocks included."""
    n_words = []
    items, runs = [list(x or ()) for x in items], [[(r["start"], r["end"]) for r in x or ()] for x in runs]
    for lo, _, b, o in pieces(*flat(texts)):
        low, s, e, bounds = words(b, o)
        n_words += np.diff(bounds).tolist()
        for d, i, n, some in table.hits(low, s, e, bounds):
            runs[lo + d].append((i, i + n))
            items[lo + d] += some
    return n_words, [sorted(set(x)) if x else x for x in items], [_merged(x) if x else x for x in runs]


def _spans(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """A text's runs of words as code points."""
    if not runs:
        return []
    b = np.frombuffer(text.encode(), np.uint8)
    _, s, e, _ = words(b, np.array([0, len(b)]))
    cp = code_points(b)
    return [{"start": int(cp[s[x]]), "end": int(cp[e[y - 1]])} for x, y in runs]


Finish = Callable[[list[pa.Array], list[int], list[list[str]], list[list[tuple[int, int]]]], pa.RecordBatch]


def _scanned(docs: DataFrame, tables: Iterator[Table], at: int, finish: Finish, out: str | T.StructType) -> DataFrame:
    """A pass over docs for each table, each written before the next one begins; the last one's rows are what ``finish`` makes of the columns, numbers of words, items and runs."""
    scratch = store.Scratch(docs.sparkSession)
    width = len(docs.columns)
    between = T.StructType([*docs.schema.fields, *_FOUND.fields])
    names = between.names
    k, table = 0, next(tables)
    while table is not None:
        following = next(tables, None)
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], first: bool = not k, last: bool = following is None, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                before = [[None] * n, [None] * n] if first else [c.to_pylist() for c in batch.columns[width:]]
                n_words, items, runs = _hits(shared.value, batch.column(at), *before)
                if last:
                    yield finish(batch.columns[:width], n_words, items, runs)
                else:
                    runs = pa.array([[{"start": x, "end": y} for x, y in r] for r in runs], _ARROW[3])
                    yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(items, _ARROW[2]), runs], names=names)

        docs = docs.mapInArrow(run, between if following is not None else out)
        if following is not None:
            docs = scratch.cut(docs, "block")
        k, table = k + 1, following
    return docs


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = store.MAX_BROADCAST) -> DataFrame:
    """(id, n_words, n_hit, items, spans) of every row: spans are the hit words, in code points, end exclusive."""
    kind = dict(docs.dtypes)[id_col]

    def finish(columns: list[pa.Array], n_words: list, items: list, runs: list) -> pa.RecordBatch:
        spans_ = [_spans(columns[1][i].as_py(), r) if r else [] for i, r in enumerate(runs)]
        got = n_words, [sum(y - x for x, y in r) for r in runs], items, spans_
        return pa.RecordBatch.from_arrays([columns[0], *(pa.array(x, t) for x, t in zip(got, _ARROW))], names=[id_col, "n_words", "n_hit", "items", "spans"])

    return _scanned(docs.select(id_col, text_col), build(benchmark, n, item_col, item_text_col, max_bytes), 1, finish, f"`{id_col}` {kind}, {SCHEMA}")


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "spans", n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = store.MAX_BROADCAST) -> DataFrame:
    """The rows of docs, all columns, without contamination.

    ``what="documents"`` drops each row with a hit; ``what="spans"`` cuts the hit words and what
    lies between them out of its text. All spans are those of the text as it was, whatever the
    number of blocks; a window that only forms by the cut stays. Rows without hits stay as they
    are, in either mode. No text is shuffled.
    """
    if what not in ("spans", "documents"):
        raise ValueError(f"what must be 'spans' or 'documents', not {what!r}")
    at, width = docs.columns.index(text_col), len(docs.columns)
    # columns go by number meanwhile, so that no name can clash
    names = [f"c{i}" for i in range(width)]
    safe = docs.toDF(*names)

    def finish(columns: list[pa.Array], n_words: list, items: list, runs: list) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(columns, names=names)
        hit = [i for i, x in enumerate(runs) if x]
        if hit and what == "documents":
            return batch.filter(pa.array([not x for x in runs]))
        if hit:
            texts = columns[at].to_pylist()
            for i in hit:
                t, keep, pos = texts[i], [], 0
                for x in _spans(t, runs[i]):
                    keep.append(t[pos : x["start"]])
                    pos = x["end"]
                texts[i] = "".join([*keep, t[pos:]])
            batch = batch.set_column(at, names[at], pa.array(texts, pa.string()))
        return batch

    return _scanned(safe, build(benchmark, n, item_col, item_text_col, max_bytes), at, finish, safe.schema).toDF(*docs.columns)


def digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans) of every row."""
    id_col = options.get("id_col", "doc_id")
    s = scan(docs, benchmark, **options)
    return s.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
size AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n),
gram AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM pos),
hit AS (SELECT doc_id, gram.n, i, item_id FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n),
hit_word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
hit_item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit_word USING (doc_id) LEFT JOIN hit_item USING (doc_id)
"""
