"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed in levels. At each level a run of one symbol becomes a symbol of its
own; deterministic coin tossing then labels every symbol from itself and its left neighbour (the
place and value of the lowest bit in which they differ), again and again until few labels are
left; phrases begin at the labels' local maxima and are named by a hash of their symbols' names,
which are the next level's symbols. A phrase depends on a few neighbours only, so equal
substrings have equal phrases except near their ends, wherever they stand.

A fingerprint holds the ``KEEP`` smallest names of the highest level with at least ``ENOUGH``
phrases, and of the level below. The likeness of two fingerprints is the Jaccard similarity of
their texts' phrases, estimated at the highest level they share, and 0 if there is none, as
between texts of very different length.

Defined results: null reads as the empty text, whose fingerprint is the empty string; two
empty fingerprints have likeness 1, an empty and another one 0. Equal texts have equal
fingerprints; texts of any length are parsed whole. Only the named columns are read. In
``with_edits`` the next document is that of the next smaller id, rows of one id in the order of
their texts' hashes and null ids last; a single row is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, NumericType

from .kernels import PIECE, U64, flat, mix, pieces, range_hash, rows_of
from .store import tune

#: Levels that are parsed at most; each makes phrases of about three symbols.
LEVELS = 5
ENOUGH = 24
KEEP = 64
#: Rows of one range of ids, in ``with_edits``, and quantiles that their borders are taken from, at most.
RANGE, CUTS = 2048, 1 << 14


def _toss_table() -> np.ndarray:
    """Label of a symbol (low byte of the index) after another (high byte); both below 256."""
    left, right = np.divmod(np.arange(1 << 16), 256)
    x = left ^ right
    low = x & -x
    place = np.bitwise_count((low - 1).astype(np.uint32)).astype(np.int64)
    return np.where(x == 0, 0, 2 * place + ((right & low) != 0)).astype(np.uint8)


_TOSS = _toss_table()


def _toss(lab: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round on labels below 256; the first symbol of a text is tossed against itself with its lowest bit changed."""
    prev = np.empty(len(lab), np.uint16)
    prev[1:] = lab[:-1]
    prev[first] = lab[first] ^ 1
    return _TOSS[prev << np.uint16(8) | lab]


def parse(sym: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text's symbols, and the texts' bounds among them."""
    n = len(sym)
    if not n:
        return np.empty(0, U64), np.zeros(len(offs), np.int64)
    first = offs[:-1][offs[1:] > offs[:-1]]
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(sym[1:], sym[:-1], out=change[1:])
    change[first] = True
    if not change.all():
        at = np.flatnonzero(change)
        size = np.diff(np.append(at, n))
        sym = sym[at]
        long = np.flatnonzero(size > 1)
        if sym.dtype == np.uint8:
            lab = sym
            sym = sym.astype(U64)
            sym[long] = mix(sym[long] + size[long].astype(U64) * U64(0xA24BAED4963EE407))
            lab = np.where(size > 1, (sym & U64(255)).astype(np.uint8), lab)
        else:
            sym = sym.copy()
            sym[long] = mix(sym[long] + size[long].astype(U64) * U64(0xA24BAED4963EE407))
            lab = None
        offs = rows_of(at, offs)
        first = offs[:-1][offs[1:] > offs[:-1]]
        n = len(sym)
    else:
        lab = sym if sym.dtype == np.uint8 else None
    if lab is None:
        prev = np.empty(n, U64)
        prev[1:] = sym[:-1]
        prev[first] = sym[first] ^ U64(1)
        x = sym ^ prev
        low = x & (~x + U64(1))
        lab = (np.bitwise_count(low - U64(1)) << 1) + ((sym & low) != 0)
        lab = lab.astype(np.uint8)
    for _ in range(3):
        lab = _toss(lab, first)
    start = np.zeros(n, bool)
    start[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    last = offs[1:][offs[1:] > offs[:-1]] - 1
    start[last] = False  # no symbol follows it
    start[first] = True
    at = np.flatnonzero(start)
    names = range_hash(sym, at, np.append(at[1:], n))
    return names, rows_of(at, offs)


def smallest(names: np.ndarray, bounds: np.ndarray, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray]:
    """The smallest distinct 32-bit names of each text, ascending, and their bounds."""
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    key = np.sort(doc << 32 | (names >> U64(32)).astype(np.int64))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    doc = key >> 32
    where = np.searchsorted(doc, np.arange(len(bounds)))
    key = key[np.arange(len(key)) - where[doc] < keep]
    return key & 0xFFFFFFFF, np.searchsorted(key >> 32, np.arange(len(bounds)))


Print = dict[int, np.ndarray]


def prints(buf: np.ndarray, offs: np.ndarray) -> list[Print]:
    """The fingerprint of each text: level to smallest names."""
    out: list[Print] = [{} for _ in range(len(offs) - 1)]
    count, kept = [], []
    sym, bounds = buf, offs
    for level in range(1, LEVELS + 1):
        sym, bounds = parse(sym, bounds)
        count.append(np.diff(bounds))
        kept.append(smallest(sym, bounds))
        if not len(sym) or (level > 1 and count[-1].max() < ENOUGH):
            break
    top = np.ones(len(out), np.int64)
    for level in range(2, len(count) + 1):
        top[count[level - 1] >= ENOUGH] = level
    for i, (t, some) in enumerate(zip(top.tolist(), (count[0] > 0).tolist())):
        if some:
            for level in (t, t - 1) if t > 1 else (t,):
                names, b = kept[level - 1]
                out[i][level] = names[b[i] : b[i + 1]]
    return out


def text_of(p: Print) -> str:
    return "|".join(f"{level}:{names.astype('>u4').tobytes().hex()}" for level, names in p.items())


def read(s: str) -> Print:
    out: Print = {}
    for part in s.split("|") if s else []:
        level, _, names = part.partition(":")
        out[int(level)] = np.frombuffer(bytes.fromhex(names), ">u4").astype(np.int64)
    return out


def likeness(a: Print, b: Print) -> float:
    """Estimated Jaccard similarity, from the smallest names of the union."""
    if not a or not b:
        return float(not a and not b)
    both = [level for level in a if level in b]
    if not both:
        return 0.0
    x, y = a[max(both)], b[max(both)]
    all_ = np.concatenate([x, y])
    all_.sort()
    twice = np.zeros(len(all_), bool)
    twice[1:] = all_[1:] == all_[:-1]
    union = len(all_) - int(twice.sum())
    k = min(KEEP, union) if max(len(x), len(y)) >= KEEP else union
    if k < union:
        # of the k smallest distinct names, those that both have
        distinct = np.flatnonzero(~twice)
        end = distinct[k] if k < len(distinct) else len(all_)
        return float(twice[:end].sum() / k)
    return float(twice.sum() / union)


def _arrays(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offs[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offs


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    tune(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [text_of(p) for _, _, b, o in pieces(*flat(batch.column(1))) for p in prints(b, o)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning, as long, of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _place(source: DataFrame) -> Column:
    """A number for each id that isn't null, ascending with the ids: the id itself, or six bytes behind what all ids begin with."""
    if isinstance(source.schema["id"].dataType, (NumericType, BooleanType)):
        return F.col("id").cast("double")
    text = F.col("id").cast("string")
    a, b = source.agg(F.min(text), F.max(text)).first()
    a, b = (a or "").encode(), (b or "").encode()
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    raw = F.substring(F.encode(text, "UTF-8"), same + 1, 6)
    return F.conv(F.rpad(F.hex(raw), 12, "0"), 16, 10).cast("double")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Ranges of about ``RANGE`` ids are sorted, each with the first row of the next range behind it,
    so that one shuffle of the texts is all, and no task needs the whole order.
    """
    spark = docs.sparkSession
    tune(spark)
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = source.withColumn("key", _place(source))
    count, low, voids = base.agg(F.count("*"), F.min("key"), F.count_if(F.col("key").isNull())).first()
    low = 0.0 if low is None else low
    parts = max(1, (count - voids) // RANGE)
    cuts: list[float] = []
    if parts > 1:
        quantiles = min(parts, CUTS)
        found = base.where("key is not null").select(F.percentile_approx("key", [i / quantiles for i in range(1, quantiles)], max(10_000, 4 * quantiles))).first()[0]
        cuts = sorted({c for c in found if c > low})
    if voids:
        # rows without an id come last, in the order of their texts' hashes: ranges of their own below all others
        share = (F.xxhash64("text").cast("double") + 2.0**63) / 2.0**64
        width = max(abs(low), 1.0)
        base = base.withColumn("key", F.coalesce("key", F.lit(low - width) - share * width))
        n = -(-voids // RANGE)
        cuts = [*(low - width - width * i / n for i in range(n - 1, 0, -1)), low, *cuts] if voids < count else [low - width - width * i / n for i in range(n - 1, 0, -1)]
    more = -(-parts // CUTS)
    if more > 1:
        # beyond that many quantiles, each range is cut evenly
        cuts = sorted({a + (b - a) * i / more for a, b in zip(cuts, cuts[1:]) for i in range(more)} | set(cuts[-1:]))
    if cuts:
        binned = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="key", outputCol="bin").transform
    else:
        binned = lambda df: df.withColumn("bin", F.lit(0.0))
    tops = {int(r["bin"]): r["top"] for r in binned(base.select("id", "key")).groupBy("bin").agg(F.max("key").alias("top")).collect()}
    order = sorted(tops)
    lead = [(b, tops[b], order[(i + 1) % len(order)]) for i, b in enumerate(order)]
    leads = spark.createDataFrame(lead or [(0, 0.0, 0)], "lead_bin int, top double, before int")
    here = F.struct(F.col("bin").cast("int").alias("part"), F.lit(False).alias("ahead"))
    there = F.struct(F.col("before").alias("part"), F.lit(True).alias("ahead"))
    placed = (
        binned(base)
        .join(F.broadcast(leads), F.col("bin").cast("int") == F.col("lead_bin"), "left")
        .select("id", "text", F.explode(F.when(F.col("key") == F.col("top"), F.array(here, there)).otherwise(F.array(here))).alias("p"))
        .select("p.part", "p.ahead", "id", "text")
        .repartition("part")
        .sortWithinPartitions("part", "ahead", F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")
    )

    def done(ids: list, texts: list[str], more: int) -> pa.RecordBatch:
        """All rows but the ``more`` last ones, which only follow others."""
        n = len(texts) - more
        edits = [edited(a, b).encode() for a, b in zip(texts[:n], texts[1:])]
        own = prints(*_arrays([t.encode() for t in texts]))
        changed = prints(*_arrays(edits))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:n], id_type),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in edits], pa.string()),
                pa.array([text_of(p) for p in own[:n]], pa.string()),
                pa.array([text_of(p) for p in changed], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own[:n], own[1:])], pa.float64()),
            ],
            names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    id_type = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, size, closed = None, [], [], 0, False
        for batch in batches:
            for p, ahead, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                t = t or ""
                if p != part:
                    part, ids, texts, size, closed = p, [], [], 0, False
                if closed:
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                if ahead or size > PIECE:
                    if len(texts) > 1:
                        yield done(ids, texts, 1)
                    ids, texts, size, closed = ids[-1:], texts[-1:], len(t), ahead

    return placed.mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
