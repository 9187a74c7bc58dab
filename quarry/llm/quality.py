"""Quality scores by a factorisation machine.

Features of a text are its words, hashed to ``SLOTS`` places and weighted by their share of the
text's words, statistics of its structure, and the class of its length, which stands for its
metadata. Their pairwise interactions have rank ``RANK`` and are summed in linear time: half of
(sum of v x) squared less the sum of v squared x squared, for each of the rank's dimensions. The
logistic of it all is the score.

The machine is fitted by AdaGrad on a bounded sample: at most ``SAMPLE`` labelled texts, chosen by
a hash of their ids, whole; their features come to the driver, not the texts. Scoring covers whole
texts.

Defined results: a null text reads as the empty text, which has only a length class and gets a
score too; an id that is labelled more than once counts as 1 if any label says so; of several texts with
one id the one with the least hash is learnt; null labels are left out; without labels all scores are 0.5. Equal texts get equal scores. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U64, flat, pieces, range_hash, rows_of, spans, sums
from .store import tune

SLOTS, RANK = 1 << 15, 8
SAMPLE = 4000
LENGTHS = 18
STATS = ("upper", "lower", "digit", "space", "breaks", "marks", "odd_marks", "foreign", "word_size", "long_words", "repeats", "again", "line_size", "no_words")
WIDTH = SLOTS + LENGTHS + len(STATS)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_KINDS = [
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _class("abcdefghijklmnopqrstuvwxyz"),
    _class("0123456789"),
    _SPACE,
    _class("\n"),
    _class(".,;:!?'\"()-"),
    _class("|#$%&*@^~_=+<>{}[]\\/`"),
    np.arange(256) >= 128,
]


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: feature numbers, their values, and the bounds of each text among them."""
    n = len(offs) - 1
    size = np.diff(offs)
    parts = [np.bincount(buf[lo:hi], minlength=256) for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist())] if n else []
    hist = np.array(parts).reshape(n, 256)
    stats = [hist[:, k].sum(1) / np.maximum(size, 1) for k in _KINDS]
    s, e = spans(~_SPACE[buf], offs)
    bounds = rows_of(s, offs)
    count = np.diff(bounds)
    some = np.maximum(count, 1)
    h = range_hash(buf, s, e)
    again = np.zeros(len(h), np.int64)
    again[1:] = h[1:] == h[:-1]
    again[bounds[:-1][count > 0]] = 0
    doc = np.repeat(np.arange(n), count)
    key = np.sort(doc.astype(U64) << U64(15) | h >> U64(64 - 15))
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(key)))
    key = key[head]
    at = np.searchsorted((key >> U64(15)).astype(np.int64), np.arange(n + 1))
    stats += [
        sums(e - s, bounds) / some / 10,
        sums(((e - s) > 20).astype(np.int64), bounds) / some,
        sums(again, bounds) / some,
        1 - np.diff(at) / some,
        np.log1p(size / (hist[:, 10] + 1)) / 8 if n else np.zeros(0),
        (count == 0).astype(float),
    ]
    length = np.minimum(np.log2(size + 1).astype(np.int64), LENGTHS - 1)
    dense = np.concatenate([np.ones((n, 1)), np.array(stats).T.reshape(n, len(STATS))], 1)
    width = dense.shape[1]
    # each row: its words, then length class and statistics
    out_bounds = np.append(0, np.cumsum(np.diff(at) + width))
    index = np.empty(out_bounds[-1], np.int64)
    value = np.empty(out_bounds[-1], np.float32)
    tail = (out_bounds[1:, None] - width + np.arange(width)).ravel()
    words = np.ones(len(index), bool)
    words[tail] = False
    index[words] = (key & U64(SLOTS - 1)).astype(np.int64)
    value[words] = times / some[(key >> U64(15)).astype(np.int64)]
    index[tail] = np.concatenate([SLOTS + length[:, None], np.broadcast_to(SLOTS + LENGTHS + np.arange(len(STATS)), (n, len(STATS)))], 1).ravel()
    value[tail] = dense.ravel()
    return index, value, out_bounds


class Machine:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.linear = np.zeros(WIDTH, np.float32)
        self.pairs = (rng.standard_normal((WIDTH, RANK)) * 0.05).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The machine's output before the logistic, and the sums of v x, of each row."""
        vx = self.pairs[index] * value[:, None]
        s = np.add.reduceat(vx, bounds[:-1], axis=0)
        q = np.add.reduceat((vx * vx).sum(1), bounds[:-1])
        return self.bias + np.add.reduceat(self.linear[index] * value, bounds[:-1]) + 0.5 * ((s * s).sum(1) - q), s

    def fit(self, index: np.ndarray, value: np.ndarray, bounds: np.ndarray, label: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        share = np.clip(label.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        past_l, past_p, past_b = np.full(WIDTH, 1e-3, np.float32), np.full((WIDTH, RANK), 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                size = bounds[rows + 1] - bounds[rows]
                b = np.append(0, np.cumsum(size))
                at = np.repeat(bounds[rows] - b[:-1], size) + np.arange(b[-1])
                i, x = index[at], value[at]
                y, s = self.raw(i, x, b)
                g = ((1 / (1 + np.exp(-y)) - label[rows]) / len(rows)).astype(np.float32)
                each = np.repeat(g, size)
                gl = each * x
                gp = gl[:, None] * (np.repeat(s, size, axis=0) - self.pairs[i] * x[:, None])
                where, inverse = np.unique(i, return_inverse=True)
                sort = np.argsort(inverse, kind="stable")
                cut = np.searchsorted(inverse[sort], np.arange(len(where)))
                dl = np.add.reduceat(gl[sort], cut) + decay * self.linear[where]
                dp = np.add.reduceat(gp[sort], cut, axis=0) + decay * self.pairs[where]
                past_l[where] += dl * dl
                past_p[where] += dp * dp
                self.linear[where] -= rate * dl / np.sqrt(past_l[where])
                self.pairs[where] -= rate * dp / np.sqrt(past_p[where])
                db = float(g.sum())
                past_b += db * db
                self.bias -= rate * db / past_b**0.5

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = [self.raw(*features(b, o))[0] for _, _, b, o in pieces(buf, offs)]
        return 1 / (1 + np.exp(-np.concatenate(out).astype(np.float64))) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Machine | None:
    """A machine fitted on labelled rows for whose ids (of labels) ``learn`` holds, or None if there are none."""
    rows = labels.where(learn & F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).alias("key")).agg(F.max(label_col).alias("label"))
    count = rows.count()
    share = min(1.0, 2 * sample / max(count, 1))
    hash_ = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(5)), F.lit(1 << 30))
    picked = rows.withColumn("h", hash_).where(F.col("h") < share * (1 << 30)).orderBy("h", "key").limit(sample)
    tune(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    first = texts.join(F.broadcast(picked), "key").groupBy("key", "h", "label").agg(F.min("t").alias("t"))
    chosen = texts.join(F.broadcast(first), ["key", "t"]).select("h", F.col("key").cast("string").alias("key"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b, o in pieces(*flat(batch.column(3))):
                index, value, bounds = features(b, o)
                cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                blobs = [pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (index.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:3]), *blobs], names=["h", "key", "label", "index", "value"])

    ddl = f"h long, key string, label {dict(chosen.dtypes)['label']}, index binary, value binary"
    got = chosen.mapInArrow(run, ddl).dropDuplicates(["key"]).collect()
    got.sort(key=lambda r: (r["h"], r["key"]))
    if not got:
        return None
    index = [np.frombuffer(r["index"], np.int32) for r in got]
    bounds = np.append(0, np.cumsum(list(map(len, index))))
    machine = Machine()
    machine.fit(np.concatenate(index).astype(np.int64), np.concatenate([np.frombuffer(r["value"], np.float32) for r in got]), bounds, np.array([float(r["label"] > 0) for r in got]))
    return machine


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    tune(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = shared.value
            out = np.full(batch.num_rows, 0.5) if m is None else m.score(*flat(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
