"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of the bytes
that follow. A byte's probability comes from the longest known context; where that has not seen
the byte, its escape probability (distinct followers over followers and distinct followers)
times that of the context shorter by one, down to all bytes alike. The statistics are frozen, so
a byte's code length depends on it and ``ORDER`` bytes before it only; workers keep the code
lengths of such byte groups in a table and add them up per text. The language with the shortest
code wins.

The trees are learnt from a bounded sample: about ``per_language`` rows of each language, fewer
if there are more than ``SAMPLED / per_language`` languages, chosen by a hash of id and text. Their whole texts
are counted in the tasks, and counts travel, not texts; beyond ``GROUPS`` counts the rarest byte
groups are left out of the trees. Everything else is exact and covers whole texts.

``keep`` also drops what is in none of the languages: texts whose code is longer than that of the
worst of ``per_language`` further learning rows of the winning language, byte for byte, by more
than ``MARGIN`` and ``SLACK`` bits. Without such rows, or without a model, it drops no text with a letter.

Defined results: a null text or one without a letter is ``und`` with score 0; a text of any
length is read whole; ties go to the language first in the alphabet; equal texts get equal
answers; without a single learnable text all is ``und``. ``score`` is the winner's share when
code lengths, divided by the root of the text's bytes, are taken as log-probabilities. Only the
named columns are read; ``keep`` returns all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .kernels import U64, flat, pieces, sums

ORDER = 4
#: Rows that are sampled of one language, and of all, about.
PER_LANGUAGE, SAMPLED = 400, 1 << 16
#: Byte groups whose counts come to the driver, at most.
GROUPS = 1 << 22
MARGIN, SLACK = 1.5, 64.0
#: Code lengths in a worker's table, at most: its size doesn't depend on the number of languages.
_CELLS = 22
UNKNOWN = "und"


def groups(buf: np.ndarray, offs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, it and the ``order`` bytes before it in its text, as one number; 0 before the text."""
    x = buf.astype(U64)
    out = x.copy()
    n = len(buf)
    for k in range(1, order + 1):
        out[k:] |= x[: max(0, n - k)] << U64(8 * k)
    first = offs[:-1][offs[1:] > offs[:-1]]
    end = offs[1:][offs[1:] > offs[:-1]]
    for k in range(min(order, n)):
        at = first[first + k < end] + k
        out[at] &= U64((1 << 8 * (k + 1)) - 1)
    return out


class Tree:
    """Frozen follower counts of one language's contexts."""

    def __init__(self, g: np.ndarray, c: np.ndarray, order: int = ORDER):
        """From distinct groups and their counts."""
        self.order, self.levels = order, []
        for k in range(order + 1):
            # level k: groups of k context bytes and one follower
            key, where = np.unique(g & U64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(where, c, len(key))
            context, at = np.unique(key >> U64(8), return_inverse=True)
            total, distinct = np.bincount(at, count, len(context)), np.bincount(at, minlength=len(context))
            self.levels.append((key, np.log2((total + distinct)[at] / count), context, np.log2((total + distinct) / np.maximum(distinct, 1))))

    @classmethod
    def of(cls, texts: list[str], order: int = ORDER) -> Tree:
        raw = [t.encode() for t in texts]
        offs = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
        return cls(*np.unique(groups(np.frombuffer(b"".join(raw), np.uint8), offs, order), return_counts=True), order)

    def lengths(self, g: np.ndarray) -> np.ndarray:
        """Code length in bits of each group's last byte after its other bytes."""
        out = np.zeros(len(g))
        open_ = np.arange(len(g))
        for k in range(self.order, -1, -1):
            key, bits, context, escape = self.levels[k]
            if not len(key) or not len(open_):
                continue
            x = g[open_] & U64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(key, x), len(key) - 1)
            seen = key[at] == x
            out[open_[seen]] += bits[at[seen]]
            open_, x = open_[~seen], x[~seen] >> U64(8)
            at = np.minimum(np.searchsorted(context, x), len(context) - 1)
            known = context[at] == x
            out[open_[known]] += escape[at[known]]
        out[open_] += 8
        return out


class Model:
    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        self.trees = [trees[k] for k in self.langs]
        #: Bits of a byte in the worst further learning row of each language.
        self.worst = np.full(len(self.langs), np.inf)
        self.bits_of_place = max(8, _CELLS - int(np.ceil(np.log2(max(len(self.langs), 1)))))
        self.places: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"places": None}

    def bits(self, g: np.ndarray) -> np.ndarray:
        """Code lengths of the groups in every language."""
        if self.places is None:
            self.places = np.full(1 << self.bits_of_place, (1 << 64) - 1, U64), np.zeros((1 << self.bits_of_place, len(self.langs)), np.float32)
        keys, vals = self.places
        at = ((g * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits_of_place)).astype(np.int64)
        lost = np.flatnonzero(keys[at] != g)
        if not len(lost):
            return vals.take(at, axis=0)
        new, where = np.unique(g[lost], return_inverse=True)
        found = np.stack([t.lengths(new) for t in self.trees], 1).astype(np.float32)
        put = ((new * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits_of_place)).astype(np.int64)
        keys[put], vals[put] = new, found
        # the last of several that share a place is what lies there
        keys[put] = new
        out = vals.take(at, axis=0)
        out[lost] = found[where]
        return out

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of every text in every language, in bits."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        for lo, hi, b, o in pieces(buf, offs):
            got = self.bits(groups(b, o))
            for j in range(len(self.langs)):
                out[lo:hi, j] = sums(got[:, j].astype(np.float64), o)
        return out


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter, of any script."""
    low = buf | 32
    out = sums(((low >= 97) & (low <= 122)).astype(np.int64), offs) > 0
    for i in np.flatnonzero(~out & (offs[1:] > offs[:-1])):
        out[i] = any(map(str.isalpha, buf[offs[i] : offs[i + 1]].tobytes().decode()))
    return out


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, worst: bool = False) -> Model:
    """A model of the languages in the rows of docs for which ``learn`` holds; ``worst`` also finds what ``keep`` needs."""
    spark = docs.sparkSession
    store.tune(spark)
    pool = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    counts = {r["lang"]: r["n"] for r in pool.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({})
    wanted = max(1, min(per_language, SAMPLED // len(counts)))
    shares = {k: wanted / n for k, n in counts.items()}
    hashed = pool.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit(4)), F.lit(1 << 30)).alias("h"))
    least = max(shares.values())
    near = hashed.where(F.col("h") < min(1.0, 2 * least) * (1 << 30))
    sent = spark.sparkContext.broadcast(shares)

    def sampled(batch: pa.RecordBatch, which: int) -> tuple[list[str], list[str]]:
        """Languages and texts of the rows of the first or the second share of a language's hashes."""
        rows = [(k, t) for k, t, h in zip(*(c.to_pylist() for c in batch.columns)) if which * sent.value[k] <= h / (1 << 30) < (which + 1) * sent.value[k]]
        return [k for k, _ in rows], [t for _, t in rows]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = sampled(batch, 0)
            for k in sorted(set(langs)):
                buf, offs = flat(pa.array([t for x, t in zip(langs, texts) if x == k], pa.large_string()))
                for _, _, b, o in pieces(buf, offs, 1 << 22):
                    g, n = np.unique(groups(b, o), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "g", "n"])

    scratch = store.Scratch(spark)
    table = scratch.cut(near.mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")), "groups")
    level, left = 1, 0
    for r in sorted(table.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["n"]):
        left += r["k"]
        if left > GROUPS:
            level = r["n"] + 1
            break
    got = table.where(F.col("n") >= level).toArrow()
    scratch.close()
    names = got.column("lang").to_numpy()
    g, n = got.column("g").to_numpy().view(U64), got.column("n").to_numpy()
    trees = {}
    for k in sorted(set(names.tolist())):
        on = np.flatnonzero(names == k)
        on = on[np.argsort(g[on])]
        trees[k] = Tree(g[on], n[on])
    model = Model(trees)
    if worst and trees:
        shared = spark.sparkContext.broadcast(model)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs, texts = sampled(batch, 1)
                if texts:
                    buf, offs = flat(pa.array(texts, pa.large_string()))
                    bits = shared.value.score(buf, offs)
                    best = bits.argmin(1)
                    own = np.array([shared.value.langs[i] for i in best.tolist()]) == np.array(langs)
                    each = bits.min(1) / np.diff(offs)
                    # short texts say little about the bits of a byte
                    own &= np.diff(offs) >= 64
                    yield pa.RecordBatch.from_arrays([pa.array(best[own].astype(np.int32)), pa.array(each[own])], names=["k", "bits"])

        for r in near.mapInArrow(measure, "k int, bits double").groupBy("k").agg(F.max("bits").alias("bits")).collect():
            model.worst[r["k"]] = r["bits"]
    return model


def answers(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text's language and score, and whether it is in a language at all."""
    buf, offs = flat(texts)
    ok = has_letter(buf, offs)
    if not model.langs:
        return [UNKNOWN] * len(ok), np.zeros(len(ok)), ok
    bits = model.score(buf, offs)
    best = bits.argmin(1)
    size = np.maximum(np.diff(offs), 1)
    gap = (bits - bits.min(1, keepdims=True)) / np.sqrt(size)[:, None]
    score = np.where(ok, 1 / np.exp2(-gap).sum(1), 0.0)
    within = bits.min(1) <= MARGIN * model.worst[best] * size + SLACK
    return [model.langs[i] if o else UNKNOWN for i, o in zip(best.tolist(), ok.tolist())], score, ok & within


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    store.tune(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, _ = answers(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is in some language by a model fitted with ``worst``."""
    store.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(answers(shared.value, batch.column(at))[2], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
