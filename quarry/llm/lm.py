"""Language-model scores: a log-bilinear model fitted by noise-contrastive estimation.

Tokens are the runs of bytes other than ASCII white space, A-Z folded, and one end per text.
Every token of every learning text is counted; the counts (by 64-bit hash of the word) stay a
table. The commonest words, at most ``HEAD``, go to all workers; the counts of the others
are joined to the texts that use them.

The model predicts the commonest words, as many as the square root of the learning tokens (at least
``VOCAB``), and one class for the rest, from two words before: the context's vector is the sum of
their vectors, each through its position's matrix. The words are in classes of about equal mass, by
frequency, as many as the square root of the words; a class's score is its vector's product with the
context's, plus its bias, and so is a word's score within its class. Biases start at the counted
log-frequencies, the noise is the counted distribution. Scores are normalised exactly, over the
classes and within the word's class. A word of the rest has the rest's probability times its own
smoothed share of it, so the probabilities of all words, one unseen among them, add up to 1.

Every learning text is fitted on, whole, once: trainers, one for ``TRAINED`` tokens and at most
``TRAINERS`` for each core, start alike and each pass over their own texts; the mean of their
parameters, each row weighted by the updates that it had, is the model.

Defined results: a null text reads as the empty text, which is an end only; texts of any length
are scored whole; without learning texts all words are unseen and all contexts alike; equal rows
are scored alike and kept apart. Only the named columns are read.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U64, flat, lower_ascii, pieces, range_hash, rows_of, spans, sums
from .store import Scratch, tune

HEAD, VOCAB, SIZE = 1 << 18, 1024, 32
TRAINED, TRAINERS = 1 << 21, 4
#: Words whose contexts are looked for repeats together, when scored.
SCORED = 1 << 18
#: Rows of parameters that are averaged together.
AVERAGED = 1 << 9
#: Tokens of one task that are counted together before they are sent, about.
COUNTED = 1 << 22
#: The end of a text, among the words' hashes.
END = np.array([0x5E7D], U64)
_FOLD = lower_ascii()
_FOLD[[32, *range(9, 14)]] = 0


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and each text's bounds among them."""
    low = _FOLD[buf]
    on = low != 0
    if (buf == 0).any():
        on |= buf == 0  # NUL is no white space
    s, e = spans(on, offs)
    bounds = rows_of(s, offs)
    n = len(offs) - 1
    out = np.empty(len(s) + n, U64)
    ends = bounds[1:] + np.arange(n)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = range_hash(low, s, e)
    out[ends] = END
    return out, np.append(0, ends + 1)


class Head:
    """The commonest words' counts, by hash: an open-addressed table."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.bits = max(10, int(4 * len(keys)).bit_length())
        self.slot = np.full((1 << self.bits) + 64, -1, np.int32)
        self.longest = 1
        left = np.arange(len(keys), dtype=np.int32)
        step = 0
        while len(left):
            at = self._home(keys[left]) + step
            free = self.slot[at] < 0
            self.slot[at[free][::-1]] = left[free][::-1]
            left = left[self.slot[at] != left]
            step += 1
            if step > 60:
                raise ValueError("the table is too full")
        self.longest = max(step, 1)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h * U64(0x9E3779B97F4A7C15) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rank of each word, or -1."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        left, at = np.arange(len(h)), self._home(h)
        for _ in range(self.longest):
            got = self.slot[at]
            ok = got >= 0
            same = ok & (self.keys[np.maximum(got, 0)] == h[left])
            out[left[same]] = got[same]
            go = ok & ~same
            left, at = left[go], at[go] + 1
            if not len(left):
                break
        return out


class Room:
    """Arrays of 32-bit numbers that are used again, by name: fresh ones of this size cost more than what is done in them."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size + size // 4, np.float32)
        return self.held[name][:size].reshape(shape)


class Model:
    """Vectors of the context (the vocabulary, the rest, before the text), of the classes and of the words in them."""

    def __init__(self, counts: np.ndarray, total: float, distinct: int, seed: int = 9):
        rng = np.random.default_rng(seed)
        v = len(counts)
        self.rest, self.start = v, v + 1
        seen = float(counts.sum())
        self.rest_mass = total - seen + 0.1 * (distinct - v + 1)
        share = np.append(counts.astype(np.float64), self.rest_mass)
        self.noise = share / share.sum()
        # classes are runs of words by frequency, the rest is one of its own
        before = np.cumsum(self.noise[:v]) - self.noise[:v]
        k = max(1, int(np.ceil(np.sqrt(v))))
        run = np.unique(np.minimum(before / max(self.noise[:v].sum(), 1e-300) * k, k - 1).astype(np.int64), return_inverse=True)[1]
        self.of = np.append(run, run.max() + 1 if v else 0).astype(np.int32)
        self.first = np.searchsorted(self.of, np.arange(self.of[-1] + 2))
        self.class_noise = np.add.reduceat(self.noise, self.first[:-1])
        inside = np.maximum(self.noise / self.class_noise[self.of], 1e-12)
        # a row is a vector and its bias
        self.words, self.classes = np.zeros((v + 1, SIZE + 1), np.float32), np.zeros((len(self.class_noise), SIZE + 1), np.float32)
        self.words[:, -1], self.classes[:, -1] = np.log(inside), np.log(np.maximum(self.class_noise, 1e-12))
        self.context = (rng.standard_normal((v + 2, SIZE)) * 0.1).astype(np.float32)
        self.place = np.stack([np.eye(SIZE, dtype=np.float32)] * 2)

    def table(self) -> np.ndarray:
        """All parameters, a row each: a vector and its bias."""
        none = np.zeros((len(self.context) + 2 * SIZE, 1), np.float32)
        return np.concatenate([self.words, self.classes, np.column_stack([np.concatenate([self.context, *self.place]), none])])

    def load(self, table: np.ndarray) -> None:
        t = table.astype(np.float32)
        self.words, self.classes, context, place = np.split(t, np.cumsum([len(self.words), len(self.classes), len(self.context)]))
        self.context, self.place = np.ascontiguousarray(context[:, :-1]), np.ascontiguousarray(place[:, :-1]).reshape(2, SIZE, SIZE)

    def vectors(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.context.take(one, axis=0) @ self.place[0] + self.context.take(two, axis=0) @ self.place[1]

    def fit(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, epochs: int = 1, batch: int = 4096, noise: int = 64, rate: float = 0.07, seed: int = 9, past: dict | None = None) -> dict:
        """Noise-contrastive estimation by AdaGrad; each batch shares its noise classes, and each class its noise words. Returns AdaGrad's sums and each row's updates, to go on with."""
        rng = np.random.default_rng(seed)
        if past is None:
            past = {k: np.full_like(getattr(self, k), 1e-6) for k in ("words", "classes", "context", "place")} | {"uses": np.zeros(len(self.words) + len(self.classes) + len(self.context) + 2 * SIZE, np.float32)}
        at_class = len(self.words)
        at_context = at_class + len(self.classes)
        uses = past["uses"]
        more = np.float32(np.log(noise))
        log_class, log_word = np.log(np.maximum(self.class_noise, 1e-12)).astype(np.float32) + more, np.log(np.maximum(self.noise / self.class_noise[self.of], 1e-12)).astype(np.float32) + more
        cum_class, cum_word = np.cumsum(self.class_noise), np.append(0, np.cumsum(self.noise))
        alone = np.diff(self.first) == 1
        place = np.empty((2, SIZE, SIZE), np.float32)
        room = Room()

        def step(k: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
            param, p = getattr(self, k), past[k]
            q = grad * grad
            q += p[rows] if isinstance(rows, slice) else p.take(rows, axis=0)
            p[rows] = q
            np.sqrt(q, out=q)
            np.divide(grad, q, out=q)
            q *= rate
            param[rows] -= q

        def heads(x: np.ndarray) -> np.ndarray:
            return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))

        def sort(x: np.ndarray) -> np.ndarray:
            # numbers of 16 bits are sorted by radix
            return np.argsort(x.astype(np.uint16), kind="stable") if at_class <= 1 << 15 else np.argsort(x)

        def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """The order that sorts x, where each value's run begins in it, the values, and which of them each of x is."""
            turn = sort(x)
            x = x[turn]
            firsts = heads(x)
            which = np.empty(len(x), np.int64)
            which[turn] = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(x))))
            return turn, firsts, x[firsts], which

        def chances(x: np.ndarray) -> np.ndarray:
            """1 / (1 + exp(x)), in place."""
            np.exp(x, out=x)
            x += 1
            return np.reciprocal(x, out=x)

        for _ in range(epochs):
            order = rng.permutation(len(word))
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                at = at[sort(word[at])]
                a, b, w = one[at], two[at], word[at]
                n = np.float32(len(at))
                h = np.ones((len(at), SIZE + 1), np.float32)
                # a context word's vector goes through its matrix once a batch
                sides = [runs(a), runs(b)]
                before = [self.context.take(x, axis=0) for _, _, x, _ in sides]
                h[:, :-1] = (before[0] @ self.place[0]).take(sides[0][3], axis=0)
                h[:, :-1] += (before[1] @ self.place[1]).take(sides[1][3], axis=0)
                c = self.of[w]
                starts = heads(c)
                present = c[starts]
                # the classes, against noise classes that all rows share; one drawn several times is scored once
                drawn = np.bincount(np.minimum(np.searchsorted(cum_class, rng.random(noise)), len(cum_class) - 1), minlength=len(self.classes))
                x = np.flatnonzero(drawn)
                times = drawn[x].astype(np.float32)[:, None]
                own, other = self.classes.take(c, axis=0), self.classes[x]
                gs = np.einsum("ij,ij->i", h, own)
                gs -= log_class[c]
                gs = -chances(gs)
                # the bias of a row of h is 1, so a bias takes the logarithm of the noise along
                against = -other
                against[:, -1] += log_class[x]
                gt = chances(np.matmul(h, against.T, out=room("classes", len(at), len(x))))
                other *= times
                gh = np.matmul(gt, other, out=room("gh", *h.shape))
                own *= gs[:, None]
                gh += own
                g = np.zeros_like(self.classes)
                g[present] = np.add.reduceat(np.multiply(gs[:, None], h, out=own), starts, axis=0)
                g[x] += times * (gt.T @ h)
                drawn[present] += 1
                rows = np.flatnonzero(drawn)
                g = g[rows]
                g /= n
                step("classes", g, rows)
                uses[at_class + rows] += 1
                # the words, against noise words that all rows of their class share; a class's words, drawn or its rows' own, are scored once
                several = np.flatnonzero(~alone[present])
                if len(several):
                    k = present[several]
                    low, high = cum_word[self.first[k]][:, None], cum_word[self.first[k + 1]][:, None]
                    x = np.searchsorted(cum_word, np.sort(low + (high - low) * rng.random((len(several), noise)), axis=1), "right") - 1
                    x = np.clip(x, self.first[k][:, None], self.first[k + 1][:, None] - 1)
                    drawn = np.bincount(x.ravel(), minlength=at_class)
                    mine = np.flatnonzero(~alone[c])
                    here = drawn > 0
                    here[w[mine]] = True
                    rows = np.flatnonzero(here)
                    times = drawn[rows].astype(np.float32)
                    left, right = np.searchsorted(rows, self.first[k]), np.searchsorted(rows, self.first[k + 1])
                    top, bottom = starts[several], np.append(starts[1:], len(c))[several]
                    other = self.words.take(rows, axis=0)
                    against = -other
                    against[:, -1] += log_word[rows]
                    cells = np.append(0, np.cumsum((right - left) * (bottom - top)))
                    t = room("words", int(cells[-1]))
                    own[:] = 0
                    parts = [(h[i:j], own[i:j], t[u:v].reshape(j - i, r - q), q, r) for i, j, q, r, u, v in zip(*(y.tolist() for y in (top, bottom, left, right, cells[:-1], cells[1:])))]
                    for hk, _, tk, q, r in parts:
                        np.matmul(hk, against[q:r].T, out=tk)
                    chances(t)
                    # where each row's own word is: its score counts as one more, less what a right word has
                    wide = np.repeat(right - left, bottom - top)
                    begin = np.repeat(cells[:-1] - left, bottom - top) + (np.arange(len(mine)) - np.repeat(np.cumsum(bottom - top) - (bottom - top), bottom - top)) * wide
                    own_at = begin + np.searchsorted(rows, w[mine])
                    gs = t[own_at] - 1
                    g = np.empty_like(other)
                    for _, _, tk, q, r in parts:
                        tk *= times[q:r]
                    t[own_at] += gs
                    for hk, gk, tk, q, r in parts:
                        np.matmul(tk, other[q:r], out=gk)
                        np.matmul(tk.T, hk, out=g[q:r])
                    gh += own
                    g /= n
                    step("words", g, rows)
                    uses[rows] += 1
                gh = gh[:, :-1] / n
                here = np.zeros(len(self.context), bool)
                for _, _, x, _ in sides:
                    here[x] = True
                rows = np.flatnonzero(here)
                g = np.zeros((len(rows), SIZE), np.float32)
                for i, (turn, firsts, x, _) in enumerate(sides):
                    # two columns at once, as the parts of a complex number
                    own = np.add.reduceat(gh.take(turn, axis=0).view(np.complex64), firsts, axis=0).view(np.float32)
                    place[i] = before[i].T @ own
                    g[np.searchsorted(rows, x)] += own @ self.place[i].T
                step("context", g, rows)
                uses[at_context + rows] += 1
                step("place", place)
                uses[-2 * SIZE :] += 1
        return past

    def log10(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of each word after its context, normalised over the classes and within the word's class; a context, and a word after it, is computed once in SCORED words."""
        room, ones = Room(), np.ones(max(len(self.classes), int(np.diff(self.first).max())), np.float32)

        def logs(h: np.ndarray, rows: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
            """Log-probability among ``rows``, after the vectors ``h``: of ``w`` after ``h[at]``."""
            x = np.matmul(h, rows.T, out=room("scores", len(h), len(rows)))
            own = x[at, w]
            with np.errstate(over="ignore"):
                np.exp(x, out=x)
                total = x @ ones[: len(rows)]
            if not ((total > 1e-30) & (total < 1e30)).all():
                np.matmul(h, rows.T, out=x)
                most = x.max(1)
                x -= most[:, None]
                np.exp(x, out=x)
                return (own - most[at]) - np.log(x @ ones[: len(rows)])[at]
            return own - np.log(total)[at]

        out = np.empty(len(word))
        for lo in range(0, len(word), SCORED):
            part = slice(lo, lo + SCORED)
            context, after = np.unique(one[part].astype(np.int64) * len(self.context) + two[part], return_inverse=True)
            pair, which = np.unique(after * len(self.words) + word[part], return_inverse=True)
            after, w = np.divmod(pair, len(self.words))
            c = self.of[w]
            h = np.ones((len(context), SIZE + 1), np.float32)
            h[:, :-1] = self.vectors(*np.divmod(context, len(self.context)))
            got = np.empty(len(pair), np.float32)
            cut = np.searchsorted(after, np.arange(0, len(context) + 4096, 4096))
            for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                got[i:j] = logs(h[k * 4096 : (k + 1) * 4096], self.classes, after[i:j] - k * 4096, c[i:j])
            order = np.argsort(c, kind="stable")
            cut = np.searchsorted(c[order], np.arange(len(self.classes) + 1))
            for k in np.flatnonzero((np.diff(cut) > 0) & (np.diff(self.first) > 1)).tolist():
                f, e = int(self.first[k]), int(self.first[k + 1])
                for q in range(int(cut[k]), int(cut[k + 1]), 4096):
                    at = order[q : min(q + 4096, cut[k + 1])]
                    got[at] += logs(h.take(after[at], axis=0), self.words[f:e], np.arange(len(at)), w[at] - f)
            out[part] = got[which]
        return out / np.log(10)


def contexts(word: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word and the one before that; ``start`` where the text has none."""
    one, two = np.empty_like(word), np.empty_like(word)
    one[1:], two[2:] = word[:-1], word[:-2]
    first = bounds[:-1]
    one[first] = two[first] = start
    second = first[first + 1 < bounds[1:]] + 1
    two[second] = start
    return one, two


class Frozen:
    """All that scoring needs on a worker."""

    def __init__(self, head: Head, total: float, distinct: int, model: Model):
        self.head, self.total, self.distinct, self.model = head, total, distinct, model

    def ids(self, rank: np.ndarray) -> np.ndarray:
        return np.where((rank >= 0) & (rank < self.model.rest), rank, self.model.rest).astype(np.int64)


def count(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): how often each token's hash occurs in all texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for _, _, b, o in pieces(*flat(batch.column(0))):
                held.append(tokens(b, o)[0])
                size += len(held[-1])
                if size > COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, frozen: Frozen, text_col: str, trainers: int) -> np.ndarray:
    """The mean of the parameters that trainers reach, each on its share of all texts of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(frozen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Frozen = shared.value
        model = copy.deepcopy(f.model)  # a worker's next task starts as this one did
        past = None
        for batch in batches:
            parts = [tokens(b, o) for _, _, b, o in pieces(*flat(batch.column(0)))]
            if not parts:
                continue
            h = np.concatenate([x for x, _ in parts])
            bounds = np.append(0, np.cumsum(np.concatenate([np.diff(y) for _, y in parts])))
            word = f.ids(f.head.find(h))
            past = model.fit(*contexts(word, bounds, model.start), word, past=past)
        if past is not None:
            uses = past["uses"].astype(np.float64)[:, None]
            table = np.column_stack([model.table() * uses, uses])
            for lo in range(0, len(table), AVERAGED):
                yield pa.RecordBatch.from_arrays([pa.array([lo // AVERAGED], pa.int32()), pa.array([table[lo : lo + AVERAGED].tobytes()], pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(x.as_buffer(), np.float64)
                held[part] = held[part] + x if part in held else x.copy()
        for part, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "sums"])

    ddl = "part int, sums binary"
    table = frozen.model.table()
    for r in docs.select(text_col).coalesce(trainers).mapInArrow(run, ddl).repartition("part").mapInArrow(add, ddl).toLocalIterator():
        x = np.frombuffer(bytes(r["sums"]), np.float64).reshape(-1, SIZE + 2)
        used = np.flatnonzero(x[:, -1] > 0)
        table[r["part"] * AVERAGED + used] = x[used, :-1] / x[used, -1:]
    return table


def fit(docs: DataFrame, learn: Column, counts: DataFrame, text_col: str = "text", head: int = HEAD, vocab: int | None = None) -> Frozen:
    """The counts' head and a model of all texts for which ``learn`` holds; ``vocab`` words, by default as many as the counts ask for."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    vocab = max(VOCAB, math.isqrt(total)) if vocab is None else vocab
    head = max(head, vocab)
    # the head is cut by classes of counts, so that no task sorts candidates of all others
    level = F.floor(F.log2("n") * 64).cast("int")
    below = None
    taken = 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        taken += r["count"]
        if taken > head:
            break
        below = r["level"]
    top = counts.where(level >= below if below is not None else F.lit(False)).toArrow()
    keys, n = top.column("word").to_numpy().view(U64), top.column("n").to_numpy()
    order = np.lexsort((keys.view(np.int64), -n))
    keys, n = keys[order], n[order]
    frozen = Frozen(Head(keys, n), float(total), int(distinct), Model(n[:vocab], float(total), int(distinct)))
    if total:
        most = TRAINERS * docs.sparkSession.sparkContext.defaultParallelism
        frozen.model.load(train(docs.where(learn), frozen, text_col, min(most, math.ceil(total / TRAINED))))
    return frozen


def score(docs: DataFrame, frozen: Frozen, counts: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row; logarithms are decimal."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    shared = spark.sparkContext.broadcast(frozen)
    names = ["tail", "id", "uid", "n_tokens", "n_known", "n_tail", "base", "score", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Frozen = shared.value
        head, model = f.head, f.model
        scale = np.log10(f.total + 0.1 * (f.distinct + 1))
        log_count = np.log10(head.counts + 0.1)
        log_rest = np.log10(model.rest_mass)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, b, o in pieces(*flat(batch.column(1)), 1 << 23):
                parts = [tokens(x, y) for _, _, x, y in pieces(b, o)]
                h = np.concatenate([x for x, _ in parts])
                bounds = np.append(0, np.cumsum(np.concatenate([np.diff(y) for _, y in parts])))
                rank = head.find(h)
                in_head = rank >= 0
                word = f.ids(rank)
                log = np.where(in_head, log_count[rank] if len(log_count) else 0.0, 0.0)
                base = np.where(in_head, log - scale, 0.0)
                got = model.log10(*contexts(word, bounds, model.start), word)
                rest = word == model.rest
                got += np.where(rest, np.where(in_head, log - log_rest, 0.0), 0.0)
                n = hi - lo
                tail = ~in_head
                tails = sums(tail.astype(np.int64), bounds)
                mine = uid + np.arange(n)
                uid += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, bool)), ids.slice(lo, n), pa.array(mine), pa.array(np.diff(bounds)), pa.array(np.diff(bounds) - tails), pa.array(tails), pa.array(sums(base, bounds) - tails * scale), pa.array(sums(got, bounds) - tails * log_rest), pa.nulls(n, pa.int64())], names=names
                )
                m = int(tail.sum())
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, bool)), pa.nulls(m, ids.type), pa.array(np.repeat(mine, tails)), none, none, none, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(h[tail].view(np.int64))], names=names)

    ddl = f"tail boolean, id {kind}, uid long, n_tokens long, n_known long, n_tail long, base double, score double, word long"
    t = scratch.cut(docs.select(id_col, text_col).mapInArrow(run, ddl), "scored")
    c = F.coalesce("n", F.lit(0))
    tails = t.where("tail").select("uid", "word").join(counts, "word", "left").groupBy("uid").agg(F.sum(F.log10(c + F.lit(0.1))).alias("tail_log"), F.count("n").alias("tail_known"))
    out = t.where("not tail").join(tails, "uid", "left")
    zero = F.coalesce("tail_log", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(int(frozen.total)).cast("long").alias("train_tokens"), (F.col("base") + zero).alias("base_score"), (F.col("score") + zero).alias("score"))


def learn_and_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``score`` of every row, by counts and a model of the rows for which ``learn`` holds."""
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    counts = scratch.cut(count(docs.where(learn), text_col), "counts")
    return score(docs, fit(docs, learn, counts, text_col, **options), counts, scratch, id_col, text_col)
