"""Near-duplicate detection: SimHash fingerprints, bit-sampling tables, verified distances.

A text's fingerprint has ``BITS`` bits: each is the majority of that bit over the hashes of its
distinct words (ASCII letters folded; letters, digits and non-ASCII characters), each weighted by
one more than the logarithm of its number in the text. Texts are
linked if their fingerprints differ in at most ``MAX_DISTANCE`` bits. Equal texts, and then equal
fingerprints, are one node each before anything is compared, so copies cost nothing.

Candidates come from tables that each group the nodes by a few sampled bits. The number of bits
grows with the logarithm of the nodes, and the number of tables with it, so that a pair of the
distance ``DESIGN`` is found with probability ``RECALL`` at every size. A bucket beyond ``CAP``
nodes is cut by additional sampled bits, in several ways at once, with the same recall; what is
then still beyond ``CAP`` is compared whole, in tiles. Pairs are compared within a task and
never sent: a task returns each node's links and a root of its group. A pair that meets in
several buckets is counted in the first only. Groups are joined by distributed union-find. Candidates travel packed,
a row for each task that they go to; which buckets are oversized is told by a share of the nodes.

Defined results: a null text reads as the empty text; a text without words is hashed whole, so
all empty texts are copies of each other; equal rows, also with equal or null ids, are copies;
ids may repeat. Only the named columns are read by ``classes``; ``keep`` returns all columns of
its input. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, roots
from .kernels import U64, flat, lower_ascii, mix, pieces, range_hash, rows_of, spans
from .store import Scratch, tune

BITS = 256
MAX_DISTANCE = 40
#: Share of differing bits at which a pair is still found with probability RECALL.
DESIGN, RECALL = 0.15, 0.98
CAP = 4096
#: Additional bits of an oversized bucket's cuts.
MORE = 8
#: Oversized buckets whose numbers are sent to all tasks, at most: 8 bytes each.
LISTED = 1 << 20
#: Packs for each task: so many that tasks get about equal numbers of them.
SPREAD = 16
#: Rows of candidates in one task, about.
TASK_ROWS = 200_000
#: Verified pairs that a task holds at once, about; links between nodes of its groups that it holds before they become roots.
HELD, LINKED = 1 << 18, 1 << 18
#: Candidates that a task packs at once, about.
PACKED = 1 << 20

_FOLD = lower_ascii()
_FOLD[[b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = 0
_SALT = mix(np.arange(1, 5, dtype=U64))


def fingerprints(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The fingerprints of texts: a row of four 64-bit words each."""
    n = len(offs) - 1
    if n > 1 << 20:
        half = n // 2
        return np.concatenate([fingerprints(buf[: offs[half]], offs[: half + 1]), fingerprints(buf[offs[half] :], offs[half:] - offs[half])])
    low = _FOLD[buf]
    s, e = spans(low != 0, offs)
    bounds = rows_of(s, offs)
    bare = np.flatnonzero(bounds[1:] == bounds[:-1])
    doc = np.concatenate([np.repeat(np.arange(n), np.diff(bounds)), bare]).astype(U64)
    h = np.concatenate([range_hash(low, s, e), range_hash(buf, offs[bare], offs[bare + 1])])
    bits = 21  # the text's number; the other 43 are the word's
    key = np.sort(doc << U64(64 - bits) | h >> U64(bits))
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(key)))
    # a word counts once, and once more for each doubling of its number in the text
    key = np.repeat(key[head], np.log2(times).astype(np.int64) + 1)
    doc = (key >> U64(64 - bits)).astype(np.int64)
    h = mix(key << U64(bits))
    at = np.searchsorted(doc, np.arange(n + 1)).tolist()
    out = np.zeros((n, 4), U64)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        word = h[at[lo] : at[hi]]
        one = np.unpackbits(mix(word[:, None] ^ _SALT).view(np.uint8)).reshape(-1, BITS)
        total = np.zeros((hi - lo, BITS), np.int32)
        for i in range(lo, hi):
            a, z = at[i] - at[lo], at[i + 1] - at[lo]
            for q in range(a, z, 255):
                total[i - lo] += one[q : min(z, q + 255)].sum(0, dtype=np.uint8)
        count = np.diff(np.array(at[lo : hi + 1]))[:, None]
        out[lo:hi] = np.packbits(2 * total > count, axis=1).view(U64)
    return out


def sampled(tables: int, bits: int, seed: int) -> np.ndarray:
    """Random masks, a row of four 64-bit words each, with so many of the fingerprint's bits."""
    rng = np.random.default_rng([seed, bits])
    out = np.zeros((tables, BITS), np.uint8)
    for t in range(tables):
        out[t, rng.choice(BITS, bits, replace=False)] = 1
    return np.packbits(out, axis=1).view(U64).reshape(tables, 4)


def tables_for(bits: int, recall: float = RECALL, design: float = DESIGN) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - design) ** bits)))


def bits_for(nodes: int) -> int:
    """So many that a bucket has some 64 nodes: fewer, fuller buckets need fewer tables, and comparing is cheaper than sending."""
    return int(min(40, max(10, math.ceil(math.log2(max(nodes, 2))) - 6)))


def bucket(fp: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A 64-bit key of the fingerprints' bits under a mask."""
    x = fp & mask
    h = mix(x[:, 0] + U64(1))
    for k in range(1, 4):
        h = mix(h ^ x[:, k])
    return h


def agree(diff: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return ~((diff & mask) != 0).any(1)


def _pairs(group: np.ndarray, side: np.ndarray, fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of rows of one group each (groups ascending); rows of side 1 and 2 only with each other."""
    n = len(group)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, n))

    def close(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.zeros(len(i), np.int64)
        for k in range(4):
            d += np.bitwise_count(fp[i, k] ^ fp[j, k])
        ok = (d <= most) & ((side[i] == 0) | (side[i] != side[j]))
        return i[ok], j[ok]

    small = size <= 16
    end = np.repeat(np.append(start[1:], n), size)
    left = np.flatnonzero(np.repeat(small, size))
    step = 1
    while len(left):
        left = left[left + step < end[left]]
        for lo in range(0, len(left), 1 << 18):
            i = left[lo : lo + (1 << 18)]
            yield close(i, i + step)
        step += 1
    words = [np.ascontiguousarray(fp[:, k]) for k in range(4)]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for s, m in zip(start[~small].tolist(), size[~small].tolist()):
        rows = max(1, (1 << 17) // m)
        for a in range(s, s + m, rows):
            z = min(a + rows, s + m)
            d = np.zeros((z - a, s + m - a), np.uint16)
            for w in words:
                d += np.bitwise_count(w[a:z, None] ^ w[None, a : s + m])
            i, j = np.nonzero(d <= most)
            ok = j > i
            i, j = i[ok] + a, j[ok] + a
            ok = (side[i] == 0) | (side[i] != side[j])
            held.append((i[ok], j[ok]))
            waiting += np.count_nonzero(ok)
            # a dense group has as many pairs as the square of its nodes: they go on as they come
            if waiting > HELD or len(held) > 256:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, waiting = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def match(node: np.ndarray, fp: np.ndarray, weight: np.ndarray, table: np.ndarray, sub: np.ndarray, group: np.ndarray, side: np.ndarray, big: np.ndarray, masks: np.ndarray, subs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, the weight of the links counted here, and each one's root among them.

    Rows are candidates: a node may have several. ``big`` has the tables in which the node's
    bucket is cut by the masks ``subs``.
    """
    order = np.lexsort((side, group))
    node, fp, weight, table, sub, group, side, big = (x[order] for x in (node, fp, weight, table, sub, group, side, big))
    ids, who = np.unique(node, return_inverse=True)
    links = np.zeros(len(ids), np.int64)
    every, up = np.arange(len(ids)), np.arange(len(ids))
    on = np.zeros(len(ids), bool)
    a, b = [], []
    linked = 0

    def joined() -> np.ndarray:
        # what is known already is an edge from each node to its root
        return roots(len(ids), np.concatenate([every[up != every], *a]), np.concatenate([up[up != every], *b]))

    for i, j in _pairs(group, side, fp, most):
        if not len(i):
            continue
        on[who[i]] = on[who[j]] = True
        apart = up[who[i]] != up[who[j]]
        a.append(who[i][apart])
        b.append(who[j][apart])
        linked += len(a[-1])
        if linked > LINKED:
            up = joined()
            a, b, linked = [], [], 0
        diff = fp[i] ^ fp[j]
        first = np.ones(len(i), bool)
        cut = np.zeros(len(i), bool)
        any_sub = np.zeros(len(i), bool)
        if big.any():
            for m in range(len(subs)):
                same = agree(diff, subs[m])
                any_sub |= same
                cut |= same & (m < sub[i])
            first &= ~((sub[i] > 0) & cut)
        for t in range(len(masks)):
            before = np.flatnonzero(first & (t < table[i]))
            if not len(before):
                continue
            met = agree(diff[before], masks[t])
            if big.any():
                met &= ~big[i[before], t] | any_sub[before]
            first[before[met]] = False
        i, j = i[first], j[first]
        np.add.at(links, who[i], weight[j])
        np.add.at(links, who[j], weight[i])
    up = joined()
    return ids[on], links[on], ids[up[on]]


_FP = ["f0", "f1", "f2", "f3"]
_FP_DDL = ", ".join(f"{c} long" for c in _FP)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest of the text, fingerprint) of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(1))
            fp = [fingerprints(b, o) for _, _, b, o in pieces(buf, offs)]
            fp = (np.concatenate(fp) if fp else np.zeros((0, 4), U64)).view(np.int64)
            raw = memoryview(buf)
            key = [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(offs.tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(4))], names=["id", "digest", *_FP])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, digest binary, {_FP_DDL}")


def _candidates(nodes: DataFrame, masks: np.ndarray) -> DataFrame:
    """(table, group, node, fingerprint, weight) for every node and table."""
    tables = len(masks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.stack([c.to_numpy() for c in batch.columns[1:5]], 1).view(U64)
            for t in range(tables):
                key = bucket(fp, masks[t]) ^ U64(t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(key.view(np.int64)), *batch.columns], names=["table", "group", *batch.schema.names])

    return nodes.select("node", *_FP, "weight").mapInArrow(run, f"table int, group long, node long, {_FP_DDL}, weight long")


def _ident(table: np.ndarray | int, sub: np.ndarray | int, group: np.ndarray) -> np.ndarray:
    """A number for each bucket: two tables, or two cuts, may share a key."""
    return mix(group.view(U64) ^ mix((np.asarray(table, U64) << U64(16)) + np.asarray(sub, U64) + U64(1)))


def _result(col: dict[str, np.ndarray], fp: np.ndarray, big: np.ndarray, masks: np.ndarray, subs: np.ndarray, most: int) -> pa.RecordBatch:
    key = _ident(col["table"], col["sub"], col["group"])
    node, links, root = match(col["node"], fp, col["weight"], col["table"], col["sub"], key, col["side"], big, masks, subs, most)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], names=["node", "links", "root"])


_LINKS = "node long, links long, root long"


class Full:
    """Oversized buckets, and those of their cuts that are still too full, with the chunks that these are compared in."""

    def __init__(self, buckets: np.ndarray, still: np.ndarray, chunks: np.ndarray):
        self.buckets = np.sort(buckets)
        order = np.argsort(still)
        self.still, self.chunks = still[order], chunks[order]

    def has(self, ident: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.zeros(len(ident), bool)
        return self.buckets[np.minimum(np.searchsorted(self.buckets, ident), len(self.buckets) - 1)] == ident

    def parts(self, ident: np.ndarray) -> np.ndarray:
        """The chunks of each cut, 0 where it isn't too full."""
        if not len(self.still):
            return np.zeros(len(ident), np.int64)
        at = np.minimum(np.searchsorted(self.still, ident), len(self.still) - 1)
        return np.where(self.still[at] == ident, self.chunks[at], 0)


def _links(nodes: DataFrame, scratch: Scratch, max_distance: int, cap: int, more: int) -> DataFrame:
    """(node, links, root) of all nodes that have a link, several rows for a node."""
    spark = nodes.sparkSession
    count = nodes.count()
    bits = bits_for(count)
    masks = sampled(tables_for(bits), bits, 1)
    subs = sampled(tables_for(more), more, 2)
    tables = len(masks)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count * tables // TASK_ROWS)
    # How full the buckets are, by a share of the nodes, on the key alone. A bucket that is taken for too
    # full, or not, by chance is only compared in another way.
    rate = 16 if cap >= 1024 else 1
    some = nodes.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(rate)) == 0).select("node", *_FP, "weight")
    least = cap // rate * 3 // 4 if rate > 1 else cap
    full = scratch.cut(_candidates(some, masks).groupBy("table", "group").count().where(F.col("count") > least), "full")
    if full.count() > LISTED:
        return _joined(nodes, full, masks, subs, parts, max_distance, cap)
    got = full.toArrow()
    known = Full(_ident(got.column("table").to_numpy(), 0, got.column("group").to_numpy()), np.empty(0, U64), np.empty(0, np.int64))
    if got.num_rows:
        first = spark.sparkContext.broadcast(known)

        def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp = np.stack([c.to_numpy() for c in batch.columns[1:5]], 1).view(U64)
                for t in range(tables):
                    key = bucket(fp, masks[t]) ^ U64(t)
                    on = np.flatnonzero(first.value.has(_ident(t, 0, key)))
                    for m in range(len(subs)):
                        cut = _ident(t, m, mix(key[on] ^ bucket(fp[on], subs[m])) + U64(m))
                        yield pa.RecordBatch.from_arrays([pa.array(cut.view(np.int64))], names=["cut"])

        still = scratch.cut(some.mapInArrow(cuts, "cut long").groupBy("cut").count().where(F.col("count") > least), "still")
        if still.count() > LISTED:
            return _joined(nodes, full, masks, subs, parts, max_distance, cap)
        then = still.toArrow()
        known = Full(known.buckets, then.column("cut").to_numpy().view(U64), -(-then.column("count").to_numpy() * rate // cap))
    shared = spark.sparkContext.broadcast(known)
    words = -(-tables // 64) if got.num_rows else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        tiles = len(subs) * int(where.chunks.max(initial=1))
        todo: list[np.ndarray] = []
        while todo or (batch := next(batches, None)) is not None:
            base = todo.pop() if todo else np.stack([c.to_numpy() for c in batch.columns], 1)
            fp = np.ascontiguousarray(base[:, 1:5]).view(U64)
            n = len(base)
            keys = [bucket(fp, masks[t]) ^ U64(t) for t in range(tables)]
            over = np.stack([where.has(_ident(t, 0, keys[t])) for t in range(tables)], 1)
            if n > 1 and n * tables + np.count_nonzero(over) * tiles > PACKED:
                todo += [base[n // 2 :], base[: n // 2]]
                continue
            if words:
                flags = np.zeros((n, words * 64), np.uint8)
                flags[:, :tables] = over
                base = np.column_stack([base, np.packbits(flags, axis=1, bitorder="little").view(np.int64)])
            rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for t in range(tables):
                plain, cut = np.flatnonzero(~over[:, t]), np.flatnonzero(over[:, t])
                rows.append((np.full(len(plain), t), keys[t][plain], plain))
                for m in range(len(subs)) if len(cut) else ():
                    key = mix(keys[t][cut] ^ bucket(fp[cut], subs[m])) + U64(m)
                    chunks = where.parts(_ident(t, m, key))
                    code = t | m << 16
                    whole = np.flatnonzero(chunks == 0)
                    rows.append((np.full(len(whole), code), key[whole], cut[whole]))
                    # what more bits don't cut is compared in tiles: chunk x of the bucket meets chunk y
                    tiled = np.flatnonzero(chunks)
                    if len(tiled):
                        k = chunks[tiled]
                        mine = (mix(base[cut[tiled], 0].view(U64) + U64(7)) % k.astype(U64)).astype(np.int64)
                        at = np.repeat(np.arange(len(tiled)), k)
                        other = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
                        low, high = np.minimum(mine[at], other), np.maximum(mine[at], other)
                        side = np.where(mine[at] == other, 0, np.where(mine[at] < other, 1, 2))
                        rows.append((code | side << 32, mix(key[tiled][at] ^ mix((low << 32 | high).astype(U64) + U64(1))), cut[tiled][at]))
            code, key, at = (np.concatenate(x) for x in zip(*rows))
            part = (mix(_ident(code & 0xFFFF, code >> 16 & 0xFFFF, key)) % U64(SPREAD * parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            table = np.column_stack([code[order], key[order].view(np.int64), base[at[order]]])
            bounds = np.searchsorted(part[order], np.arange(SPREAD * parts + 1))
            on = np.flatnonzero(bounds[1:] > bounds[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array([table[bounds[p] : bounds[p + 1]].tobytes() for p in on], pa.binary())], names=["part", "pack"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(p, []).append(np.frombuffer(x, np.int64).reshape(-1, 8 + words))
        for p in list(by):
            t = np.concatenate(by.pop(p))
            big = np.unpackbits(np.ascontiguousarray(t[:, 8:]).view(np.uint8), axis=1, bitorder="little")[:, :tables].astype(bool) if words else np.zeros((len(t), 1), bool)
            col = {"table": t[:, 0] & 0xFFFF, "sub": t[:, 0] >> 16 & 0xFFFF, "side": t[:, 0] >> 32, "group": np.ascontiguousarray(t[:, 1]), "node": t[:, 2], "weight": t[:, 7]}
            yield _result(col, np.ascontiguousarray(t[:, 3:7]).view(U64), big, masks, subs, max_distance)

    return nodes.select("node", *_FP, "weight").mapInArrow(pack, "part int, pack binary").repartition(parts, "part").mapInArrow(unpack, _LINKS)


def _joined(nodes: DataFrame, full: DataFrame, masks: np.ndarray, subs: np.ndarray, parts: int, max_distance: int, cap: int) -> DataFrame:
    """``_links`` where the oversized buckets are too many to be sent to all: they are joined to the candidates, row by row."""
    tables = len(masks)
    rows = _candidates(nodes, masks)
    rows = rows.withColumn("sub", F.lit(0)).withColumn("side", F.lit(0))
    hit = rows.join(full.select("table", "group", F.lit(True).alias("over")), ["table", "group"], "left")
    flags = hit.where("over").groupBy("node").agg(F.sort_array(F.collect_set("table")).alias("big"))
    hit = hit.join(flags, "node", "left")
    every = F.array(*(F.lit(m) for m in range(len(subs))))
    wide = hit.where("over").withColumn("sub", F.explode(every))

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            fp = np.stack([batch.column(at[c]).to_numpy() for c in _FP], 1).view(U64)
            sub = batch.column(at["sub"]).to_numpy()
            key = batch.column(at["group"]).to_numpy().view(U64)
            for m in np.unique(sub):
                on = sub == m
                key = np.where(on, mix(key ^ bucket(fp, subs[m])) + U64(m), key)
            yield batch.set_column(at["group"], "group", pa.array(key.view(np.int64)))

    columns = ["table", "group", "node", *_FP, "weight", "sub", "side", "big"]
    wide = wide.select(columns)
    wide = wide.mapInArrow(regroup, wide.schema)
    # what more bits don't cut is compared in tiles: chunk x of the bucket meets chunk y
    still = wide.groupBy("table", "sub", "group").count().where(F.col("count") > cap).select("table", "sub", "group", F.ceil(F.col("count") / cap).cast("int").alias("chunks"))
    wide = wide.join(still, ["table", "sub", "group"], "left")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiled = wide.where("chunks IS NOT NULL").withColumn("mine", mine).withColumn("other", other)
    tiled = tiled.withColumn("side", F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2))
    tiled = tiled.withColumn("group", F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")))
    rows = hit.where("over IS NULL").select(columns).unionByName(wide.where("chunks IS NULL").select(columns)).unionByName(tiled.select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        col = {c: t.column(c).to_numpy() for c in ("node", "weight", "table", "sub", "group", "side")}
        fp = np.stack([t.column(c).to_numpy() for c in _FP], 1).view(U64)
        big = np.zeros((t.num_rows, tables), bool)
        for i, some in enumerate(t.column("big").to_pylist()):
            big[i, some or []] = True
        yield _result(col, fp, big, masks, subs, max_distance)

    return rows.repartition(parts, "table", "sub", "group").mapInArrow(run, _LINKS)


def _grouped(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, max_distance: int, cap: int, more: int) -> tuple[DataFrame, DataFrame]:
    """(id, digest, node) of every row; (node, class_id, links, texts) of every node."""
    tune(docs.sparkSession)
    rows = scratch.cut(signatures(docs, id_col, text_col).withColumn("node", F.xxhash64(*_FP)), "signatures")
    texts = rows.groupBy("digest", "node", *_FP).agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    nodes = scratch.cut(texts.groupBy("node").agg(*(F.first(c).alias(c) for c in _FP), F.count("*").alias("weight"), F.min("least").alias("least"), F.sum("rows").alias("rows")), "nodes")
    found = scratch.cut(_links(nodes, scratch, max_distance, cap, more), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    full = nodes.select("node", "weight", "least", "rows").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = full.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"))
    return rows.select("id", "digest", "node"), full.join(heads, "component").select("node", "component", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, cap: int = CAP, more: int = MORE) -> DataFrame:
    """(id, class_id, class_size, n_links, n_copies) of every row.

    ``class_id`` is the smallest id of the row's group of near duplicates, ``class_size`` the
    number of its rows; ``n_links`` counts the different texts that the row's text is linked to,
    ``n_copies`` the other rows with its very text.
    """
    scratch = Scratch(docs.sparkSession)
    rows, nodes = _grouped(docs, scratch, id_col, text_col, max_distance, cap, more)
    copies = rows.groupBy("digest").agg((F.count("*") - 1).alias("n_copies"))
    copies = copies.where("n_copies > 0")
    out = rows.join(nodes, "node").join(copies, "digest", "left")
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", "n_links", F.coalesce("n_copies", F.lit(0)).alias("n_copies"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, cap: int = CAP, more: int = MORE) -> DataFrame:
    """One row of each group of near duplicates, all columns: one with the smallest id, and of those the smallest text digest."""
    scratch = Scratch(docs.sparkSession)
    rows, nodes = _grouped(docs, scratch, id_col, text_col, max_distance, cap, more)
    first = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.hex("digest").alias("digest"))
    heads = rows.join(nodes, "node").groupBy("component").agg(F.min(first).alias("head"))
    heads = heads.select(F.col("head.id").alias("head_id"), F.col("head.digest").alias("head_digest"))
    # the rows' own columns go by other names meanwhile, so that no name of theirs can clash
    names = docs.columns
    safe = [f"c{i}" for i in range(len(names))]
    key = safe[names.index(id_col)]
    tagged = with_digest(docs.toDF(*safe), safe[names.index(text_col)], "row_digest")
    kept = tagged.join(heads, F.col(key).eqNullSafe(F.col("head_id")) & (F.col("row_digest") == F.col("head_digest")), "left_semi")
    if rows.groupBy("id", "digest").count().where("count > 1").head(1):
        kept = kept.dropDuplicates([key, "row_digest"])
    return kept.drop("row_digest").toDF(*names)


def with_digest(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with the hex digest of each text, as ``signatures`` makes it."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [hashlib.blake2b((t or "").encode(), digest_size=16).hexdigest().upper() for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))
