"""Fuzzy line deduplication: MinHash bands, exact Jaccard, one line kept of each component.

A line's normal form is its ASCII letters (folded), digits and non-ASCII bytes; its shingles are
the distinct runs of ``SHINGLE`` bytes of that form. Two lines are near if the Jaccard
similarity of their shingles is at least ``NEAR``. Lines of one normal form are one node. A node of
under ``SHORT`` bytes is near to none but itself: its lines are repeats by their normal form. Other nodes
with a common MinHash band (``BANDS`` of ``ROWS`` rows, over shingles of ``LONGER`` bytes) are
candidates. Candidates that hang
together are a family, found by distributed union-find before any text moves; the texts then go
to their families, once, and are compared there exactly: in each bucket the smallest node with
all others, then all pairs that are still in different components. A family of more than
``FAMILY`` nodes is not gathered: its pairs are joined to their texts instead, with the same
result. Of every component of near lines the one at the smallest (id, text hash, line number) is
kept.

A bucket's rows are reduced to one per ``SENT`` nodes of a task before they are shuffled, so a line that a third of
all texts hold, or thousands of near copies of it, costs one row for each; rows travel packed.

Defined results: a null or empty text has no lines; lines end at line feeds; lines whose normal
form is empty are never removed; rows equal in id and text are one document and
share its decisions; null ids come after all others. ``removals`` reads only the named columns;
``dedupe`` returns all columns of its input, without texts of which nothing but white space is
left after a removal. An empty table gives an empty result. Nodes are 64-bit hashes of normal
forms; lines are only removed as equal, or as those compared, by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, roots
from .kernels import U64, flat, lower_ascii, mix, pieces
from .store import Scratch, input_bytes, tune

SHINGLE, NEAR = 5, 0.8
#: Signatures are of longer shingles: lines that merely share a language share few of them, so that
#: strangers don't become candidates as lines grow in number. More bands make up for it: words edited
#: to a similarity of 0.8 leave one of 0.76 of the longer shingles, and 16 bands find 99 % of such pairs.
LONGER = 7
BANDS, ROWS = 16, 5
SHORT = 20
#: Nodes of one task that meet before they are sent, at most.
SENT = 1 << 17
#: Nodes that hang together and are compared within one task, at most.
FAMILY = 20_000
#: Bytes of input for each task of the bands, at most, and its parts: so many that tasks get about equal numbers of them.
PART, SPREAD = 128 << 20, 16
#: Bits of the filter of nodes whose texts are fetched: its size doesn't grow with the data.
FILTER_BITS = 26

_FOLD = lower_ascii()
_FOLD[[b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = 0
_RNG = np.random.default_rng(6)
_A = (_RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingles(norm: np.ndarray, offs: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """At each byte of lines of at least ``width`` bytes the shingle there; past a line's last one, its first again."""
    n = len(norm)
    x = np.zeros(n, U64)
    for k in range(width):
        x[: n - k] |= norm[k:].astype(U64) << U64(8 * k)
    for k in range(1, width):
        x[offs[1:] - k] = x[offs[:-1]]
    return x


def bands(norm: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The band keys of each line: BANDS 64-bit numbers."""
    h = (shingles(norm, offs, LONGER) * U64(0x9E3779B97F4A7C15) >> U64(32)).astype(np.uint32)
    out = np.zeros((len(offs) - 1, BANDS), U64)
    tmp = np.empty_like(h)
    for b in range(BANDS):
        key = np.full(len(offs) - 1, b + 1, U64)
        for r in range(b * ROWS, (b + 1) * ROWS):
            np.multiply(h, _A[r], out=tmp)
            np.add(tmp, _B[r], out=tmp)
            key = mix(key ^ np.minimum.reduceat(tmp, offs[:-1]).astype(U64) + (key << U64(6)))
        out[:, b] = key
    return out


def split(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normal forms of all lines, their bounds, each line's text, and its number in it."""
    breaks = np.flatnonzero(buf == 10)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    starts = np.sort(np.concatenate([offs[:-1][full], breaks + 1]))
    # a line feed at the very end of a text opens an empty line there, at the next text's start
    doc = np.concatenate([full, np.searchsorted(offs, breaks, "right") - 1])
    order = np.argsort(np.concatenate([offs[:-1][full] * 2 + 1, (breaks + 1) * 2]), kind="stable")
    doc = doc[order]
    low = _FOLD[buf]
    on = low != 0
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(on, out=at[1:])
    first = np.searchsorted(doc, np.arange(len(offs)))
    return low[on], np.append(at[starts], at[-1]), doc, np.arange(len(doc)) - first[doc]


def pick(norm: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some lines, and their bounds."""
    size = np.diff(bounds)
    on = np.zeros(len(size), bool)
    on[which] = True
    return norm[np.repeat(on, size)], np.append(0, np.cumsum(size[which]))


def _nodes(norm: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines' nodes, and 64 more bits of their normal forms."""
    raw = memoryview(np.ascontiguousarray(norm))
    both = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(bounds[which].tolist(), bounds[which + 1].tolist())), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _tables(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Kind 0: a line (id, row, line, node = x, more bits of its form = y). 3: a text with so many lines. 4: a node x in a bucket y with others. 5: nodes x and y of one bucket."""
    kind = dict(docs.dtypes)[id_col]
    names = ["part", "kind", "id", "row", "line", "x", "y", "pack"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bucket, member = [], []
        id_type = None

        def packed(code: int, where: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
            order = np.argsort(where, kind="stable")
            table = np.stack(columns, 1)[order]
            cut = np.searchsorted(where[order], np.arange(parts + 1))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            n = len(full)
            blobs = [table[cut[p] : cut[p + 1]].tobytes() for p in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(n, code, np.int8)), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(blobs, pa.binary())], names=names)

        def send() -> Iterator[pa.RecordBatch]:
            y, x = np.concatenate(bucket).view(np.int64), np.concatenate(member)
            order = np.lexsort((x, y))
            y, x = y[order], x[order]
            head = np.concatenate([[True], y[1:] != y[:-1]])
            first, rest = np.flatnonzero(head), np.flatnonzero(~head)
            yield packed(1, y[first] % parts, [y[first], x[first]])
            # nodes beside the first of their bucket go anywhere, not all to the bucket's place
            yield packed(2, x[rest] % parts, [y[rest], x[first][np.cumsum(head)[rest] - 1], x[rest]])
            seen.clear()
            bucket.clear()
            member.clear()

        for batch in batches:
            ids, rows, spread = batch.column(0), batch.column(2), batch.column(3).to_numpy()
            id_type = ids.type
            buf, offs = flat(batch.column(1))
            for lo, hi, b, o in pieces(buf, offs, 1 << 18):
                norm, bounds, doc, number = split(b, o)
                size = np.diff(bounds)
                which = np.flatnonzero(size)
                node, form = _nodes(norm, bounds, which)
                long = size[which] >= SHORT
                at = pa.array(lo + doc[which])
                n = len(which)
                # lines, of which a third may be alike, go where their texts' rows go, not all to one place
                place = spread[lo + doc[which]] % parts
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(np.zeros(n, np.int8)), ids.take(at), rows.take(at), pa.array(number[which].astype(np.int32)), pa.array(node), pa.array(form), pa.nulls(n, pa.binary())], names=names)
                n = hi - lo
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array((spread[lo:hi] % parts).astype(np.int32)), pa.array(np.full(n, 3, np.int8)), ids.slice(lo, n), rows.slice(lo, n), pa.array(np.bincount(doc, minlength=n).astype(np.int32)), none, none, pa.nulls(n, pa.binary())], names=names)
                new = []
                for i in np.flatnonzero(long).tolist():
                    x = int(node[i])
                    if x not in seen:
                        seen.add(x)
                        new.append(i)
                if new:
                    key = bands(*pick(norm, bounds, which[new]))
                    bucket.append(key.ravel())
                    member.append(np.repeat(node[new], BANDS))
                if len(seen) > SENT:
                    yield from send()
        if bucket:
            yield from send()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ["id", "row", "line", "x", "y", "kind"]
        single, beside = [], []
        id_type = None

        def plain(code: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            n = len(x)
            return pa.RecordBatch.from_arrays([pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(x), pa.array(y), pa.array(np.full(n, code, np.int8))], names=out)

        for batch in batches:
            id_type = batch.column(2).type
            code = batch.column(1).to_numpy()
            for i in np.flatnonzero((code == 1) | (code == 2)).tolist():
                (single if code[i] == 1 else beside).append(np.frombuffer(batch.column(7)[i].as_py(), np.int64))
            rows = batch.filter(pa.array((code == 0) | (code == 3)))
            yield pa.RecordBatch.from_arrays([*rows.columns[2:7], rows.column(1)], names=out)
        if beside:
            t = np.concatenate(beside).reshape(-1, 3)
            yield plain(4, np.concatenate([t[:, 1], t[:, 2]]), np.concatenate([t[:, 0], t[:, 0]]))
            e = np.unique(t[:, 1:], axis=0) if len(t) < 1 << 20 else t[:, 1:]
            yield plain(5, np.ascontiguousarray(e[:, 0]), np.ascontiguousarray(e[:, 1]))
        if single:
            t = np.concatenate(single).reshape(-1, 2)
            del single
            order = np.lexsort((t[:, 1], t[:, 0]))
            y, x = t[order, 0], t[order, 1]
            head = np.concatenate([[True], y[1:] != y[:-1]])
            first = np.maximum.accumulate(np.where(head, np.arange(len(y)), 0))
            more = np.flatnonzero(x != x[first])
            group = np.zeros(len(y), bool)
            group[more] = group[first[more]] = True
            yield plain(4, x[group], y[group])
            e = np.unique(np.stack([x[first[more]], x[more]], 1), axis=0)
            yield plain(5, np.ascontiguousarray(e[:, 0]), np.ascontiguousarray(e[:, 1]))

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 31)).alias("spread"))
    sent = source.mapInArrow(run, f"part int, kind tinyint, id {kind}, row long, line int, x long, y long, pack binary")
    return sent.repartition(parts // SPREAD, "part").mapInArrow(meet, f"id {kind}, row long, line int, x long, y long, kind tinyint")


def _filter(nodes: DataFrame) -> np.ndarray:
    """A bit for each node, by its lowest bits."""
    rows = nodes.select((F.col("node").bitwiseAND((1 << FILTER_BITS) - 1)).alias("bit")).groupBy(F.shiftright("bit", 3).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).cast("int").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _texts(docs: DataFrame, text_col: str, wanted: np.ndarray) -> DataFrame:
    """(node, form, normal form) of the lines whose node passes the filter, perhaps several times."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > 1 << 18:
                seen = set()
            for _, _, b, o in pieces(*flat(batch.column(0))):
                norm, bounds, _, _ = split(b, o)
                which = np.flatnonzero(np.diff(bounds) >= SHORT)
                node, form = _nodes(norm, bounds, which)
                bit = node & ((1 << FILTER_BITS) - 1)
                ok = np.flatnonzero(shared.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).tolist()
                ok = [i for i, x in zip(ok, node[ok].tolist()) if not (x in seen or seen.add(x))]
                raw = norm.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(form[ok]), pa.array([raw[bounds[i] : bounds[i + 1]] for i in which[ok]], pa.binary())], names=["node", "form", "norm"])

    return docs.select(text_col).mapInArrow(run, "node long, form long, norm binary")


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, numbered among those of all, and the texts' bounds."""
    offs = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
    x = shingles(np.frombuffer(b"".join(texts), np.uint8), offs)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    key = np.sort(np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offs)) << 32 | rank)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & 0xFFFFFFFF, np.searchsorted(key >> 32, np.arange(len(texts) + 1))


def jaccard(sets: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of the sets a[i] and b[i]."""
    rank, bounds = sets
    size = np.diff(bounds)
    both = np.concatenate([a, b])
    lens = size[both]
    ends = np.cumsum(lens)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[both] - ends + lens, lens)
    pair = np.repeat(np.concatenate([np.arange(len(a)), np.arange(len(a))]), lens)
    key = np.sort(pair << 32 | rank[at])
    inter = np.bincount(key[1:][key[1:] == key[:-1]] >> 32, minlength=len(a))
    return inter / (size[a] + size[b] - inter)


def similarities(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Exact Jaccard similarity of the shingles of left[i] and right[i]."""
    n = len(left)
    return jaccard(shingle_sets([*left, *right]), np.arange(n), np.arange(n, 2 * n)) if n else np.zeros(0)


def compare(texts: list[bytes], bucket: np.ndarray, member: np.ndarray, near: float) -> np.ndarray:
    """The smallest number of each text's component; ``member`` are the texts in the ``bucket`` beside them."""
    n = len(texts)
    sets = shingle_sets(texts)
    size = np.diff(sets[1])
    up = np.arange(n)
    tested: list[np.ndarray] = []

    def test(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal up
        step = np.cumsum(size[a] + size[b])
        at = 0
        while at < len(a):
            # a share at a time; what it connects is not compared again
            to = max(at + 1, int(np.searchsorted(step, (step[at - 1] if at else 0) + (1 << 19))))
            x, y = a[at:to], b[at:to]
            apart = up[x] != up[y]
            x, y = x[apart], y[apart]
            ok = jaccard(sets, x, y) >= near
            tested.append(x[~ok] * n + y[~ok])
            if ok.any():
                up = roots(n, np.concatenate([np.arange(n), x[ok]]), np.concatenate([up, y[ok]]))
            at = to

    key = np.unique(np.stack([bucket, member], 1), axis=0)
    bucket, member = key[:, 0], key[:, 1]
    head = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(len(bucket)), 0))
    star = np.unique(np.stack([member[first[~head]], member[~head]], 1), axis=0)
    once = np.zeros(len(star), bool)
    once[np.unique(star[:, 1], return_index=True)[1]] = True
    for some in (star[once], star[~once]):
        test(some[:, 0], some[:, 1])
    # buckets in several components: all pairs across them
    starts = np.flatnonzero(head)
    lens = np.diff(np.append(starts, len(bucket)))
    root = up[member]
    several = np.maximum.reduceat(root, starts) != np.minimum.reduceat(root, starts)
    on = np.repeat(several, lens)
    end = np.repeat(starts + lens, lens)
    left, step = np.flatnonzero(on), 1
    known = np.unique(np.concatenate(tested)) if tested else np.zeros(0, np.int64)
    cross: list[np.ndarray] = []
    pending = 0

    def settle() -> None:
        nonlocal known, cross, pending
        pairs = np.setdiff1d(np.concatenate(cross), known)
        test(pairs // n, pairs % n)
        known, cross, pending = np.union1d(known, np.concatenate(tested)) if tested else known, [], 0

    while len(left):
        left = left[left + step < end[left]]
        a, b = member[left], member[left + step]
        apart = up[a] != up[b]
        if apart.any():
            cross.append(a[apart] * n + b[apart])
            pending += len(cross[-1])
            if pending > 1 << 18:
                settle()
        step += 1
    if cross:
        settle()
    return up


def _families(rows: DataFrame, near: float) -> DataFrame:
    """(node, form, component) of the nodes of whole families: rows (family, node, bucket or else form, text or null)."""

    def done(node: np.ndarray, bucket: np.ndarray, text: list[bytes | None]) -> pa.RecordBatch:
        has = np.array([t is not None for t in text], bool)
        where = np.flatnonzero(has)
        where = where[np.lexsort((bucket[where], node[where]))]
        ids, at = np.unique(node[where], return_index=True)
        where = where[at]
        member = node[~has]
        if len(ids) and len(member):
            up = compare([text[i] for i in where.tolist()], bucket[~has], np.searchsorted(ids, member), near)
            on = np.flatnonzero(np.bincount(up, minlength=len(ids))[up] > 1)
        else:
            up, on = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[on], pa.int64()), pa.array(bucket[where[on]], pa.int64()), pa.array(ids[up[on]], pa.int64())], names=["node", "form", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list]] = []
        size = 0
        for batch in batches:
            family, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bucket = batch.column(2).to_numpy()
            held.append((family, node, bucket, batch.column(3).to_pylist()))
            size += batch.nbytes
            if size < 4 << 20:
                continue
            # all families but the last, which may go on
            f = np.concatenate([h[0] for h in held])
            cut = int(np.searchsorted(f, f[-1]))
            if not cut:
                continue
            n, b, t = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), [x for h in held for x in h[3]]
            yield done(n[:cut], b[:cut], t[:cut])
            held = [(f[cut:], n[cut:], b[cut:], t[cut:])]
            size = sum(len(x or b"") + 24 for x in t[cut:])
        if held:
            yield done(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), [x for h in held for x in h[3]])

    return rows.repartition("family").sortWithinPartitions("family").mapInArrow(run, "node long, form long, component long")


def _verified(pairs: DataFrame, texts: DataFrame, near: float) -> DataFrame:
    """The pairs (a, b) that are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(batch.column(k).nbytes for k in (2, 3))
            step = max(1, batch.num_rows * (1 << 20) // max(int(size), 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ok = similarities(part.column(2).to_pylist(), part.column(3).to_pylist()) >= near
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok))

    one = texts.select(F.col("node").alias("b"), F.col("norm").alias("norm_b"))
    two = texts.select(F.col("node").alias("a"), F.col("norm").alias("norm_a"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "norm_a", "norm_b").mapInArrow(run, "a long, b long")


def _large_families(members: DataFrame, texts: DataFrame, near: float, scratch: Scratch) -> DataFrame:
    """(node, form, component), as ``_families`` finds it, without gathering a family."""
    texts = scratch.cut(texts.groupBy("node").agg(F.min(F.struct("form", "norm")).alias("t")).select("node", "t.form", "t.norm"), "texts")
    centers = members.groupBy("bucket").agg(F.min("node").alias("a"))
    pairs = scratch.cut(members.join(centers, "bucket").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    edges = scratch.cut(_verified(pairs, texts, near), "edges")
    groups = components(edges, scratch)
    placed = members.join(groups, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    placed = scratch.cut(placed.join(several, "bucket", "left_semi"), "placed")
    other = placed.select("bucket", F.col("node").alias("other"), F.col("component").alias("other_component"))
    cross = placed.join(other, "bucket").where("component <> other_component AND node < other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    more = scratch.cut(_verified(cross.join(pairs, ["a", "b"], "left_anti"), texts, near), "edges")
    found = components(edges.unionByName(more), scratch) if more.head(1) else groups
    return found.join(texts.select("node", "form"), "node").select("node", "form", "component")


def _decided(docs: DataFrame, id_col: str, text_col: str, near: float, family: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The tables of ``_tables``, and (id, row, removed, kept_in) of the texts that lose lines."""
    tune(docs.sparkSession)
    # what meets in one task stays in its memory: the tasks grow with the input
    parts = SPREAD * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // PART)
    t = scratch.cut(_tables(docs, id_col, text_col, parts), "lines", "kind")
    families = scratch.cut(components(t.where("kind = 5").select(F.col("x").alias("a"), F.col("y").alias("b")), scratch).withColumnRenamed("component", "family"), "families")
    large = scratch.cut(families.groupBy("family").count().where(F.col("count") > family).select("family"), "large")
    members = t.where("kind = 4").select(F.col("x").alias("node"), F.col("y").alias("bucket")).join(families, "node")
    texts = _texts(docs, text_col, _filter(families)).join(families, "node")
    rows = members.select("family", "node", "bucket", F.lit(None).cast("binary").alias("norm")).unionByName(texts.select("family", "node", F.col("form").alias("bucket"), "norm"))
    some = bool(large.head(1))
    if some:
        rows = rows.join(large, "family", "left_anti")
    groups = _families(rows, near)
    if some:
        wide = scratch.cut(members.join(large, "family", "left_semi").select("bucket", "node").distinct(), "members")
        groups = groups.unionByName(_large_families(wide, texts.join(large, "family", "left_semi").select("node", "form", "norm"), near, scratch))
    groups = scratch.cut(groups, "groups")
    where = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("line").alias("line"))
    lines = t.where("kind = 0").select("id", "row", "line", F.col("x").alias("node"), F.col("y").alias("form"))
    by_node = lines.groupBy("node", "form").agg(F.min(where).alias("first"), F.max(where).alias("final"))
    # lines of a component, or else of one form
    by_node = by_node.join(groups, ["node", "form"], "left").select("node", "form", "first", "final", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("form")).otherwise(0).alias("alone"))
    heads = by_node.groupBy("component", "alone").agg(F.min("first").alias("head"), F.max("final").alias("final")).where(~F.col("head").eqNullSafe(F.col("final"))).select("component", "alone", "head")
    lost = by_node.select("node", "form", "component", "alone").join(heads, ["component", "alone"]).select("node", "form", "head")
    gone = lines.join(lost, ["node", "form"]).where(~where.eqNullSafe(F.col("head")))
    by_text = gone.select("id", "row", "line", F.col("head.id").alias("kept")).groupBy("id", "row").agg(F.sort_array(F.collect_set("line")).alias("removed"), F.sort_array(F.collect_set("kept")).alias("kept_in"))
    return t, by_text


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: float = NEAR, family: int = FAMILY) -> DataFrame:
    """(id, n_lines, n_removed, removed_lines, kept_in) of every row: the numbers of the lines it loses, from 0, and the ids of the texts that keep a line of their components."""
    scratch = Scratch(docs.sparkSession)
    t, gone = _decided(docs, id_col, text_col, near, family, scratch)
    gone = gone.withColumnRenamed("id", "gone_id").withColumnRenamed("row", "gone_row")
    texts = t.where("kind = 3").select("id", "row", F.col("line").cast("long").alias("n_lines"))
    out = texts.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left")
    return out.select(F.col("id").alias(id_col), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"), F.coalesce("kept_in", F.array().cast(f"array<{dict(docs.dtypes)[id_col]}>")).alias("kept_in"))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: float = NEAR, family: int = FAMILY) -> DataFrame:
    """docs, all columns, with the lines removed from the texts; see the module."""
    scratch = Scratch(docs.sparkSession)
    _, gone = _decided(docs, id_col, text_col, near, family, scratch)
    names = docs.columns
    at = names.index(text_col)
    safe = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*safe).withColumn("row", F.xxhash64(safe[at]))
    key = safe[names.index(id_col)]
    joined = plain.join(gone, F.col(key).eqNullSafe(F.col("id")) & (plain["row"] == gone["row"]), "left").select(*safe, "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = batch.column(len(names)).to_pylist()
            hit = [i for i, r in enumerate(removed) if r]
            batch = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=safe)
            if hit:
                texts = batch.column(at).to_pylist()
                keep = np.ones(len(texts), bool)
                for i in hit:
                    drop = set(removed[i])
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in drop)
                    keep[i] = bool(texts[i].strip())
                batch = batch.set_column(at, safe[at], pa.array(texts, pa.string())).filter(pa.array(keep))
            yield batch

    return joined.mapInArrow(run, docs.toDF(*safe).schema).toDF(*names)
