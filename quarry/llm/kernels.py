"""Numpy kernels over the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = []

#: Bytes of text that a kernel works on at once; a longer text is a piece of its own.
PIECE = 1 << 20


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64, n + 1 + column.offset)[column.offset :]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    lo, hi = int(offs[0]), int(offs[-1])
    return np.frombuffer(data, np.uint8, hi)[lo:], offs - lo


def pieces(buf: np.ndarray, offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, row past the last, bytes, offsets."""
    n, at = len(offs) - 1, 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _POW or len(_POW[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 16
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            x = np.full(size, b, U64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=U64))
        _POW[:] = out
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def spans(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, none of which crosses a text's border."""
    n = len(mask)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s, e = mask.copy(), mask.copy()
    s[1:] &= ~mask[:-1]
    e[:-1] &= ~mask[1:]
    edge = offs[:-1][offs[:-1] < n]
    s[edge] = mask[edge]
    edge = offs[1:][offs[1:] > 0] - 1
    e[edge] = mask[edge]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


def range_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end]; they depend on the content alone."""
    n = len(codes)
    p, q = powers(n + 1)
    c = np.zeros(n + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * p[:n], out=c[1:])
    return mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def rows_of(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For ascending positions, the bounds of each text's positions: n + 1 indexes."""
    return np.searchsorted(starts, offs, "left")


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], 0 for empty ranges."""
    n = len(bounds) - 1
    out = np.zeros((n, *values.shape[1:]), values.dtype if values.dtype != bool else np.int64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=out.dtype)
    return out


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def code_points(buf: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each byte: n + 1 counts."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def record(names: list[str], arrays: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, t.type) if not isinstance(a, pa.Array) else a.cast(t.type) for a, t in zip(arrays, schema)], names=names)
