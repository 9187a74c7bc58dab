"""Matching in linear time: patterns of the dialect run by RE2, through Arrow's kernels.

RE2 never backtracks and needs no stack, so no pattern and no text can make it slow or crash it.
A batch of texts goes through a kernel at once. Where a pattern has word borders, which RE2 only
knows for ASCII, the texts are first rewritten by one ASCII character for each set of characters
that the pattern can't tell apart, word characters by word characters; positions are then mapped
back. The few patterns that RE2 refuses (programs beyond its bound on size, or more sets of
characters than ASCII has) are matched by a backtracking module instead.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import dialect as d

#: Bytes that may stand around matches, none of which occurs in the texts at hand.
_MARKS = [*range(9), *range(14, 32), 127]


def _hex(c: str) -> str:
    return rf"\x{{{ord(c):x}}}"


def _class(ranges: tuple[tuple[int, int], ...]) -> str:
    if not ranges:
        return r"[^\x{0}-\x{10ffff}]"
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" if a < b else rf"\x{{{a:x}}}" for a, b in ranges) + "]"


def _borders(n: object) -> bool:
    if isinstance(n, d.Look):
        return n.kind in ("word", "no word")
    if isinstance(n, d.Repeat):
        return _borders(n.node)
    return isinstance(n, (d.Seq, d.Alt)) and any(map(_borders, n.items))


def _singles(n: object) -> list[d.Property | d.Set_]:
    """The classes and characters of a tree, as classes."""
    if isinstance(n, d.Char):
        return [d.Set_(tuple((c, c) for c in (d.variants(n.char) if n.fold else n.char)))]
    if isinstance(n, (d.Property, d.Set_)):
        return [n]
    if isinstance(n, d.Repeat):
        return _singles(n.node)
    return [x for y in n.items for x in _singles(y)] if isinstance(n, (d.Seq, d.Alt)) else []


class _Letters(dict):
    """The ASCII character that stands for each character, found when it is first asked for."""

    def __init__(self, tree: object):
        super().__init__()
        self.sets = [d.code_points(s) for s in dict.fromkeys([d.WORD, *_singles(tree)])]
        newline = [((10, 10),)]
        edges = sorted({0} | {x for s in self.sets + newline for a, b in s for x in (a, b + 1)})
        self.starts = np.array([e for e in edges if e < 0x110000])
        kinds = np.zeros((len(self.starts), len(self.sets) + 1), bool)
        for k, s in enumerate(self.sets + newline):
            for a, b in s:
                kinds[np.searchsorted(self.starts, a) : np.searchsorted(self.starts, b, "right"), k] = True
        rows, which = np.unique(kinds, axis=0, return_inverse=True)
        word = iter("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
        other = iter([chr(c) for c in (*range(32, 48), *range(58, 65), *range(91, 95), 96, *range(123, 127))])
        self.letter = ["\n" if r[-1] else next(word if r[0] else other, None) for r in rows]
        if None in self.letter:
            raise ValueError("too many sets of characters")
        self.which, self.rows = which.ravel(), rows

    def __missing__(self, c: int) -> str:
        out = self[c] = self.letter[self.which[np.searchsorted(self.starts, c, "right") - 1]]
        return out

    def spelled(self, node: d.Property | d.Set_) -> str:
        k = self.sets.index(d.code_points(node))
        chars = [self.letter[i] for i in np.flatnonzero(self.rows[:, k]).tolist()]
        return _class(tuple((ord(c), ord(c)) for c in chars))


class Linear:
    """A pattern, ready for batches of texts."""

    def __init__(self, pattern: str):
        tree = d.parse(pattern)
        self.pattern = pattern
        self.nullable = d.nullable(tree)
        #: Empty matches are also found between the bytes of a character.
        self.inside = self.nullable and not d.asserts(tree)
        tree = d.simplify(tree)
        self.letters: _Letters | None = None
        self.re2: str | None = None
        try:
            if _borders(tree):
                self.letters = _Letters(tree)
                self.re2 = d.emit_re2(tree, lambda c: _hex(self.letters[ord(c)]), self.letters.spelled)
            else:
                self.re2 = d.emit_re2(tree, _hex, lambda node: _class(d.code_points(node)))
            pc.match_substring_regex(pa.array(["x"]), pattern=self.re2)
        except (pa.ArrowInvalid, ValueError):
            self.letters = self.re2 = None

    def _seen(self, texts: pa.Array) -> pa.Array:
        """What RE2 reads of the texts."""
        texts = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts
        if self.letters is None:
            return texts
        return pa.array([t if t is None else t.translate(self.letters) for t in texts.to_pylist()], pa.string())

    def found(self, texts: pa.Array) -> pa.Array:
        """Whether each text has a match; false for nulls."""
        if self.re2 is None:
            compiled = d.to_python(self.pattern)
            return pa.array([t is not None and compiled.search(t) is not None for t in texts.to_pylist()], pa.bool_())
        return pc.fill_null(pc.match_substring_regex(self._seen(texts), pattern=self.re2), False)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of each text's matches; 0 for nulls."""
        if self.nullable or self.re2 is None:
            return np.diff(self.ranges(texts)[0])
        return pc.fill_null(pc.count_substring_regex(self._seen(texts), pattern=self.re2), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)

    def ranges(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of each text's matches among all, their starts and their ends, in bytes of the text."""
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        marked = None
        if self.re2 is not None:
            seen = self._seen(texts)
            full = pc.fill_null(seen, "")
            mark = next((c for c in _MARKS if not pc.any(pc.match_substring(full, chr(c))).as_py()), None)
            if mark is not None:
                marked = pc.replace_substring_regex(full, pattern=self.re2, replacement=f"{chr(mark)}\\0{chr(mark)}")
        if marked is None:
            compiled = d.to_python(self.pattern)
            found = [d.find_all(compiled, t, self.inside) if t is not None else [] for t in texts.to_pylist()]
            flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 2)
            return np.append(0, np.cumsum([len(f) for f in found])).astype(np.int64), flat[:, 0], flat[:, 1]
        buf, offs = _bytes(marked)
        at = np.flatnonzero(buf == mark)
        bounds = np.searchsorted(at, offs)
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        place = at - offs[row] - (np.arange(len(at)) - bounds[row])
        keep = valid[row]
        bounds = np.append(0, np.cumsum(np.where(valid, np.diff(bounds), 0))) // 2
        starts, ends = place[keep][::2], place[keep][1::2]
        if self.letters is not None or self.inside:
            raw, offs = _bytes(pc.fill_null(texts.cast(pa.string()), ""))
            row = np.repeat(np.arange(len(texts)), np.diff(bounds))
            if self.letters is not None and len(starts):
                first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                base = np.searchsorted(first, offs)
                starts, ends = (np.minimum(first[base[row] + x], offs[row + 1]) - offs[row] for x in (starts, ends))
            if self.inside and len(starts):
                there = offs[row] + starts
                lead = raw[np.minimum(there, max(len(raw) - 1, 0))] if len(raw) else np.zeros(len(there), np.uint8)
                more = np.where((starts == ends) & (there < offs[row + 1]), (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0), 0)
                step = np.arange(int((more + 1).sum())) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                starts, ends = np.repeat(starts, more + 1) + step, np.repeat(ends, more + 1) + step
                bounds = np.append(0, np.cumsum(more + 1))[bounds]
        return bounds.astype(np.int64), starts, ends

    def texts(self, texts: pa.Array) -> pa.Array:
        """The matched texts of each text."""
        bounds, starts, ends = self.ranges(texts)
        raw, offs = _bytes(pc.fill_null(texts.cast(pa.string()), ""))
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        size = ends - starts
        cut = np.append(0, np.cumsum(size))
        where = np.arange(cut[-1]) + np.repeat(offs[row] + starts - cut[:-1], size)
        flat = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[where]))).cast(pa.string())
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, and their bounds."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, off, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(off, width, len(texts) + texts.offset + 1)[texts.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]


@cache
def compiled(pattern: str) -> Linear:
    """The pattern, compiled once in each process."""
    return Linear(pattern)
