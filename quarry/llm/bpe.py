"""BPE encoding and decoding with a word-end vocabulary, in batched numpy merge rounds.

A text is cut at its special tokens, then at white space, and each distinct chunk is encoded
once per worker: NFC, lower case, the tokenizer's word pattern, bytes as printable symbols. The
symbols of all new words lie in one flat array. A round finds the lowest-ranked pair of every
unfinished word (ranks by binary search over the sorted pair keys, looked up again only next to
a merge) and merges it in all words at once.

Defined results: a null or empty text has no tokens; texts of any length are encoded whole;
equal texts give equal ids; rows are independent, so repeated ids and rows keep their number.
Only the id and text columns are read: other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .store import tune

_WORD = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.V0)
#: What str.split takes for white space and the tokenizer does not.
_ODD = "\x1c\x1d\x1e\x1f"
_SPACE = regex.compile(r"\p{White_Space}+")
#: Chunks that a worker remembers; then it forgets all and starts again.
MEMORY = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges flat[start:start + size] one after another, and their bounds."""
    bounds = np.append(0, np.cumsum(sizes))
    where = np.arange(bounds[-1])
    where += np.repeat(starts - bounds[:-1], sizes)
    return flat.take(where, mode="clip"), bounds


class Bpe:
    """One vocabulary file, loaded; keeps the chunks it has encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.end] for s in symbols], np.int64)
        #: No merge's parts are made by a later merge: then all places of a word's best pair may merge in one round.
        first = np.full(max(self.token) + 1, -1, np.int64)
        first[made[::-1]] = np.arange(len(made))[::-1]
        rank = np.arange(len(made))
        self.ordered = bool((first[left] < rank).all() and (first[right] < rank).all())
        tokens = [self.token.get(i, "").encode() for i in range(max(self.token) + 1)]
        self.token_size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_text = np.frombuffer(b"".join(tokens), np.uint8)
        self.begin()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, by binary search; the number of merges where there is none."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the number of each word's; words are not empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(sizes)
        sym[ends - 1] = self.last[raw[ends - 1]]
        none = len(self.keys)
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), none, np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.rank(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            if (best == none).any():
                live = np.repeat(best != none, np.diff(np.append(starts, len(sym))))
                done.append((word[~live], sym[~live]))
                sym, word, rank = sym[live], word[live], rank[live]
                continue
            size = np.diff(np.append(starts, len(sym)))
            hit = np.flatnonzero(rank == np.repeat(best, size))
            if self.ordered:
                # of pairs that overlap, as in a run of one symbol, every other one from the left
                run = np.concatenate([[False], (hit[1:] == hit[:-1] + 1) & (word[hit[1:]] == word[hit[:-1]])])
                where = np.arange(len(hit))
                head = np.maximum.accumulate(np.where(run, 0, where))
                hit = hit[(where - head) % 2 == 0]
            else:
                hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))
            sym, word, rank = sym[keep], word[keep], rank[keep]
            near = np.zeros(len(sym), bool)
            near[moved] = True
            near[moved[moved > 0] - 1] = True
            again = np.flatnonzero(near)
            rank[again] = none
            again = again[again + 1 < len(sym)]
            again = again[word[again] == word[again + 1]]
            rank[again] = self.rank(sym[again], sym[again + 1])
        word = np.concatenate([w for w, _ in done])
        order = np.argsort(word, kind="stable")
        return np.concatenate([x for _, x in done])[order], np.bincount(word, minlength=len(words))

    def learn(self, new: list[str]) -> None:
        """Encode chunks that aren't known yet; none of them holds a line break."""
        s = unicodedata.normalize("NFC", "\n".join(new)).replace("Σ", "σ").lower()
        words = _WORD.findall(s)
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        mark = number.pop("\n", None)
        if mark is not None:
            number = {w: i for i, w in enumerate(number)}
        flat, n = self.merge([w.encode() for w in number])
        which = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
        chunk = np.cumsum(which < 0)
        which, chunk = which[which >= 0], chunk[which >= 0]
        ids, _ = gather(flat, (np.cumsum(n) - n)[which], n[which])
        sizes = np.bincount(chunk, n[which], len(new)).astype(np.int64)
        base = len(self.number)
        self.number.update(zip(new, range(base, base + len(new))))
        self.add(ids, sizes)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append chunks' ids, and the decoded text of each with one blank at its end."""
        size = self.token_size[ids] + 1
        text, bounds = gather(self.token_text, self.token_at[ids], size)
        text[bounds[1:] - 1] = 32
        ends = np.cumsum(sizes)
        width = np.diff(bounds[np.append(0, ends)])
        for kept, more in zip(self.kept, (ids.astype("<u4"), text)):
            kept.append(more)
        for where, sizes_ in ((0, sizes), (1, width)):
            last = self.at[where][-1] + self.size[where][-1] if len(self.at[where]) else 0
            self.at[where] = np.append(self.at[where], last + np.cumsum(sizes_) - sizes_)
            self.size[where] = np.append(self.size[where], sizes_)

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in _ODD):
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def pieces(self, text: str) -> list[str]:
        """The text's chunks; special tokens are chunks of their own."""
        if self.cut is None or "<|" not in text:
            return self.chunks(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.chunks(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.chunks(text[at:])

    def begin(self) -> None:
        """Forget all chunks but the special tokens."""
        self.number = {s: i for i, s in enumerate(self.special)}
        self.kept: list[list[np.ndarray]] = [[], []]
        self.at, self.size = [np.empty(0, np.int64), np.empty(0, np.int64)], [np.empty(0, np.int64), np.empty(0, np.int64)]
        ids = np.array(list(self.special.values()), np.int64)
        self.add(ids, np.ones(len(ids), np.int64))

    def encode_bytes(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian 32-bit integers, and the decoded text in UTF-8."""
        if len(self.number) > MEMORY:
            self.begin()
        cut = [self.pieces(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        which = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        lost = np.flatnonzero(which < 0).tolist()
        if lost:
            self.learn(list(dict.fromkeys(flat[i] for i in lost)))
            which[lost] = [self.number[flat[i]] for i in lost]
        bounds = np.append(0, np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))))
        out = []
        for k in (0, 1):
            if len(self.kept[k]) > 1:
                self.kept[k] = [np.concatenate(self.kept[k])]
            got, ends = gather(self.kept[k][0], self.at[k][which], self.size[k][which])
            unit, raw = got.itemsize, got.tobytes()
            e = (ends[bounds] * unit).tolist()
            out.append([raw[a : b - k] if b > a else b"" for a, b in zip(e, e[1:])])
        return list(zip(*out)) if texts else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, "<u4") for b, _ in self.encode_bytes(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by blanks, special ones included, unknown ids left out: the vocabulary has no decoder of its own."""
        return " ".join(self.token[i] for i in map(int, ids) if i in self.token)


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _groups(texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row; see the module for odd cases."""
    tune(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            for group in _groups(texts):
                got = bpe.encode_bytes(group)
                ids = [np.frombuffer(b, "<i4") for b, _ in got]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array(ids, pa.list_(pa.int32())), pa.array([t.decode() for _, t in got], pa.string())], names=[id_col, "ids", "decoded"])
                at += len(group)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded string) of every row of ids; null ids decode to the empty text."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row, hashed where it is encoded so that no ids travel."""
    tune(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, a, b = [], [], []
            for group in _groups(texts):
                for ids, text in bpe.encode_bytes(group):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
