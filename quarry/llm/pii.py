"""Personal data: exact patterns, and a skip-chain conditional random field that adds to them.

The patterns are e-mail addresses, IPv4 addresses, card numbers that pass Luhn's check, and phone
numbers with a plus sign. The field's nodes are a text's mentions: words around an @, and runs of
digits with at most two separators between digits; a run of more digits than any kind has is cut,
into equal parts if it repeats one. Each node has potentials of its own features
(shape, digits, checks, the words around it), of the mention before and after it in the text, and
of its skip edges, which link mentions that are equal or similar (the same last seven digits, the
same part before the @) at any distance in the text. Loopy belief propagation makes the labels
of such mentions agree: a number that is once written as a phone number is one elsewhere too.

The weights are fitted by pseudo-likelihood to the patterns' findings in a bounded sample of
at most ``SAMPLE`` texts with mentions, chosen by a hash of id and text. So that the field learns
what equal mentions tell, ``ECHOES`` mentions of each text are put once more at its end, in a form
that the patterns miss and without the words around them, with the label of the first, twice, and
as often others of its form that are of no kind; texts with
runs that had to be cut have no sure labels and are not learnt from. The patterns' spans always stay, as given labels of their mentions; the field adds mentions that it finds likelier
personal than not, unless they overlap a pattern's span.

Defined results: a null text reads as the empty text, without spans; texts of any length are
searched whole, in linear time; equal texts have equal spans; without a text to learn from the
field adds nothing. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import tune

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE = 4000
#: Digits of one mention, at most.
MOST = 19
#: Mentions of a text that are repeated for learning, and that it may have at most to be learnt from.
ECHOES, LEARNT = 4, 2000
SLOTS = 1 << 12
ROUNDS = 10
#: What a pattern's finding adds to its label.
SURE = 30.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HOST = re.compile(r"[A-Za-z0-9.-]*[A-Za-z0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9])*+")
_ANY = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def at_signs(text: str, host: re.Pattern[str]) -> list[tuple[int, int]]:
    """Spans of a local part, an @ and a match of ``host``, leftmost and not overlapping."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > end and text[i - 1] in _LOCAL:
            i -= 1
        if i < at and (m := host.match(text, at + 1)):
            out.append((i, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base(text: str) -> list[Span]:
    """The patterns' spans, by kind and start, in code points."""
    if not _ANY.search(text):
        return []
    out: list[Span] = [("email", a, b) for a, b in at_signs(text, _DOMAIN)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


class Mention:
    __slots__ = ("start", "end", "keys", "features")

    def __init__(self, text: str, start: int, end: int, is_address: bool):
        self.start, self.end = start, end
        s = text[start:end]
        before = text[max(0, start - 24) : start]
        after = text[end : end + 24]
        word = (before.split() or [""])[-1].lower().strip(".,;:!?\"'") if before[-1:].isspace() else before[-1:]
        follow = (after.split() or [""])[0].lower().strip(".,;:!?\"'") if after[:1].isspace() else after[:1]
        d = digits(s)
        shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "0", s)))[:24]
        exact = re.sub(r"[0-9]", "0", s)[:24]
        f = [f"shape {shape}", f"exact {exact}", f"n {min(len(d), 20)}", f"at {is_address}", f"glued {start > 0 and text[start - 1].isalnum()} {end < len(text) and text[end].isalnum()}", f"plus {start > 0 and text[start - 1] == '+'} {len(d) >= 9}", f"open {before[-2:].strip()[-1:]}", "one"]
        if is_address:
            f.append(f"dot {'.' in s.partition('@')[2]}")
        else:
            f.append(f"luhn {13 <= len(d) <= 19 and luhn(d)}")
            parts = s.split(".")
            f.append(f"parts {len(parts) if len(parts) < 6 else 6} {all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}")
        f += [f"word {word}", f"follow {follow}"]
        self.features = [zlib.crc32(x.encode()) % SLOTS for x in f]
        if is_address:
            self.keys = [f"@{s.partition('@')[0].lower()}"]
        else:
            self.keys = [f"#{d}"] if len(d) >= 5 else []
            if len(d) >= 7:
                self.keys.append(f"~{d[-7:]}")

    @classmethod
    def of(cls, features: list[int], keys: list[str]) -> Mention:
        """A mention without its place."""
        out = cls.__new__(cls)
        out.start = out.end = 0
        out.features, out.keys = features, keys
        return out


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A long run cut at its separators: into equal parts if it repeats one of 7 digits or more, else into each with 7 or more."""
    tokens = [(start + m.start(), start + m.end()) for m in re.finditer(r"[0-9]+", text[start:end])]
    n = len(tokens)
    for p in range(1, n // 2 + 1):
        if n % p == 0 and all(text[a:b] == text[c:d] for (a, b), (c, d) in zip(tokens, tokens[p:])):
            whole = [(tokens[i][0], tokens[i + p - 1][1]) for i in range(0, n, p)]
            if 7 <= len(digits(text[slice(*whole[0])])) <= MOST:
                return whole
            break
    return [(a, b) for a, b in tokens if 7 <= b - a <= MOST]


def mentions(text: str) -> list[Mention]:
    """The field's nodes, in the order of the text; none overlap."""
    if not _ANY.search(text):
        return []
    out = []
    spans = [(a, b, True) for a, b in at_signs(text, _HOST)]
    taken = 0
    for m in _NUMBER.finditer(text):
        while taken < len(spans) and spans[taken][1] <= m.start():
            taken += 1
        if taken < len(spans) and spans[taken][0] < m.end():
            continue
        n = len(digits(m.group()))
        if n > MOST:
            out += [(a, b, False) for a, b in parts(text, *m.span())]
        elif n >= 4:
            out.append((*m.span(), False))
    return [Mention(text, a, b, k) for a, b, k in sorted(out + spans)]


def edges(nodes: list[Mention]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours; skip edges from a mention to the last and the first one with a common key."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1)]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    skip: dict[tuple[int, int], None] = {}
    for i, m in enumerate(nodes):
        for k in m.keys:
            for seen in (first.get(k), last.get(k)):
                if seen is not None and seen != i:
                    skip[seen, i] = None
            first.setdefault(k, i)
            last[k] = i
    return chain, list(skip)


class Graph:
    """The nodes and edges of several texts."""

    def __init__(self, texts: list[list[Mention]]):
        feats, where, self.bounds = [], [], np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        pairs: list[list[tuple[int, int]]] = [[], []]
        for at, nodes in zip(self.bounds.tolist(), texts):
            for i, m in enumerate(nodes):
                feats += m.features
                where += [at + i] * len(m.features)
            for kind, some in enumerate(edges(nodes)):
                pairs[kind] += [(at + a, at + b) for a, b in some]
        self.n = int(self.bounds[-1])
        self.feats, self.where = np.array(feats, np.int64), np.array(where, np.int64)
        self.pairs = [np.array(p, np.int64).reshape(-1, 2) for p in pairs]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Field:
    def __init__(self):
        k = len(LABELS)
        self.unary = np.zeros((SLOTS, k))
        self.pair = [np.zeros((k, k)), np.zeros((k, k))]

    def scores(self, g: Graph) -> np.ndarray:
        out = np.zeros((g.n, len(LABELS)))
        np.add.at(out, g.where, self.unary[g.feats])
        return out

    def fit(self, g: Graph, label: np.ndarray, epochs: int = 150, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Pseudo-likelihood: each node given its neighbours' labels, by AdaGrad over the whole sample."""
        k = len(LABELS)
        past = [np.full((SLOTS, k), 1e-6), np.full((k, k), 1e-6), np.full((k, k), 1e-6)]
        gold = np.eye(k)[label]
        for _ in range(epochs):
            s = self.scores(g)
            for kind in (0, 1):
                a, b = g.pairs[kind].T
                np.add.at(s, a, self.pair[kind][:, label[b]].T)
                np.add.at(s, b, self.pair[kind][label[a]])
            p = np.exp(s - s.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - gold) / max(g.n, 1)
            grads = [np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros((k, k))]
            np.add.at(grads[0], g.feats, d[g.where])
            for kind in (0, 1):
                a, b = g.pairs[kind].T
                grads[1 + kind] += d[a].T @ gold[b] + gold[a].T @ d[b]
            for w, x, q in zip([self.unary, *self.pair], grads, past):
                x += decay * w
                q += x * x
                w -= rate * x / np.sqrt(q)

    def marginals(self, g: Graph, known: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
        """Each node's label probabilities, by loopy belief propagation over chain and skip edges; ``known`` labels but 0 are given."""
        s = self.scores(g)
        if known is not None:
            on = np.flatnonzero(known)
            s[on, known[on]] += SURE
        if not g.n:
            return s
        src = np.concatenate([x for p in g.pairs for x in (p[:, 0], p[:, 1])])
        dst = np.concatenate([x for p in g.pairs for x in (p[:, 1], p[:, 0])])
        sizes = [len(p) for p in g.pairs]
        table = np.concatenate([np.broadcast_to(t, (m, *t.shape)) for w, m in zip(self.pair, sizes) for t in (w, w.T)])
        back = np.concatenate([np.arange(m) + o for m, o in zip([sizes[0], sizes[0], sizes[1], sizes[1]], [sizes[0], 0, 2 * sizes[0] + sizes[1], 2 * sizes[0]])]).astype(np.int64)
        message = np.zeros((len(src), len(LABELS)))
        for _ in range(rounds):
            belief = s.copy()
            np.add.at(belief, dst, message)
            out = _log_sum((belief[src] - message[back])[:, :, None] + table, 1)
            message = out - _log_sum(out, 1)[:, None]
        belief = s.copy()
        np.add.at(belief, dst, message)
        return np.exp(belief - _log_sum(belief, 1)[:, None])


def gold(found: list[Span], nodes: list[Mention]) -> list[int]:
    """The patterns' label of each mention that lies in a pattern's span, or holds it; spans are few."""
    out = []
    for m in nodes:
        best = 0
        for kind, a, b in found:
            if min(b, m.end) - max(a, m.start) >= 0.8 * max(b - a - 1, m.end - m.start):
                best = LABELS.index(kind)
        out.append(best)
    return out


#: Another mention of the same form; it is of no kind.
_OTHER = str.maketrans("0123456789abcdefghijklmnopqrstuvwxyz", "3456789012nopqrstuvwxyzabcdefghijklm")
#: So much white space that a mention's features hold no words before or after it.
_FAR = "\n " * 13


def echo(text: str, m: Mention, kind: str, turn: int) -> str:
    """A mention as it may be written again, in a form without what the patterns ask for."""
    s = text[m.start : m.end]
    if "@" in s:
        return f"{s.partition('@')[0]}@localhost"
    d = digits(s)
    if kind == "phone":
        return f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}" if turn % 2 and len(d) >= 10 else d[-10:]
    if kind == "ip":
        return f"{s}.0"
    return s


def lesson(text: str) -> tuple[list[Mention], list[int]] | None:
    """The mentions of a text and of its echoes with their labels; None if the patterns can't tell them."""
    own = mentions(text)
    if len(own) > LEARNT or any(len(digits(m.group())) > MOST for m in _NUMBER.finditer(text)):
        return None
    label = gold(base(text), own)
    # what the patterns found first, then others
    chosen = sorted(range(len(own)), key=lambda i: (not label[i], i))[:ECHOES]
    more, tail = [], ""
    entries = []
    for turn, i in enumerate(chosen):
        said = echo(text, own[i], LABELS[label[i]], turn + i)
        other = said.translate(_OTHER)
        entries += [(said, label[i]), (said, label[i]), (other, 0), (other.translate(_OTHER), 0)]
    # in no order, so that what stands beside them tells nothing
    for k, (x, y) in sorted(enumerate(entries), key=lambda e: zlib.crc32(f"{e[0]} {e[1][0]}".encode())):
        tail += f"{_FAR}{x}\n"
        more.append(y)
    whole = text + tail
    nodes = mentions(whole)
    again = [m for m in nodes if m.start >= len(text)]
    if len(again) != len(more):
        return own, label
    return own + again, label + more


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field | None:
    pool = docs.where(F.col(text_col).rlike("[0-9@]"))
    share = min(1.0, 2 * sample / max(pool.count(), 1))
    hash_ = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit(8)), F.lit(1 << 30))
    few = pool.where(hash_ < share * (1 << 30)).select(hash_.alias("h"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # features travel, not texts
        for batch in batches:
            texts = batch.column(1).to_pylist()
            packs = []
            for t in texts:
                learnt = lesson(t)
                packs.append(json.dumps([[[m.features, m.keys] for m in learnt[0]], learnt[1]]) if learnt else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packs, pa.string())], names=["h", "pack"])

    rows = few.mapInArrow(run, "h long, pack string").where(F.col("pack").isNotNull())
    got = sorted(rows.dropDuplicates().collect(), key=lambda r: (r["h"], r["pack"]))[:sample]
    packs = [json.loads(r["pack"]) for r in got]
    nodes = [[Mention.of(*m) for m in p[0]] for p in packs]
    label = np.array([x for p in packs for x in p[1]], np.int64)
    if not len(label):
        return None
    field = Field()
    field.fit(Graph(nodes), label)
    return field


def find(texts: list[str], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans and the spans that the field adds."""
    bases = [base(t) for t in texts]
    more: list[list[Span]] = [[] for _ in texts]
    if field is not None:
        nodes = [mentions(t) for t in texts]
        g = Graph(nodes)
        known = np.array([x for b, n in zip(bases, nodes) for x in (gold(b, n) if b else [0] * len(n))], np.int64)
        p = field.marginals(g, known)
        best = p.argmax(1)
        for i, (lo, hi) in enumerate(zip(g.bounds.tolist(), g.bounds[1:].tolist())):
            if not best[lo:hi].any():
                continue
            taken = sorted((a, b) for _, a, b in bases[i])
            starts = np.array([a for a, _ in taken])
            ends = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else starts
            for k in np.flatnonzero(best[lo:hi]).tolist():
                m = nodes[i][k]
                before = int(np.searchsorted(starts, m.end)) if taken else 0
                if p[lo + k, best[lo + k]] >= 0.5 and not (before and ends[before - 1] > m.start):
                    more[i].append((LABELS[best[lo + k]], m.start, m.end))
    return list(zip(bases, more))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def spans(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, added>>) of every row."""
    tune(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(field)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = find([t or "" for t in batch.column(1).to_pylist()], shared.value)
            out = [[{"kind": k, "start": a, "end": b, "added": added} for added, some in enumerate(pair) for k, a, b in some] for pair in got]
            for row in out:
                for s in row:
                    s["added"] = bool(s["added"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long,added:boolean>>")


def digests(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row; the counts by kind are the patterns', ``n_spans`` counts all."""
    tune(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = find([t or "" for t in batch.column(1).to_pylist()], shared.value)
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in got], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array([joined(b + m) for b, m in got], pa.string()), pa.array([len(b) + len(m) for b, m in got], pa.int64())], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
