"""Secret scans: candidates by character runs, false positives removed by a random forest.

Runs are of letters, digits and ``+/=_-`` (ASCII); long ones around a dot are one; one that holds
``name=value`` is its value, and the name stands before it. A run is a candidate if it has
``LONG`` characters or more and a digit, a known prefix or much entropy in letters of both
cases; or ``SHORTEST`` or more and, in the ``BEFORE`` characters before it, a word such as key,
token or password, with a digit in the run or a sign of assignment right before it. So is the
header of a private key. The forest sees a candidate's length, character classes and transitions
between them, entropy, how likely its characters follow each other in the corpus's words, how much of it
dictionary words cover, its path, the words around it, and its form (hexadecimal, UUID, known
prefixes, placeholders).

The forest is fitted on labelled findings, at most ``SAMPLE`` of them. Where none have been
labelled, ``seed_findings`` makes a labelled set by rule (keys, tokens and passwords against
digests, identifiers, numbers, placeholders and paths), put between texts of the corpus
(``surroundings``, a bounded sample). ``lexicon`` takes the dictionary and the character
transitions from the counts of all words of the corpus.

Defined results: a null text reads as the empty text, without candidates; whole texts of any
length are scanned; equal texts have equal findings; without findings to learn from every
candidate counts, with score 1; an empty corpus gives a small dictionary that is built in.
Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import code_points, flat, pieces, spans
from .store import tune

LONG, SHORTEST, BEFORE, AFTER = 16, 8, 40, 24
SAMPLE = 20_000
TREES, DEPTH, LEAF = 48, 10, 3

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGNS = np.frombuffer(b"\"'`:=", np.uint8)
_DIGITS = re.compile(rb"[0-9]")
_LETTERS = re.compile(rb"(?<![a-z])[a-z]{3,12}(?![a-z])")
_HEADER = re.compile(rb"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
_TELLING = re.compile(r"(?i)(?:key|token|secret|passw|pwd|auth|bearer|credential)")
_DIGEST = re.compile(r"(?i)(?:sha-?\d*|md5|commit|hash|checksum|digest|integrity|uuid|etag|build|version|revision)")
_PREFIX = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abp]-|AIza|ya29|eyJ|npm_|SG)")
_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
_FAKE = re.compile(r"(?i)(?:example|sample|your|test|dummy|fake|placeholder|changeme|xxxx|0000|1234|abcd|todo|foo|bar)")
_WORDS = """the and for with from this that have not are was you your all can will use set get put add new key value name type list data file path test user
account admin access token secret password public private client server service system config default index image version release build source target
class object string number integer boolean array table column query result error message status state event action request response header content length
size width height color style font text title label button input output form page link menu item group order product price customer address phone email
city country date time year month day hour minute second start end begin first last next previous left right top bottom center middle open close read
write create update delete insert select remove find search sort filter map reduce merge split join copy move rename load save send receive connect
example sample placeholder change random local remote global static dynamic final abstract virtual template module package library function method
variable constant parameter argument return handler manager factory builder provider consumer producer worker thread process queue stack buffer cache""".split()  # fmt: skip
#: Words of the corpus's dictionary, and texts whose words surround the findings made by rule, at most.
DICTIONARY, SURROUNDINGS = 20_000, 2000
NAMES = ("length", "upper", "lower", "digit", "symbol", "changes", "entropy", "follow", "covered", "hex", "hex_size", "uuid", "prefix", "fake", "telling", "assigned", "quoted", "digest", "path_like", "test_path", "config_path", "words_before", "words_after", "repeat", "header", "all_digits")


class Lexicon:
    """A dictionary with counts: which words are known, and log-probabilities of a letter after a letter."""

    def __init__(self, counts: dict[str, int] | None = None):
        counts = {w: 1 for w in _WORDS} | (counts or {})
        self.known = frozenset(counts)
        c = np.full((27, 27), 0.5)
        for w, n in counts.items():
            for a, b in zip(" " + w, w + " "):
                c[(ord(a) - 96) if a != " " else 0, (ord(b) - 96) if b != " " else 0] += math.log1p(n)
        self.follow = np.log2(c / c.sum(1, keepdims=True)).tolist()

    def covered(self, s: str) -> float:
        """Share of the characters in dictionary words of at least three letters, longest first from the left."""
        low, at, n = s.lower(), 0, 0
        while at < len(low):
            for size in range(min(12, len(low) - at), 2, -1):
                if low[at : at + size] in self.known:
                    n += size
                    at += size
                    break
            else:
                at += 1
        return n / max(len(s), 1)


def lexicon(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> Lexicon:
    """The commonest words of all texts: runs of 3 to 12 ASCII letters, folded, that occur more than once."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            buf, offs = flat(batch.column(0))
            for lo, hi, b, o in pieces(buf, offs):
                # a line feed between texts, so that no word goes on in the next one
                text = np.insert(b, o[1:-1], 10) if hi - lo > 1 else b
                counts.update(_LETTERS.findall(text.tobytes().lower()))
            if len(counts) > 1 << 19:
                yield sent()
                counts.clear()
        if counts:
            yield sent()

    top = docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(size)
    return Lexicon({r["word"]: r["n"] for r in top.collect()})


def surroundings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SURROUNDINGS) -> list[str]:
    """Pieces of 200 characters out of texts: at most so many, chosen by a hash of id and text."""
    h = F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit(7))
    at = F.pmod(h, F.greatest(F.length(text_col) - 200, F.lit(1))) + 1
    some = docs.where(F.length(text_col) > 0).select(h.alias("h"), F.substring(F.col(text_col), at.cast("int"), F.lit(200)).alias("piece"))
    return [r["piece"] for r in some.orderBy("h", "piece").limit(size).collect()]


def features(before: str, s: str, after: str, path: str, known: Lexicon) -> list[float]:
    n = len(s)
    upper = sum("A" <= c <= "Z" for c in s)
    lower = sum("a" <= c <= "z" for c in s)
    digit = sum("0" <= c <= "9" for c in s)
    kind = [0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if "0" <= c <= "9" else 3 for c in s]
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    letters = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in s.lower()]
    follow = sum(known.follow[a][b] for a, b in zip(letters, letters[1:])) / max(n - 1, 1)
    hex_ = bool(_HEX.match(s))
    strip = before.rstrip()
    p = path.lower()
    return [
        min(n, 200),
        upper / n,
        lower / n,
        digit / n,
        (n - upper - lower - digit) / n,
        sum(a != b for a, b in zip(kind, kind[1:])) / max(n - 1, 1),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        follow,
        known.covered(s),
        hex_,
        hex_ * (n in (32, 40, 64, 128)),
        bool(_UUID.match(s)),
        bool(_PREFIX.match(s)),
        bool(_FAKE.search(s)),
        bool(_TELLING.search(before)),
        strip.rstrip("\"'`")[-1:] in (":", "="),
        before[-1:] in ('"', "'", "`") and before[-1:] == after[:1],
        bool(_DIGEST.search(before[-24:])),
        s.count("/") >= 2 or before[-1:] in ("/", ".", "\\"),
        "test" in p or "example" in p or "doc" in p,
        p.endswith((".env", ".pem", ".cfg", ".ini", ".yml", ".yaml", ".properties", ".conf")),
        sum(w.lower().strip(".,;:=\"'") in known.known for w in before.split()),
        sum(w.lower().strip(".,;:=\"'") in known.known for w in after.split()),
        max(counts.values()) / n,
        s.startswith("-----BEGIN"),
        digit == n,
    ]


class Model:
    """A forest, or none, and the lexicon that its features need."""

    def __init__(self, forest: Forest | None, known: Lexicon):
        self.forest, self.known = forest, known

    def score(self, rows: list[list[float]]) -> np.ndarray:
        return self.forest.score(np.array(rows, float)) if self.forest is not None else np.ones(len(rows))


class Forest:
    """Trees by Gini impurity on bootstrap samples, each split from a random choice of features and thresholds."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 7):
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        tried = max(1, int(math.sqrt(x.shape[1]) * 1.5))
        for _ in range(self.trees):
            feature, threshold, child, share = [], [], [], []

            def grow(rows: np.ndarray, depth: int) -> int:
                me = len(feature)
                feature.append(-1)
                threshold.append(0.0)
                child.append((0, 0))
                share.append(float(y[rows].mean()))
                if depth == self.depth or len(rows) < 2 * self.leaf or share[me] in (0.0, 1.0):
                    return me
                best = (2.0, -1, 0.0)
                for f in rng.choice(x.shape[1], tried, replace=False):
                    v = x[rows, f]
                    order = np.argsort(v, kind="stable")
                    v, t = v[order], y[rows][order]
                    cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                    cut = cut[(cut >= self.leaf) & (cut <= len(v) - self.leaf)]
                    if not len(cut):
                        continue
                    c = np.cumsum(t)
                    a, b = c[cut - 1] / cut, (c[-1] - c[cut - 1]) / (len(v) - cut)
                    g = (cut * a * (1 - a) + (len(v) - cut) * b * (1 - b)) / len(v)
                    k = int(g.argmin())
                    if g[k] < best[0]:
                        best = (float(g[k]), int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2))
                if best[1] < 0:
                    return me
                feature[me], threshold[me] = best[1], best[2]
                left = x[rows, best[1]] <= best[2]
                child[me] = grow(rows[left], depth + 1), grow(rows[~left], depth + 1)
                return me

            grow(rng.integers(0, len(y), len(y)), 0)
            self.nodes.append((np.array(feature), np.array(threshold), np.array(child), np.array(share)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that each row falls into."""
        out = np.zeros(len(x))
        for feature, threshold, child, share in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                go = f >= 0
                if not go.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]
                at = np.where(go, child[at, right.astype(np.int64)], at)
            out += share[at]
        return out / max(len(self.nodes), 1)


def seed_findings(n: int = 3000, seed: int = 7, around: list[str] | None = None) -> list[tuple[str, str, str, str, int]]:
    """(before, candidate, after, path, label) by rule, between pieces of ``around``; half of them secrets."""
    rng = np.random.default_rng(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    up = alnum[:26] + "234567"

    def text(chars: str, size: int) -> str:
        return "".join(rng.choice(list(chars), size))

    def pick(*some: str) -> str:
        return str(rng.choice(some))

    def words(k: int) -> str:
        return " ".join(rng.choice(_WORDS, k))

    def prose() -> str:
        if around:
            some = str(around[rng.integers(len(around))]).split()
            at = int(rng.integers(0, max(1, len(some) - 4)))
            return " ".join(some[at : at + int(rng.integers(1, 6))])
        # words of any language: syllables put together
        return " ".join("".join(rng.choice(["an", "er", "ti", "on", "re", "es", "th", "ou", "de", "la", "ch", "ei", "ó", "é", "mi"], rng.integers(1, 5))) for _ in range(rng.integers(1, 6)))

    out = []
    for i in range(n):
        lead = pick(words(3), prose(), "", prose() + ". ")
        path = pick("", "", "src/app.py", "deploy/.env", "config/prod.yml", "tests/test_x.py", "docs/example.md", "server.properties")
        name = pick("token", "api_key", "secret", "password", "auth_token", "client_secret", "SECRET_KEY", "access_token", "Authorization: Bearer")
        q = pick('"', "'", "")
        gap = pick(" = ", "=", ": ", " => ", " ")
        tail = pick(" ", "\n", f" {prose()}", ";")
        if i % 2:
            s = pick(
                text(hexa, int(rng.choice([32, 40, 64]))), "AKIA" + text(up, 16), "ghp_" + text(alnum, 36), "sk_live_" + text(alnum, 24), "xoxb-" + text("0123456789", 12) + "-" + text(alnum, 24),
                text(alnum + "+/", 40), text(alnum, int(rng.integers(12, 48))), text(alnum[:52], int(rng.integers(16, 40))), text(alnum + "!", 10).replace("!", "x"), "AIza" + text(alnum + "_-", 35), "glpat-" + text(alnum, 20), "eyJ" + text(alnum, 60),
            )
            if _PREFIX.match(s) and rng.random() < 0.4:
                out.append((lead + " ", s, tail, path, 1))
            else:
                out.append((f"{lead} {name}{gap}{q}", s, q + tail, path, 1))
        else:
            kind = int(rng.integers(0, 11))
            before = f"{lead} {pick('', name + gap)}" if rng.random() < 0.3 else f"{lead} "
            if kind == 0:
                out.append((f"{lead} {pick('commit', 'sha256:', 'md5', 'checksum', 'hash', 'revision')} ", text(hexa, int(rng.choice([32, 40, 64]))), tail, path, 0))
            elif kind == 1:
                out.append((before, f"{text(hexa, 8)}-{text(hexa, 4)}-{text(hexa, 4)}-{text(hexa, 4)}-{text(hexa, 12)}", tail, path, 0))
            elif kind == 2:
                out.append((before, pick("", "_").join(w.capitalize() for w in rng.choice(_WORDS, 4)) + str(rng.integers(1, 999)), tail, path, 0))
            elif kind in (3, 4):
                out.append((f"{lead} ", text("0123456789", int(rng.integers(16, 20))), tail, path, 0))
            elif kind == 5:
                out.append((f"{lead} {name}{gap}{q}", pick("your_token_here_1234567890", "xxxxxxxxxxxxxxxx1234", "EXAMPLE_KEY_0123456789", "changeme-changeme-123", "test_token_abcd1234567", "sample0000000000000000"), q + tail, path, 0))
            elif kind == 6:
                out.append((f"{lead} /", "/".join(rng.choice(_WORDS, 4)) + f"/v{rng.integers(1, 9)}", tail, path, 0))
            elif kind == 7:
                out.append((before, "-".join(rng.choice(_WORDS, 4)) + f"-{rng.integers(1, 99)}", tail, path, 0))
            elif kind == 10:
                # a word after a telling one is no secret
                out.append((f"{lead} {name}{pick(' ', ': ', ' = ')}", "".join(rng.choice(_WORDS, 2))[: int(rng.integers(8, 14))].ljust(8, "s"), f" {prose()}", path, 0))
            elif kind == 8:
                out.append((f"{lead} ", f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}{text('0123456789', 4)}-{text('0123456789', 4)}", tail, path, 0))
            else:
                out.append((f"{lead} ", "".join(rng.choice(["thre", "tion", "enou", "ereding", "ung", "ment", "ción"], 5)).replace("ó", "o") + str(rng.integers(1, 99)), tail, path, 0))
    return out


def fit(findings: list[tuple[str, str, str, str, int]] | None = None, known: Lexicon | None = None, around: list[str] | None = None) -> Model:
    """A model of labelled findings: (before, candidate, after, path, label), at most SAMPLE of them."""
    known = known or Lexicon()
    rows = (seed_findings(around=around) if findings is None else findings)[:SAMPLE]
    if not rows:
        return Model(None, known)
    x = np.array([features(b[-BEFORE:], s, a[:AFTER], p, known) for b, s, a, p, _ in rows], float)
    return Model(Forest().fit(x, np.array([float(r[4]) for r in rows])), known)


def learn(docs: DataFrame, findings: list[tuple[str, str, str, str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model with the dictionary of a corpus, and where findings are made by rule, among its texts."""
    return fit(findings, lexicon(docs, text_col), surroundings(docs, id_col, text_col) if findings is None else None)


_NAME = re.compile(rb"[A-Za-z_][A-Za-z0-9_-]*=+(?=[^=])")


def _entropy(s: bytes) -> float:
    return -sum(k / len(s) * math.log2(k / len(s)) for k in Counter(s).values())


def candidates(buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first byte, byte past the last) of every candidate, bytes counted from the text's start."""
    out = []
    s, e = spans(_RUN[buf], offs)
    if len(s):
        # long runs around a dot, as in signed tokens
        dot = np.zeros(len(s), bool)
        dot[1:] = (s[1:] == e[:-1] + 1) & (buf[np.minimum(e[:-1], len(buf) - 1)] == 46) & (e[1:] - s[1:] >= 10) & (e[:-1] - s[:-1] >= 10)
        dot[1:] &= np.searchsorted(offs, s[1:], "right") == np.searchsorted(offs, s[:-1], "right")
        s, e = s[~dot], e[np.append(~dot[1:], True)]
    digits = np.append(0, np.cumsum(_DIGIT[buf]))
    size = e - s
    at = np.maximum(s, 1)
    near = np.isin(buf[at - 1], _SIGNS) | ((buf[at - 1] == 32) & np.isin(buf[np.maximum(at - 2, 0)], _SIGNS)) if len(s) else np.zeros(0, bool)
    named = np.zeros(len(s), bool)
    signs = np.append(0, np.cumsum(buf == 61))
    if len(s):
        named = signs[e] > signs[s]
    on = np.flatnonzero((size >= SHORTEST) & ((digits[e] > digits[s]) | near | named | (size >= LONG)))
    doc = np.searchsorted(offs, s[on], "right") - 1
    raw = buf.tobytes()
    for d, a, b in zip(doc.tolist(), s[on].tolist(), e[on].tolist()):
        first, assigned = int(offs[d]), False
        while m := _NAME.match(raw, a, b):
            a, assigned = m.end(), True
        run = raw[a:b]
        if len(run) < SHORTEST:
            continue
        digit = _DIGITS.search(run)
        if len(run) >= LONG and (digit or _PREFIX.match(run.decode()) or (run.lower() != run and run.upper() != run and _entropy(run) >= 3.8)):
            out.append((d, a - first, b - first))
            continue
        before = raw[max(first, a - 4 * BEFORE) : a].decode("utf-8", "replace")[-BEFORE:]
        if (digit or assigned or before.rstrip(" \"'`")[-1:] in (":", "=")) and _TELLING.search(before):
            out.append((d, a - first, b - first))
    if b"-----BEGIN " in raw:
        for m in _HEADER.finditer(raw):
            d = int(np.searchsorted(offs, m.start(), "right")) - 1
            if m.end() <= offs[d + 1]:
                out.append((d, m.start() - int(offs[d]), m.end() - int(offs[d])))
    return out


def find(buf: np.ndarray, offs: np.ndarray, paths: list[str], model: Model) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of every candidate of each text, in code points."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(offs) - 1)]
    for lo, hi, b, o in pieces(buf, offs):
        got = candidates(b, o)
        if not got:
            continue
        raw, cp = b.tobytes(), code_points(b)
        rows, where = [], []
        for d, s, e in got:
            a, z, first, last = s + int(o[d]), e + int(o[d]), int(o[d]), int(o[d + 1])
            rows.append(features(raw[max(first, a - 4 * BEFORE) : a].decode("utf-8", "replace")[-BEFORE:], raw[a:z].decode("ascii"), raw[z : min(last, z + 4 * AFTER)].decode("utf-8", "replace")[:AFTER], paths[lo + d], model.known))
            where.append((lo + d, int(cp[a] - cp[first]), int(cp[z] - cp[first])))
        score = model.score(rows)
        for (d, s, e), p in zip(where, score.tolist()):
            out[d].append((s, e, p))
    return [sorted(x) for x in out]


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, least: float = 0.5) -> DataFrame:
    """(id, n_candidates, findings array<struct<start, end, score>>) of every row: the candidates of score ``least`` and above."""
    tune(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = find(*flat(batch.column(1)), [p or "" for p in batch.column(2).to_pylist()], shared.value)
            kept = [[{"start": a, "end": b, "score": p} for a, b, p in x if p >= least] for x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array(kept, item)], names=[id_col, "n_candidates", "findings"])

    path = F.col(path_col) if path_col else F.lit("")
    return docs.select(F.col(id_col), F.col(text_col), path.cast("string").alias("secret_path")).mapInArrow(run, f"`{id_col}` {kind}, n_candidates long, findings array<struct<start:long,end:long,score:double>>")


def digests(docs: DataFrame, model: Model, **options) -> DataFrame:
    """(id, n_candidates, n_secrets, spans, top_score) of every row; spans are start:end, comma-joined, in code points."""
    id_col = options.get("id_col", "doc_id")
    found = scan(docs, model, **options)
    spans_ = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["start"].cast("string"), f["end"].cast("string"))), ",")
    return found.select(id_col, "n_candidates", F.size("findings").cast("long").alias("n_secrets"), spans_.alias("spans"), F.coalesce(F.array_max(F.transform("findings", lambda f: f["score"])), F.lit(0.0)).alias("top_score"))
