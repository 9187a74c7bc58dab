"""Operators over pairs of rows, union-find and the pipeline: against brute force; skewed and odd tables."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import components, language, lines, simhash
from quarry.llm.fingerprint import _arrays
from quarry.llm.store import Scratch, crc_mod

from .conftest import SCHEMA, prose
from .test_rowwise import TOKENIZER, brute_hits


def merged(n, pairs):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    pairs = {"chain": [(i, i + 1) for i in range(200)], "star": [(0, i) for i in range(1, 300)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "none": []}[shape]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(4), Scratch(spark)).collect()}
    up = merged(301, pairs)
    assert got == {x: up[x] for a, b in pairs if a != b for x in (a, b)}
    if pairs:
        a, b = np.array(pairs).T
        assert components.roots(301, a, b).tolist() == up


def simhash_brute(rows):
    texts = sorted({t or "" for _, t in rows})
    fp = simhash.fingerprints(*_arrays([t.encode() for t in texts]))
    near = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if np.bitwise_count(fp[i] ^ fp[j]).sum() <= simhash.MAX_DISTANCE]
    up, links = merged(len(texts), near), [0] * len(texts)
    for i, j in near:
        links[i] += 1
        links[j] += 1
    at = {t: i for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        if d is not None:
            u = up[at[t or ""]]
            least[u] = min(least.get(u, d), d)
    return sorted(([d, least.get(up[at[t or ""]]), links[at[t or ""]], sum((t or "") == (x or "") for _, x in rows) - 1] for d, t in rows), key=repr)


@pytest.mark.parametrize(("cap", "listed"), [(4096, 1 << 20), (2, 1 << 20), (2, 0)])
def test_simhash_classes(docs, monkeypatch, cap, listed):
    monkeypatch.setattr(simhash, "LISTED", listed)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = simhash.classes(docs, cap=cap).collect()
    assert sorted(([r.doc_id, r.class_id, r.n_links, r.n_copies] for r in got), key=repr) == simhash_brute(rows)
    sizes = Counter(r.class_id for r in got if r.class_id not in (None, 5))
    assert all(r.class_size == sizes[r.class_id] for r in got if r.class_id in sizes)
    kept = simhash.keep(docs, cap=cap)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # two groups begin with the id 5, which has two texts
    assert len(ids) == len({x[1] if x[1] is not None else repr(x) for x in simhash_brute(rows)}) + 1


def test_simhash_hot_group(spark):
    """A third of all rows are one text, another third near copies of one."""
    rng = random.Random(2)
    base = prose(rng, 120).split(" ")
    rows = [(i, " ".join(base)) for i in range(60)]
    for i in range(60, 120):
        w = list(base)
        w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(i, prose(rng, 80)) for i in range(120, 180)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for cap in (4096, 4):
        got = simhash.classes(table, cap=cap).collect()
        assert sorted(([r.doc_id, r.class_id, r.n_links, r.n_copies] for r in got), key=repr) == simhash_brute(rows)
    assert sorted(r.doc_id for r in simhash.keep(table).collect()) == [0, *range(120, 180)]


def trigrams(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def test_simhash_recall(spark):
    """Near copies as word trigrams tell them, not as fingerprints do: those of similarity 0.5 and more share a class, strangers don't."""
    rng = random.Random(21)
    rows, near = [], []
    for i in range(150):
        w = prose(rng, rng.randint(60, 200)).split(" ")
        rows.append((2 * i, " ".join(w)))
        for _ in range(max(1, int(len(w) * rng.choice([0.01, 0.03, 0.06, 0.1])))):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [prose(rng, 1)], [w[k], prose(rng, 1)]])
        rows.append((2 * i + 1, " ".join(w)))
        a, b = trigrams(rows[-2][1]), trigrams(rows[-1][1])
        near.append(len(a & b) / len(a | b))
    got = {r.doc_id: r for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    together = [got[2 * i].class_id == got[2 * i + 1].class_id for i in range(150)]
    alike = [t for t, j in zip(together, near) if j >= 0.5]
    assert len(alike) > 80 and np.mean(alike) >= 0.97
    assert all(r.class_size <= 2 for r in got.values())


def test_packed_candidates(spark):
    """Full buckets that are compared by broadcasts, and many small ones, give the pairs of all with all."""
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, (120, 4), dtype=np.uint64)
    fp[1::2] = fp[::2]
    fp[1::2, 0] ^= np.uint64(0xFFFF)
    group = np.sort(rng.integers(0, 3, 120)).astype(np.uint64)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if group[i] == group[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= 40}
    got = [p for a, b in simhash._pairs(group, np.zeros(120, np.int64), fp, 40) for p in zip(a.tolist(), b.tolist())]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_dense_groups_are_bounded(monkeypatch):
    """A group of near copies has as many links as the square of its nodes; they are counted, not kept."""
    rng = np.random.default_rng(2)
    n = 2500
    flips = np.zeros((n, simhash.BITS), np.uint8)
    for row in flips:
        row[rng.choice(simhash.BITS, 12, replace=False)] = 1
    fp = np.packbits(flips, axis=1).view(np.uint64)
    none, masks = np.zeros(n, np.int64), simhash.sampled(3, 10, 1)
    tracemalloc.start()
    node, links, root = simhash.match(np.arange(n), fp, none + 1, none, none, none.view(np.uint64), none, np.zeros((n, 3), bool), masks, masks, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(node) == n and (links == n - 1).all() and not root.any()
    assert peak < 100 << 20  # 3.1 million links
    monkeypatch.setattr(simhash, "LINKED", 10)
    chain = np.zeros((40, 4), np.uint64)
    chain[:, 0] = [(1 << i) - 1 for i in range(40)]
    one = np.zeros(40, np.int64)
    node, links, root = simhash.match(np.arange(40), chain, one + 1, one, one, one.view(np.uint64), one, np.zeros((40, 3), bool), masks, masks, 1)
    assert links.tolist() == [1, *[2] * 38, 1] and not root.any()


def test_line_bands_at_the_threshold():
    """Lines with scattered one-character edits and a similarity of 0.80 to 0.83 share a band."""
    rng = random.Random(22)
    left, right = [], []
    while len(left) < 600:
        a = prose(rng, rng.randint(12, 40)).replace(" ", "").lower()
        b = list(a)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(len(b))] = rng.choice("qxzjv")
        b = "".join(b)
        if 0.8 <= lines.similarities([a.encode()], [b.encode()])[0] <= 0.83:
            left.append(a.encode())
            right.append(b.encode())
    x, y = (lines.bands(*_arrays(t)) for t in (left, right))
    assert (x == y).any(1).mean() >= 0.97


def test_equal_nodes_of_different_lines(spark, monkeypatch):
    """Lines whose 64-bit nodes collide are told apart by their other bits."""
    real = lines._nodes

    def crude(norm, bounds, which):
        node, form = real(norm, bounds, which)
        return np.full_like(node, 7), form

    # the tasks get the patched function by value, as part of these
    cloudpickle.register_pickle_by_value(lines)
    monkeypatch.setattr(lines, "_nodes", crude)
    try:
        docs = spark.createDataFrame([(0, "first line of it, long enough\nshort"), (1, "another line, which is long enough\nbrief"), (2, "short\nfirst line of it, long enough")], "doc_id long, text string")
        got = {r.doc_id: r.removed_lines for r in lines.removals(docs).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(lines)
    assert got == {0: [], 1: [], 2: [0, 1]}


def lines_brute(rows):
    """{(id, text): removed line numbers}, by comparing all lines with all."""
    at: dict[bytes, list] = {}
    for d, t in set(rows):
        for i, x in enumerate(t.split("\n")) if t else []:
            b = lines._FOLD[np.frombuffer(x.encode(), np.uint8)]
            n = b[b != 0].tobytes()
            if len(n) >= lines.SHORT:
                at.setdefault(n, []).append((d is None, d or 0, t, i))
    forms = list(at)
    sets = [{n[i : i + lines.SHINGLE] for i in range(len(n) - lines.SHINGLE + 1)} for n in forms]
    near = [(i, j) for i in range(len(forms)) for j in range(i + 1, len(forms)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= lines.NEAR]
    up = merged(len(forms), near)
    groups: dict[int, list] = {}
    for i, n in enumerate(forms):
        groups.setdefault(up[i], []).extend(at[n])
    return groups


@pytest.mark.parametrize("family", [20_000, 2])
def test_line_removals(docs, family):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    keys = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    removed: dict = {}
    for group in lines_brute(rows).values():
        first = min(group, key=lambda g: (g[0], g[1], keys[None if g[0] else g[1], g[2]], g[3]))
        for g in group:
            if g != first:
                removed.setdefault((None if g[0] else g[1], g[2]), set()).add(g[3])
    got = lines.removals(docs, family=family).collect()
    want = sorted(([d, t.count("\n") + 1 if t else 0, sorted(removed.get((d, t), ()))] for d, t in rows), key=repr)
    assert sorted(([r.doc_id, r.n_lines, r.removed_lines] for r in got), key=repr) == want
    assert all(r.n_removed == len(r.removed_lines) and len(r.kept_in) <= r.n_removed for r in got)
    left = lines.dedupe(docs, family=family)
    assert left.columns == docs.columns
    texts = []
    for d, t in rows:
        cut = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in removed.get((d, t), ())) if t else t
        if (d, t) not in removed or cut.strip():
            texts.append([d, cut])
    assert sorted(([r.doc_id, r.text] for r in left.collect()), key=repr) == sorted(texts, key=repr)


def test_short_lines(spark):
    texts = ["All rights reserved.\nfirst", "all rights, reserved\n...\nAnd ornd.\nAnd ornd.", "All rights reserve.\n...\n\nx", "X!\n日本"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.removed_lines, r.kept_in) for r in lines.removals(docs).collect()}
    # equal normal forms only, and none that is empty
    assert got == {0: ([], []), 1: ([0, 3], [0, 1]), 2: ([], []), 3: ([0], [2])}
    assert [r.text for r in lines.dedupe(docs).orderBy("doc_id").collect()] == [texts[0], "...\nAnd ornd.", texts[2], "日本"]


def test_jaccard_and_split():
    got = lines.similarities([b"abcdefgh", b"aaaaaaaa"], [b"abcdefgh", b"aaaaabbbbb"])
    assert got.tolist() == [1.0, 1 / 6]
    buf, offs = _arrays([b"one\ntwo\n", b"", b"\n", b"x"])
    _, _, doc, number = lines.split(buf, offs)
    assert doc.tolist() == [0, 0, 0, 2, 2, 3] and number.tolist() == [0, 1, 2, 0, 1, 0]


def test_empty_pipeline(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item of words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_pipeline(rows, items, model):
    """The stages one after another, by plain loops: (doc_id, text, lang) rows, benchmark items, the language model."""
    known = {k: i for i, k in enumerate(model.langs)}
    kept = []
    for d, t, *_ in rows:
        if not any(map(str.isalpha, t or "")):
            continue
        g = language.groups(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        bits = {k: tree.lengths(g).sum() for k, tree in zip(model.langs, model.trees)}
        k = min(bits, key=bits.get)
        if bits[k] <= language.MARGIN * model.worst[known[k]] * len(g) + language.SLACK:
            kept.append((d, t))
    removed = {}
    for group in lines_brute(kept).values():
        first = min(group, key=lambda g: (g[1], g[3]))
        for g in group:
            if g != first:
                removed.setdefault(g[1], set()).add(g[3])
    cut = []
    for d, t in kept:
        x = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in removed.get(d, ())) if t else t
        if d not in removed or x.strip():
            cut.append((d, x))
    heads = {c for _, c, *_ in simhash_brute(cut)}
    unique = [(d, t) for d, t in cut if d in heads]
    clean = [(d, t) for d, t in unique if not brute_hits(t, items, 10)[1]]
    library = Tokenizer.from_file(TOKENIZER)
    out = []
    for d, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out, [len(x) for x in (kept, cut, unique, clean)]


def test_pipeline_against_brute_force(spark, made, tmp_path):
    rng = random.Random(23)
    item = prose(rng, 24)
    rows = [(i, t, "en", "s", 1) for i, t in made]
    rows += [(700 + i, f"{prose(rng, 25)}\n{prose(rng, 3)} {item if i % 2 else item.upper()} {prose(rng, 4)}", "en", "s", 1) for i in range(4)]
    rows += [(710 + i, prose(rng, 60), "en", "s", 1) for i in range(60)]
    # near copies whose only line differs too much for the line stage
    for i in range(6):
        w = prose(rng, 150).split(" ")
        rows.append((780 + 2 * i, " ".join(w), "en", "s", 1))
        for k in rng.sample(range(150), 14):
            w[k] = prose(rng, 1)
        rows.append((781 + 2 * i, " ".join(w), "en", "s", 1))
    rows += [(800 + i, "".join(rng.choices("ΩΨΞΛабвгд漢字", k=150)), None, "s", 1) for i in range(3)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    # few languages' rows are needed to see the model reject
    few = functools.partial(language.fit, per_language=40)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(language, "fit", few)
        got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
        model = few(docs, crc_mod("doc_id", 5) != 0, worst=True)
    want, sizes = brute_pipeline(rows, [(1, item), (2, None)], model)
    assert got == sorted(want)
    assert len(rows) > sizes[0] >= sizes[1] > sizes[2] > sizes[3], (len(rows), sizes)
    assert not {800, 801, 802, 700, 701} & {r[0] for r in got} and {710, 769} <= {r[0] for r in got}


def test_empty_tables(spark, empty):
    assert simhash.classes(empty).count() == 0 == simhash.keep(empty).count()
    assert lines.removals(empty).count() == 0 == lines.dedupe(empty).count()


def test_pipeline(spark, docs, tmp_path):
    rng = random.Random(7)
    item = prose(rng, 20)
    extra = [(800, f"{prose(rng, 30)} {item}", "en", "s", 1), (801, prose(rng, 40), "en", "s", 1)]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, SCHEMA))
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = [r.doc_id for r in now.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "tokenization"]
    assert 801 in seen["tokenization"] and 800 in seen["near_dedup"] and 800 not in seen["decontamination"]
    assert sorted(seen["tokenization"], key=repr) == sorted(seen["decontamination"], key=repr)
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((tuple(r) for r in ran.collect()), key=repr) == sorted((tuple(r) for r in now.collect()), key=repr)
