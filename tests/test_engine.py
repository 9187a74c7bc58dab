"""Search, index, corpus, suffixes, sources and streaming on small tables."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import dialect
from quarry.operators import corpus, index, order, search, suffixes
from quarry.plans import literals
from quarry.plans.literals import fold
from quarry.session import Scratch, released, shared_dir
from quarry.sources import corpus as sources
from quarry.sources import foreign
from quarry.streaming import watch

from .test_dialect import DOCS, GOLDEN


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").persist()


@pytest.fixture(scope="module")
def indexed(docs, tmp_path_factory):
    return index.build(docs, str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("pattern", [*GOLDEN, "contains.*another", "(?i)CASE", "zzz", "document[12]"])
def test_counts_with_and_without_index(docs, indexed, pattern):
    whole = search.count_matches(docs, pattern).first()
    assert search.count_matches(docs, pattern, index=indexed).first() == whole
    assert search.count_matches(docs, pattern, index=indexed, skip_index=True).first() == whole
    assert whole.n_matches == GOLDEN.get(pattern, whole.n_matches)


def test_ranges_are_bytes(spark):
    rows = spark.createDataFrame([(1, "éa éa"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in search.ranges(rows, "a").orderBy("start").collect()] == [(1, 2, 3), (1, 6, 7)]
    assert [r["match"] for r in search.matched_texts(rows, "é?a").collect()] == ["éa", "éa"]


def test_limit_and_group(docs):
    assert [tuple(r) for r in search.limited(docs, "needle", 2).collect()] == [(2, 9, 15), (3, 9, 15)]
    assert search.limited(docs, "needle", 0).count() == 0
    one = {r.doc_id: [tuple(m) for m in r.matches] for r in search.grouped(search.ranges(docs, "needle")).collect()}
    assert one == {2: [(9, 15)], 3: [(9, 15), (28, 34)]}


def test_doc_ends(spark):
    ends = [1, 5, 10, 11, 12, 20, 100]
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    bounds = corpus.doc_bounds(rows)
    assert [tuple(r) for r in bounds.orderBy("doc_id").collect()] == list(zip(range(7), [0, *ends], ends))
    asked = spark.createDataFrame([(o,) for o in (0, 1, 2, 11, 12, 99, 100)], "offset long")
    found = {r.offset: r.doc_id for r in corpus.offset_to_doc(asked, bounds, block=4).collect()}
    assert found == {0: 0, 1: 1, 2: 1, 11: 4, 12: 5, 99: 6}
    assert corpus.doc_bounds(rows.limit(0)).count() == 0
    assert corpus.facts(rows).first() == (7, 6, 100)


@pytest.mark.parametrize("key", [32, 4])
def test_suffixes(spark, tmp_path, monkeypatch, key):
    """Whole suffixes decide, in copies, shared passages and runs of one character too."""
    monkeypatch.setattr(suffixes, "KEY", key)
    monkeypatch.setattr(suffixes, "BLOCK", 100)
    rng = random.Random(3)
    base = "".join(rng.choices("ab \n", k=150))
    texts = [base, base, base[:90], base[30:] + "x", "", "Banana", " " * 70, "é" * 40 + "Ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = suffixes.build(docs, str(tmp_path / "table"), key)
    want = sorted((fold(t)[i:].encode(), d, i) for d, t in enumerate(texts) for i in range(len(t)))
    rows = table.orderBy("rank").collect()
    assert [(r.doc_id, r.pos) for r in rows] == [(d, i) for _, d, i in want]
    assert [(r["rank"], r.block, r.slot) for r in rows] == [(i, i // 100, i % 100) for i in range(len(want))]
    assert [r["rank"] for r in suffixes.blocks(table, 1, 2).collect()] == list(range(100, 300)) and suffixes.block(table, 0).count() == 100
    assert suffixes.at_rank(table, docs, 7).first().content == texts[want[7][1]][want[7][2] :]
    for literal in ["A", "Ban", base[10:110], base[:33], "zz", base[10:60] + "q", " " * 50, " " * 71, base]:
        k = fold(literal).encode()
        below = sum(w[0] < k for w in want)
        there = [(d, i) for w, d, i in want if w.startswith(k)]
        assert tuple(suffixes.lookup(table, docs, literal).first()) == (below, below + len(there)), literal
        assert sorted(map(tuple, suffixes.occurrences(table, docs, literal).collect())) == sorted(there), literal
    assert {tuple(r) for r in suffixes.adjacent(table, docs, ["an", "an"]).collect()} == {(5, 1)}
    assert {tuple(r) for r in suffixes.adjacent(table, docs, [base[:50], base[50:140]]).collect()} == {(0, 0), (1, 0)}
    none = suffixes.build(docs.limit(0), str(tmp_path / "none"), key)
    assert none.count() == 0 and tuple(suffixes.lookup(none, docs, "a").first()) == (0, 0)


def test_suffixes_by_scan(spark, monkeypatch):
    """What a table tells of sizes, places and occurrences, told without one."""
    monkeypatch.setattr(suffixes, "BLOCK", 10)
    monkeypatch.setattr(suffixes, "build", None)
    texts = ["Banana bANana", "", None, "aaaa", "éé🎉Éa", "\ud7ff\ue000 ban", "a" * 45 + "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted((fold(t)[i:].encode(), d, i) for d, t in enumerate(texts) for i in range(len(t or "")))
    assert tuple(suffixes.facts_of(docs).first()) == (len(want), (len(want) - 1) // 10)
    for literal in ["", "a", "ANA", "aa", "é", "É", "🎉", "\ue000", "zz", "\U0010ffff", "banana banana", "a" * 45 + "c", "a" * 40]:
        k = fold(literal).encode()
        below, there = sum(w[0] < k for w in want), [(d, i) for w, d, i in want if w.startswith(k)]
        assert tuple(suffixes.lookup_of(docs, literal).first()) == (below, below + len(there)), literal
        assert sorted(map(tuple, suffixes.adjacent_of(docs, [literal[:1], literal[1:3], literal[3:]]).collect())) == sorted(there), literal
    none = docs.limit(0)
    assert tuple(suffixes.facts_of(none).first()) == (0, None) and tuple(suffixes.lookup_of(none, "a").first()) == (0, 0) and not suffixes.adjacent_of(none, ["a"]).count()


@pytest.mark.parametrize("pattern", ["(a|b)+c", "(a+)+$", "(?:ab|ba)+", r"\b(?:\w+ )+x", r"(?:a?){30}a{30}"])
def test_no_text_is_too_much(spark, pattern):
    """A megabyte on which backtracking matchers run out of stack or time."""
    texts = ["ab" * 500_000, "a" * 1_000_000 + "!", "ab " * 300_000, "ababc", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small = [t and t[:40] + t[-1:] for t in texts]
    want = {"(a|b)+c": [0, 0, 0, 1], "(a+)+$": [0, 0, 0, 0], "(?:ab|ba)+": [1, 0, 300_000, 1], r"\b(?:\w+ )+x": [0, 0, 0, 0], r"(?:a?){30}a{30}": [0, 1_000_000 // 60 + 1, 0, 0]}[pattern]
    got = {r.doc_id: r.n_matches for r in search.count_by_doc(docs, pattern).collect()}
    assert got == {i: n for i, n in enumerate(want) if n}
    compiled = dialect.to_python(pattern)
    few = spark.createDataFrame(list(enumerate(small)), "doc_id long, text string")
    if pattern != r"(?:a?){30}a{30}":
        assert sorted((r.doc_id, [tuple(m) for m in r.matches]) for r in search.search(few, pattern).collect()) == [(i, f) for i, t in enumerate(small) if t and (f := dialect.find_all(compiled, t))]


def test_ordered_and_required(docs):
    assert [r.doc_id for r in search.search(docs.repartition(3), "needle", ordered=True).collect()] == [2, 3]
    assert search.required(dialect.simplify(dialect.parse("(?:ab+c.*de|f)gh(?i)x"))) == ["gh"] and search.required(dialect.parse("ab+c.*d")) == ["ab", "c", "d"]
    assert {p: search.in_jvm(p) for p in ("License", r"\d{3}-\d{4}", "of (the|an)", "a+", "(?:ab){9}", "x*", "(?:a?){30}a{30}")} == {"License": True, r"\d{3}-\d{4}": True, "of (the|an)": True, "a+": False, "(?:ab){9}": True, "x*": False, "(?:a?){30}a{30}": False}


def test_chunks_and_shares(spark, docs, monkeypatch):
    """An index of many small chunks, and one whose lookups are left to the cluster, find the same."""
    small = index.Index(index.postings(docs.coalesce(1), chunk=20).persist(), index.frequencies(index.postings(docs)))
    assert small.postings.select("chunk").distinct().count() > 3
    for kept in (1 << 20, 0):
        monkeypatch.setattr(index, "KEPT", kept)
        monkeypatch.setattr(index, "INTERSECTED", kept)
        one = index.Index(small.postings, small.frequencies)
        assert (one.kept is None) == (not kept)
        for pattern in ("needle", "(?i)needle", "document[12]", "zzz", "needle.*another"):
            assert search.count_matches(docs, pattern, index=one).first() == search.count_matches(docs, pattern).first()
    monkeypatch.setattr(search, "LISTED", 0)
    monkeypatch.undo()
    found = index.probe(small, literals.plan("needle"), share=0.1)
    assert found.needs == () and index.candidates(small, literals.plan("needle"), share=0.1) is None
    assert sorted(index.rows(small.postings).where("gram = 'nee'").select("doc_id").toPandas().doc_id) == [2, 3, 4]


def test_bounded_batches(spark, docs):
    """Neither searches nor index builds leave the size of Arrow batches to the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for use in (lambda: search.ranges(docs, "n+"), lambda: search.matching(docs, "n+"), lambda: index.postings(docs)):
        spark.conf.unset(key)
        use()
        assert 0 < int(spark.conf.get(key).rstrip("bB")) <= 8 << 20


def test_chunk_is_bounded(spark):
    """A task packs its documents before it holds the grams of many megabytes of them."""
    long = spark.range(0, 12, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("ab"), F.col("id").cast("string")), 300_000).alias("text"))
    found = index.postings(long)
    rows = found.where(F.col("gram") == index.ALL).select("chunk", "ids").collect()
    assert sum((r.ids for r in rows), []) == list(range(12)) and max(len(r.ids) for r in rows) <= 6
    wanted = [index.gram_key("ab1"), index.gram_key("b10")]
    assert {r.gram: r.df for r in index.frequencies(found).where(F.col("gram").isin(wanted)).collect()} == dict(zip(wanted, (3, 1)))


def test_running_totals(spark):
    """Ids of any type and spread; ties; empty tables."""
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("zz", 7), ("b", 2), ("c", 0)], "k string, n long").repartition(4)
    got = sorted((r.k, r.n, r.before) for r in order.running(rows, ["k", "n"], "n", Scratch(spark)).collect())
    assert got == [("a", 1, 0), ("b", 2, 1), ("b", 2, 3), ("c", 0, 5), ("zz", 7, 5)]
    wide = spark.createDataFrame([(10**15, "abc"), (3, "é"), (-5, "x"), (4, None)], "doc_id long, text string")
    bounds = {r.doc_id: (r.doc_start, r.doc_end) for r in corpus.doc_bounds(wide).collect()}
    assert bounds == {-5: (0, 1), 3: (1, 3), 4: (3, 3), 10**15: (3, 6)}
    assert tuple(corpus.bounds_of(wide, 3).first()) == (3, 1, 3) and corpus.bounds_of(wide, 7).count() == 0


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    with released():
        made = Scratch(spark)
        kept = made.cut(spark.range(3), "x")
        assert kept.count() == 3 and os.path.isdir(made.root)
    assert not os.path.isdir(made.root)


def test_sources(spark, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "plain").write_text("needle here")
    (d / ".dot").write_bytes(b"bad \xff needle")
    (d / "sub" / "deep").write_text("x" * 200)
    got = sources.directory(spark, str(d), max_file=100).orderBy("doc_id").collect()
    assert [(r.doc_id, os.path.basename(r.path), r.valid) for r in got] == [(0, ".dot", False), (1, "plain", True)]
    assert got[1].content == b"needle here" and got[0].text == "bad \ufffd needle"
    assert [(r.doc_id, os.path.basename(r.path)) for r in sources.directory(spark, str(d), hidden=False).orderBy("doc_id").collect()] == [(0, "plain"), (1, "deep")]
    assert sources.directory(spark, f"file://{d}").count() == 3
    with pytest.raises(FileNotFoundError):
        sources.directory(spark, str(tmp_path / "none"))
    out = str(tmp_path / "out")
    built = sources.build_index(spark, out, directory_path=str(d))
    found = index.load(spark, f"{out}/index")
    assert search.count_matches(built, "needle", index=found).first() == (2, 2)
    assert sources.result_lines(built, "needle", limit=1) == ["document 0:", "needle"]
    assert sources.result_lines(built, "needle", limit=0) == []
    sources.write_results(built, "needle", str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
    with pytest.raises(ValueError):
        sources.build_index(spark, out)
    assert sources.string(spark, "é").first().text == "é"
    assert (sources.parse_size("256MB"), sources.parse_size("2 MiB"), sources.parse_size("7")) == (256_000_000, 2 << 20, 7)


def test_foreign_index(spark, tmp_path):
    def text(s):
        return bytes([len(s)]) + s.encode()

    body = b"payload"
    toc = (0).to_bytes(4, "big") + text("repos") + b"\0" + (1).to_bytes(4, "big") + (2).to_bytes(4, "big")
    toc += text("files") + b"\1" + b"".join(n.to_bytes(4, "big") for n in (1, 2, 3, 4))
    (tmp_path / "good").write_bytes(body + toc + len(body).to_bytes(4, "big") + len(toc).to_bytes(4, "big"))
    (tmp_path / "bad").write_bytes(b"short")
    rows = {(r.tag, r.kind, r.data_offset, r.data_size, r.index_offset, r.index_size) for r in foreign.read_toc(spark, str(tmp_path)).where("error is null").collect()}
    assert rows == {("repos", 0, 1, 2, None, None), ("files", 1, 1, 2, 3, 4)}
    assert foreign.read_toc(spark, str(tmp_path)).where("error is not null").count() == 1
    with pytest.raises(ValueError):
        foreign.Reader(b"\xff" * 10 + b"\1").uvarint()
    one = spark.createDataFrame([('{"ID":1,"Name":"n","Branches":[{"name":"b","version":"v"}],"SubRepoMap":{"s":{"ID":2}},"Rank":3,"Tombstone":false}',)], "json string")
    meta = foreign.with_metadata(one).first().metadata
    assert (meta.ID, meta.Branches[0].version, meta.SubRepoMap, meta.Rank) == (1, "v", {"s": '{"ID":2}'}, 3)


def test_streaming(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    stream = watch.arriving(spark, str(tmp_path / "in"), docs.schema)
    for _ in range(2):  # the second run finds nothing new
        watch.search_into(stream, "needle", str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
