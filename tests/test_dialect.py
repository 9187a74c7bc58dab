"""The dialect: golden match counts, translations, rejected patterns."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from quarry.functions import dialect as d
from quarry.functions.linear import Linear

DOCS = ["document1", "document2", "contains needle", "contains needle and another needle", "contains case sensitive nEeDlE", "line1\nline2"]
GOLDEN = {"doc": 2, "another": 1, "needle": 3, "ne.*ed.*le": 2, "ne.*?ed.*?le": 3, "(?i)needle": 4, r"(?i)ne\w*ed\w*le": 4, ".*": 7, "(?s).*": 6, r"\w+": 15, "(?i)contains case sensitive": 1}


@pytest.mark.parametrize("pattern", GOLDEN)
def test_golden_counts(pattern):
    assert sum(len(d.find_all(d.to_python(pattern), t)) for t in DOCS) == GOLDEN[pattern]


@pytest.mark.parametrize(
    ("pattern", "text", "ranges"),
    [
        ("11", "1111", [(0, 2), (2, 4)]),
        ("x*", "abc", [(0, 0), (1, 1), (2, 2), (3, 3)]),
        ("x*", "xa", [(0, 1), (2, 2)]),
        ("é+", "aéé", [(1, 5)]),
        ("b$", "ab\n", []),
        ("(?m)b$", "ab\n", [(1, 2)]),
        ("(?m)^", "a\n", [(0, 0), (2, 2)]),
        (".", "\r ", [(0, 1), (1, 4)]),
        ("(?i)k", "KK", [(0, 1), (1, 4)]),
        (r"\w", "é_1-", [(0, 2), (2, 3), (3, 4)]),
        ("[[:alpha:]]+", "ab1l:", [(0, 2), (3, 4)]),
        ("[a-d&&[^b]]+", "abcd", [(0, 1), (2, 4)]),
        ("[a-d--b]+", "abcd", [(0, 1), (2, 4)]),
        ("(?U)a+", "aaa", [(0, 1), (1, 2), (2, 3)]),
        ("(?x) a b # two", "ab", [(0, 2)]),
        (r"\x{e9}|\x41", "éA", [(0, 2), (2, 3)]),
        ("(?P<n>a)(?<m>b)", "ab", [(0, 2)]),
        ("a|ab", "ab", [(0, 1)]),
        (r"\bfoo\b", "foo food", [(0, 3)]),
        ("", "", [(0, 0)]),
    ],
)
def test_ranges(pattern, text, ranges):
    assert d.find_all(d.to_python(pattern), text) == ranges


@pytest.mark.parametrize(("pattern", "hits", "misses"), [
    (r"(?i)[\x{2100}-\x{2200}]", "kK\u212a", "jx"),
    (r"(?i)[\x{1000}-\x{ffff}]", "kK\u212ass", "jx"),
    (r"(?i)\p{Lu}", "kKéÉ", "1 日"),
    (r"(?i)\P{Lu}", "1 日", "kKéÉ"),
    (r"(?i)[^k]", "js", "kK\u212a"),
    (r"(?i)[a-z&&[^K]]", "aA\u017f", "kK\u212a"),
    (r"(?i)[[:^alpha:]]", "1é\u212akKsS", "aZ"),
    ("(?i)[é\u1e9e]", "éÉßẞ", "es"),
])
def test_folded_classes(pattern, hits, misses):
    """Whatever equals a member but for case is a member too; complements are taken after that."""
    compiled, linear = d.to_python(pattern), Linear(pattern)
    for c, want in [(c, True) for c in hits] + [(c, False) for c in misses]:
        if c == "s" and "1000" in pattern:
            want = linear.found(pa.array(["\u017f"]))[0].as_py()
        assert bool(compiled.match(c)) == want == linear.found(pa.array([c]))[0].as_py(), (pattern, c)


PATTERNS = [*GOLDEN, "x*", "é+", "b$", "(?m)b$", "(?m)^", "(?m)^$", ".", "(?i)k", r"\bfoo\b", r"\b", r"\B", r"\b\w+\b", "[[:alpha:]]+", "[a-d&&[^b]]+", "(?U)a+", "a|ab", "", "(a|b)+c", "(a+)+$", "(?:ab|ba)+", "(?i)[^k]+", r"\pL+", r"\s*", "a{1200}", "a{2,1500}?", "(?:ab){2,3}?", "[日本]+|é"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_linear_matcher_agrees(pattern):
    rng = random.Random(1)
    texts = [*DOCS, "é_1-KKſk", "ab\n", "a\rb", "foo food é foo", "", "日本語 food", "\n\na", "x\x00y", "a" * 2600, None]
    texts += ["".join(rng.choices("ab kKſéß日\n_1.-\x01", k=rng.randint(0, 40))) for _ in range(150)]
    m = Linear(pattern)
    assert m.re2 is not None
    column = pa.array(texts, pa.string())
    bounds, starts, ends = m.ranges(column)
    compiled = d.to_python(pattern)
    for i, t in enumerate(texts):
        want = d.find_all(compiled, t, m.inside) if t is not None else []
        assert list(zip(starts[bounds[i] : bounds[i + 1]].tolist(), ends[bounds[i] : bounds[i + 1]].tolist())) == want, t
    assert m.counts(column).tolist() == (bounds[1:] - bounds[:-1]).tolist()
    assert m.found(column).to_pylist() == (bounds[1:] > bounds[:-1]).tolist()
    if not m.inside:
        assert m.texts(column).to_pylist() == [[x.group() for x in compiled.finditer(t)] if t is not None else [] for t in texts] or m.nullable
    assert m.ranges(column[:0])[0].tolist() == [0] and m.ranges(column[3:6])[0].tolist() == (bounds[3:7] - bounds[3]).tolist()


def test_refused_by_the_linear_matcher():
    """A program beyond its bound is matched otherwise, with the same result."""
    m = Linear(r"\pL{900}x")
    assert m.re2 is None and m.counts(pa.array(["a" * 900 + "x", "b", None])).tolist() == [1, 0, 0]


def test_empty_matches_between_bytes():
    assert d.find_all(d.to_python("x*"), "é", inside=True) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("pattern", [r"(a)\1", "a(?=b)", "(?<!a)b", "(?-u)a", "[[:foo:]]", "a{2", "(", ")", "*", "[a", "a{3,2}", r"\q", "(?>a)", r"\x{110000}"])
def test_rejected(pattern):
    with pytest.raises(d.PatternError):
        d.parse(pattern)


def test_java_agrees(spark):
    rows = spark.createDataFrame([(t,) for t in [*DOCS, "é_1-KK", "ab\n", "a\rb", "foo food", ""]], "t string")
    texts = [r.t for r in rows.collect()]
    for pattern in ["needle", "(?i)needle", r"\w+", r"\bfoo\b", "b$", "(?m)b$", "a.b", "(?i)k", "[a-d&&[^b]]", r"\s", "[[:upper:]]", "[a-z~~e-z]", r"\pL+", "[^a-z]"]:
        got = [r.m for r in rows.selectExpr("t rlike r'" + d.to_java(pattern) + "' as m").collect()]
        assert got == [bool(d.find_all(d.to_python(pattern), t)) for t in texts], pattern
