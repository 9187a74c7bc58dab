"""The engine's regular-expression dialect: parser, and translation to Java and to Python.

The dialect is that of linear-time engines: no look-around, no back-references; Unicode classes
by default; ``$`` without ``m`` only at the very end; ``.`` without ``s`` anything but a line
feed. The translations (to Java, Python and RE2) spell these meanings out instead of relying on
the target's defaults. Java's and Python's matchers backtrack, RE2 doesn't; ``bounded`` tells
which patterns are harmless in the former two.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cache
from math import prod

import regex


class PatternError(ValueError):
    """A pattern that the dialect doesn't have, with the place of the trouble."""


@dataclass(frozen=True)
class Char:
    """One character; ``fold`` lets its case variants match too."""

    char: str
    fold: bool = False


@dataclass(frozen=True)
class Any_:
    newline: bool


@dataclass(frozen=True)
class Property:
    """A Unicode property or Perl class by its Java spelling."""

    java: str
    python: str
    negated: bool = False
    fold: bool = False


@dataclass(frozen=True)
class Set_:
    """A class: ranges, properties and nested classes; ``op`` combines two operands."""

    ranges: tuple[tuple[str, str], ...] = ()
    parts: tuple[object, ...] = ()
    negated: bool = False
    fold: bool = False
    op: str = ""


@dataclass(frozen=True)
class Look:
    """An assertion: text start/end, line start/end, word border or not."""

    kind: str


@dataclass(frozen=True)
class Repeat:
    node: object
    least: int
    most: int | None
    lazy: bool


@dataclass(frozen=True)
class Seq:
    items: tuple[object, ...] = ()


@dataclass(frozen=True)
class Alt:
    items: tuple[object, ...] = ()


@dataclass
class Flags:
    i: bool = False
    m: bool = False
    s: bool = False
    x: bool = False
    U: bool = False


_PERL = {
    "d": Property(r"\p{Nd}", r"\p{Nd}"),
    "s": Property(r"\p{IsWhite_Space}", r"\p{White_Space}"),
    "w": Property(r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}", r"\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍"),
}
_POSIX = {
    "alnum": "09AZaz", "alpha": "AZaz", "ascii": "\x00\x7f", "blank": "\t\t  ", "cntrl": "\x00\x1f\x7f\x7f", "digit": "09", "graph": "!~",
    "lower": "az", "print": " ~", "punct": "!/:@[`{~", "space": "\t\r  ", "upper": "AZ", "word": "09AZ__az", "xdigit": "09AFaf",
}
#: Largest count of a repetition; engines that compile repetitions have a bound on the program's size instead.
MOST_REPEATED = 1 << 16
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}
_CATEGORY = {"Letter": "L", "Uppercase_Letter": "Lu", "Lowercase_Letter": "Ll", "Number": "N", "Decimal_Number": "Nd", "Punctuation": "P", "Symbol": "S", "Separator": "Z", "Mark": "M", "Other": "C"}


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def fail(self, what: str) -> PatternError:
        return PatternError(f"{what} at {self.i} in {self.p!r}")

    def peek(self, n: int = 1) -> str:
        return self.p[self.i : self.i + n]

    def take(self) -> str:
        if self.i >= len(self.p):
            raise self.fail("unexpected end")
        self.i += 1
        return self.p[self.i - 1]

    def alternation(self, f: Flags, depth: int) -> object:
        f = replace(f)
        branches, items = [], []
        while True:
            c = self.peek()
            if c == "" or c == ")":
                if c == ")" and not depth:
                    raise self.fail("unopened group")
                break
            if c == "|":
                self.i += 1
                branches.append(Seq(tuple(items)))
                items = []
                continue
            if f.x and c.isspace():
                self.i += 1
                continue
            if f.x and c == "#":
                end = self.p.find("\n", self.i)
                self.i = len(self.p) if end < 0 else end + 1
                continue
            node = self.atom(f, depth)
            if node is None:
                continue
            items.append(self.repeat(node, f))
        branches.append(Seq(tuple(items)))
        return branches[0] if len(branches) == 1 else Alt(tuple(branches))

    def repeat(self, node: object, f: Flags) -> object:
        while True:
            if f.x:
                while self.peek().isspace() and self.peek():
                    self.i += 1
            c = self.peek()
            if c in ("*", "+", "?") and c:
                self.i += 1
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            elif c == "{":
                m = regex.compile(r"\{\s*(\d+)\s*(,)?\s*(\d+)?\s*\}").match(self.p, self.i)
                if not m:
                    raise self.fail("bad repetition")
                self.i = m.end()
                least = int(m[1])
                most = int(m[3]) if m[3] else None if m[2] else least
                if most is not None and most < least:
                    raise self.fail("bad repetition")
                if max(least, most or 0) > MOST_REPEATED:
                    raise self.fail(f"repetition beyond {MOST_REPEATED}")
            else:
                return node
            lazy = self.peek() == "?"
            self.i += lazy
            node = Repeat(node, least, most, lazy != f.U)

    def atom(self, f: Flags, depth: int) -> object | None:
        c = self.take()
        if c == "(":
            return self.group(f, depth)
        if c == "[":
            return self.set_(f)
        if c == ".":
            return Any_(f.s)
        if c == "^":
            return Look("line start" if f.m else "start")
        if c == "$":
            return Look("line end" if f.m else "end")
        if c == "\\":
            return self.escape(f)
        if c in "*+?{":
            raise self.fail("nothing to repeat")
        return Char(c, f.i)

    def group(self, f: Flags, depth: int) -> object | None:
        inner = f
        if self.peek() == "?":
            self.i += 1
            m = regex.compile(r"P?<([A-Za-z_][\w.\[\]]*)>").match(self.p, self.i)
            if m:
                self.i = m.end()
            elif self.peek() in ("=", "!", ">") or self.peek(2) in ("<=", "<!", "P=", "P>"):
                raise self.fail("look-around, atomic groups and back-references are not supported")
            else:
                inner, on = replace(f), True
                while (c := self.take()) not in ":)":
                    if c == "-":
                        on = False
                    elif c in "imsxU":
                        setattr(inner, c, on)
                    elif c == "u" and on:
                        pass
                    else:
                        raise self.fail(f"flag {c!r} is not supported")
                if c == ")":
                    for name in "imsxU":
                        setattr(f, name, getattr(inner, name))
                    return None
        node = self.alternation(inner, depth + 1)
        if self.take() != ")":
            raise self.fail("unclosed group")
        return node

    def hex(self, c: str) -> str:
        if self.peek() == "{":
            end = self.p.find("}", self.i)
            digits, self.i = self.p[self.i + 1 : end], end + 1
        else:
            n = {"x": 2, "u": 4, "U": 8}[c]
            digits = self.peek(n)
            self.i += n
            if len(digits) < n:
                raise self.fail("bad code point")
        try:
            return chr(int(digits, 16))
        except (ValueError, OverflowError):
            raise self.fail("bad code point") from None

    def property(self, negated: bool, fold: bool) -> Property:
        if self.peek() == "{":
            end = self.p.find("}", self.i)
            if end < 0:
                raise self.fail("unclosed property")
            name, self.i = self.p[self.i + 1 : end], end + 1
        else:
            name = self.take()
        if name.startswith("^"):
            name, negated = name[1:], not negated
        key = name.partition("=")[2] or name
        short = _CATEGORY.get(key, key)
        java = rf"\p{{{short}}}" if len(short) <= 2 else rf"\p{{Is{short}}}"
        return Property(java, rf"\p{{{short}}}", negated, fold)

    def escape(self, f: Flags, inside: bool = False) -> object:
        c = self.take()
        if c in "dswDSW":
            p = _PERL[c.lower()]
            return replace(p, negated=c.isupper())
        if c in "pP":
            return self.property(c == "P", f.i)
        if c in "xuU":
            return Char(self.hex(c), f.i)
        if c in _ESCAPES:
            return Char(_ESCAPES[c], f.i)
        if not inside and c in "bBAz":
            return Look({"b": "word", "B": "no word", "A": "start", "z": "end"}[c])
        if c.isalnum():
            raise self.fail("back-references are not supported" if c.isdigit() else f"unknown escape \\{c}")
        return Char(c, f.i)

    def set_(self, f: Flags) -> Set_:
        negated = self.peek() == "^"
        self.i += negated
        ranges, parts, done = [], [], None
        op = ""
        first = True

        def current() -> Set_:
            return Set_(tuple(ranges), tuple(parts), False, f.i)

        while True:
            if f.x:
                while self.peek().isspace() and self.peek():
                    self.i += 1
            c = self.peek()
            if c == "":
                raise self.fail("unclosed class")
            if c == "]" and not first:
                self.i += 1
                break
            two = self.peek(2)
            if two in ("&&", "--", "~~"):
                self.i += 2
                left = current() if done is None else Set_((), (done, current()), False, False, op)
                done, op, ranges, parts, first = left, two, [], [], False
                continue
            first = False
            if two == "[:":
                end = self.p.find(":]", self.i)
                name = self.p[self.i + 2 : end]
                if end < 0 or name.lstrip("^") not in _POSIX:
                    raise self.fail("unknown POSIX class")
                self.i = end + 2
                pairs = _POSIX[name.lstrip("^")]
                parts.append(Set_(tuple(zip(pairs[::2], pairs[1::2])), (), name[0] == "^"))
                continue
            if c == "[":
                self.i += 1
                parts.append(self.set_(f))
                continue
            self.i += 1
            item = self.escape(f, True) if c == "\\" else Char(c)
            if not isinstance(item, Char):
                parts.append(item)
                continue
            if self.peek() == "-" and self.peek(2) not in ("-]", "--"):
                self.i += 1
                d = self.take()
                end_ = self.escape(f, True) if d == "\\" else Char(d)
                if not isinstance(end_, Char) or end_.char < item.char:
                    raise self.fail("bad range")
                ranges.append((item.char, end_.char))
            else:
                ranges.append((item.char, item.char))
        body = current() if done is None else Set_((), (done, current()), False, False, op)
        return replace(body, negated=negated) if done is None else Set_((), (body,), negated)


def parse(pattern: str) -> object:
    """The pattern's tree, or PatternError."""
    p = _Parser(pattern)
    node = p.alternation(Flags(), 0)
    if p.i < len(pattern):
        raise p.fail("unopened group")
    return node


@cache
def _variants_table() -> dict[str, str]:
    groups: dict[str, list[str]] = {}
    for c in map(chr, range(0x1E944)):
        folded = c.casefold() if len(c.casefold()) == 1 else c.lower()
        if len(folded) == 1 and (folded != c or c.upper() != c):
            groups.setdefault(folded, []).append(c)
    out = {}
    for key, some in groups.items():
        every = "".join(sorted({key, *some}))
        for c in every:
            out[c] = every
    return out


def variants(c: str) -> str:
    """The characters that equal c but for case, itself included."""
    return _variants_table().get(c, c)


@cache
def _folded_in(body: str) -> str:
    """The characters outside a class (its Python spelling) that equal one of its members but for case."""
    inside = regex.compile(body, regex.V1).match
    return "".join(c for c, some in _variants_table().items() if not inside(c) and any(map(inside, some)))


def _spelled(chars: str, point: Callable[[str], str]) -> str:
    """Characters, ascending, as single ones and ranges of a class."""
    out, at = [], 0
    chars = sorted(chars)
    while at < len(chars):
        to = at
        while to + 1 < len(chars) and ord(chars[to + 1]) == ord(chars[to]) + 1:
            to += 1
        out.append(point(chars[at]) if at == to else f"{point(chars[at])}-{point(chars[to])}")
        at = to + 1
    return "".join(out)


def _java_point(c: str) -> str:
    return rf"\x{{{ord(c):x}}}"


def _python_point(c: str) -> str:
    return rf"\U{ord(c):08x}"


def _emit_set(s: object, java: bool) -> str:
    point = _java_point if java else _python_point
    if isinstance(s, Property):
        body = s.java if java else s.python
        if s.fold:
            body += _spelled(_folded_in(f"[{s.python}]"), point)
        return f"[^{body}]" if s.negated else f"[{body}]"
    if s.op:
        a, b = (_emit_set(x, java) for x in s.parts)
        inner = {"&&": f"[{a}&&{b}]", "--": f"[{a}&&[^{b}]]" if java else f"[{a}--{b}]", "~~": f"[[{a}&&[^{b}]][{b}&&[^{a}]]]" if java else f"[{a}~~{b}]"}[s.op]
        return f"[^{inner}]" if s.negated else inner
    body = "".join(point(a) if a == b else f"{point(a)}-{point(b)}" for a, b in s.ranges)
    body += "".join(_emit_set(x, java) for x in s.parts)
    if s.fold and body:
        body += _spelled(_folded_in(_emit_set(replace(s, negated=False, fold=False), False)), point)
    if not body:
        return "[^\\x{0}-\\x{10ffff}]" if java else r"[^\U00000000-\U0010ffff]"
    return f"[{'^' * s.negated}{body}]"


@cache
def _every() -> tuple[tuple[int, str], ...]:
    return tuple((a, "".join(map(chr, range(a, b)))) for a, b in ((0, 0xD800), (0xE000, 0x110000)))


@cache
def code_points(node: Property | Set_) -> tuple[tuple[int, int], ...]:
    """The ranges of code points that a class matches, both ends included."""
    runs = regex.compile(f"{_emit_set(node, False)}+", regex.V1)
    return tuple((first + m.start(), first + m.end() - 1) for first, text in _every() for m in runs.finditer(text))


_JAVA_LOOK = {"start": r"\A", "end": r"\z", "line start": r"(?<![^\n])", "line end": r"(?![^\n])"}
_WORDS = (_PERL["w"].java, _PERL["w"].python)
WORD = _PERL["w"]
_SINGLE = (Char, Any_, Property, Set_)
_HARMLESS = " _,;:@%/'\"=<>!~`"


def _count(n: Repeat) -> str:
    count = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((n.least, n.most)) or f"{{{n.least}{'' if n.most == n.least else ',' if n.most is None else f',{n.most}'}}}"
    return count + "?" * n.lazy


def _emit(n: object, java: bool) -> str:
    if isinstance(n, Char):
        if n.fold and len(v := variants(n.char)) > 1:
            return _emit_set(Set_(tuple((c, c) for c in v)), java)
        return n.char if n.char.isalnum() and n.char.isascii() or n.char in _HARMLESS else _java_point(n.char) if java else _python_point(n.char)
    if isinstance(n, Any_):
        return r"(?s:.)" if n.newline else r"[^\n]"
    if isinstance(n, (Property, Set_)):
        return _emit_set(n, java)
    if isinstance(n, Look):
        if n.kind in _JAVA_LOOK:
            return _JAVA_LOOK[n.kind] if java or n.kind != "end" else r"\Z"
        w = f"[{_WORDS[0 if java else 1]}]"
        border = f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
        return border if n.kind == "word" else f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))"
    if isinstance(n, Repeat):
        return f"(?:{_emit(n.node, java)}){_count(n)}"
    if isinstance(n, Seq):
        return "".join(f"(?:{_emit(x, java)})" if isinstance(x, Alt) else _emit(x, java) for x in n.items)
    return "|".join(_emit(x, java) for x in n.items)


def simplify(n: object) -> object:
    """The tree with alternations of single characters as classes; it matches the same."""
    if isinstance(n, Repeat):
        return replace(n, node=simplify(n.node))
    if isinstance(n, Seq):
        items = tuple(map(simplify, n.items))
        return items[0] if len(items) == 1 else Seq(items)
    if isinstance(n, Alt):
        items = tuple(map(simplify, n.items))
        if all(isinstance(x, (Char, Property, Set_)) for x in items):
            chars = [v for x in items if isinstance(x, Char) for v in (variants(x.char) if x.fold else x.char)]
            return Set_(tuple((c, c) for c in chars), tuple(x for x in items if not isinstance(x, Char)))
        return Alt(items)
    return n


def to_java(pattern: str) -> str:
    """The pattern for Spark's rlike and regexp functions."""
    return _emit(simplify(parse(pattern)), True)


def to_python(pattern: str) -> regex.Pattern[str]:
    """The pattern compiled for the regex module."""
    return regex.compile(_emit(simplify(parse(pattern)), False), regex.V1)


def emit_re2(n: object, point: Callable[[str], str], single: Callable[[object], str]) -> str:
    """A simplified tree for RE2; ``single`` spells a class, ``point`` a character."""
    if isinstance(n, Char):
        return single(Set_(tuple((c, c) for c in v))) if n.fold and len(v := variants(n.char)) > 1 else point(n.char)
    if isinstance(n, Any_):
        return r"(?s:.)" if n.newline else r"[^\n]"
    if isinstance(n, (Property, Set_)):
        return single(n)
    if isinstance(n, Look):
        return {"start": r"\A", "end": r"\z", "line start": "(?m:^)", "line end": "(?m:$)", "word": r"\b", "no word": r"\B"}[n.kind]
    if isinstance(n, Repeat):
        inner = f"(?:{emit_re2(n.node, point, single)})"
        # RE2 takes counts up to 1000; more of them stand one behind another
        whole, most = divmod(n.least, 1000)[0], n.most
        if n.least <= 1000 and (most is None or most <= 1000):
            return inner + _count(n)
        if most is not None and most != n.least:
            more = most - n.least
            tail = f"{inner}{{0,1000}}{'?' * n.lazy}" * (more // 1000) + (f"{inner}{{0,{more % 1000}}}{'?' * n.lazy}" if more % 1000 else "")
        else:
            tail = f"{inner}*{'?' * n.lazy}" if most is None else ""
        return f"(?:{f'{inner}{{1000}}' * whole}{f'{inner}{{{n.least % 1000}}}' if n.least % 1000 else ''}{tail})"
    if isinstance(n, Seq):
        return "".join(f"(?:{emit_re2(x, point, single)})" if isinstance(x, Alt) else emit_re2(x, point, single) for x in n.items)
    return "|".join(emit_re2(x, point, single) for x in n.items)


def _ways(n: object) -> float:
    """How many ways a backtracking matcher may try at one place, at most; infinite if that depends on the text."""
    if isinstance(n, Repeat):
        if n.most is None:
            return float("inf")
        w = _ways(n.node)
        if isinstance(n.node, _SINGLE):
            return n.most - n.least + 1
        if n.most > 100:
            return float("inf")
        return sum(w**k for k in range(n.least, n.most + 1))
    if isinstance(n, Seq):
        return prod(map(_ways, n.items))
    if isinstance(n, Alt):
        return sum(map(_ways, n.items))
    return 1


def bounded(n: object) -> bool:
    """Whether a backtracking matcher needs a bounded number of steps at each place of a text: no loop without an end, few choices."""
    return _ways(n) <= 1000


def nullable(n: object) -> bool:
    """Whether a tree can match the empty text."""
    if isinstance(n, Look):
        return True
    if isinstance(n, Repeat):
        return n.least == 0 or nullable(n.node)
    if isinstance(n, Seq):
        return all(map(nullable, n.items))
    if isinstance(n, Alt):
        return any(map(nullable, n.items))
    return False


def asserts(n: object) -> bool:
    """Whether a tree has an assertion."""
    if isinstance(n, Look):
        return True
    if isinstance(n, Repeat):
        return asserts(n.node)
    return isinstance(n, (Seq, Alt)) and any(map(asserts, n.items))


def find_all(compiled: regex.Pattern[str], text: str, inside: bool = False) -> list[tuple[int, int]]:
    """Byte ranges of all matches: leftmost first, not overlapping, no empty match right behind another.

    ``inside``: empty matches are also found between the bytes of a character.
    """
    ascii_ = text.isascii()
    at = None
    if not ascii_:
        at = [0]
        for c in text:
            o = ord(c)
            at.append(at[-1] + (1 if o < 0x80 else 2 if o < 0x800 else 3 if o < 0x10000 else 4))
    out: list[tuple[int, int]] = []
    last = -1
    for m in compiled.finditer(text):
        a, b = m.span()
        if a == b and a == last:
            continue
        last = b
        out.append((a, b) if ascii_ else (at[a], at[b]))
        if inside and at and a == b and a < len(text):
            out += [(x, x) for x in range(at[a] + 1, at[a + 1])]
    return out
