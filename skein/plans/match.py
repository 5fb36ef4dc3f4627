"""Search expressions: parsing into a tree, and the tree as Spark columns over token arrays.

A document has token arrays in fields ('content', 'prose'; commands have 'arguments', 'output'). The tree is
evaluated with higher-order functions inside the JVM; `necessary` gives word prefixes of which a matching
document must hold, so that an inverted index can narrow the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import stem, tokenize


class BadQuery(ValueError):
    """A raw expression that can't be parsed."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    fields: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10
    fields: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    parts: tuple = field(default_factory=tuple)


Node = Phrase | Near | Op
Analyzer = Callable[[str], list[str]]


def stemmed(text: str) -> list[str]:
    return [stem(w) for _, _, w in tokenize(text)]


def plain(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def literal(pattern: str, any_: bool = False, analyze: Analyzer = stemmed, fields: tuple[str, ...] | None = None) -> Node | None:
    """Each blank-separated term is a phrase whose last word is a prefix; None if there is no word at all."""
    leaves = [Phrase(tuple(ws), prefix=True) for ws in map(analyze, pattern.split()) if ws]
    if not leaves:
        return None
    tree = leaves[0] if len(leaves) == 1 else Op("or" if any_ else "and", tuple(leaves))
    return restrict(tree, fields) if fields else tree


def command_query(pattern: str, match: str = "both", analyze: Analyzer = stemmed) -> Node | None:
    """Terms over a call's arguments and output; with 'both', each term may be in either."""
    if match not in ("both", "arguments", "output"):
        raise BadQuery(f"invalid match mode {match!r}")
    return literal(pattern, analyze=analyze, fields=None if match == "both" else (match,))


def restrict(node: Node, fields: tuple[str, ...]) -> Node:
    """The tree with every leaf limited to some fields."""
    if isinstance(node, Op):
        return Op(node.kind, tuple(restrict(p, fields) for p in node.parts))
    both = fields if node.fields is None else tuple(f for f in node.fields if f in fields)
    if isinstance(node, Near):
        return replace(node, fields=both, phrases=tuple(replace(p, fields=both) for p in node.phrases))
    return replace(node, fields=both)


# --- raw expressions ----------------------------------------------------------------------------------------

_LEX = re.compile(r'\s*(?:(?P<str>"(?:[^"]|"")*")|(?P<word>[A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|(?P<sym>[(){}:^*+,-]))')


class _Parser:
    """Recursive descent: OR < AND < NOT < adjacency; columns and parentheses bind tightest."""

    def __init__(self, text: str, names: tuple[str, ...], analyze: Analyzer):
        self.names, self.analyze, self.at = names, analyze, 0
        self.toks: list[tuple[str, str]] = []
        pos = 0
        while pos < len(text.rstrip()):
            m = _LEX.match(text, pos)
            if not m:
                raise BadQuery(f"syntax error near {text[pos:pos + 12]!r}")
            kind = m.lastgroup
            value = m[kind]
            if kind == "str":
                value = value[1:-1].replace('""', '"')
            elif kind == "word" and value in ("AND", "OR", "NOT"):
                kind = "key"
            self.toks.append((kind, value))
            pos = m.end()

    def peek(self, kind: str, value: str | None = None, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.toks) and self.toks[i][0] == kind and (value is None or self.toks[i][1] == value)

    def take(self, kind: str, value: str | None = None) -> str:
        if not self.peek(kind, value):
            raise BadQuery(f"syntax error: expected {value or kind}")
        self.at += 1
        return self.toks[self.at - 1][1]

    def parse(self) -> Node | None:
        node = self.chain("OR")
        if self.at < len(self.toks):
            raise BadQuery(f"syntax error near {self.toks[self.at][1]!r}")
        return node

    def chain(self, key: str) -> Node | None:
        below = {"OR": lambda: self.chain("AND"), "AND": lambda: self.chain("NOT"), "NOT": self.adjacent}[key]
        node = below()
        while self.peek("key", key):
            self.at += 1
            node = _join(key.lower(), node, below())
        return node

    def adjacent(self) -> Node | None:
        node = self.unit()
        while self.at < len(self.toks) and not self.peek("key") and not self.peek("sym", ")"):
            node = _join("and", node, self.unit())
        return node

    def unit(self) -> Node | None:
        fields = self.columns()
        if self.peek("sym", "("):
            self.at += 1
            node = self.chain("OR")
            self.take("sym", ")")
            return restrict(node, fields) if fields is not None and node is not None else node
        node = self.near_or_phrase()
        return restrict(node, fields) if fields is not None and node is not None else node

    def columns(self) -> tuple[str, ...] | None:
        start, minus = self.at, self.peek("sym", "-")
        self.at += minus
        names: list[str] = []
        if self.peek("sym", "{"):
            self.at += 1
            while not self.peek("sym", "}"):
                names.append(self.take("str") if self.peek("str") else self.take("word"))
            self.at += 1
        elif (self.peek("word") or self.peek("str")) and self.peek("sym", ":", 1):
            names.append(self.toks[self.at][1])
            self.at += 1
        if not names or not self.peek("sym", ":"):
            if names or minus:
                raise BadQuery("syntax error in a column filter")
            self.at = start
            return None
        self.at += 1
        unknown = [n for n in names if n.lower() not in self.names]
        if unknown:
            raise BadQuery(f"no such column: {unknown[0]}")
        named = {n.lower() for n in names}
        return tuple(f for f in self.names if (f in named) != minus)

    def near_or_phrase(self) -> Node | None:
        if self.peek("word", "NEAR") and self.peek("sym", "(", 1):
            self.at += 2
            phrases = []
            while not self.peek("sym", ")") and not self.peek("sym", ","):
                phrases.append(self.phrase())
            distance = 10
            if self.peek("sym", ","):
                self.at += 1
                raw = self.take("word")
                if not raw.isdigit():
                    raise BadQuery("expected a number in NEAR")
                distance = int(raw)
            self.take("sym", ")")
            phrases = [p for p in phrases if p.words]
            if not phrases:
                return None
            return phrases[0] if len(phrases) == 1 else Near(tuple(phrases), distance)
        p = self.phrase()
        return p if p.words else None

    def phrase(self) -> Phrase:
        initial = self.peek("sym", "^")
        self.at += initial
        words: list[str] = []
        while True:
            text = self.take("str") if self.peek("str") else self.take("word")
            words += self.analyze(text)
            star = self.peek("sym", "*")
            self.at += star
            if not self.peek("sym", "+"):
                return Phrase(tuple(words), prefix=star, initial=initial)
            self.at += 1


def _join(kind: str, a: Node | None, b: Node | None) -> Node | None:
    """A part without words is left out."""
    if a is None or b is None:
        return (b if a is None else a) if kind != "not" or a is not None else None
    if isinstance(a, Op) and a.kind == kind and kind != "not":
        return Op(kind, (*a.parts, b))
    return Op(kind, (a, b))


def raw(expression: str, names: tuple[str, ...] = ("content", "prose"), analyze: Analyzer = stemmed, fields: tuple[str, ...] | None = None) -> Node | None:
    """The tree of a raw expression; BadQuery if it isn't one, None if it is empty or holds no word."""
    if not expression.strip():
        return None
    node = _Parser(expression.strip(), names, analyze).parse()
    return restrict(node, fields) if fields and node is not None else node


# --- as columns ---------------------------------------------------------------------------------------------


class Evaluator:
    """Columns of a tree over token arrays, one a field; use bind() to give it arrays that are computed once a row."""

    def __init__(self, arrays: dict[str, Column]):
        self.arrays = arrays

    @staticmethod
    def bind(sources: dict[str, Column], build: Callable[[Evaluator], Column]) -> Column:
        """build's column with every source evaluated once a row.

        A plain column would be inlined into every place that uses it, also inside the functions that run for each
        token; the argument of a higher-order function isn't.
        """
        packed = F.array(F.struct(*[c.alias(name) for name, c in sources.items()]))
        return F.get(F.transform(packed, lambda row: build(Evaluator({name: row[name] for name in sources}))), F.lit(0))

    def names(self, node: Phrase | Near) -> list[str]:
        return [f for f in self.arrays if node.fields is None or f in node.fields]

    def positions(self, p: Phrase, name: str) -> Column:
        """Where the phrase begins in a field, in order."""
        arr, n = self.arrays[name], len(p.words)
        none = F.array().cast("array<int>")

        def here(i: Column) -> Column:
            out = F.lit(True)
            for j, w in enumerate(p.words):
                token = F.get(arr, i + j)
                out = out & (token.startswith(w) if p.prefix and j == n - 1 else token == F.lit(w))
            return out

        if p.initial:
            return F.when((F.size(arr) >= n) & here(F.lit(0)), F.array(F.lit(0))).otherwise(none)
        return F.filter(F.when(F.size(arr) >= n, F.sequence(F.lit(0), F.size(arr) - n)).otherwise(none), here)

    def count(self, p: Phrase) -> Column:
        """Instances of a phrase in its fields."""
        out = F.lit(0)
        for name in self.names(p):
            out = out + F.size(F.filter(self.arrays[name], _token_test(p)) if _simple(p) else self.positions(p, name))
        return out

    def size(self) -> Column:
        return sum((F.size(a) for a in self.arrays.values()), F.lit(0))

    def matches(self, node: Node) -> Column:
        if isinstance(node, Op):
            parts = [self.matches(p) for p in node.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if node.kind == "and" else out | p if node.kind == "or" else out & ~p
            return out
        out = F.lit(False)
        for name in self.names(node):
            out = out | (self._near(node, name) if isinstance(node, Near) else self._has(node, name))
        return out

    def _has(self, p: Phrase, name: str) -> Column:
        return F.exists(self.arrays[name], _token_test(p)) if _simple(p) else F.size(self.positions(p, name)) > 0

    def _near(self, node: Near, name: str) -> Column:
        """Some last beginning m has every phrase begin within its own length and the distance before it."""
        lists = [(p, self.positions(p, name)) for p in node.phrases]

        def fits(m: Column) -> Column:
            out = F.lit(True)
            for p, at in lists:
                out = out & F.exists(at, _between(m - len(p.words) - node.distance, m))
            return out

        return F.exists(F.array_distinct(F.concat(*[at for _, at in lists])), fits)

    def features(self, node: Node) -> Column:
        """struct(hit, size, c0, c1, ...): whether a document matches, its words, and the instances of each phrase."""
        return F.struct(self.matches(node).alias("hit"), self.size().alias("size"), *[self.count(p).alias(f"c{i}") for i, p in enumerate(phrases(node))])


def _simple(p: Phrase) -> bool:
    return len(p.words) == 1 and not p.initial


def _token_test(p: Phrase) -> Callable[[Column], Column]:
    word = p.words[0]
    return (lambda t: t.startswith(word)) if p.prefix else (lambda t: t == F.lit(word))


def _between(low: Column, high: Column) -> Callable[[Column], Column]:
    return lambda x: (x >= low) & (x <= high)


def phrases(node: Node | None) -> list[Phrase]:
    """The phrases that count for the rank, in order; those only under NOT's right side don't."""
    if node is None:
        return []
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    return [p for part in (node.parts[:1] if node.kind == "not" else node.parts) for p in phrases(part)]


def necessary(node: Node | None) -> list[tuple[str, bool]] | None:
    """(word, is prefix): a matching document holds at least one of them; None if no such list exists."""
    if node is None:
        return None
    if isinstance(node, (Phrase, Near)):
        p = node if isinstance(node, Phrase) else max(node.phrases, key=lambda x: max(map(len, x.words)))
        i = max(range(len(p.words)), key=lambda k: len(p.words[k]))
        return [(p.words[i], p.prefix and i == len(p.words) - 1)]
    lists = [necessary(p) for p in (node.parts[:1] if node.kind == "not" else node.parts)]
    if node.kind == "or":
        return None if any(x is None for x in lists) else [w for x in lists for w in x]
    known = [x for x in lists if x is not None]
    return min(known, key=lambda x: (len(x), -max(len(w) for w, _ in x))) if known else None
