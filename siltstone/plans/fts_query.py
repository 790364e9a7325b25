"""Full-text query language to Column expressions over a document's token array.

Bare words are joined by an implicit AND that binds tightest, then NOT, AND and OR; quotes make a phrase, a
trailing * a prefix, parentheses group, NEAR(a b, n) bounds a distance, and ^ ties a phrase to the first token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import FOLD_FROM, FOLD_TO


class QueryError(ValueError):
    """The query can't be parsed."""


def fold_word(w: str) -> str:
    return w.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def quote(text: str) -> str:
    """Escape free text to a query of quoted words."""
    return " ".join(f'"{w}"' for w in re.findall(r"\w+", text))


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False

    def starts(self, tokens: Column) -> Column:
        """array<int> of the 0-based positions at which the phrase begins."""
        n = len(self.words)

        def test(i: Column) -> Column:
            ok = F.lit(True)
            for k, w in enumerate(self.words):
                t = F.get(tokens, i + k)
                ok = ok & (t.startswith(w) if self.prefix and k == n - 1 else t == w)
            return ok & (i == 0) if self.first else ok

        if n == 1 and not self.prefix and not self.first:
            w = self.words[0]
            return F.filter(F.transform(tokens, lambda t, i: F.when(t == w, i)), lambda i: i.isNotNull())
        first = self.words[0]
        head = lambda t: t.startswith(first) if self.prefix and n == 1 else t == first
        at = F.filter(F.transform(tokens, lambda t, i: F.when(head(t), i)), lambda i: i.isNotNull())  # few places are looked at further
        return F.filter(at, test)

    def count(self, tokens: Column) -> Column:
        if len(self.words) == 1 and not self.first:
            w = self.words[0]
            return F.size(F.filter(tokens, lambda t: t.startswith(w) if self.prefix else t == w))
        return F.size(self.starts(tokens))


@dataclass(frozen=True)
class Node:
    op: str  # AND, OR, NOT, NEAR
    parts: tuple
    distance: int = 10


def _lex(q: str) -> list[tuple[str, str]]:
    out, pos = [], 0
    rx = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\*?)|([()^,])|([^\W]+)(\*?))', re.U)
    q = q.rstrip()
    while pos < len(q):
        m = rx.match(q, pos)
        if not m or m.end() == pos:
            raise QueryError(f"unexpected sign at {pos} in {q!r}")
        pos = m.end()
        if m[1] is not None:
            out.append(("phrase*" if m[2] else "phrase", m[1].replace('""', '"')))
        elif m[3]:
            out.append((m[3], m[3]))
        elif m[4] in ("AND", "OR", "NOT", "NEAR"):
            out.append((m[4], m[4]))
        else:
            out.append(("word*" if m[5] else "word", m[4]))
    return out


def parse(q: str) -> Phrase | Node:
    toks = [*_lex(q), ("end", "")]
    at = 0

    def peek() -> str:
        return toks[at][0]

    def take(kind: str | None = None) -> str:
        nonlocal at
        if kind and peek() != kind:
            raise QueryError(f"expected {kind} but found {toks[at][1]!r} in {q!r}")
        at += 1
        return toks[at - 1][1]

    def atom():
        first = peek() == "^" and bool(take())
        kind = peek()
        if kind == "(" and not first:
            take()
            inner = either()
            take(")")
            return inner
        if kind == "NEAR" and not first:
            take()
            take("(")
            parts = []
            while peek() not in (",", ")", "end"):
                parts.append(atom())
            n = 10
            if peek() == ",":
                take()
                n = int(take("word"))
            take(")")
            return Node("NEAR", tuple(parts), n)
        if kind not in ("word", "word*", "phrase", "phrase*"):
            raise QueryError(f"unexpected {toks[at][1]!r} in {q!r}")
        words = tuple(map(fold_word, re.findall(r"\w+", take())))
        if not words:
            raise QueryError(f"empty phrase in {q!r}")
        return Phrase(words, kind.endswith("*"), first)

    def together():
        parts = [atom()]
        while peek() in ("word", "word*", "phrase", "phrase*", "(", "^", "NEAR"):
            parts.append(atom())
        return parts[0] if len(parts) == 1 else Node("AND", tuple(parts))

    def without():
        left = together()
        while peek() == "NOT":
            take()
            left = Node("NOT", (left, together()))
        return left

    def both():
        parts = [without()]
        while peek() == "AND":
            take()
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("AND", tuple(parts))

    def either():
        parts = [both()]
        while peek() == "OR":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("OR", tuple(parts))

    tree = either()
    take("end")
    return tree


def phrases(tree: Phrase | Node) -> list[Phrase]:
    """The phrases that score: those of a NOT's right side don't."""
    if isinstance(tree, Phrase):
        return [tree]
    parts = tree.parts[:1] if tree.op == "NOT" else tree.parts
    return [p for x in parts for p in phrases(x)]


def every_phrase(tree: Phrase | Node) -> list[Phrase]:
    """All phrases a document's tokens are tested for, a NOT's right side among them."""
    return [tree] if isinstance(tree, Phrase) else [p for x in tree.parts for p in every_phrase(x)]


def _near(a: Phrase, b: Phrase, distance: int, tokens: Column) -> Column:
    return F.exists(a.starts(tokens), lambda i: F.exists(b.starts(tokens), lambda j: F.abs(j - i) <= distance + len(a.words)))


def matches(tree: Phrase | Node, tokens: Column) -> Column:
    if isinstance(tree, Phrase):
        return tree.count(tokens) > 0
    if tree.op == "NEAR":
        ok = F.lit(True)
        for a, b in zip(tree.parts, tree.parts[1:], strict=False):
            ok = ok & _near(a, b, tree.distance, tokens)
        return ok
    cols = [matches(p, tokens) for p in tree.parts]
    out = cols[0]
    for c in cols[1:]:
        out = out & ~c if tree.op == "NOT" else (out & c if tree.op == "AND" else out | c)
    return out
