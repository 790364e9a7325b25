"""Markup residue: finds HTML, Markdown, wiki and LaTeX markup and turns it to clean text that keeps the structure.

A content is cut into DOM leaf blocks: lines, cut again at block-level tags, each with the ancestors it stands under
(open tags, fences, LaTeX environments, wiki tables, comments). A linear-chain conditional random field labels each block
from features of its ancestors, its line's form and the inline signs in it; the labels are decoded by Viterbi. It is
trained on the driver by maximum likelihood on `PAGES` labelled pages made here by rule (`labelled_pages`), plain
pages with look-alike signs among them; no row of the data is used. Sequences of equal features are decoded once a task.

Labels: O plain, INLINE prose with inline markup, HEAD, LIST, QUOTE, CODE, TABLE, FORMULA, DROP (comments, styles, categories).
A document holds markup if a block isn't O.

Defined cases: null and empty contents hold none; a record of named fields or a JSON object is plain; unclosed tags, fences and
environments end with the text; texts of any length are read whole.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("O", "INLINE", "HEAD", "LIST", "QUOTE", "CODE", "TABLE", "FORMULA", "DROP")
PAGES = 500

_BLOCK = re.compile(
    r"(</?(?:p|div|h[1-6]|ul|ol|li|dl|dt|dd|table|thead|tbody|tr|td|th|pre|blockquote|section|article|header|footer|nav|style|script|br|hr|html|body)\b[^<>]*>|<!--.*?(?:-->|$))",
    re.I,
)
_TAG = r"</?(?:[a-zA-Z][a-zA-Z0-9]*)(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>]+))?)*\s*/?>"
#: Inline signs; one alternation, the group's name is the feature.
_INLINE = re.compile(
    r"(?P<comment><!--)"
    rf"|(?P<tag>{_TAG})"
    r"|(?P<entity>&(?:[a-zA-Z]{2,8}|\#\d{1,6}|\#[xX][0-9a-fA-F]{1,5});)"
    r"|(?P<formula>\\\([^\n]*?\\\)|\\\[.*?\\\]|\$\$.+?\$\$|(?<![\w$\\])\$(?!\d+\b(?![\^_\\{]))(?=[^\s$])[^$\n]{0,160}?(?<=[^\s$])\$(?![\w$]))"
    r"|(?P<command>(?<![\w:\\])\\(?:[a-zA-Z]{2,}\*?(?![\w\\])|[a-zA-Z]+(?=[\{\[])))"
    r"|(?P<image>!\[[^\[\]\n]*\]\([^()\s]+\))"
    r"|(?P<link>\[[^\[\]\n]*\n?[^\[\]\n]*\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\))"
    r"|(?P<note>\[\^[\w-]+\])"
    r"|(?P<wikilink>\[\[[^\[\]]+\]\])"
    r"|(?P<template>\{\{[^{}]+\}\})"
    r"|(?P<quotes>(?<!')'{2,5}(?=[^'\s])[^'\n]*(?:'[^'\n]+)*?[^'\n]*'{2,5}(?!'))"
    r"|(?P<code>`+[^`\n]+\n?[^`\n]*`+)"
    r"|(?P<strong>\*\*(?=[^\s*])[^*\n]*\n?[^*\n]*(?<=[^\s*])\*\*|(?<!\w)__(?=[^\s_])[^_\n]+(?<=[^\s_])__(?!\w))"
    r"|(?P<strike>~~(?=\S)[^~\n]+\n?[^~\n]*(?<=\S)~~)"
    r"|(?P<emphasis>(?<![\w*\\])\*(?=[^\s*])[^*\n]*\n?[^*\n]*(?<=[^\s*])\*(?![\w*])|(?<![\w_\\/|])_(?=[^\s_])[^_\n]*\n?[^_\n]*(?<=[^\s_])_(?![\w_]))"
    r"|(?P<digits>\d)",
    re.S,
)
#: Forms of a whole line; the first that fits is the feature.
_FORMS = [
    (name, re.compile(rx))
    for name, rx in (
        ("fence", r"\s*(?:```|~~~)"),
        ("wikihead", r"={2,6}[^=\n]+={2,6}\s*$"),
        ("under", r"(?:={3,}|-{3,})\s*$"),
        ("rule", r"\s{0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$"),
        ("hashes", r"#{1,6}\s+\S"),
        ("bullet", r"\s*[*+-]{1,4}\s+\S"),
        ("number", r"\s*\d{1,3}[.)]\s+\S"),
        ("quote", r"\s*>\s*\D"),
        ("wikitable", r"\s*(?:\{\||\|\}|\|-)"),
        ("tablerule", r"\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$"),
        ("row", r"\s*\|.*\|\s*$"),
        ("cell", r"\s*[|!]\s*\S"),
        ("begin", r"\s*\\begin\{"),
        ("end", r"\s*\\end\{"),
        ("section", r"\s*\\(?:part|chapter|(?:sub)*section|paragraph|title)\*?\{"),
        ("item", r"\s*\\item\b"),
        ("display", r"\s*(?:\\\[|\$\$)"),
        ("remark", r"%\s*\S"),
        ("category", r"\s*\[\[(?:Category|File|Image):[^\]]*\]\]\s*$"),
        ("infobox", r"\s*\{\{[^{}]*\}\}\s*$"),
        ("refdef", r"\s*\[\^?[^\[\]\n]+\]:\s"),
    )
]
_NAMED = re.compile(r"[^:=;.!?\n]{1,40}[:=].*\S")
_PAIRS = re.compile(r"[^:=;.!?\n]{1,40}=.*\S", re.S)
_VOID = {"br", "hr", "p", "li", "img"}
_ENV = re.compile(r"\\(begin|end)\{(\w+\*?)\}")
_HEADS = {f"h{i}" for i in range(1, 7)}


def is_record(text: str) -> bool:
    """A JSON object, or named fields by line or by semicolon."""
    t = text.strip("﻿​ \t\r\n ")
    if t[:1] == "{" and t[-1:] == "}":
        try:
            return isinstance(json.loads(t), dict)
        except ValueError:
            return False
    if not _NAMED.match(t):
        return False
    lines = [x for x in t.splitlines() if x.strip()]
    if len(lines) > 1 and all(map(_NAMED.match, lines)):
        return True
    parts = [x for x in t.split(";") if x.strip()]
    return len(parts) > 1 and all(map(_PAIRS.match, (p.strip() for p in parts)))


class Block:
    __slots__ = ("ancestors", "end", "features", "start", "text")

    def __init__(self, text: str, start: int, ancestors: tuple[str, ...]):
        self.text, self.start, self.end, self.ancestors = text, start, start + len(text), ancestors
        self.features: set[str] = set()


def _group(names: list[str]) -> str:
    """What an open ancestor means for the blocks below it."""
    for n in reversed(names):
        if n in _HEADS:
            return "heading"
        if n in ("ul", "ol", "li", "dl", "dd", "dt", "itemize", "enumerate", "description"):
            return "list"
        if n in ("pre", "fence", "verbatim", "lstlisting", "code"):
            return "code"
        if n in ("table", "tr", "td", "th", "thead", "tbody", "wikitable", "tabular"):
            return "table"
        if n in ("style", "script", "nav", "comment"):
            return "drop"
        if n in ("equation", "equation*", "align", "align*", "displaymath", "math"):
            return "formula"
        if n in ("blockquote", "quote", "quotation"):
            return "quote"
    return "plain" if not names else "box"


def blocks(text: str) -> list[Block]:
    """DOM leaf blocks in order, with features of ancestors and form; inline features are added from the whole text."""
    out: list[Block] = []
    stack: list[str] = []
    pos, blank, last = 0, True, ""
    for line in text.split("\n"):
        at, pos = pos, pos + len(line) + 1
        bare = line.strip()
        if not bare:
            blank = True
            continue
        inside = stack[-1] if stack else ""
        form = ""
        if inside == "fence":
            form = "fence" if bare.startswith(("```", "~~~")) else "fenced"
        else:
            form = next((name for name, rx in _FORMS if rx.match(line)), "")
        # signs that a wrapped sentence may begin with count only at the start of a paragraph or after their like
        if form in ("bullet", "number", "quote", "hashes") and not (blank or last == form or last in ("bullet", "number") and form in ("bullet", "number", "hashes") or form == "hashes"):
            form = ""
        if form == "hashes" and not blank and last == "bullet":
            form = "bullet"  # a numbered item of a wiki list
        if form == "cell" and "wikitable" not in stack:
            form = ""
        if form == "under" and (blank or last not in ("", "text")):
            form = "rule" if bare[0] == "-" else ""
        if form == "under":
            out[-1].features.add("above-under")
        if form == "fence":
            out.append(Block(line, at, (*stack, "fence")))
            if inside == "fence":
                stack.pop()
            else:
                stack.append("fence")
        elif form == "wikitable":
            if bare.startswith("{|"):
                stack.append("wikitable")
            out.append(Block(line, at, tuple(stack)))
            if bare.startswith("|}") and "wikitable" in stack:
                while stack.pop() != "wikitable":
                    pass
        elif inside in ("fence", "verbatim", "lstlisting") and not (m := _ENV.search(line)):
            out.append(Block(line, at, tuple(stack)))
        else:
            env = list(_ENV.finditer(line))
            for m in env:
                if m[1] == "begin":
                    stack.append(m[2])
            pieces = _BLOCK.split(line) if "<" in line else [line]
            offset, first, tags = at, True, 0
            for k, piece in enumerate(pieces):
                if k % 2:
                    name = piece.strip("</>!- \t").split()[0].rstrip("/>").lower() if piece[:4] != "<!--" else "comment"
                    tags += 1
                    if name == "comment":
                        b = Block(piece, offset, (*stack, "comment"))
                        b.features |= {"at:drop", "comment"}
                        out.append(b)
                    elif piece[1] == "/":
                        if name in stack:
                            while stack.pop() != name:
                                pass
                    elif name not in _VOID or name in ("p", "li"):
                        if name in ("p", "li") and stack and stack[-1] == name:
                            stack.pop()
                        stack.append(name)
                elif piece.strip():
                    b = Block(piece, offset, tuple(stack))
                    if tags:
                        b.features.add("edge-tag")
                    if first and form:
                        b.features.add("form:" + form)
                    first = False
                    out.append(b)
                offset += len(piece)
            if tags and first:
                b = Block(line, at, tuple(stack))
                b.features |= {"only-tags", "edge-tag"}
                out.append(b)
            elif tags:
                out[-1].features.add("edge-tag")
            for m in env:
                if m[1] == "end" and m[2] in stack:
                    while stack.pop() != m[2]:
                        pass
        b = out[-1]
        if form and not any(f.startswith("form:") for f in b.features):
            b.features.add("form:" + form)
        blank, last = False, form or "text"
    for b in out:
        b.features.add("at:" + _group(list(b.ancestors)))
    if out:
        starts = [b.start for b in out]
        for m in _INLINE.finditer(text):
            if (kind := m.lastgroup) != "digits":
                b = out[max(0, bisect_right(starts, m.start()) - 1)]
                if b.start <= m.start() < b.end:  # a block-level tag lies between blocks and counts as their edge
                    b.features.add("in:" + kind)
                    if kind == "formula" and m[0] == b.text.strip():
                        b.features.add("all-formula")
    return out


# ------------------------------------------------------------------------------------------------ labelled pages


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[tuple[int, str]]]]:
    """n pages of (text, [(offset, label)]) made by rule: each part is written with its label."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    vocab = "queue index cache shard tag report folder team node run page file release note check user reader slow warm first second next".split()

    def words(lo: int = 4, hi: int = 12) -> str:
        return " ".join(pick(vocab) for _ in range(int(rng.integers(lo, hi))))

    def plain() -> str:
        s = words().capitalize()
        k = int(rng.integers(1, 400))
        extra = pick(
            ["", "", "", f" costs ${k} to ${k + 9}", f" if a < {k} and b > 3", f" see [{k}]", f" set {{{k}, 9}}", f" near 2^{k % 20}", f" is x * y * z", f" at C:\\{pick(vocab)}\\new",
             f" in /srv/a_{pick(vocab)}/v2", f" waits ~{k} minutes", f" under #{pick(vocab)}", f" is 50% & rising", f" k == e but k != c", f" a -> b -> c", f" x_a|x_b", f" C# and F#", f" <3 it", f" - about {k} ms"]
        )
        return s + extra + "."

    inline = [
        lambda: f"<b>{words(1, 3)}</b>", lambda: f'<a href="#s{rng.integers(9)}">{words(1, 3)}</a>', lambda: f"<span class='q'>{words(1, 3)}</span>", lambda: "</div>", lambda: "&amp;", lambda: "&#160;", lambda: "&nbsp;",
        lambda: f"**{words(1, 4)}**", lambda: f"*{words(1, 3)}*", lambda: f"_{words(1, 3)}_", lambda: f"~~{words(1, 3)}~~", lambda: f"`{words(1, 3)}`", lambda: f"[{words(1, 3)}](notes/{rng.integers(99)}.md)",
        lambda: f"![{words(1, 2)}](img/{rng.integers(99)}.png)", lambda: f"[^{rng.integers(99)}]", lambda: f"[^{rng.integers(9)}]", lambda: f"[[{words(1, 3)}]]", lambda: f"[[{words(1, 2)}|{words(1, 2)}]]", lambda: f"{{{{lang|en|{words(1, 3)}}}}}",
        lambda: f"'''{words(1, 3)}'''", lambda: f"''{words(1, 2)}''", lambda: f"<ref>{words(1, 3)}</ref>", lambda: f"\\emph{{{words(1, 3)}}}", lambda: f"\\textbf{{{words(1, 3)}}}~\\cite{{k{rng.integers(99)}}}", lambda: "\\noindent", lambda: f"\\ref{{s{rng.integers(9)}}}",
        lambda: f"$n_{{{rng.integers(9)}}} \\le x^2$", lambda: "\\(a + b\\)",
    ]

    turn = [0]

    def prose() -> list[tuple[str, str]]:
        turn[0] += 1  # every inline sign comes equally often
        return [(f"{words().capitalize()} {inline[turn[0] % len(inline)]()} {words()}.", "INLINE")]

    def heading() -> list[tuple[str, str]]:
        t = words(1, 4).capitalize()
        kind = int(rng.integers(5))
        if kind == 0:
            return [("#" * int(rng.integers(1, 6)) + " " + t, "HEAD")]
        if kind == 1:
            return [(t + "\n", "HEAD"), (pick(["=====", "-----"]), "HEAD")]
        if kind == 2:
            return [(f"== {t} ==", "HEAD")]
        if kind == 3:
            return [(f"\\{pick(['section', 'subsection*', 'subsubsection'])}{{{t}}}", "HEAD")]
        return [("<h2>" + t + "</h2>", "HEAD")]

    def listing() -> list[tuple[str, str]]:
        m, kind = int(rng.integers(2, 4)), int(rng.integers(5))
        items = [words().capitalize() + "." for _ in range(m)]
        if kind == 0:
            return [(f"{pick(['-', '*', '+'])} {x}\n", "LIST") for x in items]
        if kind == 1:
            return [(f"{i + 1}. {x}\n", "LIST") for i, x in enumerate(items)]
        if kind == 2:
            return [("<ul>\n", "LIST"), *[(f"<li>{x}</li>\n", "LIST") for x in items], ("</ul>", "LIST")]
        if kind == 3:
            return [("\\begin{itemize}\n", "LIST"), *[(f"\\item {x}\n", "LIST") for x in items], ("\\end{itemize}", "LIST")]
        return [(f"{pick(['* ', '** '])}{x}\n", "LIST") for x in items]

    def code() -> list[tuple[str, str]]:
        lines = [f"n = {rng.integers(9)}\n", "while n > 0:\n", "    n -= 1\n"]
        a, b = [("```\n", "```"), ("```sql\n", "```"), ("<pre><code>", "</code></pre>"), ("\\begin{verbatim}\n", "\\end{verbatim}")][int(rng.integers(4))]
        return [(a, "CODE"), *[(x, "CODE") for x in lines], (b, "CODE")]

    def tabular() -> list[tuple[str, str]]:
        kind = int(rng.integers(3))
        if kind == 0:
            return [("| step | effect |\n", "TABLE"), ("|---|:-:|\n", "TABLE"), (f"| {rng.integers(99)} | {words()} |", "TABLE")]
        if kind == 1:
            return [('{| class="grid"\n', "TABLE"), ("|-\n", "TABLE"), (f"! {words(1, 2)}\n", "TABLE"), (f"| {words()}\n", "TABLE"), ("|}", "TABLE")]
        return [(f"<table><tr><th>{words(1, 2)}</th><td>{words()}</td></tr></table>", "TABLE")]

    def drop() -> list[tuple[str, str]]:
        return [
            (pick([f"<!-- {words(1, 4)} -->", "<style>.k{color:#333}</style>", f"[[Category:{words(1, 2)}]]", f"% draft by {words(1, 2)}", f"{{{{Infobox store|owner={words(1, 2)}}}}}", f"[^{rng.integers(9)}]: {words()}", "* * *", "---"]), "DROP")
        ]

    def formula() -> list[tuple[str, str]]:
        return [(pick(["\\[ s = \\sum_{i=1}^{9} w_i^2 \\]", "$$a^2 + b^2 = c^2$$", "\\begin{equation}\na^2 + b = c\n\\end{equation}"]), "FORMULA")]

    def quote() -> list[tuple[str, str]]:
        if rng.integers(3) == 0:
            return [(f"<blockquote>{words().capitalize()}.</blockquote>", "QUOTE")]
        return [(f"> {words().capitalize()}.\n", "QUOTE") for _ in range(int(rng.integers(1, 4)))]

    def div() -> list[tuple[str, str]]:
        return [(f"<p>{words().capitalize()}. {words()}</p>", "INLINE")]

    def text() -> list[tuple[str, str]]:
        return [(plain() + pick(["\n", " ", " "]), "O") for _ in range(int(rng.integers(1, 4)))]

    parts = [prose, prose, prose, prose, heading, listing, code, tabular, drop, formula, quote, div]
    pages = []
    for k in range(n):
        body, marks = "", []
        for _ in range(int(rng.integers(1, 6))):
            for piece, label in (text if k % 3 == 0 or rng.integers(2) else pick(parts))():
                marks.append((len(body), label))
                body += piece
            body = body.rstrip("\n") + "\n\n"
        pages.append((body.rstrip("\n"), marks))
    return pages


# ------------------------------------------------------------------------------------------------ the random field


class Field:
    """Linear-chain conditional random field over sets of binary features."""

    def __init__(self, names: list[str]):
        self.index = {n: i for i, n in enumerate(names)}
        self.emit = np.zeros((len(names) + 1, len(LABELS)))  # the last row is the bias
        self.move = np.zeros((len(LABELS), len(LABELS)))
        self._seen: dict[tuple, tuple[int, ...]] = {}

    def encode(self, features: set[str]) -> tuple[int, ...]:
        return tuple(sorted(self.index[f] for f in features if f in self.index))

    def _dense(self, seqs: list[list[tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
        t = max(map(len, seqs))
        x = np.zeros((len(seqs), t, self.emit.shape[0]))
        mask = np.zeros((len(seqs), t), bool)
        for i, s in enumerate(seqs):
            mask[i, : len(s)] = True
            for j, f in enumerate(s):
                x[i, j, list(f)] = 1
                x[i, j, -1] = 1
        return x, mask

    def fit(self, seqs: list[list[tuple[int, ...]]], labels: list[list[int]], steps: int = 140, rate: float = 0.3, ridge: float = 1e-5) -> None:
        """Maximum likelihood by Adam, all pages at once."""
        x, mask = self._dense(seqs)
        n, t, _ = x.shape
        flat = x.reshape(n * t, -1)
        gold = np.zeros((n, t), int)
        for i, y in enumerate(labels):
            gold[i, : len(y)] = y
        hot = np.eye(len(LABELS))[gold] * mask[..., None]
        pairs = np.einsum("ntk,ntl->kl", hot[:, :-1], hot[:, 1:])
        rows, lasts = np.arange(n), mask.sum(axis=1) - 1
        state = [np.zeros_like(self.emit), np.zeros_like(self.emit), np.zeros_like(self.move), np.zeros_like(self.move)]
        for step in range(1, steps + 1):
            e = (flat @ self.emit).reshape(n, t, -1)
            up, down = np.zeros_like(e), np.zeros_like(e)
            up[:, 0] = e[:, 0]
            for j in range(1, t):
                v = up[:, j - 1, :, None] + self.move[None]
                top = v.max(axis=1)
                up[:, j] = np.where(mask[:, j, None], e[:, j] + top + np.log(np.exp(v - top[:, None]).sum(axis=1)), up[:, j - 1])
            for j in range(t - 2, -1, -1):
                v = self.move[None] + (e[:, j + 1] + down[:, j + 1])[:, None, :]
                top = v.max(axis=2)
                down[:, j] = np.where(mask[:, j + 1, None], top + np.log(np.exp(v - top[..., None]).sum(axis=2)), 0)
            z = up[rows, lasts]
            z = z.max(axis=1) + np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1))
            p = np.exp(up + down - z[:, None, None]) * mask[..., None]
            both = up[:, :-1, :, None] + self.move + (e[:, 1:] + down[:, 1:])[:, :, None, :] - z[:, None, None, None]
            q = (np.exp(np.minimum(both, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
            grads = [flat.T @ (hot - p).reshape(n * t, -1) / n - ridge * self.emit, (pairs - q) / n - ridge * self.move]
            for k, (w, g) in enumerate(zip((self.emit, self.move), grads, strict=True)):
                state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
                state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
                w += rate * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def decode(self, seq: tuple[tuple[int, ...], ...]) -> tuple[int, ...]:
        """Viterbi; equal sequences are decoded once."""
        if (done := self._seen.get(seq)) is not None:
            return done
        e = [self.emit[list(f)].sum(axis=0) + self.emit[-1] for f in seq]
        best, back = e[0], []
        for x in e[1:]:
            v = best[:, None] + self.move
            back.append(v.argmax(axis=0))
            best = v.max(axis=0) + x
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        out = tuple(reversed(path))
        if len(self._seen) < 200_000 and len(seq) < 64:
            self._seen[seq] = out
        return out


def _gold(found: list[Block], marks: list[tuple[int, str]]) -> list[int]:
    starts = np.array([a for a, _ in marks])
    return [LABELS.index(marks[max(0, int(np.searchsorted(starts, b.start, side="right")) - 1)][1]) for b in found]


def _merge(found: list[Block], gold: list[int], marks: list[tuple[int, str]]) -> list[int]:
    """A block that spans several parts has markup if any of them has."""
    starts = [a for a, _ in marks]
    out = []
    for b, g in zip(found, gold, strict=True):
        own = [LABELS.index(x) for a, x in zip(starts, (x for _, x in marks), strict=True) if b.start <= a < b.end]
        out.append(g if g or not own else next((x for x in own if x), 0))
    return out


@cache
def trained(pages: int = PAGES, seed: int = 5) -> Field:
    data = [(blocks(t), m) for t, m in labelled_pages(pages, seed)]
    data = [(b, _merge(b, _gold(b, m), m)) for b, m in data if b]
    field = Field(sorted({f for b, _ in data for x in b for f in x.features}))
    field.fit([[field.encode(x.features) for x in b] for b, _ in data], [y for _, y in data])
    return field


def label(text: str, field: Field) -> list[tuple[Block, str]]:
    """Blocks of a text with their labels. A record is plain."""
    if is_record(text):
        return [(Block(text, 0, ()), "O")]
    found = blocks(text.replace("\r\n", "\n").replace("\r", "\n"))
    if not found:
        return []
    return list(zip(found, (LABELS[k] for k in field.decode(tuple(field.encode(b.features) for b in found))), strict=True))


# ------------------------------------------------------------------------------------------------ clean text


def _plain(t: str) -> str:
    """Inline markup to text: code and formulas stay marked, links and emphasis give their text."""
    t = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|<!--.*?(?:-->|$)", "", t, flags=re.S)
    t = re.sub(r"</?code\b[^<>]*>", "`", t)
    t = html.unescape(re.sub(_TAG, "", t))
    t = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)", r"\1", t)
    t = re.sub(r"\[\^[\w-]+\]", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]", r"\1", t)
    t = re.sub(r"\{\{lang\|[^{}|]*\|([^{}]*)\}\}", r"\1", t)
    t = re.sub(r"\{\{[^{}]*\}\}", "", t)
    t = re.sub(r"'{2,5}", "", t)
    t = re.sub(r"\*\*([^*\n]+)\*\*|~~([^~\n]+)~~|(?<![\w*])\*([^\s*][^*\n]*)\*(?![\w*])|(?<![\w_])_([^\s_][^_\n]*)_(?![\w_])", lambda m: next(g for g in m.groups() if g), t)
    keep = re.split(r"(\\\([^\n]*?\\\)|\\\[.*?\\\]|\$[^$\n]+\$)", t)
    for k in range(0, len(keep), 2):
        p = re.sub(r"~?\\(?:cite|ref|label|footnotemark)\w*(?:\[[^\]]*\])?\{[^{}]*\}", "", keep[k])
        for _ in range(3):
            p = re.sub(r"\\[a-zA-Z]{2,}\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", p)
        keep[k] = re.sub(r"(?<![\w:\\])\\[a-zA-Z]{2,}\*?(?![\w\\])\s?", "", p)
    return re.sub(r"[ \t]+", " ", "".join(keep)).strip()


_ENDS = re.compile(r"\\begin\{[^{}]*\}(?:\[[^\]]*\]|\{[^{}]*\})*|\\end\{[^{}]*\}")
_SECTION = re.compile(r"\s*\\(title|part|chapter|(?:sub)*section|paragraph)\*?(?:\[[^\]]*\])?\{")
_ITEM = re.compile(r"(\s*)(?:(\d{1,3})[.)]\s|([*+#-]+)\s|(\\item\b)(?:\[[^\]]*\])?)")
_LISTS = ("ul", "ol", "dl", "itemize", "enumerate", "description")
_APART = re.compile(r"\n[ \t]*\n|</?(?:p|div|section|article|header|footer|nav|h[1-6]|blockquote|table|ul|ol|dl|pre|hr)\b", re.I)


def _head(b: Block, after: Block | None) -> tuple[int, str]:
    """Level and text of a heading."""
    t = b.text.strip()
    if m := re.match(r"(#{1,6})\s+", t):
        return len(m[1]), re.sub(r"\s+#+$", "", t[m.end() :])
    if m := re.match(r"(={2,6})\s*(.*?)\s*={2,6}$", t):
        return len(m[1]), m[2]
    if m := _SECTION.match(t):
        return {"title": 1, "part": 1, "chapter": 1, "paragraph": 4}.get(m[1], 1 + m[1].count("sub")), t
    tag = next((n for n in reversed(b.ancestors) if n in _HEADS), "") or next(iter(re.findall(r"<(h[1-6])\b", t.lower())), "")
    if tag:
        return int(tag[1]), t
    return 2 if after is not None and re.match(r"-{3,}\s*$", after.text.strip()) else 1, t


def _item(b: Block, numbers: dict[int, int], fresh: bool) -> tuple[int, str, str]:
    """Depth from 1, sign and text of a list item; numbers: the last number at each depth of ordered lists that carry none."""
    t, m = b.text, _ITEM.match(b.text)
    kinds = [n for n in b.ancestors if n in _LISTS]
    if kinds:
        depth, ordered = len(kinds), kinds[-1] in ("ol", "enumerate")
        t = t[m.end() :] if m and m[4] else t
    else:
        wiki = m[3] if m and m[3] else ""
        depth = max(len(wiki), 1) + (len(m[1].expandtabs(4)) // 2 if m else 0)
        if m and m[2]:
            return depth, f"{m[2]}. ", t[m.end() :]
        ordered, t = wiki.endswith("#"), t[m.end() :] if m else t
    for deeper in [d for d in numbers if fresh or d > depth]:
        del numbers[deeper]
    if not ordered:
        return depth, "- ", t
    numbers[depth] = numbers.get(depth, 0) + 1
    return depth, f"{numbers[depth]}. ", t


def _same_row(a: Block, b: Block, gap: str) -> bool:
    cells = {"td", "th"}
    return bool(cells & {*a.ancestors} and cells & {*b.ancestors} and not re.search(r"</?tr\b", gap, re.I)) or ("wikitable" in a.ancestors and "wikitable" in b.ancestors and not re.search(r"\n\s*\|[-}]", gap))


def _numbered(text: str, found: list[tuple[Block, str]], k: int) -> bool:
    """Whether a line with `#` is an item of a wiki list: its like stands on the next or the last line."""
    if not re.match(r"#+\s", found[k][0].text):
        return False
    for a, b in ((k - 1, k), (k, k + 1)):
        if a >= 0 and b < len(found) and text[found[a][0].end : found[b][0].start] == "\n" and all(re.match(r"[#*]+\s", found[j][0].text) for j in (a, b)):
            return True
    return False


def clean(text: str, field: Field, found: list[tuple[Block, str]] | None = None) -> str:
    """Clean text with its structure.

    Headings begin with as many `#` as their level, list items with two blanks a depth and `- ` or `n. `, quotes with `> `; code
    stands between fences with its indentation and blank lines, cells of a table row are joined by ` | `, formulas stay
    as they are. One blank line stands between paragraphs and between parts of different kinds."""
    found = label(text, field) if found is None else found
    if all(x == "O" for _, x in found):
        return text
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[str] = []
    last: tuple[Block, str] | None = None
    fence, numbers = "", {}
    for k, (b, x) in enumerate(found):
        t, kind = b.text, "TEXT" if x in ("O", "INLINE") else x
        gap = text[last[0].end : b.start] if last else ""
        if x == "HEAD" and _numbered(text, found, k):
            kind = "LIST"
        if x == "DROP":
            continue
        if x == "CODE":
            if m := re.match(r"\s*(?:```+|~~~+)\s*([\w+#-]*)", t):
                fence = m[1]
                continue
            if re.match(r"\s*\\(?:begin|end)\{", t):
                continue
            t = html.unescape(re.sub(r"</?(?:pre|code)\b[^<>]*>", "", t)).rstrip()
        elif x == "FORMULA":
            t = _ENDS.sub("", t).strip()
            t = t if not t or re.match(r"\$|\\[\[(]", t) or re.search(r"\$$|\\[\])]$", t) else f"$${t}$$"
        elif x == "O":
            t = t.strip()
        else:
            sign = ""
            if x == "TABLE":
                if re.match(r"\s*(?:\{\||\|\}|\|-|\|?\s*:?-{2,})", t) or re.match(r"\s*\\(?:begin|end|hline|toprule|midrule|bottomrule)\b", t):
                    continue
                t = re.sub(r"^\|\+", "", t.strip())
                t = re.sub(r"\\\\\s*(?:\\hline)?\s*$", "", t)
                parts = re.split(r"(?<!\\)&(?!\w{2,8};)" if "tabular" in b.ancestors else r"\||!!", t.strip("|!"))
                t = " | ".join(c.strip() for c in parts if c.strip())
            elif kind == "LIST":
                if not _plain(_ENDS.sub("", t)):
                    continue
                depth, sign, t = _item(b, numbers, not (last and last[1] == "LIST"))
                sign = "  " * (depth - 1) + sign
            elif x == "HEAD":
                if re.match(r"(?:={3,}|-{3,})\s*$", t.strip()):
                    continue
                level, t = _head(b, found[k + 1][0] if k + 1 < len(found) else None)
                sign = "#" * level + " "
            elif x == "QUOTE":
                t, sign = re.sub(r"^\s*>\s?", "", t), "> "
            t = _plain(_ENDS.sub("", t))
            t = sign + t if t else ""
        if not t.strip():
            continue
        if last is None:
            glue = ""
        elif kind != last[1] or kind == "HEAD":
            glue = "\n\n"
        elif kind == "CODE":
            glue = "\n" * max(1, gap.count("\n"))
        elif kind == "TABLE":
            glue = " | " if _same_row(last[0], b, gap) else "\n"
        else:
            glue = "\n\n" if kind == "TEXT" and _APART.search(gap) else "\n"
        if last and last[1] == "CODE" and kind != "CODE":
            glue = "\n```" + glue
        if kind == "CODE" and not (last and last[1] == "CODE"):
            glue += f"```{fence}\n"
            fence = ""
        out.append(glue + t)
        last = (b, kind)
    return "".join(out) + ("\n```" if last and last[1] == "CODE" else "")


def _run(with_text: bool, field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kinds, texts = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = label(t, field)
                got = sorted({x for _, x in found} - {"O"})
                if got:
                    ids.append(k)
                    kinds.append(",".join(got))
                    if with_text:
                        texts.append(clean(t, field, found))
            cols = [pa.array(ids, pa.string()), pa.array(kinds, pa.string())] + ([pa.array(texts, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(cols, names=["id", "kinds", "text"][: len(cols)])

    return run


def markup_documents(documents: DataFrame, key: str = "id", content: str = "content", with_text: bool = False) -> DataFrame:
    """(id, kinds) of the documents with markup, kinds the labels found; with_text also (text), the clean text."""
    rows = documents.select(F.col(key).cast("string").alias("id"), F.col(content).alias("content")).filter("id is not null and content is not null and content <> ''")
    return rows.mapInArrow(_run(with_text, trained()), "id string, kinds string" + ", text string" * with_text)
