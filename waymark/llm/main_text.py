"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between the tags of block elements.
Features of a block are its ancestors' tags, the words of their classes and ids, and
traits of its text (length, share of links, sentences, marks). Buttons, choices and parts
of a line whose class or id labelled pages have only beside articles (an advert in a span)
are leaves of their own; what the field keeps of the line around them stays one block. The field is trained on
labelled pages (see labelled_pages.py, a bounded set) by stochastic gradients of the
likelihood; Viterbi decoding then labels all blocks of a page together.

Markup may be broken: unknown end tags are skipped, open elements end where their
parent does, buttons and choices without an end tag of their own hold nothing, a cut tag or
comment at the end is dropped. Text is skipped only in elements that hold no markup (scripts,
styles, text fields, titles, frames) and in templates. Null or empty pages and pages
without main blocks have the text "". Repeated rows are extracted alike; other columns
are kept, a column named like the result is replaced. Nothing of a text is cut.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
# Elements by the HTML standard: raw text, no content, part of a line, and those that a start tag of the key ends.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "br"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "button", "canvas", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "object", "option", "q", "s",
          "samp", "select", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "wbr", "img"}
# Parts of formulas and drawings.
INLINE |= {"mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mspace", "mtable", "mtr", "mtd", "semantics", "annotation"}
INLINE |= {"g", "path", "rect", "circle", "ellipse", "line", "polyline", "polygon", "defs", "use", "symbol", "text", "tspan", "textpath", "desc"}
CHOICES = {"button", "select"}  # leaves of their own whatever their class
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LENGTHS = (2, 10)


@dataclass
class Block:
    text: str
    features: list[str]
    gold: bool
    raw: str = ""
    continues: bool = False  # the line of the block before it goes on


@dataclass
class Element:
    tag: str
    names: tuple[str, ...] = ()
    gold: bool | None = None
    inline: bool = False
    inner: int = 0  # open elements of the same tag inside an inline one


def _element(tag: str, attributes: str) -> Element:
    names, gold = [], None
    if "=" in attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values)
            if key.lower() == "data-main":
                gold = value == "1"
            else:
                names += [x.lower() for x in NAME.findall(value)]
    return Element(tag, tuple(names), gold)


def _traits(text: str, linked: int) -> list[str]:
    words = text.split()
    length = sum(len(words) > n for n in LENGTHS)
    traits = [f"words={length}", f"links={0 if not linked else 1 + (10 * linked > 3 * len(text)) + (10 * linked > 7 * len(text))}", f"ends={words[-1][-1] in '.!?'}"]
    return traits + [f"mark={m}" for m in "©»·" if m in text]


def _line(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def _closed(tag: str, page: str, at: int) -> bool:
    """Whether an element that starts before the place has an end tag; choices hold no others of their kind."""
    found = re.compile(rf"<(/?){tag}\b", re.I).search(page, at) if tag in CHOICES else re.compile(rf"<(/){tag}\b", re.I).search(page, at)
    return found is not None and bool(found[1])


def blocks(page: str | None, beside: frozenset[str] = frozenset()) -> list[Block]:
    """The leaf blocks of a page in order; training labels come from data-main attributes.

    Parts of a line with a class or id in `beside` are blocks of their own.
    """
    page, out = page or "", []
    stack, text, linked, links, at, goes_on = [Element("#")], [], 0, 0, 0, False

    def close(within_line: bool = False) -> None:
        nonlocal linked, goes_on
        raw = "".join(text)
        joined = _line(raw)
        if joined:
            tags = dict.fromkeys(e.tag for e in stack[1:])
            names = dict.fromkeys(n for e in stack for n in e.names)
            gold = next((e.gold for e in reversed(stack) if e.gold is not None), False)
            out.append(Block(joined, [f"at={stack[-1].tag}", *[f"in={t}" for t in tags], *[f"name={n}" for n in names], *_traits(joined, linked)], gold, raw, goes_on))
        elif raw and goes_on and out:
            out[-1].raw += raw  # a blank between two parts of a line
        goes_on = within_line and (goes_on or bool(joined))
        text.clear()
        linked = 0

    while at < len(page):
        found = TOKEN.match(page, at)
        token, at = found[0], found.end()
        if token[0] != "<" or token == "<":
            text.append(token)
            linked += len(token) if links else 0
            continue
        if not (tag := (found[2] or "").lower()):
            if token.startswith("<![CDATA["):
                text.append(html.escape(token[9:].removesuffix("]]>")))
            continue
        if tag in INLINE:
            links = max(0, links + (-1 if found[1] else 1)) if tag == "a" else links
            own = next((e for e in reversed(stack) if e.inline and e.tag == tag), None)
            if found[1] and own is not None and own.inner:
                own.inner -= 1
            elif found[1] and own is not None:
                close(stack[-1] is own)
                while stack.pop() is not own:
                    pass
            elif not found[1] and tag not in VOID and not found[3].endswith("/"):
                element = _element(tag, found[3]) if tag in CHOICES or "=" in found[3] else None
                if element and (tag in CHOICES or not beside.isdisjoint(element.names)) and _closed(tag, page, at):
                    close(True)
                    element.inline = True
                    stack.append(element)
                elif own is not None:
                    own.inner += 1
        elif tag == "br":
            text.append(" ")
        elif found[1]:
            if any(e.tag == tag for e in stack):
                close()
                while stack.pop().tag != tag:
                    pass
                links = 0
        elif tag in RAW and not found[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag in ("textarea", "title"):
                text.append(" ")
        else:
            close()
            links = 0
            ends = ENDS.get(tag, set()) | {"p"}
            while len(stack) > 1 and stack[-1].tag in ends:
                stack.pop()
            if tag not in VOID and not found[3].endswith("/"):
                stack.append(_element(tag, found[3]))
    close()
    return out


def beside_names(pages: list[str]) -> frozenset[str]:
    """The class and id words that labelled pages have on what isn't the article, and nowhere on articles."""
    found: dict[bool, set[str]] = {False: set(), True: set()}
    for page in pages:
        for token in TOKEN.finditer(page):
            if token[2] and not token[1] and (element := _element(token[2].lower(), token[3])).gold is not None:
                found[element.gold].update(element.names)
    return frozenset(found[False] - found[True])


@dataclass
class Field:
    """Weights by feature for the two labels (0 other, 1 main), and of one label after another."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    gains: dict[str, float] = field(default_factory=dict)
    beside: frozenset[str] = frozenset()

    def scores(self, page: list[Block]) -> np.ndarray:
        none = np.zeros(2)
        return np.array([sum((self.weights.get(f, none) for f in b.features), none) for b in page])

    def decode(self, page: list[Block]) -> list[bool]:
        """The most likely labels of all blocks, by Viterbi."""
        if not page:
            return []
        # One number for each feature is enough: the weight for main less that for other.
        if len(self.gains) != len(self.weights):
            self.gains = {f: float(w[1] - w[0]) for f, w in self.weights.items()}
        gains, m = self.gains, self.moves.tolist()
        gain = [sum(gains.get(f, 0.0) for f in b.features) for b in page]
        other, main, back = float(self.start[0]), float(self.start[1]) + gain[0], []
        for g in gain[1:]:
            from_other, from_main = (m[1][0] + main > m[0][0] + other), (m[1][1] + main > m[0][1] + other)
            back.append((from_other, from_main))
            other, main = max(m[1][0] + main, m[0][0] + other), max(m[1][1] + main, m[0][1] + other) + g
        labels = [main > other]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]

    def expected(self, page: list[Block]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each block and expected counts of moves, by forward and backward sums."""
        score, n = self.scores(page), len(page)
        ahead, after = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = self.start + score[0]
        for i in range(1, n):
            ahead[i] = np.logaddexp(ahead[i - 1, 0] + self.moves[0], ahead[i - 1, 1] + self.moves[1]) + score[i]
        for i in range(n - 2, -1, -1):
            x = self.moves + score[i + 1] + after[i + 1]
            after[i] = np.logaddexp(x[:, 0], x[:, 1])
        total = np.logaddexp(*ahead[-1])
        moves = np.zeros((2, 2))
        if n > 1:
            x = ahead[:-1, :, None] + self.moves + (score + after)[1:, None, :] - total
            moves = np.exp(x).sum(0)
        return np.exp(ahead + after - total), moves


def train(pages: list[str], rounds: int = 6, rate: float = 0.4, decay: float = 1e-4, seed: int = 11) -> Field:
    """Fit a field to labelled pages by AdaGrad on the likelihood of one page at a time."""
    beside = beside_names(pages)
    data = [b for page in pages if (b := blocks(page, beside))]
    model, seen = Field(beside=beside), {}
    seen_moves, seen_start = np.full((2, 2), 1.0), np.ones(2)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for n in rng.permutation(len(data)):
            page = data[n]
            gold = np.array([int(b.gold) for b in page])
            chance, moves = model.expected(page)
            slope = np.eye(2)[gold] - chance
            for i, b in enumerate(page):
                for f in b.features:
                    w = model.weights.setdefault(f, np.zeros(2))
                    s = seen.setdefault(f, np.ones(2))
                    s += slope[i] ** 2
                    w += rate * (slope[i] - decay * w) / np.sqrt(s)
            held = np.zeros((2, 2))
            np.add.at(held, (gold[:-1], gold[1:]), 1)
            for w, s, g in ((model.moves, seen_moves, held - moves), (model.start, seen_start, slope[0])):
                s += g ** 2
                w += rate * g / np.sqrt(s)
    return model


def extract(page: str | None, model: Field) -> str:
    found, lines = blocks(page, model.beside), []
    for block, main in zip(found, model.decode(found)):
        if not block.continues:
            lines.append("")
        if main:
            lines[-1] += block.raw
        elif lines[-1]:
            lines[-1] += " "
    return "\n".join(x for x in map(_line, lines) if x)


def main_text(model: Field, page: Column) -> Column:
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extract(p, model) for p in pages], dtype="object")
    return text(page)


def extracted(pages: DataFrame, model: Field, page: str = "html", out: str = "text") -> DataFrame:
    """Add `out`, the main text."""
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() != out.lower()]
    return pages.select(*kept, main_text(model, F.col(f"`{page}`")).alias(out))
