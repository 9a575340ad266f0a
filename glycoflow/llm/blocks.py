"""Leaf blocks of a web page: stretches of text between the tags that start or end a block, with their ancestors.

A small tokenizer reads tags, comments and the raw text of scripts and styles; a stack of open elements follows the usual
rules for what a tag closes by itself. It never fails: what is not markup is text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Elements whose content is not text of the page, that never hold content, and that do not end a block.
RAW = ("script", "style", "template", "noscript", "svg", "math", "iframe", "object", "audio", "video", "canvas")
HEAD = ("title", "textarea", "option", "select")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "picture", "q", "rp", "rt", "ruby", "s", "samp", "small", "source", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: What the start of an element closes, up to the nearest of the elements that stop the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
PARTS = {"article", "aside", "dialog", "fieldset", "footer", "form", "header", "main", "nav", "section", "td"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WHITE = re.compile(r"[ \t\n\r\f\v]+")
_RAW = "|".join(RAW)
#: The rest of a tag: a value in quotes may hold what else would end it, and one without its second quote ends the page.
_REST = r"""(?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+(?:>|\Z)"""
TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*)|<(?P<raw>{_RAW})\b{_REST}.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>{_REST})|[^<]+|<",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-zA-Z]{2,}")


@dataclass
class Block:
    """Text of a block and what is around it: its own tag, all tags above, words of their names, those of the nearest named
    element and the tag of the nearest part of the page, and characters in links."""

    text: str
    tag: str
    above: frozenset[str]
    names: frozenset[str]
    nearest: frozenset[str] = frozenset()
    part: str = ""
    linked: int = 0
    bold: bool = False


@dataclass
class _Open:
    """An open element; tags and names are those of the elements around it, too."""

    tag: str
    tags: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset()
    nearest: frozenset[str] = frozenset()
    part: str = ""


def _with(have: frozenset[str], more: set[str]) -> frozenset[str]:
    return have if more <= have else have | more


def blocks(page: str) -> list[Block]:
    """Blocks with a character that is not white space, in page order; references are decoded, white space is one space."""
    out: list[Block] = []
    root = _Open("")
    stack: list[_Open] = [root]
    n_open: Counter[str] = Counter()
    pieces: list[str] = []
    linked = 0
    in_link = bold = False

    def ended() -> None:
        nonlocal linked, bold
        if pieces:
            text = WHITE.sub(" ", html.unescape("".join(pieces))).strip(" ")
            if text:
                here = stack[-1]
                out.append(Block(text, here.tag, here.tags, here.names, here.nearest, here.part, min(linked, len(text)), bold))
            pieces.clear()
        linked = 0
        bold = False

    def close(tags: set[str], stops: set[str]) -> None:
        """Close the nearest element of these, with what is open in it."""
        if not any(n_open[t] for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                n_open.subtract(o.tag for o in stack[depth:])
                del stack[depth:]
                return
            if stack[depth].tag in stops:
                return

    for token in TOKEN.finditer(page):
        tag = token["tag"]
        if tag is None:
            said = token[0]
            if said[0] == "<" and len(said) > 1:
                continue
            if stack[-1].tag not in HEAD:
                pieces.append(said)
                if in_link:
                    linked += len(said)
            continue
        tag = tag.lower()
        end = token["end"] == "/"
        if tag in INLINE:
            if tag == "a":
                in_link = not end
            elif tag == "br":
                pieces.append(" ")
            elif tag in ("b", "strong") and not end:
                bold = True
            continue
        ended()
        in_link = False
        if end:
            close(HEADINGS if tag in HEADINGS else {tag}, set())
            continue
        if tag in VOID:
            continue
        # Any block element closes an open paragraph.
        if stack[-1].tag == "p":
            n_open["p"] -= 1
            stack.pop()
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            close(HEADINGS, set())
        if tag in CLOSES:
            close(*CLOSES[tag])
        words = {w.lower() for value in NAMES.findall(token["attributes"]) for w in WORD.findall(value)} if "=" in token["attributes"] else set()
        around = stack[-1]
        nearest, part = frozenset(words) or around.nearest, tag if tag in PARTS else around.part
        stack.append(_Open(tag, _with(around.tags, {tag}), _with(around.names, words), nearest, part))
        n_open[tag] += 1
    ended()
    return out
