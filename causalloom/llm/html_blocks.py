"""Leaf blocks of HTML pages: text runs between block tags, each with its path of open tags."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
HIDDEN = frozenset("script style head title noscript template iframe svg math noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An opening tag closes an open element of the same group, up to the nearest of the stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
TAG_NAME = re.compile(r"[^\s/>]+")
SCOPE = frozenset("article aside body div footer form header main nav section table td th ul ol li".split())

#: Tags are cut by the states of HTML attributes: a quote opens a value only right after "=". All repeats are possessive, so no page takes more than linear time here.
ATTRIBUTES = r"""(?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|=)*+"""
MARKUP = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</?[A-Za-z][^\s/>]*+{ATTRIBUTES}(?:>|\Z)|</[^A-Za-z][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
NAMING = frozenset("class id role itemprop aria-label".split())
CONCEALED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Cells of the hashed path vector.
PATH_CELLS = 256


@dataclass(slots=True)
class Block:
    """A leaf: its text, the hashed tags and name words of its ancestors as bits, the number of ancestors, and its length inside links."""

    text: str
    path: int
    depth: int
    linked: int


def bit(word: str) -> int:
    return 1 << zlib.crc32(word.encode()) % PATH_CELLS


@lru_cache(maxsize=20_000)
def _step(tag: str, attributes: str) -> tuple[int, bool]:
    """A tag's bits, for its name and the words of its class, id and role, and whether it hides what it holds."""
    bits, hides = bit(tag), tag in HIDDEN
    if attributes.strip(" /"):
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in NAMING:
                for x in NAME_PARTS.findall(a or b or c):
                    bits |= bit(f".{x.lower()}")
            elif name == "hidden" or name == "style" and CONCEALED.search(a or b or c) or name == "aria-hidden" and (a or b or c).lower() == "true" and tag not in INLINE:
                hides = True
    return bits, hides


@dataclass(slots=True)
class _Open:
    """An open element: its tag, the bits of it and all its ancestors, and whether it hides what it holds."""

    tag: str
    path: int
    hides: bool


class _Page:
    """The open elements of a page that is being read, and the leaves found so far."""

    def __init__(self):
        self.out: list[Block] = []
        self.stack: list[_Open] = []
        self.count: dict[str, int] = {}
        self.held: list[str] = []
        self.linked = self.hidden = 0

    def text(self, run: str) -> None:
        self.held.append(run)
        if self.count.get("a"):
            self.linked += len(run)

    def flush(self) -> None:
        """What is held becomes a leaf."""
        if self.held:
            text = SPACE.sub(" ", html.unescape("".join(self.held))).strip()
            if text and not self.hidden:
                top = next((x for x in reversed(self.stack) if x.tag not in INLINE), None)
                path = (self.stack[-1].path if self.stack else 0) | bit(f"last:{top.tag if top else ''}")
                self.out.append(Block(text, path, len(self.stack), min(self.linked, len(text))))
            self.held.clear()
        self.linked = 0

    def open(self, tag: str, attributes: str) -> None:
        bits, hides = _step(tag, attributes)
        self.stack.append(_Open(tag, bits | (self.stack[-1].path if self.stack else 0), hides))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.hidden += hides

    def close(self, depth: int) -> None:
        """Close the elements from this depth on."""
        gone = self.stack[depth:]
        if any(x.tag not in INLINE or x.hides for x in gone):
            self.flush()
        for x in gone:
            self.count[x.tag] -= 1
            self.hidden -= x.hides
        del self.stack[depth:]

    def close_nearest(self, tags: frozenset | set, stops: frozenset | set) -> None:
        """Close the nearest open element of these tags, unless one of the stops is nearer. Where none is open nothing is searched."""
        if any(self.count.get(t) for t in tags):
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth].tag in tags:
                    self.close(depth)
                    return
                if self.stack[depth].tag in stops:
                    return

    def end(self, tag: str) -> None:
        """An end tag: closes the nearest element of its name; an inline one reaches no further than the nearest block."""
        if tag == "br":
            self.held.append(" ")
        elif tag == "p" and not self.count.get("p"):
            self.flush()
        elif self.count.get(tag):
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth].tag == tag:
                    self.close(depth)
                    return
                if tag in INLINE and self.stack[depth].tag not in INLINE:
                    return

    def begin(self, tag: str, attributes: str) -> None:
        """A start tag."""
        if tag in ("br", "wbr", "img"):
            self.held.append(" " * (tag == "br"))
            return
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_P:
                self.close_nearest({"p"}, SCOPE)
            if tag in IMPLIED:
                self.close_nearest(*IMPLIED[tag])
            if tag == "body" and self.count.get("head"):
                self.close(next(d for d, x in enumerate(self.stack) if x.tag == "head"))
        elif _step(tag, attributes)[1]:
            self.flush()  # a hidden part inside a line ends what stands before it
        if tag not in VOID:
            self.open(tag, attributes)


def blocks(page: str | None) -> list[Block]:
    """The leaves of a page in order, white space inside each one space, ends trimmed, empty ones left out.

    Comments, doctypes, scripts, styles and elements that are hidden (by their kind, the
    attribute hidden, or a style without display) have no leaves. Inline tags and line
    breaks don't end a leaf. A quote in a tag opens a value only after "=", as in browsers;
    any other is part of a name. Tags that are open at the page's end count as closed;
    markup that the end cuts off is dropped. Null pages have no leaves. Time is linear in
    the page for nested elements of any depth.
    """
    page = page or ""
    state = _Page()
    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            state.text(page[at:stop])
        if not m:
            break
        token, at = m[0], m.end()
        if token[1] in "!?" or token[1:2] == "/" and not token[2:3].isalpha():
            continue
        if token[-1] != ">":
            break  # the page ends inside a tag
        closing = token[1] == "/"
        name = TAG_NAME.match(token, 1 + closing)[0]
        tag, attributes = name.lower(), token[1 + closing + len(name) : -1]
        if closing:
            state.end(tag)
        elif tag in RAW:
            state.flush()
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            inner, at = page[at : over.start() if over else end], over.start() if over else end
            if tag == "textarea":
                state.open(tag, attributes)
                state.text(inner)
                state.close(len(state.stack) - 1)
            close_tag = MARKUP.match(page, at)
            at = close_tag.end() if close_tag else end
        else:
            state.begin(tag, attributes)
    state.flush()
    return state.out
