"""A small HTML tree: tolerant building, selection, editing, text and serialising.

Tokens come from the standard library's tokenizer, so script and style contents
are opaque.  The builder knows void elements, implied end tags, and formatting
elements that are re-opened in the next block when a block closes over them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"table"}
_IMPLIED = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_RAW = frozenset(("script", "style"))


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Element | str] = []

    def add(self, child: Element | str) -> None:
        if isinstance(child, Element):
            child.parent = self
        self.children.append(child)

    def unwrap(self) -> None:
        up = self.parent
        at = next(i for i, c in enumerate(up.children) if c is self)
        for child in self.children:
            if isinstance(child, Element):
                child.parent = up
        up.children[at : at + 1] = self.children
        self.parent = None

    @property
    def filled(self) -> bool:
        """Whether there is anything inside but white space."""
        return any(isinstance(c, Element) or c.strip() for c in self.children)

    def walk(self) -> Iterator[Element]:
        """Elements below this one, in document order; a snapshot, so edits don't disturb it."""
        found, stack = [], [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            node = stack.pop()
            found.append(node)
            stack.extend(c for c in reversed(node.children) if isinstance(c, Element))
        return iter(found)

    def find(self, fits: Callable[[Element], bool] | str) -> Element | None:
        test = (lambda e: e.tag == fits) if isinstance(fits, str) else fits
        return next((e for e in self.walk() if test(e)), None)

    def text(self) -> str:
        parts, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.tag not in _RAW:
                stack.extend(reversed(node.children))
        return "".join(parts)

    def inner(self) -> str:
        return "".join(serialized(c, self.tag in _RAW) for c in self.children)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class Lengths:
    """Lengths of the stripped texts of all elements below a root, from one pass over it."""

    def __init__(self, root: Element):
        parts: list[str] = []
        at = 0
        self.spans: dict[int, tuple[int, int]] = {}
        stack: list[tuple[Element | str, bool]] = [(root, False)]
        while stack:
            node, done = stack.pop()
            if isinstance(node, str):
                parts.append(node)
                at += len(node)
            elif done:
                self.spans[id(node)] = (self.spans[id(node)][0], at)
            else:
                self.spans[id(node)] = (at, at)
                stack.append((node, True))
                if node.tag not in _RAW:
                    stack.extend((c, False) for c in reversed(node.children))
        text = "".join(parts)
        self.after, self.before = [len(text)] * (len(text) + 1), [-1] * (len(text) + 1)
        for i in range(len(text) - 1, -1, -1):
            self.after[i] = self.after[i + 1] if text[i].isspace() else i
        self.text, self.solid = text, [0] * (len(text) + 1)
        for i, ch in enumerate(text):
            self.before[i + 1] = self.before[i] if ch.isspace() else i
            self.solid[i + 1] = self.solid[i] + (not ch.isspace())

    def __getitem__(self, node: Element) -> int:
        lo, hi = self.spans[id(node)]
        return max(0, self.before[hi] - self.after[lo] + 1)

    def short(self, node: Element, most: int) -> str:
        """The element's text with white space squeezed if it has `most` characters at most, else nothing."""
        lo, hi = self.spans[id(node)]
        if not 0 < self.solid[hi] - self.solid[lo] <= most:
            return ""
        text = " ".join(self.text[lo:hi].split())
        return text if len(text) <= most else ""


def pruned(root: Element, gone: set[int]) -> None:
    """Take the marked elements out of the tree."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or id(c) not in gone]
        stack.extend(c for c in node.children if isinstance(c, Element))


def serialized(node: Element | str, raw: bool = False) -> str:
    if isinstance(node, str):
        return node if raw else html.escape(node, quote=False)
    attrs = "".join(f' {k}="{html.escape(v or "", quote=True)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" if node.tag in VOID else f"<{node.tag}{attrs}>{node.inner()}</{node.tag}>"


class _Builder(HTMLParser):
    """Open elements are counted by tag, so a look for what isn't open costs nothing however deep the nesting."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#root")
        self.open = [self.root]
        self.count: Counter[str] = Counter()
        self.there: set[int] = set()
        self.active: list[Element] = []

    def _enter(self, node: Element) -> None:
        self.open.append(node)
        self.count[node.tag] += 1
        self.there.add(id(node))

    def _close_to(self, at: int) -> None:
        for node in self.open[at:]:
            self.count[node.tag] -= 1
            self.there.discard(id(node))
        del self.open[at:]

    def _reopen(self) -> None:
        """Open formatting elements again that a closing block took with it."""
        for i, lost in enumerate(self.active):
            if id(lost) not in self.there:
                node = Element(lost.tag, lost.attrs)
                self.open[-1].add(node)
                self._enter(node)
                self.active[i] = node

    def _imply(self, closing: set[str], scope: set[str]) -> None:
        """Close the nearest open elements of the given kinds, within the scope."""
        while any(self.count[t] for t in closing):
            at = len(self.open) - 1
            while self.open[at].tag not in closing:
                if self.open[at].tag in scope:
                    return
                at -= 1
            self._close_to(at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named: dict[str, str] = {}
        for k, v in attrs:
            named.setdefault(k, v or "")
        if tag in _CLOSES_P:
            self._imply({"p"}, {"table", "td", "th"})
        if tag in _IMPLIED:
            self._imply(_IMPLIED[tag], _SCOPE[tag])
        if tag not in BLOCK:
            self._reopen()
        node = Element(tag, named)
        self.open[-1].add(node)
        if tag not in VOID:
            self._enter(node)
            if tag in FORMATTING:
                alike = [e for e in self.active if e.tag == tag and e.attrs == named]
                if len(alike) == 3:  # more are never re-opened
                    self.active = [e for e in self.active if e is not alike[0]]
                self.active.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.open[-1].tag == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in FORMATTING:
            last = next((i for i in range(len(self.active) - 1, -1, -1) if self.active[i].tag == tag), None)
            if last is not None:
                del self.active[last]
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._close_to(at)
                return
            if self.open[at].tag in ("td", "th", "table") and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in _RAW and data.strip():
            self._reopen()
        self.open[-1].add(data)


def parse(text: str | None) -> Element:
    builder = _Builder()
    builder.feed(text or "")
    builder.close()
    return builder.root


def selector(text: str) -> Callable[[Element], bool]:
    """#id, .class or a tag name."""
    if text.startswith("#"):
        return lambda e: e.attrs.get("id") == text[1:]
    if text.startswith("."):
        return lambda e: text[1:] in e.classes()
    return lambda e: e.tag == text


_DECLARATION = re.compile(r"\s*([^:;]*?)\s*:\s*([^;]*?)\s*(?:;|\Z)")


def style_value(node: Element, name: str) -> str:
    """The last non-empty declaration of a property in a style attribute."""
    found = ""
    for piece in (node.attrs.get("style") or "").split(";"):
        key, colon, value = piece.partition(":")
        if colon and key.strip() == name and value.strip():
            found = value.strip()
    return found


def visible(node: Element) -> bool:
    return (
        style_value(node, "display") != "none" and style_value(node, "visibility") != "hidden" and "hidden" not in node.attrs
        and (node.attrs.get("aria-hidden") != "true" or "fallback-image" in (node.attrs.get("class") or ""))
    )
