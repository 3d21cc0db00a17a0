"""Pages as trees of blocks and runs of text, and numbers that describe each node."""

from __future__ import annotations

import functools
import html as entities
import re
from dataclasses import dataclass, field

import numpy as np

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>|[!?/][^>]*>)", re.S)
ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""", re.I)
TOKEN = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")

#: Elements that begin a block, by kind.
KINDS = {
    "article": "article main", "navigation": "nav menu", "header": "header hgroup", "footer": "footer", "aside": "aside dialog", "form": "form fieldset legend search",
    "section": "section details summary", "div": "div center address", "paragraph": "p", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl dir", "item": "li dt dd",
    "table": "table thead tbody tfoot tr td th caption", "quote": "blockquote pre figure figcaption",
}
KIND = {tag: i for i, tags in enumerate(KINDS.values()) for tag in tags.split()}
BLOCKS = frozenset(KIND) | {"hr"}
#: What an attribute's word, or an element's name, says about its role.
ROLES = {
    "navigation": "nav navigation navbar menu breadcrumb breadcrumbs crumbs toc pagination pager skip tabs", "header": "header masthead banner topbar logo brand site",
    "footer": "footer foot copyright colophon legal imprint bottom", "side": "aside sidebar side rail widget complementary secondary", "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog toast banner paywall warning", "form": "form newsletter subscribe signup login search register contact input",
    "comment": "comment comments disqus reply replies respond discussion reader feedback", "more": "share sharing social related recommended recommendations more popular trending tags tag meta byline",
    "content": "article content post entry story main body text articlebody maincontent prose hentry", "hidden": "hidden invisible screenreader sr",
}
ROLE_BITS: dict[str, int] = {}
for _i, _words in enumerate(ROLES.values()):
    for _word in _words.split():
        ROLE_BITS[_word] = ROLE_BITS.get(_word, 0) | 1 << _i
TAG_BITS = {tag: ROLE_BITS.get(tag, 0) for tag in BLOCKS} | {"p": 0, "body": 0}

#: Left out with all they hold. An end tag is looked for; without one, the first kind takes the rest of the page, and the second only its start tag.
RAW = {"script", "style"}
SKIPPED = {"title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "object", "canvas", "audio", "video", "button", "select", "datalist"}
END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW | SKIPPED}
#: A start tag of the first closes an open one of the second, up to the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
HEADINGS = frozenset(KINDS["heading"].split())


@functools.lru_cache(1 << 14)
def told_roles(attributes: str) -> tuple[int, str]:
    """The roles that id, class and role name, and the value of data-keep (given in training pages)."""
    bits, keep = 0, ""
    for name, *values, hidden in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if hidden or name.lower() == "style" and re.search(r"display\s*:\s*none", value, re.I):
            bits |= ROLE_BITS["hidden"]
        elif name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            for word in TOKEN.findall(value):
                bits |= ROLE_BITS.get(word.lower(), 0)
        elif name.lower() == "data-keep":
            keep = value
    return bits, keep


@dataclass
class Nodes:
    """Nodes of some pages in page order; a page's first node is its root. Runs of text are the leaves."""

    parent: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    inherited: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)

    def add(self, parent: int, kind: int, own: int, inherited: int, depth: int, text: str | None, linked: int, keep: str) -> int:
        for values, value in zip((self.parent, self.kind, self.own, self.inherited, self.depth, self.text, self.linked, self.keep), (parent, kind, own, inherited, depth, text, linked, keep)):
            values.append(value)
        return len(self.parent) - 1

    def read(self, page: str) -> None:
        """Add a page's nodes."""
        root = self.add(len(self.parent), -1, 0, 0, 0, None, 0, "")
        self.roots.append(root)
        stack, open_tags, pieces, at, link, linked = [(root, "")], {}, [], 0, 0, 0

        def end_run() -> None:
            nonlocal linked
            text = " ".join("".join(pieces).split())
            if text:
                above = stack[-1][0]
                self.add(above, self.kind[above], self.own[above], self.inherited[above] | self.own[above], self.depth[above] + 1, text, min(linked, len(text)), self.keep[above])
            pieces.clear()
            linked = 0

        def close() -> None:
            nonlocal link
            node, tag = stack.pop()
            open_tags[tag] -= 1
            link = 0 if link > len(stack) else link

        def say(piece: str) -> None:
            nonlocal linked
            piece = entities.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            linked += len(piece) if link else 0

        while found := TAG.search(page, at):
            if found.start() > at:
                say(page[at : found.start()])
            at = found.end()
            if not (tag := found[2]):
                continue
            tag = tag.lower()
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                link = 0 if found[1] else len(stack)
            elif tag in END and not found[1]:
                if end := END[tag].search(page, at):
                    at = end.end()
                elif tag in RAW:
                    at = len(page)
            elif tag in BLOCKS:
                end_run()
                if found[1]:
                    if open_tags.get(tag):
                        while stack[-1][1] != tag:
                            close()
                        close()
                    continue
                if stack[-1][1] == "p" or tag in HEADINGS and stack[-1][1] in HEADINGS:
                    close()
                if tag == "hr":
                    continue
                closed, bound = CLOSES.get(tag, ((), ()))
                if any(map(open_tags.get, closed)):
                    place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][1] in closed or stack[i][1] in bound), 0)
                    if stack[place][1] in closed:
                        while len(stack) > place:
                            close()
                above = stack[-1][0]
                bits, keep = told_roles(found[3]) if found[3] else (0, "")
                stack.append((self.add(above, KIND[tag], bits | TAG_BITS[tag], self.inherited[above] | self.own[above], self.depth[above] + 1, None, 0, keep or self.keep[above]), tag))
                open_tags[tag] = open_tags.get(tag, 0) + 1
            elif tag in ("body", "html", "head"):
                end_run()
        if at < len(page):
            say(page[at:])
        end_run()


def by_parent(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[end] - total[first]


def described(nodes: Nodes) -> np.ndarray:
    """A row of numbers for each node: density of its subtree, words of its attributes and of those above, depth, place, and what its siblings are like."""
    n = len(nodes.parent)
    parent, depth, kind = np.array(nodes.parent), np.array(nodes.depth), np.array(nodes.kind)
    order = np.arange(n)
    end = order + 1
    for i in range(n - 1, -1, -1):
        p = nodes.parent[i]
        if end[i] > end[p]:
            end[p] = end[i]
    leaf = np.array([t is not None for t in nodes.text])
    texts = [t or "" for t in nodes.text]
    chars, linked = np.array([len(t) for t in texts], float), np.array(nodes.linked, float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts], float)
    commas = np.array([t.count(",") for t in texts], float)
    stops = np.array([t.count(". ") + t.count("! ") + t.count("? ") + t.endswith((".", "!", "?")) for t in texts], float)
    C, L, W, P, S, K, T = (by_parent(x, order, end) for x in (chars, linked, words, commas, stops, leaf.astype(float), np.ones(n)))
    paragraphs = by_parent((leaf & (kind == KIND["p"])).astype(float), order, end)
    root = np.repeat(nodes.roots, np.diff([*nodes.roots, n]))
    before = np.concatenate([[0], np.cumsum(chars)])[order]
    before, whole = before - before[root], np.maximum(C[root], 1)

    siblings = np.lexsort((order, parent))
    siblings = siblings[parent[siblings] != siblings]
    groups = parent[siblings]
    new = np.concatenate([[True], groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count, number = np.ones(n), np.zeros(n)
    previous, following, alike, mean = np.full(n, -1), np.full(n, -1), np.ones(n), C.copy()
    if len(at):
        size = np.diff([*at, len(siblings)])
        group = np.cumsum(new) - 1
        count[siblings], number[siblings] = size[group], np.arange(len(siblings)) - at[group]
        same = ~new[1:]
        previous[siblings[1:][same]], following[siblings[:-1][same]] = siblings[:-1][same], siblings[1:][same]
        mean[siblings] = np.add.reduceat(C[siblings], at)[group] / size[group]
        pairs, inverse = np.unique(group * 64 + kind[siblings], return_inverse=True)
        alike[siblings] = np.bincount(inverse, minlength=len(pairs))[inverse] / size[group]
    there = lambda x, other: np.where(other >= 0, x[other], -1)
    density = L / np.maximum(C, 1)
    own, inherited = np.array(nodes.own), np.array(nodes.inherited)
    bits = np.arange(len(ROLES))
    columns = [
        depth, np.log1p(C), density, C / T, W / np.maximum(K, 1), S / np.maximum(W, 1), P / np.maximum(W, 1), C / whole, before / whole, (before + C) / whole, number / count, np.log1p(count),
        alike, np.log1p(mean), np.log1p(there(C, previous) + 1), np.log1p(there(C, following) + 1), there(density, previous), there(density, following), np.log1p(C[parent]), density[parent], C / np.maximum(C[parent], 1),
        paragraphs / np.maximum(K, 1), leaf, np.log1p(T), S / np.maximum(K, 1),
    ]
    return np.column_stack([*columns, *(kind == k for k in range(len(KINDS))), own[:, None] >> bits & 1, inherited[:, None] >> bits & 1]).astype(np.float32)
