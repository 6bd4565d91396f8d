"""Block trees of HTML pages, and their alignment by simple tree matching."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed values of HTML: elements that start a block of their own, that never have an end tag, whose content is not markup.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: An element's start tag ends an open element of these, up to the nearest of STOP.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
}
STOP = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
#: What is not the article, by element.
OUTSIDE = frozenset("head nav footer aside form script style noscript template iframe svg math button select textarea title menu dialog object canvas audio video datalist noembed noframes".split())
#: What is not the article, by a word of class, id or role.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs toolbar footer masthead comment comments commentlist respond reply replies disqus share sharing social"
    " related recommended recommendations newsletter subscribe signup popup modal overlay widget widgets pagination pager contentinfo complementary search form dialog skip".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset({"article", "main"})

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|<[a-zA-Z/!?][^>]*+\Z""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?(?=[\s/]|$)""", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
#: Elements that can hold an article; text stands in the others.
CONTAINERS = frozenset("html body div section article main center td table tbody tr blockquote fieldset details form nav aside header footer".split())
#: Deeper elements are parsed, but not aligned: they belong to the deepest element above them that is.
MOST_DEPTH = 150


@dataclass
class Node:
    tag: str
    label: str
    parent: Node | None
    depth: int = 0
    outside: bool = False
    main: bool = False
    header: bool = False  # in a header inside the article
    children: list[Node] = field(default_factory=list)
    slot: int = -1

    @property
    def key(self) -> str:
        """What makes neighbours one run: the label, and for elements of no meaning whether they hold others."""
        return self.label if self.children or self.tag not in ("div", "section") else self.label + " "

    def at(self) -> int:
        """The slot of this element, or of the nearest one above it that was matched."""
        n = self
        while n.slot < 0 and n.parent:
            n = n.parent
        return n.slot


@dataclass
class Page:
    root: Node
    blocks: list[tuple[Node, str]]  # text of a block and the element that it stands in, in page order


def _attributes(raw: str) -> tuple[str, set[str], bool]:
    """The label's part, the words of class, id and role, and whether the element is hidden."""
    if not raw or not raw.strip():
        return "", set(), False
    label, words, hidden = "", set(), False
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= bool(_HIDING.search(value))
        else:
            words.update(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            label += f".{value}" if name == "class" else ""
    return label, words, hidden


def parse(source: str | None) -> Page:
    """The tree of block elements and the text blocks of a page, however broken its markup."""
    root = Node("#root", "#root", None)
    node, blocks, text, inline_outside = root, [], [], []

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                blocks.append((node, joined))

    source = source or ""
    at = 0
    while at < len(source):
        m = _TAG.search(source, at)
        stop = m.start() if m else len(source)
        if stop > at and not inline_outside:
            text.append(html.unescape(source[at:stop]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if tag in BLOCK or (tag in OUTSIDE and tag not in RAW):
                if tag in inline_outside:
                    del inline_outside[inline_outside.index(tag) :]
                    continue
                n = node
                while n.parent and n.tag != tag:
                    n = n.parent
                if n.parent:
                    flush()
                    node = n.parent
            continue
        if tag in RAW:
            end = _ENDS[tag].search(source, at)
            at = end.start() if end else len(source)
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in BLOCK:
            if tag in OUTSIDE and tag not in VOID and not (m[0].endswith("/>")):
                if tag == "head":
                    continue
                inline_outside.append(tag)
            continue
        flush()
        if tag == "hr":
            continue
        # implied ends
        closes, stops = CLOSES.get(tag), STOP.get(tag, {"table"})
        n, cut = node, None
        while n.parent:
            if closes and n.tag in closes:
                cut = n
            elif n.tag == "p" and not closes:
                cut = n
                break
            if n.tag in (stops if closes else MAIN | {"body", "div", "section", "td", "th", "li", "table", "form", "nav", "aside", "footer", "header"}):
                break
            n = n.parent
        if cut:
            node = cut.parent
        if tag in ("html", "body") and any(c.tag == tag for c in (node, *node.children)):
            continue
        label, words, hidden = _attributes(m[3] or m[6] or "")
        keeps = tag in ("html", "body", *MAIN)
        header = not keeps and (tag == "header" or "header" in words)
        own = hidden or tag in OUTSIDE or (not keeps and bool(words & OUTSIDE_WORDS)) or (header and not node.main)
        child = Node(tag, tag + label, node, node.depth + 1, node.outside or own, node.main or tag in MAIN or "main" in words and tag in ("div", "section"), node.header or header)
        node.children.append(child)
        node = child
    flush()
    return Page(root, blocks)


def fold(node: Node) -> list[tuple[str, list[Node]]]:
    """node's children with runs of one key as one: the key and its elements."""
    out: list[tuple[str, list[Node]]] = []
    for c in node.children if node.depth < MOST_DEPTH else ():
        if out and out[-1][0] == c.key:
            out[-1][1].append(c)
        else:
            out.append((c.key, [c]))
    return out


def runs_of(nodes: list[Node]) -> list[tuple[str, list[Node]]]:
    """The folded children of a run of elements, those of one key together."""
    if len(nodes) == 1:
        return fold(nodes[0])
    merged: dict[str, list[Node]] = {}
    for n in nodes:
        for name, run in fold(n):
            merged.setdefault(name, []).extend(run)
    return list(merged.items())


class Template:
    """The folded tree of a reference page. Its nodes are slots, numbered so that a subtree is a range of numbers."""

    def __init__(self, labels: list[str], children: list[list[int]]):
        self.labels, self.children = labels, children

    @staticmethod
    def of(page: Page) -> Template:
        out = Template([], [])
        out._add("#root", [page.root])
        return out

    def _add(self, label: str, nodes: list[Node]) -> int:
        me = len(self.labels)
        self.labels.append(label)
        self.children.append([])
        self.children[me] = [self._add(name, run) for name, run in runs_of(nodes)]
        return me

    def regions(self) -> list[tuple[int, int, int, bool]]:
        """(slot, end, depth, whole) of each container: its subtree is slot to end - 1; whole: the page or its body.

        Nothing inside an article or main element is listed, as such an element is an article by its name.
        """
        out = []

        def walk(slot: int, depth: int, inside: bool) -> int:
            tag = self.labels[slot].strip().split(".")[0]
            place = None
            if not inside and (slot == 0 or tag in CONTAINERS):
                place = len(out)
                out.append((slot, 0, depth, slot == 0 or tag in ("html", "body")))
            end = slot + 1
            for k in self.children[slot]:
                end = walk(k, depth + 1, inside or tag in MAIN)
            if place is not None:
                out[place] = (slot, end, depth, out[place][3])
            return end

        walk(0, 0, False)
        return out

    def align(self, page: Page) -> int:
        """Write into each matched element of the page the slot that simple tree matching gives it; how many matched."""
        memo: dict[tuple[int, int], tuple[int, list]] = {}

        def weight(slot: int, nodes: list[Node]) -> int:
            if (slot, id(nodes[0])) in memo:
                return memo[slot, id(nodes[0])][0]
            runs, kids = runs_of(nodes), self.children[slot]
            table = [[0] * (len(runs) + 1) for _ in range(len(kids) + 1)]
            for i, k in enumerate(kids, 1):
                for j, (name, run) in enumerate(runs, 1):
                    best = max(table[i - 1][j], table[i][j - 1])
                    if self.labels[k] == name:
                        best = max(best, table[i - 1][j - 1] + weight(k, run))
                    table[i][j] = best
            pairs, i, j = [], len(kids), len(runs)
            while i and j:
                if self.labels[kids[i - 1]] == runs[j - 1][0] and table[i][j] == table[i - 1][j - 1] + weight(kids[i - 1], runs[j - 1][1]):
                    pairs.append((kids[i - 1], runs[j - 1][1]))
                    i, j = i - 1, j - 1
                elif table[i][j] == table[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
            memo[slot, id(nodes[0])] = (table[-1][-1] + 1, pairs)
            return table[-1][-1] + 1

        matched = weight(0, [page.root])
        todo = [(0, [page.root])]
        while todo:
            slot, nodes = todo.pop()
            for n in nodes:
                n.slot = slot
            todo += memo[slot, id(nodes[0])][1]
        return matched
