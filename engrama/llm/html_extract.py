"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements and the text blocks in them are the nodes of a tree; each is content or not. A node's potential comes
from its own features (tag, hints in class and id, length, link density, marks), a parent-child potential from how
labels go together along an edge to such a tag. Both are estimated from labelled pages. Sum-product messages pass from
the leaves to the root and back, exactly, and give each text block's marginal probability of being content.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without
from .html_samples import labelled_pages

#: A tag's name and attributes up to its end; a quote matters only after an equals sign, and only if it is closed.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: References to numbers that are far beyond any character.
_BEYOND = re.compile(r"&#(?:[0-9]{300,}|[xX][0-9a-fA-F]{300,});?")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-label|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
#: Elements whose text is never shown or never prose.
SKIPPED = frozenset("script style noscript template head svg math iframe object select textarea button canvas audio video map datalist".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body article section main nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot caption tr td th blockquote pre form fieldset legend figure figcaption address details summary dialog center menu hgroup search".split())
#: What an opening tag closes first, and what that search doesn't leave.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_MARKS = frozenset("| / > - · • » « : , –".split())
#: Words in class, id and role, by what they say.
HINTS = {
    "good": "article content post entry story main body text prose page copy",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pager pagination toc sitemap skip tabs",
    "head": "header masthead topbar top logo brand hero",
    "foot": "footer bottom copyright legal colophon imprint",
    "side": "sidebar side aside widget rail related recommended popular trending teaser more tags",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner dfp commercial",
    "note": "cookie cookies consent gdpr notice notification alert popup modal overlay paywall privacy message toast disclaimer",
    "talk": "comment comments reply replies discussion discuss respond disqus thread feedback reactions guestbook",
    "form": "form login signin signup register subscribe subscription newsletter search contact share social follow",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}


class Node:
    __slots__ = ("parent", "tag", "hints", "under", "words", "linked", "stops", "text", "kids")

    def __init__(self, parent: int, tag: str, hints: tuple):
        self.parent, self.tag, self.hints = parent, tag, hints
        self.under: tuple = ()  # the hints of the nearest ancestor that has any
        self.words = self.linked = self.stops = self.kids = 0
        self.text: str | None = None


def _hints(attrs: str) -> tuple[tuple, bool]:
    kinds, hidden = set(), False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), html.unescape(a or b or c)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(_HIDDEN.search(value))
        else:
            kinds.update(_HINT[w] for w in map(str.lower, _PART.findall(value)) if w in _HINT)
    return tuple(sorted(kinds)), hidden


class _Scanner:
    """Splits a page into texts and tags, moving forward only: the work is in proportion to the page, broken or not."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = True  # whether a > within quotes doesn't end a tag
        self.ends = {"-->": True, "]]>": True}  # whether there may be one more

    def find(self, mark: str, at: int) -> int:
        k = self.page.find(mark, at) if self.ends[mark] else -1
        self.ends[mark] = k >= 0
        return k

    def skip(self, at: int) -> tuple[int, str, re.Match | None] | None:
        """What begins at the < at this place: (where it ends, text it holds, tag); None where it is a mere sign."""
        page = self.page
        if page.startswith("<!--", at):
            k = self.find("-->", at + 4)
            return (k + 3 if k >= 0 else len(page)), "", None
        if page.startswith("<![CDATA[", at) and (k := self.find("]]>", at)) >= 0:
            return k + 3, page[at + 9 : k], None
        if at > self.last:
            return None
        if page.startswith(("<!", "<?"), at):
            return page.index(">", at) + 1, "", None
        m = _TAG.match(page, at) if self.quotes else None
        if not m and page[at + 1 : at + 3].lstrip("/")[:1].isascii() and page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
            self.quotes = False  # every > is in some quotes: from here on quotes don't count
            m = _PLAIN_TAG.match(page, at, page.index(">", at) + 1)
        return (m.end(), "", m) if m else None


def parse(page: str) -> list[Node]:
    """The page's block elements and text blocks, parents first; text blocks have the tag #."""
    nodes = [Node(-1, "root", ())]
    stack: list[tuple[str, int, bool]] = [("root", 0, False)]  # tag, node of the nearest block, whether unseen
    buffer: list[str] = []
    linked, links, at, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        words = "".join(buffer).split()
        buffer.clear()
        if words:
            n = Node(stack[-1][1], "#", ())
            if linked:  # marks between links go with them
                linked += sum(w in _MARKS for w in words)
            n.text, n.words, n.linked = " ".join(words), len(words), min(linked, len(words))
            n.stops = sum(w[-1] in ".!?:;" for w in words)
            nodes.append(n)
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][2]:
            raw = html.unescape(_BEYOND.sub("\ufffd", raw))
            buffer.append(raw)
            if links:
                linked += len(raw.split())

    def cut(k: int) -> None:
        """Close all elements from the k-th of the stack on."""
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    def push(tag: str, node: int, unseen: bool) -> None:
        places[tag].append(len(stack))
        stack.append((tag, node, unseen))

    def top(tags: set) -> int:
        """The place of the innermost open element with such a tag."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag
    scanner = _Scanner(page)
    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        text(page[at:begin])
        found = scanner.skip(begin)
        if not found:
            text("<")
            at = begin + 1
            continue
        at, plain, m = found
        text(plain)
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif places[tag]:
                flush()
                cut(places[tag][-1])
            elif tag in BLOCKS:
                flush()
            continue
        attrs = m[3]
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input"):
                text(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s>/]", re.I).search(page, at)
            stop = close.start() if close else end
            if tag not in SKIPPED and tag != "title":
                text(page[at:stop])
            at = page.find(">", stop) + 1 or end
            continue
        if tag == "a":
            links += 0 if attrs.endswith("/") and "href" not in attrs.lower() else 1
            continue
        if tag in BLOCKS:
            flush()
            links = 0
            if stack[-1][0] == "p":
                cut(len(stack) - 1)
            if tag in CLOSES:
                drop, keep = CLOSES[tag]
                if (k := top(drop)) > top(keep):
                    cut(k)
            hints, hidden = _hints(attrs)
            nodes.append(Node(stack[-1][1], tag, hints))
            push(tag, len(nodes) - 1, stack[-1][2] or hidden)
        elif tag in SKIPPED:
            if not attrs.endswith("/"):
                flush()
                push(tag, stack[-1][1], True)
    flush()
    for n in nodes[1:]:
        n.under = nodes[n.parent].hints or nodes[n.parent].under
    for n in reversed(nodes[1:]):  # sums over subtrees
        p = nodes[n.parent]
        p.words += n.words
        p.linked += n.linked
        p.stops += n.stops
        p.kids += 1
    return nodes


def features(nodes: list[Node], k: int) -> list[tuple]:
    """What is seen of a node; evidence that its only text block shows as well is left to that."""
    n = nodes[k]
    density = min(4, int(4.999 * n.linked / max(1, n.words)))
    if n.text is not None:
        size = min(9, int(2 * math.log10(n.words + 1)))
        return [("leaf", nodes[n.parent].tag, size, density), ("stops", min(3, int(20 * n.stops / n.words)), size > 3)]
    out = [("hint", h) for h in n.hints] or [("hint", None)]
    out += [("under", h) for h in n.under] or [("under", None)]
    if n.kids < 2:
        return [("one", n.tag), *out]
    return [("many", n.tag, density, min(3, n.kids // 3)), ("share", min(4, int(5 * n.words / max(1, nodes[0].words)))), *out]


_GROUP = {"#": "#", "p": "p", "li": "li", "div": "div", "section": "div"}


class TreeModel:
    """Log potentials of nodes by feature and label, and of edges by the child's kind of tag and both labels."""

    def __init__(self, pages: list[tuple[list[Node], list[int]]], smooth: float = 0.5):
        seen: dict = defaultdict(lambda: [smooth, smooth])
        total: dict = defaultdict(lambda: [2 * smooth, 2 * smooth])
        edges: dict = defaultdict(lambda: [[1.0, 1.0], [1.0, 1.0]])
        for nodes, labels in pages:
            for k, n in enumerate(nodes):
                for f in features(nodes, k):
                    seen[f][labels[k]] += 1
                    total[f[0]][labels[k]] += 1
                if n.parent >= 0:
                    edges[_GROUP.get(n.tag, "other")][labels[n.parent]][labels[k]] += 1
        self.node = {f: (math.log(c[0] / total[f[0]][0]), math.log(c[1] / total[f[0]][1])) for f, c in seen.items()}
        self.edge = {g: [[math.log(x / sum(row)) for x in row] for row in t] for g, t in edges.items()}

    def unary(self, nodes: list[Node], k: int) -> list[float]:
        a = b = 0.0
        for f in features(nodes, k):
            u = self.node.get(f)
            if u:
                a += u[0]
                b += u[1]
        return [a, b]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each node's probability of being content, by one upward and one downward pass of sum-product messages."""

        def plus(a: float, b: float) -> float:
            return max(a, b) + math.log1p(math.exp(-abs(a - b)))

        flat = [[-0.7, -0.7], [-0.7, -0.7]]
        belief = [self.unary(nodes, k) for k in range(len(nodes))]
        tables = [self.edge.get(_GROUP.get(n.tag, "other"), flat) for n in nodes]
        up: list = [None] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            b, t = belief[k], tables[k]
            up[k] = (plus(t[0][0] + b[0], t[0][1] + b[1]), plus(t[1][0] + b[0], t[1][1] + b[1]))
            p = belief[nodes[k].parent]
            p[0] += up[k][0]
            p[1] += up[k][1]
        for k in range(1, len(nodes)):
            p, t = belief[nodes[k].parent], tables[k]
            a, b = p[0] - up[k][0], p[1] - up[k][1]  # the parent without what this node told it
            m = max(a, b)  # keep numbers small
            belief[k][0] += plus(a + t[0][0], b + t[1][0]) - m
            belief[k][1] += plus(a + t[0][1], b + t[1][1]) - m
        return [1 / (1 + math.exp(max(-700.0, min(700.0, a - b)))) for a, b in belief]


@functools.cache
def train(pages: int = 600, seed: int = 3) -> TreeModel:
    """A model of so many generated pages with labelled blocks."""
    done = []
    for page, wanted in labelled_pages(pages, seed):
        nodes = parse(page)
        labels = [int(n.text in wanted) if n.text is not None else 0 for n in nodes]
        good = [n.words * y for n, y in zip(nodes, labels, strict=True)]
        for k in range(len(nodes) - 1, 0, -1):
            good[nodes[k].parent] += good[k]
        for k, n in enumerate(nodes):  # an element is content if most of its words are
            if n.text is None:
                labels[k] = int(2 * good[k] > n.words)
        done.append((nodes, labels))
    return TreeModel(done)


def main_text(page: str | None, model: TreeModel) -> str:
    if not page:
        return ""
    nodes = parse(page)
    chances = model.marginals(nodes)
    return "\n".join(n.text for n, c in zip(nodes, chances, strict=True) if n.text is not None and c >= 0.5)


def extract(df: DataFrame, html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """df with `text`, the page's main text ('' if it has none), and `n_chars`, its code points (long).

    Character references are decoded, white space in a block becomes one space, blocks come in page order, joined by
    one newline. A null or empty page gives an empty text, a page of plain text is judged as one block. Broken markup is
    read as far as it goes: unclosed elements end with their parent, unclosed comments with the page. Every row stays;
    input columns named as the added ones are replaced.
    """
    model = model or train()
    read = F.pandas_udf(lambda pages: pd.Series([main_text(p, model) for p in pages], dtype=object), "string")
    # the page is read through the udf before any column of the same name is replaced
    out = df.withColumn("_hx", read(F.col(html_col)))
    kept = [c for c in without(out, "text", "n_chars").columns if c != "_hx"]
    return out.select(*kept, F.col("_hx").alias("text"), F.length("_hx").cast("long").alias("n_chars"))
