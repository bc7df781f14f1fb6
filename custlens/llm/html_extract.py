"""Main text of web pages by tag-path ratios.

A page becomes a list of blocks, each with the root-to-leaf path of its open
elements (name and class).  Per path the blocks' text length, punctuation and
link text are added up; text and punctuation per block are the path's two
ratios.  Both are smoothed over neighbouring blocks, fused by their product,
weighted where the path leads through an ``article`` or ``main`` element, and held
against a threshold.  All paths over the threshold are content, and so is the
lowest container that they share, widened to an ``article`` around it, with every
block in it whose path is not boilerplate by name and which is not one of a list
of links.  So a short paragraph or heading between them stays.  Where they share
the page's body only, it is the container of each, and the headings of the
elements around it.

Paths are nodes of a tree that share their heads, so a page's work is in
proportion to its length and number of blocks, however deep they are.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Hashable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import arrow_types, as_batch, map_arrow

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，¿¡]")
_PARTS = re.compile(r"[a-z]+")

#: Content is text up to the end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that do not begin a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Start tag -> open elements that it ends, up to the nearest of the containers.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Boilerplate by element name, and by a word of class, id or role.
OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "head"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies",
         "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo",
         "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar",
         "widget", "alert", "alertdialog", "complementary", "contentinfo"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements of running text: a class is boilerplate there by its last word only, these left out ("share-price" is not).
LEAVES, NEUTRAL = {"p", "blockquote", "pre", "li", "td", "dd", "dt", "figure", "figcaption"}, {"text", "box", "link", "links", "message", "line", "label", "note", "info", "item", "list", "block"}
#: First words of a class that make an ``article`` a reader's comment or an advert.
REMARKS = {"comment", "comments", "reply", "replies", "sponsored", "advert", "advertisement", "promo", "promoted"}
#: Foreign or embedded content that an element without an end tag does not open.
EMBEDDED = {"svg", "math", "object", "canvas", "template"}
#: Share of the highest fused ratio that a path needs; share of link text that makes a path a menu; weight of article and main.
OVER, LINKS, NAMED = 0.1, 0.5, 2.0


def _said(name: str, words: str) -> bool:
    """Whether class, id and role call the element boilerplate."""
    if name in HEADINGS or name == "main":
        return False
    for token in words.split():
        parts = _PARTS.findall(token)
        if name == "article":
            if parts and parts[0] in REMARKS:
                return True
        elif name in LEAVES:
            while len(parts) > 1 and parts[-1] in NEUTRAL:
                parts.pop()
            if parts and parts[-1] in WORDS:
                return True
        elif WORDS.intersection(parts):
            return True
    return False


class _Page:
    """Blocks of a page (path node, text, link characters) and the tree of paths:
    node 0 is the empty path; a node's parent has a smaller number."""

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, int]] = []
        self.parent, self.name = [-1], [""]
        #: Boilerplate; boilerplate but for a heading (an article's header); within article or main.
        self.outside, self.header, self.inside = [False], [False], [False]
        self.nodes: dict[tuple[int, str], int] = {}
        self.stack: list[tuple[str, int]] = []
        self.opened: Counter[str] = Counter()
        self.parts: list[str] = []
        self.links = 0
        unclosed: set[str] = set()
        at, end = 0, len(html)
        while at < end:
            m = _MARKUP.search(html, at)
            if not m:
                self.text(html[at:])
                break
            self.text(html[at:m.start()])
            at = m.end()
            name = m["name"] or m["name2"]
            if m["cdata"] is not None:
                self.parts.append(m["cdata"])
            elif name:
                name, rest = name.lower(), m["rest"] or m["rest2"] or ""
                if m["end"] or m["end2"]:
                    self.close(name)
                elif name in RAW and not (name in EMBEDDED and (name in unclosed or rest.endswith("/"))):
                    stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                    if stop:
                        at = stop.end()
                    elif name in EMBEDDED:
                        unclosed.add(name)
                    else:
                        break
                elif name not in RAW:
                    self.open(name, rest)
        self.flush()

    @property
    def node(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(unescape(raw) if "&" in raw else raw)
            if self.opened["a"]:
                self.links += len(raw.strip())

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((self.node, text, min(self.links, len(text))))
        self.parts, self.links = [], 0

    def _pop_to(self, k: int) -> None:
        for name, _ in self.stack[k:]:
            self.opened[name] -= 1
        del self.stack[k:]

    def _child(self, name: str, words: str) -> int:
        """The node of an element in the open one."""
        at = self.node
        key = (at, f"{name}.{words}")
        if key not in self.nodes:
            self.nodes[key] = len(self.parent)
            self.parent.append(at)
            self.name.append(name)
            shell = name in ("html", "body")
            titled = self.inside[at] and "#hidden" not in words and (name == "header" or name in ("div", "section") and WORDS.intersection(_PARTS.findall(words)) == {"header"})
            self.header.append(self.header[at] or titled)
            self.outside.append(self.outside[at] or not shell and not titled and (name in OUTSIDE or "#hidden" in words or bool(words) and _said(name, words)))
            self.inside.append(self.inside[at] or name in ("article", "main"))
        return self.nodes[key]

    def boilerplate(self, node: int) -> bool:
        return self.outside[node] or self.header[node] and self.name[node] not in HEADINGS

    def open(self, name: str, rest: str) -> None:
        if name in INLINE:
            if name not in VOID:
                self.stack.append((name, self.node))
                self.opened[name] += 1
            return
        self.flush()
        if name in VOID:
            return
        ended, within = ENDS.get(name, ({"p"}, {"button", "table", "object"}))
        if self.opened["p"] or any(self.opened[n] for n in ended):
            for k in range(len(self.stack) - 1, -1, -1):
                n = self.stack[k][0]
                if n in within:
                    break
                if n in ended or n == "p":
                    self._pop_to(k)
                    if name not in ENDS or n != "p":
                        break
        words = " ".join(next((g for g in a if g), "") for a in _ATTRIBUTE.findall(rest)) if rest else ""
        if rest and _HIDDEN.search(rest):
            words += " #hidden"
        if not rest.endswith("/"):
            self.stack.append((name, self._child(name, " ".join(words.lower().split()))))
            self.opened[name] += 1

    def close(self, name: str) -> None:
        inline = name in INLINE
        if not inline:
            self.flush()
        elif name in VOID:
            return
        if not self.opened[name]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            n = self.stack[k][0]
            if n == name:
                self._pop_to(k)
                return
            if inline and n not in INLINE:
                return


def _smooth(v: list[float]) -> list[float]:
    """Weights 1, 2, 1 over neighbouring blocks."""
    return [(2 * x + (v[i - 1] if i else x) + (v[i + 1] if i + 1 < len(v) else x)) / 4 for i, x in enumerate(v)]


def path_scores(blocks: list[tuple[Hashable, str, int]]) -> dict[Hashable, float]:
    """Fused, smoothed ratio of each path, 1 at most."""
    total: dict[Hashable, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for path, text, links in blocks:
        t = total[path]
        t[0] += 1
        t[1] += len(text) - links
        t[2] += len(_PUNCTUATION.findall(text)) if links < len(text) else 0
    length = _smooth([total[p][1] / total[p][0] for p, _, _ in blocks])
    marks = _smooth([total[p][2] / total[p][0] for p, _, _ in blocks])
    fused: dict[Hashable, list[float]] = defaultdict(list)
    for (path, _, _), a, b in zip(blocks, length, marks):
        fused[path].append(a * (b + 0.1))
    mean = {p: sum(v) / len(v) for p, v in fused.items()}
    most = max(mean.values(), default=0)
    return {p: v / most if most else 0.0 for p, v in mean.items()}


def extract_text(html: str) -> str:
    """Blocks of the main text, one a line; empty if there are none."""
    page = _Page(html)
    parent, name = page.parent, page.name
    blocks = [b for b in page.blocks if not page.boilerplate(b[0])]
    if not blocks:
        return ""
    scores = {p: s * (NAMED if page.inside[p] else 1) for p, s in path_scores(blocks).items()}
    link_share: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    unlinked = set()
    for path, text, links in blocks:
        link_share[path][0] += links
        link_share[path][1] += len(text)
        if not links and _PUNCTUATION.search(text):
            unlinked.add(path)
    menus = {p for p, (a, b) in link_share.items() if a > LINKS * b}
    least = OVER * max(scores.values())
    content = {p for p in scores if scores[p] >= least and (p not in menus or p in unlinked)}
    if not content:
        return ""
    # the container of a path is the element around its last, but for elements that hold text and elements alike
    best = {p if name[p] in ("div", "section", "td", "body", "article", "main") or parent[p] <= 0 else parent[p] for p in content}
    below = [0] * len(parent)
    for p in best:
        below[p] += 1
    for p in range(len(parent) - 1, 0, -1):
        below[parent[p]] += below[p]
    # of the nodes above all of them, which lie on one line, the last is the lowest
    shared = max(p for p, n in enumerate(below) if n == len(best))
    around = shared
    while around > 0 and name[around] != "article":
        around = parent[around]
    if around > 0:
        shared = around
    if name[shared] not in ("", "html", "body"):
        best = {shared}
    heads = set()
    for p in best:
        while p >= 0 and p not in heads:
            heads.add(p)
            p = parent[p]
    best |= content
    within = [p in best for p in range(len(parent))]
    for p in range(1, len(parent)):
        within[p] = within[p] or within[parent[p]]

    def headed(path: int) -> bool:
        up = parent[path]
        while up > 0 and name[up] in ("header", "hgroup"):
            up = parent[up]
        return name[path] in HEADINGS and up in heads

    keep = [text for path, text, links in blocks if not (path in menus and links > LINKS * len(text)) and (within[path] or headed(path))]
    return "\n".join(keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points).  A null html counts as empty
    and gives an empty text; null ids and urls stay; repeated rows are taken each;
    only page_id, url and html are read; an empty table gives an empty one."""
    schema = "page_id long, url string, text string, n_chars long"
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                texts = [extract_text(h) if h else "" for h in b.column(2).to_pylist()]
                yield as_batch([b.column(0), b.column(1), texts, [len(t) for t in texts]], types)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, schema)
