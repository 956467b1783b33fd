"""HTML extraction with a tree-structured graphical model (operator 6).

A page's elements are the nodes of a tree; each is content or not.  A node's own potential comes from what
it looks like (its kind of tag, hints in its class, id and role, how much of its text is links), a
parent-child potential from both states and the child's kind and hints.  All are counted, with smoothing, on
labelled pages.  Sum-product messages pass upward to the root and downward again; a block of text is
kept if its element's marginal for content is one half or more.

Text rules: character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by an empty line in page order; block elements separate blocks, ``br`` is
white space; scripts, styles, the head, comments and form controls have no text.  A formula's text is
read in order, like that of other inline elements, without its annotations, which are not shown.

Defined results: NULL or empty html, and pages without content, give empty text; unclosed and
misplaced tags are closed where HTML closes them; repeated rows give repeated results; NULL page_id and url
stay NULL; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title noscript template svg iframe object select option textarea button canvas audio video map datalist annotation annotation-xml".split())
#: What may stand in a head; any other tag ends it, as text does.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
MATH = frozenset("math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub "
                 "msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE = (MATH - SILENT) | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre "
                     "section table ul".split())
#: Start tags that end an open formula.
ENDS_MATH = CLOSES_P | frozenset("b big body br code dd dt em embed i img li meta nobr ruby s small span strike strong sub sup tt u var".split())
#: Elements of a formula that may hold HTML.
HOLDS_HTML = frozenset("mi mo mn ms mtext annotation-xml".split())
#: Start tags that end an open element of these kinds, up to the nearest container of the last kinds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SPACE = re.compile(r"[\s ]+")

KINDS = {t: k for k, ts in {
    "article": "article main", "page": "html body", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside dialog",
    "form": "form fieldset label legend input", "paragraph": "p blockquote pre", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl", "item": "li dt dd",
    "table": "table thead tbody tfoot tr td th caption", "figure": "figure figcaption picture", "address": "address"}.items() for t in ts.split()}

HINTS = [(h, re.compile(rf"(?:^|[^a-z])(?:{p})", re.I)) for h, p in [
    ("comment", r"comments?|disqus|respond|replies|reader"),
    ("advert", r"ads?(?![a-z])|advert|banner|promo|sponsor|dfp"),
    ("notice", r"cookie|consent|gdpr|notice|alert|popup|modal|newsletter|subscri|signup|paywall|toast"),
    ("nav", r"nav|menu|breadcrumb|pagination|pager|toc(?![a-z])|skip"),
    ("footer", r"foot|copyright|legal|colophon"),
    ("header", r"header|masthead|topbar|site-?title|logo|brand"),
    ("side", r"side|related|recommend|widget|share|social|popular|trending|tags?(?![a-z])|meta(?![a-z])|byline|author-?box"),
    ("form", r"form|search|login|sign-?in"),
    ("content", r"article|content|post|entry|story|main|body|text|prose"),
]]


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "text", "links", "label")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.text = self.links = 0  # characters of text, and of text in links, below this node
        self.label = None


class Page(HTMLParser):
    """Block elements as a tree, and the page's blocks of text with the element each lies in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.nodes = [self.root]
        self.open: list[tuple[str, Node]] = []  # every open tag, inline ones with the block they are in
        self.places: dict[str, list[int]] = {}  # where each tag stands in it, outermost first
        self.blocks: list[tuple[Node, list[str]]] = []
        self.fresh = True
        self.silent = self.in_link = 0

    @property
    def node(self) -> Node:
        return self.open[-1][1] if self.open else self.root

    @property
    def in_head(self) -> bool:
        return bool(self.open) and self.open[-1][0] == "head"

    def handle_starttag(self, tag, attrs):
        if self.in_head:
            if tag in ("html", "head"):
                return
            if tag not in HEAD:
                self._end({"head"}, set())
        if tag in ENDS_MATH:
            self._end({"math"}, HOLDS_HTML)
        if tag in CLOSES_P:
            self._end({"p"}, {"button", "td", "th", "li", "div", "article", "section", "body"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in VOID:
            if tag in ("br", "wbr"):
                self._text(" " if tag == "br" else "")
            elif tag == "hr":
                self.fresh = True
            return
        node = self.node
        if tag not in INLINE and tag not in SILENT:
            node = Node(tag, dict(attrs), node)
            node.parent.children.append(node)
            self.nodes.append(node)
            self.fresh = True
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node))
        self.silent += tag in SILENT
        self.in_link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes void elements and those of formulas only
        if tag in MATH and self.open and self.open[-1][0] == tag:
            self._end({tag}, set())

    def handle_endtag(self, tag):
        if tag in ("br", "body", "html") and self.in_head:
            self._end({"head"}, set())
        if tag == "br":
            self._text(" ")
        elif tag in ("body", "html"):
            return  # what follows still belongs to the page
        elif tag not in VOID:
            self._end({tag}, {"table"} if tag in ("p", "li", "div") else {"body"})

    def _end(self, tags: set[str], stop: set[str]) -> None:
        """Close the nearest open element of ``tags`` with all inside it, if none of ``stop`` lies between."""
        nearest = lambda names: max((self.places[t][-1] for t in names if self.places.get(t)), default=-1)
        at = nearest(tags)
        if at < 0 or nearest(stop - tags) > at:
            return
        for t, _ in self.open[at:]:
            self.places[t].pop()
            self.silent -= t in SILENT
            self.in_link -= t == "a"
            self.fresh |= t not in INLINE and t not in SILENT
        del self.open[at:]

    def handle_data(self, data):
        if self.in_head and data.strip(" \t\n\f\r"):
            self._end({"head"}, set())
        if not self.silent:
            self._text(data)

    def _text(self, data: str) -> None:
        if self.silent:
            return
        node = self.node
        if self.fresh or not self.blocks or self.blocks[-1][0] is not node:
            self.blocks.append((node, []))
            self.fresh = False
        self.blocks[-1][1].append(data)
        node.text += len(data)
        node.links += len(data) if self.in_link else 0


def parse(html: str | None) -> Page:
    page = Page()
    page.feed(html if isinstance(html, str) else "")
    page.close()
    for node in reversed(page.nodes[1:]):  # children come after their parents
        node.parent.text += node.text
        node.parent.links += node.links
    return page


def hint(node: Node) -> str:
    named = " ".join(str(node.attrs.get(k) or "") for k in ("class", "id", "role", "itemprop"))
    return next((h for h, p in HINTS if p.search(named)), "none") if named.strip() else "none"


def meets(node: Node) -> str:
    """What the potential between a node and its parent depends on, besides their states."""
    return f"{KINDS.get(node.tag, 'box')}/{hint(node)}"


def looks(node: Node) -> tuple[str, ...]:
    """What a node's own potential depends on."""
    return ("tag:" + KINDS.get(node.tag, "box"), "hint:" + hint(node), "links:" + ("none" if not node.text or not node.links else "most" if 2 * node.links > node.text else "some"))


class Model:
    """Potentials as log probabilities, from pages whose elements carry data-label="content" or "other".

    An element without label has its parent's.  ``most`` bounds the pages looked at.
    """

    def __init__(self, pages: Iterable[str], most: int = 1000, smooth: float = 0.1):
        seen: dict = defaultdict(lambda: [0.0, 0.0])
        edges: dict = defaultdict(lambda: [[0.0, 0.0], [0.0, 0.0]])
        states = [0.0, 0.0]
        for _, html in zip(range(most), pages):
            for node in parse(html).nodes:
                own = node.attrs.get("data-label")
                node.label = int(own == "content") if own else node.parent.label if node.parent else 0
                states[node.label] += 1
                for f in looks(node):
                    seen[f][node.label] += 1
                if node.parent:
                    edges[meets(node)][node.parent.label][node.label] += 1
        values: dict = defaultdict(int)
        for f in seen:
            values[f.split(":")[0]] += 1
        self.unseen = {f: (0.0, 0.0) for f in values}
        self.own = {f: tuple(math.log((c[s] + smooth) / (states[s] + smooth * values[f.split(":")[0]])) for s in (0, 1)) for f, c in seen.items()}
        total = [[sum(e[p][c] for e in edges.values()) + smooth for c in (0, 1)] for p in (0, 1)]
        self.any_edge = [[math.log(total[p][c] / sum(total[p])) for c in (0, 1)] for p in (0, 1)]
        self.edge = {k: [[math.log((e[p][c] + smooth) / (sum(e[p]) + 2 * smooth)) for c in (0, 1)] for p in (0, 1)] for k, e in edges.items()}

    def marginals(self, page: Page) -> dict[int, float]:
        """The probability of content for every node, by sum-product over the tree."""
        nodes = page.nodes
        up, down, sent = {}, {}, {}
        for node in nodes:
            found = [self.own.get(f, (0.0, 0.0)) for f in looks(node)]
            up[id(node)] = [sum(x[0] for x in found), sum(x[1] for x in found)]
        for node in reversed(nodes[1:]):
            own, edge = up[id(node)], self.edge.get(meets(node), self.any_edge)
            message = [_log_add(edge[p][0] + own[0], edge[p][1] + own[1]) for p in (0, 1)]
            sent[id(node)] = message
            above = up[id(node.parent)]
            above[0] += message[0]
            above[1] += message[1]
        down[id(page.root)] = [0.0, -20.0]  # the page as a whole is never content
        out = {}
        for node in nodes:
            if node.parent:
                above, before, own, edge = up[id(node.parent)], down[id(node.parent)], sent[id(node)], self.edge.get(meets(node), self.any_edge)
                rest = [above[p] + before[p] - own[p] for p in (0, 1)]  # all the parent knows but from here
                down[id(node)] = _level([_log_add(rest[0] + edge[0][c], rest[1] + edge[1][c]) for c in (0, 1)])
            a, b = (up[id(node)][s] + down[id(node)][s] for s in (0, 1))
            out[id(node)] = 1 / (1 + math.exp(min(700.0, a - b)))
        return out

    def text(self, html: str | None) -> str:
        page = parse(html)
        content = self.marginals(page)
        kept = (SPACE.sub(" ", "".join(parts)).strip() for node, parts in page.blocks if content[id(node)] >= 0.5)
        return "\n\n".join(x for x in kept if x)


def _log_add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def _level(m: list[float]) -> list[float]:
    top = max(m)
    return [x - top for x in m]


def labelled_pages() -> Iterator[str]:
    """Labelled pages of a handful of common layouts, each with and without its optional parts."""
    boxes = [
        '<nav data-label="other"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>',
        '<header data-label="other"><h1><a href="/">The Site</a></h1><p>All that is new</p></header>',
        '<div class="header" data-label="other"><a href="/">The Site</a></div>',
        '<div class="menu" data-label="other"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></div>',
        '<div class="ad" data-label="other">Buy one of these today.</div>',
        '<div class="advert" data-label="other"><p>Buy two of these today.</p></div>',
        '<div class="cookie-notice" data-label="other"><p>This site sets cookies. <button>Fine</button></p></div>',
        '<div class="notice" data-label="other">The site will be down tonight.</div>',
        '<aside data-label="other"><h3>More</h3><ul><li><a href="/x">One more story</a></li></ul></aside>',
        '<aside data-label="other"><p>About this site and who writes it.</p></aside>',
        '<div class="sidebar" data-label="other"><h3>Read on</h3><p>Other things that are read.</p></div>',
        '<form action="/s" data-label="other"><label>Your mail</label><input name="m"><p>We never share it.</p></form>',
        '<section class="comments" data-label="other"><h2>Comments</h2><div class="comment"><p>I have seen this before.</p></div><ul><li>So have I.</li></ul></section>',
        '<div id="comments" data-label="other"><p>A reader wrote this.</p></div>',
        '<footer data-label="other"><p>All rights reserved.</p> &copy; The Site</footer>',
        '<div class="footer" data-label="other">&copy; The Site <a href="/c">Contact</a></div>',
    ]
    body = [
        "<h1>A title</h1><p>A first paragraph of some length, with <a href='/z'>a link</a> in it.</p><p>Short.</p><p>Another one.</p>",
        "<h1>A title</h1>Text that stands in no paragraph.<p>And one that does.</p><h2>Part</h2><ul><li>a point</li><li>a second point</li></ul>",
        "<h2>A title</h2><p>Words.</p><blockquote><p>Quoted words.</p></blockquote><table><tr><td>1</td><td>2</td></tr></table><pre>code</pre>",
        "<h1>A title</h1><section><h2>Part</h2><p>Some words.</p></section><div><p>More words.</p></div><figure><figcaption>What it shows</figcaption></figure>",
    ]
    wraps = ['<article data-label="content">{}</article>', '<main data-label="content">{}</main>', '<div class="content" data-label="content">{}</div>',
             '<div id="article-body" data-label="content">{}</div>', '<main data-label="content"><article>{}</article></main>',
             '<article data-label="content"><div class="post-body">{}</div></article>']
    for i, wrap in enumerate(wraps):
        for j, text in enumerate(body):
            before = "".join(boxes[(i + 3 * j + k) % 14] for k in range(2))
            after = "".join(boxes[(5 * i + j + k + 7) % 16] for k in range(3))
            inside = boxes[4 + (i + j) % 10] if (i + j) % 3 == 0 else ""  # boxes also stand inside the article
            yield f'<html><body data-label="other">{before}{wrap.format(text + inside)}{after}</body></html>'
    for i in range(5):  # pages whose text stands in the body itself
        for text in body:
            yield f'<html><body data-label="content">{boxes[3 * i] if i else ""}{text}{boxes[2 * i + 1] if i else ""}</body></html>'


def extract_text(pages: DataFrame, labelled: Iterable[str] | None = None, most_labelled: int = 1000) -> DataFrame:
    """page_id, url, text, n_chars.  The model is fitted on at most ``most_labelled`` labelled pages."""
    model = Model(labelled_pages() if labelled is None else labelled, most_labelled)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html"):
                text = [model.text(h) for h in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    page_id = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        extract, f"page_id {page_id}, url string, text string, n_chars long")
