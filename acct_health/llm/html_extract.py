"""Main text of web pages by container paths that the pages of a host agree on.

Each page is cut into containers (article, main, section, div, table cell, ...). Text whose nearest
container is c counts for c, and half of a container's score for the one around it; links and hidden
parts (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) count
nothing. From the best container on, the article is whole: the article or main around it, and further
containers below the body that add text and no block of mostly links. That container votes, with the
best one's share of the page's score, for its generalised path: tags and classes from the root, digits
as ``#``. Spark adds up the votes per host, and each page's text is
taken from the containers with its host's winning path; a page that has none takes its own best one.

White space and block borders become one space, character references are decoded, hidden parts inside
the container are left out, everything else is kept in page order. Names of boilerplate (``ad-top``,
``related-posts``) hide a block; names that only begin like one (``search-strategy``) hide it if it is mostly
links or has a form, and ids count only on containers, since headings carry anchors. A header inside an
article belongs to it if it has a heading. Start tags end what HTML lets them end (p, li, dt, dd, cells, rows),
so a hidden paragraph without an end tag hides nothing after it.

Defined results: null html is as empty and gives the empty text; markup cut off at the end is dropped;
a page without containers is one container; one left without text by its hidden parts is judged again
without hiding by class and id; pages without a host vote together; rows with equal ids or
urls are pages of their own; a tie between paths goes to the greater string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acct_health.llm.common import read_table, stored

#: Up to this many hosts the winning paths are broadcast; beyond, pages are joined with them by salted host.
BROADCAST_HOSTS = 50_000
SALTS = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/a-zA-Z!?][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>?|\Z", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select")}
_DIGITS = re.compile(r"\d+")

# Fixed element sets.
_CONTAINERS = frozenset("body div article section main table td th aside nav header footer form".split())
_HIDDEN = frozenset("nav header footer aside form button label fieldset dialog menu head".split())
_NEVER_HIDDEN = frozenset("html body main article".split())  # by class, id or role, which often tell their layout or state
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert form menu".split())
# Names of classes and ids. A head with generic words after it names boilerplate; with other words
# (``search-strategy``, ``comment-on-law``) it may name a section of the article.
_GENERIC = (r"(?:[-_](?:lists?|box|bar|wrap(?:per)?|container|block|section|area|form|inner|outer|content|body|widget|links?|items?|posts?|articles?|stories|"
            r"buttons?|icons?|slot|unit|banner|notice|popup|modal|header|footer|nav|menu|top|bottom|left|right|main|primary|secondary|global|mobile|"
            r"desktop|text|message|toggle|panel|group|row|col|us|this|meta|author|thread|children|reply|policy|consent|\d+|[a-z]))*$")
_HEADS = (r"(?:banner|nav|navbar|navigation|menu|menubar|breadcrumbs?|header|footer|sidebar|aside|widgets?|cookies?|consent|notice|alert|popup|modal|overlay|"
          r"newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|comments?|respond|repl(?:y|ies)|"
          r"disqus|pagination|pager|skip|toolbar|search)")
_BOILERPLATE = re.compile(
    rf"(?:ads?|advert\w*|sponsor(?:ed)?|promo)(?:[-_].*)?$|{_HEADS}{_GENERIC}"
    r"|(?!has|with|no)[a-z0-9_-]*[-_](?:ads?|advert|nav|menu|sidebar|footer|header|comments?|cookies?|banner|notice)$", re.I)
_DOUBTFUL = re.compile(rf"{_HEADS}[-_]", re.I)
_HEADER = re.compile(r"(?:[a-z0-9_-]*[-_])?header$", re.I)
_OWN_HEADER = re.compile(r"(?:entry|post|article|section|content|story|chapter)[-_]header$", re.I)
# Open elements that a start tag ends, and elements beyond which neither it nor an end tag reaches.
_TABLE, _LISTS = ("table",), ("ul", "ol", "menu")
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"),
         **dict.fromkeys(("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot", "tr", "td", "th")),
         **dict.fromkeys("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                         "hr main menu nav ol p pre section table ul".split(), ("p",))}
_SCOPE = {"li": _LISTS, "dt": ("dl",), "dd": ("dl",), "p": ("table", "td", "th", "button"),
          **dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot"), _TABLE)}
_SCOPES = frozenset("ul ol dl".split())  # tables and buttons are containers anyway
_FORM = frozenset("form input button textarea select".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Open:
    """Open elements, each with the container around it; finds and ends one without a walk over all."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, around: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, around))

    def end(self, tags: tuple[str, ...], scope: tuple[str, ...], node: int, outermost: bool = False) -> int:
        """Ends the innermost open element of ``tags`` within ``scope`` (or the outermost, if they are
        parts of each other) and all in it; gives the container that is open then."""
        found = [self.places[t][-1] for t in tags if self.places.get(t)]
        if not found:
            return node
        border = max((self.places[t][-1] for t in scope if self.places.get(t)), default=-1)
        found = [i for i in found if i > border]
        if not found:
            return node
        first = min(found) if outermost else max(found)
        node = self.stack[first][1]
        while len(self.stack) > first:
            self.places[self.stack.pop()[0]].pop()
        return node


class Page:
    """Containers of a page and its text in pieces. Container 0 is the page itself."""

    def __init__(self, html: str):
        self._judge(html, True)
        if any(self.hidden) and not self._has_text():
            self._judge(html, False)

    def _judge(self, html: str, by_class: bool) -> None:
        """Cuts the page up; without ``by_class`` names of classes and ids hide nothing."""
        self.by_class = by_class
        self.parent, self.step, self.hidden, self.tag = [-1], [""], [False], [""]
        self.doubt = [""]  # "block": hidden if it is mostly links or has a form; "header": unless it has a heading
        self.in_article = [False]
        self.forms, self.headings = set(), set()  # containers with such elements directly in them
        self.pieces: list[tuple[int, str, bool]] = []  # container, text, in a link
        self._parse(html)
        if any(self.doubt):
            self._settle()

    def _settle(self) -> None:
        """Hides the doubtful containers that look like boilerplate, and what is in them."""
        n = len(self.parent)
        text, linked = [0] * n, [0] * n
        form, heading = [i in self.forms for i in range(n)], [i in self.headings for i in range(n)]
        for node, piece, link in self.pieces:
            (linked if link else text)[node] += len(piece.strip())
        for i in range(n - 1, 0, -1):
            mostly_links = linked[i] > text[i]
            if self.doubt[i]:
                self.hidden[i] |= mostly_links or form[i] or self.doubt[i] == "header" and not heading[i]
            up = self.parent[i]
            text[up], linked[up] = text[up] + text[i], linked[up] + linked[i]
            form[up], heading[up] = form[up] or form[i], heading[up] or heading[i]
        for i in range(1, n):
            self.hidden[i] |= self.hidden[self.parent[i]]

    def _has_text(self) -> bool:
        return any(not link and not self.hidden[node] and text.strip() for node, text, link in self.pieces)

    def _open(self, tag: str, attributes: str, node: int) -> int:
        names, off, doubt = [], tag in _HIDDEN, ""
        named = tag not in _NEVER_HIDDEN
        by_class = named and self.by_class
        block = tag in _CONTAINERS or tag in _SCOPES
        if tag == "header" and self.in_article[node]:
            off, doubt = False, "header"
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "class" or name == "id" and block:
                    words = sorted(set(value.split())) if name == "class" else [value]
                    names = words if name == "class" else names
                    for c in words if by_class else ():
                        if block and (_OWN_HEADER.match(c) or self.in_article[node] and _HEADER.match(c)):
                            doubt = "header"
                        elif _BOILERPLATE.match(c):
                            off = True
                        elif block and _DOUBTFUL.match(c):
                            doubt = doubt or "block"
                elif name == "role":
                    off |= named and value.lower() in _ROLES
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    off = True
        if tag not in _CONTAINERS and not off and not doubt:
            return node
        self.parent.append(node)
        self.step.append(_DIGITS.sub("#", ".".join([tag, *names]).lower()).replace("/", "_"))
        self.hidden.append(self.hidden[node] or off)
        self.tag.append(tag)
        self.doubt.append(doubt)
        self.in_article.append(self.in_article[node] or tag in ("article", "main"))
        return len(self.parent) - 1

    def _parse(self, html: str) -> None:
        node, link, at = 0, False, 0
        opened = _Open()
        pieces = self.pieces
        search = _TOKEN.search
        while True:
            m = search(html, at)
            text = html[at:m.start() if m else len(html)]
            if text:
                pieces.append((node, text, link))
            if not m:
                return
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    link = False
                node = opened.end((tag,), _SCOPE.get(tag, ()), node)
                if tag not in _INLINE:
                    pieces.append((node, " ", False))
                continue
            if tag in _ENDS:
                node = opened.end(_ENDS[tag], _SCOPE[_ENDS[tag][0]], node, True)
            if tag not in _INLINE:
                pieces.append((node, " ", False))
            if tag in _FORM:
                self.forms.add(node)
            elif tag in _HEADINGS:
                self.headings.add(node)
            if tag in _RAW:
                at = _RAW[tag].search(html, at).end()
                continue
            if tag in _VOID or m[3].endswith("/") and tag not in _INLINE and tag not in _CONTAINERS:
                continue
            if tag == "a":  # a link ends the one before it; an anchor without a target is none
                link = "href" in m[3].lower()
            inner = self._open(tag, m[3], node)
            if inner != node or tag in _SCOPES:
                opened.push(tag, node)
                node = inner

    def best(self) -> tuple[int, float]:
        """(container of the whole article around the highest score, that score's share of all); -1 if there is no text."""
        score = [0.0] * len(self.parent)
        linked = [0.0] * len(self.parent)
        for node, text, link in self.pieces:
            if not self.hidden[node]:
                (linked if link else score)[node] += len(text.strip())
        own = score.copy()
        for node in range(len(score) - 1, 0, -1):
            if self.tag[node] in ("article", "main"):
                score[node] *= 1.5
            score[self.parent[node]] += score[node] / 2
        top = max(range(len(score)), key=lambda i: (score[i], i))
        return (self._whole(top, own, linked), score[top] / sum(score)) if score[top] > 0 else (-1, 0.0)

    def _whole(self, top: int, text: list[float], linked: list[float]) -> int:
        """The container of the whole article around the best one: the enclosing article or main, then the
        outermost container below the body that adds text and no block of mostly links. A table adds none
        by its cells, which may be columns of a layout. ``text`` and ``linked`` are characters outside and
        inside links."""
        text, linked = text.copy(), linked.copy()
        for node in range(len(text) - 1, 0, -1):
            text[self.parent[node]] += text[node]
            linked[self.parent[node]] += linked[node]
        links = [0] * len(text)  # blocks of mostly links in and under a container
        for node in range(len(text) - 1, 0, -1):
            links[node] += linked[node] > text[node]
            links[self.parent[node]] += links[node]
        around = []
        node = self.parent[top]
        while node > 0 and self.tag[node] != "body":
            around.append(node)
            node = self.parent[node]
        for i in range(len(around) - 1, -1, -1):
            if self.tag[around[i]] in ("article", "main"):
                top, around = around[i], around[i + 1:]
                break
        whole, chars = top, text[top]
        for node in around:
            if links[node] > links[top]:
                break
            if text[node] > chars and self.tag[node] != "table":
                whole = node
            chars = text[node]
        return whole

    def path(self, node: int) -> str:
        """The generalised path of a container from the root."""
        steps = []
        while node > 0:
            steps.append("/" + self.step[node])
            node = self.parent[node]
        return "".join(reversed(steps))

    def _on_path(self, path: str) -> list[bool]:
        """Which containers have this path and aren't hidden."""
        steps = path.split("/")[1:]
        depth = [0] + [-1] * (len(self.parent) - 1)  # steps of the path that lead to a container; -1: off the path
        for i in range(1, len(depth)):
            before = depth[self.parent[i]]
            if 0 <= before < len(steps) and steps[before] == self.step[i]:
                depth[i] = before + 1
        return [d == len(steps) and not h for d, h in zip(depth, self.hidden, strict=True)]

    def text(self, path: str | None) -> str:
        """Text of the containers of ``path``, or of the best one where there are none."""
        inside = self._on_path(path) if path is not None else [False] * len(self.parent)
        if not any(inside):
            top, _ = self.best()
            if top < 0:
                return ""
            inside[top] = True
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parent[i]]
        raw = "".join([text for node, text, _ in self.pieces if inside[node] and not self.hidden[node]])
        return " ".join(unescape(raw).split())


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^.*?://([^/?#]*)", 1))
    return pages.withColumn("__host", host)


def votes(pages: DataFrame) -> DataFrame:
    """(__host, path, votes): what the pages of each host vote for. ``pages`` has __host and html."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[str, str], float] = {}
            for host, html in zip(b.column("__host").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = Page(html or "")
                top, share = page.best()
                if top >= 0:
                    key = host, page.path(top)
                    total[key] = total.get(key, 0.0) + share
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()),
                                              pa.array(list(total.values()), pa.float64())], ["__host", "path", "votes"])

    found = pages.select("__host", "html").mapInArrow(vote, "__host string, path string, votes double")
    return found.groupBy("__host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(__host, path): each host's path of most votes."""
    return votes(pages).groupBy("__host").agg(F.max(F.struct("votes", "path")).alias("top")).select("__host", "top.path")


def extract(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    pages = with_host(pages.select("page_id", "url", "html"))
    paths = stored(winning_paths(pages), "paths")
    if paths.count() <= broadcast_hosts:
        joined = pages.join(F.broadcast(paths), "__host", "left")
    else:  # a host may have a third of all pages
        salted = paths.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [Page(html or "").text(path) for html, path in zip(b.column("html").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "path").mapInArrow(take, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
