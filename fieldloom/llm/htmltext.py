"""Main text of web pages: text-to-tag ratios of lines, smoothed and thresholded.

The page runs once through the standard library's streaming parser. Its events give lines, one a block,
with the characters and tags in it and the containers around it. Lines in containers that say themselves
that they are no article, by kind or by name (menus, headers, footers, sidebars, notices, adverts, forms,
comments), are marked and go first. Of the others, the logarithms of the text-to-tag ratios, characters
outside links only, are smoothed by a Gaussian and cut into two clusters at the threshold that parts them
best; ratios that are all alike are one cluster. The upper cluster chooses the content region: an article
or main element, or the innermost container that holds it all, and the containers around it that add only
unmarked lines. Where the region is no more than the page itself, blocks without any line of the upper
cluster go, but for headings and paragraphs next to it. What is left is the text, short lines included,
in page order.

Defined cases: null and empty pages and pages without text give an empty string; unclosed and stray
tags are taken as browsers do, roughly; a form or a layout name that marks most of a page marks nothing; if
forms and layout names mark nearly everything, only other kinds and names count; a page of adverts and
notices has no text; the time a page takes is linear in its size, however deep its containers nest;
repeated rows and null ids are rows of their own; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

_SET = frozenset
SILENT = _SET("script style template noscript head title svg math iframe object applet audio video canvas select datalist textarea button option".split())
VOID = _SET("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = _SET(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Containers that are no article by kind; header only outside one.
OUTSIDE = _SET("nav footer aside form header menu dialog fieldset".split())
#: Of these, what a page's text can be wrapped in.
WRAPS = _SET("form fieldset".split())
ROLES = _SET("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
#: Words of class and id names that mark a container.
NAMES = _SET(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs footer sidebar widget widgets cookie cookies consent gdpr notice notices comment comments respond disqus reply replies share "
    "sharing social related recommended recommendations newsletter subscribe signup popup modal login search pagination pager toolbar masthead topbar".split()
)
COMMENTS = _SET("comment comments respond disqus reply replies".split())
#: Of these, what never holds an article, whatever its share of a page, and what can name the layout of a page around one.
ADVERTS = _SET("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices".split())
LAYOUT = _SET("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar widget widgets login search pagination pager toolbar masthead topbar".split())
#: Names that say what a wrapper has or lacks, not what it is.
_STATES = re.compile(r"(?:has|with|no|without|hide|hides|hidden)[-_].*").fullmatch
WHOLE_NAMES = _SET("header site-header page-header top-header".split())
#: An open element of the first kind ends before a start tag of the second.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class _Node:
    """An open element: whether its kind or a name marks it (or one around it), and whether it holds comments.

    soft: the form, fieldset or layout name that marks lies on this very element, so a page's text can be wrapped in it.
    hard: it is marked whatever its share of the page; advert: an advert or notice, never text.
    """

    __slots__ = ("tag", "parent", "depth", "kind", "name", "comment", "soft", "hard", "advert", "at", "block")

    def __init__(self, tag, parent, kind, name, comment=False, soft=False, hard=False, advert=False):
        self.tag, self.parent, self.kind, self.name, self.comment, self.soft, self.hard, self.advert = tag, parent, kind, name, comment, soft, hard, advert
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if parent is None or tag in BLOCK else parent.block


class Line:
    __slots__ = ("text", "tags", "node", "linked")

    def __init__(self, text, tags, node, linked=0):
        self.text, self.tags, self.node, self.linked = text, tags, node, linked


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.node = _Node("", None, False, False)
        self.node.at = 0
        #: All elements, parents before children, and how many are open of each kind.
        self.nodes: list[_Node] = [self.node]
        self.opened: dict[str, int] = {}
        self.silent = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.node, self.linked))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            if tag == "title" and self.silent == 0 and self.node.tag in ("svg", "math"):
                return
            self.open(tag, attrs)
            self.silent += 1
            return
        if self.silent:
            if tag not in ("body", "article", "main") or any(n.tag not in ("head", "title") for n in self.silent_nodes()):
                return
            self.close_to(self.silent_nodes()[-1])  # a head that was never closed
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        if tag in _ENDS or tag in BLOCK:
            while self.node.tag in ("p",) and tag in BLOCK or self.node.tag in _ENDS and tag in _ENDS[self.node.tag]:
                self.close_to(self.node)
        self.open(tag, attrs)

    def silent_nodes(self):
        out, n = [], self.node
        while n.parent:
            if n.tag in SILENT:
                out.append(n)
            n = n.parent
        return out

    def open(self, tag, attrs):
        a = {k: (v or "") for k, v in attrs}
        up = self.node
        kind, name, hard, soft, advert = up.kind, up.name, up.hard, False, up.advert
        whole = {x for x in f"{a.get('class', '')} {a.get('id', '')}".lower().split() if not _STATES(x)}
        words = set(re.split(r"[^a-z0-9]+", " ".join(whole)))
        if tag in ("article", "main"):
            # an article that begins in a menu, header or form that was never closed; but comments can be articles, too
            name = up.comment or bool(words & COMMENTS)
            kind = kind and up.comment
            hard = up.comment or name
            advert = False
        elif tag not in ("html", "body"):
            if tag in OUTSIDE and not (tag == "header" and self.within("article", "main")) or a.get("role", "").lower() in ROLES:
                kind = True
                soft = tag in WRAPS and a.get("role", "form").lower() == "form" or tag not in OUTSIDE and a["role"].lower() == "form"
                hard = hard or not soft
            if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()):
                kind = hard = True
            if words & NAMES or whole & WHOLE_NAMES:
                name = True
                firm = bool(words & NAMES - LAYOUT)
                soft, hard = soft or not firm, hard or firm
                advert = advert or bool(words & ADVERTS)
        self.node = _Node(tag, up, kind, name, up.comment or bool(words & COMMENTS) and tag not in ("html", "body"), soft, hard, advert)
        self.node.at = len(self.nodes)
        self.nodes.append(self.node)
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def within(self, *tags):
        return any(self.opened.get(t) for t in tags)

    def close_to(self, node):
        """Leave node and all that is open inside it."""
        n = self.node
        while True:
            self.silent -= n.tag in SILENT
            self.opened[n.tag] -= 1
            if n is node:
                break
            n = n.parent
        if self.node.tag in BLOCK or node.tag in BLOCK:
            self.flush()
        self.node = node.parent

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.silent:
            self.tags += 1
        if tag in BLOCK and not self.silent:
            self.flush()
        if not self.opened.get(tag):
            return
        n = self.node
        while n.parent and n.tag != tag:
            # inline end tags don't close the blocks around them
            if tag not in BLOCK and tag not in SILENT and n.tag in BLOCK:
                return
            n = n.parent
        if n.parent:
            self.close_to(n)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.within("a"):
                self.linked += len(data.strip())


def lines_of(html: str) -> tuple[list[Line], list[_Node]]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.lines, parser.nodes


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    radius = max(1, math.ceil(2 * sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        span = range(max(0, i - radius), min(len(values), i + radius + 1))
        total = sum(weights[j - i + radius] for j in span)
        out.append(sum(values[j] * weights[j - i + radius] for j in span) / total)
    return out


#: Clusters whose mean ratios lie within this factor are one.
ALIKE = 4.0


def threshold(values: list[float]) -> float:
    """The cut that parts values into two clusters with the least spread inside; the least value if their means are alike."""
    v = sorted(values)
    upto, total, best = 0.0, sum(v), None
    for i in range(1, len(v)):
        upto += v[i - 1]
        low, high = upto / i, (total - upto) / (len(v) - i)
        between = i * (len(v) - i) * (high - low) ** 2
        if v[i] > v[i - 1] and (best is None or between > best[0]):
            best = (between, v[i], high - low)
    return v[0] if best is None or best[2] < math.log(ALIKE) else best[1]


def content_lines(lines: list[Line]) -> list[bool]:
    """Which lines' smoothed text-to-tag ratio lies in the upper cluster."""
    if not lines:
        return []
    ratios = smooth([math.log1p(max(0, len(x.text) - x.linked) / max(1, x.tags)) for x in lines])
    bound = threshold(ratios)
    return [r >= bound for r in ratios]


_PARTS = _SET(["", "html", "body", "main", "article", "section", "div", "td", "center"])
_PAGE = _SET(["", "html", "body", "main", "article"])
_DECLARED = _SET(["article", "main"])
_HEADINGS = _SET("h1 h2 h3 h4 h5 h6 p hgroup".split())


def _passed_up(nodes: list[_Node], own: list, stop: frozenset = _SET()) -> list:
    """own's sums over all that each element holds; elements of the kinds in stop keep theirs to themselves."""
    for n in reversed(nodes):
        if n.parent is not None and n.tag not in stop:
            own[n.parent.at] += own[n.at]
    return own


def region(lines: list[Line], picked: list[bool], nodes: list[_Node]) -> _Node | None:
    """The container of the article.

    An article or main element with nine tenths of the picked lines' characters says so itself; else it is the innermost
    container with all of them. From there up while a parent adds nothing but lines that are no links: at the page's own
    level or that of an article or main element, nothing but headings and paragraphs.
    """
    mass, total = [0] * len(nodes), 0
    for line, yes in zip(lines, picked, strict=True):
        if yes:
            mass[line.node.at] += len(line.text)
            total += len(line.text)
    mass = _passed_up(nodes, mass)

    def innermost(share: int) -> _Node | None:
        held = (n for n in nodes if mass[n.at] and n.tag in _PARTS and mass[n.at] * 10 >= total * share)
        return max(held, key=lambda n: n.depth, default=None)

    n = innermost(9)
    while n is not None and n.tag not in _DECLARED:
        n = n.parent
    best = n if n is not None else innermost(10)
    return best and _widened(best, lines, nodes)


def _widened(top: _Node, lines: list[Line], nodes: list[_Node]) -> _Node:
    chain, n = [], top
    while n is not None:
        chain.append(n)
        n = n.parent
    level = [-1] * len(nodes)
    for i, n in enumerate(chain):
        level[n.at] = i
    for n in nodes:
        if level[n.at] < 0:
            level[n.at] = level[n.parent.at]
    added: dict[int, list[Line]] = {}
    for x in lines:
        added.setdefault(level[x.node.at], []).append(x)
    best = 0
    for i in range(1, len(chain)):
        for x in added.get(i, ()):
            if x.linked * 2 > len(x.text) or chain[i].tag in _PAGE and x.node.block.tag not in _HEADINGS:
                return chain[best]
        best = i
    return chain[best]


def inside(lines: list[Line], top: _Node, nodes: list[_Node]) -> list[bool]:
    held = [False] * len(nodes)
    for n in nodes[top.at :]:
        held[n.at] = n is top or n.parent is not None and held[n.parent.at]
    return [held[x.node.at] for x in lines]


def chosen(lines: list[Line], picked: list[bool], top: _Node, nodes: list[_Node]) -> list[bool]:
    """The lines in the region; of one that is the page itself, the blocks with a picked line, and headings and paragraphs
    without links in between or next to these.
    """
    keep = inside(lines, top, nodes)
    if top.tag not in _PAGE or top.tag in _DECLARED:
        return keep
    body = next((n for n in nodes if n.tag == "body"), top)
    if all(inside(lines, body, nodes)):
        top = body
    child = [-1] * len(nodes)  # the block right under top that an element is in
    for n in nodes[top.at + 1 :]:
        child[n.at] = n.at if n.parent is top else child[n.parent.at]
    of = [child[x.node.at] for x in lines]
    rich = {c for c, yes in zip(of, picked, strict=True) if yes}
    plain = [x.node.block.tag in _HEADINGS and x.node.block.parent is top and x.linked * 2 <= len(x.text) for x in lines]
    good = [k and (c in rich or c < 0 and yes) for k, c, yes in zip(keep, of, picked, strict=True)]
    for order in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
        back = 1 if order.step > 0 else -1
        for i in order:
            good[i] = good[i] or keep[i] and plain[i] and good[i - back]
    return good


def unmarked(every: list[Line], nodes: list[_Node]) -> list[Line]:
    """The lines that no container marks.

    A form, or a wrapper with a name of page layout, that holds most of the text that nothing else marks is no mark, unless
    an article or main element holds more than a tenth of it. If a tenth of that text or less is left, and no article or
    main element says that this is all, forms and such names count for nothing. Adverts and notices are never text, and
    comments, shares and recommendations only on a page that has nothing else.
    """
    able = [x for x in every if not x.node.hard]
    total = sum(len(x.text) for x in able)
    mass = [0] * len(nodes)
    for x in able:
        mass[x.node.at] += len(x.text)
    mass = _passed_up(nodes, mass, _DECLARED)
    marked, declared = [False] * len(nodes), [False] * len(nodes)
    for n in nodes[1:]:
        declared[n.at] = n.tag in _DECLARED or declared[n.parent.at]
    said = sum(len(x.text) for x in able if declared[x.node.at]) * 10 > total
    for n in nodes[1:]:
        if n.kind or n.name:
            marked[n.at] = n.soft and (said or mass[n.at] * 2 <= total) or n.tag not in _DECLARED and marked[n.parent.at]
    lines = [x for x in able if not marked[x.node.at]]
    if sum(len(x.text) for x in lines) * 10 <= total and not any(declared[x.node.at] for x in lines):
        lines = able
    return lines or [x for x in every if not x.node.kind and not x.node.advert]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    every, nodes = lines_of(html)
    lines = unmarked(every, nodes)
    picked = content_lines(lines)
    top = region(lines, picked, nodes)
    keep = [True] * len(lines) if top is None else chosen(lines, picked, top, nodes)
    return " ".join(x.text for x, yes in zip(lines, keep, strict=True) if yes)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to (page_id, url, text, n_chars)."""

    def make(rows):
        for r in rows:
            text = main_text(r["html"])
            yield {"page_id": r["page_id"], "url": r["url"], "text": text, "n_chars": len(text)}

    return map_rows(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
