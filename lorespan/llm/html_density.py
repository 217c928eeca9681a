"""Main text of web pages by composite text density.

A page becomes a tree of nodes. A node's composite density is its characters per tag, weighed down
by the part of them that is in links:

    C / T * log(base, C / LC * T / LT),  base = ln(C / NC * LC + LCb / Cb * C + e)

with C, T characters and tags, LC, LT those in links, NC = C - LC, and LCb, Cb those of the body. A
node's density sum adds up its children's densities. The node with the largest sum holds the text; the
least density on its path to the body is the threshold below which other nodes count as noise. The
content is the largest-sum node of each subtree above the threshold, and of it all but parts that
are marked as something else (navigation, adverts, forms, comments and the like). Where the text with
the largest sum stands in paragraphs, others without any aren't of it, however dense. The title and
headings right before the content belong to it, and so do columns beside it whose paragraphs are like its own.

A mark is an element or a role of that meaning, or a class or id all of whose words say so ("ad",
"cookie-notice", "post-comments", but not "promo-free" or "alert-fatigue"). A form or such a name doesn't
count for what holds most of a page's open text, unless an article stands outside it (a wrapper isn't a
sidebar, but a sidebar longer than its article is). Comments are comments however long they are, but for
what holds the page's h1 or main. Lists of teasers (a heading, then headings that all link elsewhere) are
marked, too, unless they are most of the page.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from lorespan.llm.common import plain, small_batches, utf8

# Fixed values of HTML: elements without an end tag, elements that break a line, elements without readable text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center caption dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select option button textarea input datalist".split())
CLOSES = {"p": frozenset(BLOCK - {"br", "option", "optgroup"}), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Elements, roles, and words in class or id names that mark what is no article.
ASIDE = frozenset("nav aside footer menu dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARKS = frozenset(
    "ad ads adbox adbanner advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus"
    " footer gdpr masthead menu menubar nav navbar navigation newsletter notice popup modal overlay promo promoted promotion related recommended replies respond"
    " share sharing sidebar sidenav skip social sponsor sponsored subscribe subscription toolbar topbar widget login signup alert"
    " toc pagination pager bottombar siteheader sitefooter pageheader pagefooter".split()
)
REMARKS = frozenset("comment comments commentlist disqus replies respond".split())
READERS = frozenset("reader readers user users visitor visitors".split())
ANSWERS = frozenset("reaction reactions response responses opinions voices letters discussion".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that go with marks in names, and elements that hold text.
BESIDE = frozenset("box wrap wrapper container inner outer section list item area block bar panel top bottom left right links buttons posts articles post article site page global main form slot unit zone user number body text thread".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption summary".split())
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None = None
    marked: bool = False
    named: bool = False  # marked by a name only, or a form
    remark: bool = False  # readers' comments by name
    away: bool = False  # a link to elsewhere
    block: Node | None = None  # the nearest element that breaks a line or is silent, itself included
    parts: list = field(default_factory=list)  # texts and nodes in order
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    blocks: int = 0  # blocks in it, line breaks aside
    open: int = 0  # characters outside of marked elements
    written: int = 0  # characters in paragraphs and the like
    titles: int = 0  # h1 and main with text in it
    heads: int = 0  # other headings with text
    leads: int = 0  # those all of whose text links elsewhere
    lead_first: bool | None = None  # whether the first heading does
    away_chars: int = 0  # characters that link elsewhere
    density: float = 0.0
    total: float = 0.0


def _words(attrs: dict[str, str | None]) -> list[list[str]]:
    """The words of each class and id."""
    return [_NAME.findall(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", x).lower()) for value in (attrs.get("class"), attrs.get("id")) for x in (value or "").split()]


def _readers(words: list[str]) -> bool:
    return any(w in READERS for w in words) and any(w in ANSWERS for w in words) and all(w in READERS or w in ANSWERS or w in BESIDE for w in words)


def _says_so(words: list[str]) -> bool:
    """Whether all words of a class or id, one of them at least a mark, say that it is no article text."""
    return _readers(words) or any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words)


def marked(tag: str, attrs: dict[str, str | None], parent: Node) -> bool:
    """Whether an element is of a kind that is no article text, or hidden."""
    if tag in ASIDE or tag in SILENT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or ""):
        return True
    if tag == "header":  # that of an article belongs to it
        at = parent
        while at and at.tag not in ("article", "main"):
            at = at.parent
        return at is None
    return False


def named(tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether an element's class or id says that it is no article text; a form is none either, unless it wraps the page."""
    if tag in ("body", "html", "article", "main"):
        return False
    return tag == "form" or any(map(_says_so, _words(attrs)))


def remark(tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether an element's class or id says that readers wrote it; an article can be such a comment."""
    if tag in ("body", "html", "main"):
        return False
    return any(_readers(w) or _says_so(w) and any(x in REMARKS for x in w) for w in _words(attrs))


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")
        self.root.block = self.root
        self.open: Counter = Counter()
        self.body: Node | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag == "body":
            if self.body is None:
                self._leave(self.root)
                self.at = self.body = self._new(tag, {})
            return
        at = self.at
        while at.parent and tag in CLOSES.get(at.tag, ()):
            at = at.parent
        # an open paragraph ends below inline elements, too
        up = at.block
        if up.tag == "p" and tag in CLOSES["p"] and up.parent:
            at = up.parent
        self._leave(at)
        new = self._new(tag, dict(attrs))
        if tag not in VOID:
            self.at = new
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _new(self, tag: str, attrs: dict) -> Node:
        node = Node(tag, self.at, marked(tag, attrs, self.at), named(tag, attrs), remark(tag, attrs))
        node.away = tag == "a" and not (attrs.get("href") or "#").strip().startswith("#")
        node.block = node if tag in BLOCK or tag in SILENT else self.at.block
        self.at.parts.append(node)
        return node

    def _leave(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or self.open[tag] <= 0:
            return
        at = self.at
        while at.parent and at.tag != tag:
            if at.tag == "body":
                return
            at = at.parent
        if at.parent and at.tag == tag:
            self._leave(at.parent)

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def measure(root: Node) -> list[Node]:
    """Fills in what densities need, bottom up; all nodes, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    for node in reversed(order):
        if node.tag in SILENT:
            continue
        for x in node.parts:
            if isinstance(x, Node):
                x.marked |= x.remark and not x.titles
                if x.tag not in SILENT:
                    node.blocks += x.blocks + (x.tag in BLOCK and x.tag != "br")
                    node.chars += x.chars
                    node.open += 0 if x.marked else x.open
                    node.written += x.chars if x.tag in PARAGRAPHS else x.written
                    node.tags += x.tags + 1
                    node.link_chars += x.link_chars
                    node.link_tags += x.link_tags + (x.tag == "a")
                    node.away_chars += x.away_chars
                    if not x.marked:
                        head = x.tag in HEADINGS and x.tag != "h1" and x.chars > 0
                        node.titles += x.titles + (x.tag in ("h1", "main") and x.chars > 0)
                        node.heads += x.heads + head
                        lead = head and x.away_chars == x.chars
                        node.leads += x.leads + lead
                        if node.lead_first is None:
                            node.lead_first = lead if head else x.lead_first
            else:
                n = len(_SPACE.sub(" ", x).strip())
                node.chars += n
                node.open += n
        if node.tag == "a":
            node.link_chars = node.chars
            node.away_chars = node.chars if node.away else 0
    return order


def weigh(order: list[Node], body: Node) -> None:
    share = body.link_chars / max(1, body.chars)
    for node in order:
        if not node.chars:
            continue
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        base = log(c / max(1, c - node.link_chars) * node.link_chars + share * c + e)
        node.density = c / t * log(max(1.0, c / lc * t / lt)) / log(max(base, 1.0001))
    for node in order:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node) and not x.marked)


def _within(node: Node, others) -> Node | None:
    """The nearest of others that is node or around it."""
    at: Node | None = node
    while at is not None and at not in others:
        at = at.parent
    return at


def _path(node: Node) -> list[Node]:
    """node and the nodes around it, up to the body."""
    path, at = [], node
    while at is not None and at.tag != "html":
        path.append(at)
        at = at.parent
    return path


def _whole(node: Node) -> Node:
    """The nearest block around an inline element that has no blocks in it: text beside it is of the same paragraph."""
    while node.tag not in BLOCK and not node.blocks and node.parent:
        node = node.parent
    return node


def _opened(body: Node, within: bool = False) -> list[Node]:
    """The nodes in neither a marked nor, if not within, a named one; parents first, in page order."""
    out, stack = [], [body]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.parts) if isinstance(x, Node) and not x.marked and (within or not x.named))
    return out


def _unname(order: list[Node], body: Node) -> None:
    """Marks what a name says is something else, but for what holds most of the page and has no article beside it."""
    free = _opened(body)
    text = any(n.tag in PARAGRAPHS and n.tag not in HEADINGS and n.open > n.link_chars for n in free)
    article = text and any(n.tag in ("article", "main", "h1") and n.open for n in free)
    for node in order:
        node.marked |= node.named and (article or 2 * node.open <= body.open)


def _teasers(body: Node) -> None:
    """Marks lists of teasers: blocks in which all headings, but for the first at most, link elsewhere; and such blocks side by side."""
    for node in _opened(body, True):
        beside = [x for x in node.parts if isinstance(x, Node) and not x.marked and x.tag in BLOCK and x.chars]
        cards = set()
        for x in beside:
            if x.titles or x.tag in HEADINGS or not x.leads or 2 * x.open > body.open:
                continue
            if x.heads == x.leads or x.leads > 1 and x.heads == x.leads + 1 and not x.lead_first:
                cards.add(x)
        if sum(x.leads for x in cards) > 1 and 2 * sum(x.open for x in cards) <= body.open:
            for x, after in zip(beside, [*beside[1:], None], strict=True):
                x.marked |= x in cards or x.tag in HEADINGS and x.tag != "h1" and after in cards


def _titles(chosen: set[Node], path: list[Node]) -> None:
    """Adds the page's title and the headings right before what is chosen: of the blocks beside the path, the last h1 before it, if nothing chosen has one, and headings next to a chosen block."""
    titled = any(n.titles or n.tag == "h1" for n in chosen)
    for around, inner in zip(path[1:], path, strict=False):
        blocks = [x for x in around.parts if isinstance(x, Node) and not x.marked and x.chars and (x.tag in BLOCK or x is inner)]
        for x, after in reversed(list(zip(blocks, blocks[1:], strict=False))):
            if x.tag in HEADINGS and x.tag != "h1" and x.link_chars < x.chars and (after in chosen or after is inner):
                chosen.add(x)
        before = blocks[: next((i for i, x in enumerate(blocks) if x is inner), 0)]
        title = next((x for x in reversed(before) if x.tag == "h1" and x.link_chars < x.chars), None)
        if title and not titled:
            titled = True
            chosen.add(title)


def _like(node: Node, best: Node) -> bool:
    """Whether node is text in paragraphs at least half as long as those of best, with next to no links."""
    if 2 * node.written <= node.chars or 5 * node.link_chars > node.chars or best.tag in PARAGRAPHS:
        return False
    return 2 * node.chars * max(1, best.tags) >= best.chars * max(1, node.tags)


def content(root: Node, body: Node) -> list[Node]:
    """The nodes that hold the article, in page order: the one with the largest density sum and, of each subtree outside it that is as dense as its path, the one with that subtree's largest sum."""
    order = measure(root)
    _unname(order, body)
    _teasers(body)
    weigh(order, body)
    # what is marked, or in something marked, is no candidate
    candidates = _opened(body, True)
    best = max(candidates, key=lambda n: n.total)
    articles = {n for n in candidates if n.tag in ("article", "main") and n.chars}
    around = _within(best, articles)
    heads = {_within(n, articles) for n in candidates if n.tag == "h1" and n.chars}
    if around is None and len(articles) == 1 and heads == articles and _within(next(iter(articles)), {best}):
        around = next(iter(articles))  # a page's only article, with its only headings of the first rank, is not beside but in the densest node
    if around:  # an article around the densest node names its limits itself; others as dense as the path are parts of it
        least = min((n.density for n in _path(around) if n.density > 0), default=0.0)
        apart = {n for n in articles if n.density >= least and not _within(n, {around}) and not _within(around, {n})}
        return [n for n in order if n is around or n in apart and not (n.parent and _within(n.parent, apart))]
    best = _whole(best)
    path = _path(best)
    inside = set(path)
    threshold = min((n.density for n in path if n.density > 0), default=0.0)
    # beside text in paragraphs, blocks without any are noise
    if 2 * best.written > best.chars:
        below = {best}
        for node in order:  # parents come first
            if node.parent in below:
                below.add(node)
        for node in candidates:
            if node.tag in BLOCK and node.tag not in PARAGRAPHS and node.chars and not node.written and node not in inside and node not in below:
                node.marked = True
    # lists of links that are less dense are noise
    for node in candidates:
        if node.tag in BLOCK and node not in inside and node.link_tags > 1 and node.link_chars > 0.6 * node.chars and node.density < threshold:
            node.marked = True
    # where all blocks beside the path are as dense as its least dense node, the block around them is of the text with all it has
    for node in path[1:]:
        beside = [x for x in node.parts if isinstance(x, Node) and not x.marked and x.tag in BLOCK and x.chars]
        if sum(x.density >= threshold for x in beside if x not in inside) and all(x.density >= threshold or x in inside for x in beside):
            best = node
    # the largest sum of each subtree; of equal ones the outer node
    peak: dict[Node, Node] = {}
    for node in reversed(candidates):
        below = [peak[x] for x in node.parts if isinstance(x, Node) and not x.marked]
        peak[node] = max((node, *below), key=lambda n: n.total)
    chosen, open_ = {best}, [body]
    while open_:
        node = open_.pop()
        if node in chosen:
            continue
        if node not in inside and node.tag in BLOCK and node.chars and node.density >= threshold:
            chosen.add(_whole(peak[node]))
        if node not in chosen:
            open_.extend(x for x in node.parts if isinstance(x, Node) and not x.marked)
    if best is not body:
        # columns: blocks beside the densest one whose paragraphs are like its own
        held: set[Node] = set()
        for n in chosen:
            while n is not None and n not in held:
                held.add(n)
                n = n.parent
        for x in best.parent.parts if best.parent else ():
            if isinstance(x, Node) and x.tag == best.tag and not x.marked and x.chars and x not in held and _like(x, best):
                chosen.add(x)
        _titles(chosen, _path(best))
    return [n for n in order if n in chosen]


def _blocks(node: Node, out: list[list[str]]) -> None:
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif not (x.marked and x is not node):
            if x.tag in BLOCK:
                out.append([])
                stack.append(None)
            stack.extend(reversed(x.parts))


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in order, each with single spaces and trimmed, joined by single spaces; empty if there is none."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    body = tree.body or tree.root
    blocks: list[list[str]] = [[]]
    for node in content(tree.root, body):
        _blocks(node, blocks)
    return " ".join(x for x in (_SPACE.sub(" ", "".join(b)).strip() for b in blocks) if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages (page_id, url, html).

    Null, empty and broken html give what text they have, or an empty text; pages may be of any length
    and nest to any depth. Of nodes with equal sums the outer one counts. page_id may be of any type.
    Repeated rows come back as often, and equal pages alike; other columns are left aside; an empty
    table gives an empty one.
    """
    small_batches(pages.sparkSession)
    pages = plain(pages, "page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in utf8(batch.column("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
