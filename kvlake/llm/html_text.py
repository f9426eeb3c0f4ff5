"""Main text of HTML pages by composite text density.

A page becomes a tree in one pass over its characters. Each node's density is its characters per tag, lowered by the
share of characters inside links (Sun, Song and Liao's composite text density, with their logarithm's base); a run of
text is a node of one tag. A node's sum adds up its children's densities. The container around the node with the largest
sum is the heart of the page, and its path to the body gives the thresholds for what lies beside it:

* branches that look like the path (same tag and class) and reach the least density on it belong to the text, too;
* inside the article (or <main>, or the box whose heading stands before the heart) so do headings, paragraphs, lists and
  tables beside the path, and boxes that are as dense as the article as a whole. A box of few characters a tag, such as
  comments or an advert without a telling name, stays out.

Menus, page headers, footers, asides, forms, scripts and the like are left out by tag or role, and so are boxes of which
a class or the id says nothing but advert, notice, comments ... (``cookie-banner``, not ``share-price-table``), and
blocks that are little else than links. A name that has such a word among others halves a node's density, no more.

Defined results: null or empty pages, and pages without text, give ''; text outside any block counts as a block of its own
between its neighbours; broken markup is read as far as tags can be told: an end tag without a start is passed over, a
tag that never ends is text; extra columns pass through. Time grows with the page's length alone.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kvlake.llm.common import arrow_map, table

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe textarea svg math object canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title head caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can be the heart of a page; for others it is the one of these around them.
CONTAINERS = frozenset("article body div main section td center".split())
LEFT_OUT = frozenset("head title nav header footer aside form fieldset button select option menu dialog label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that tell a box beside the text.
BOXES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments commentlist disqus respond reply replies feedback related recommended recommendations trending share sharing social search pagination pager toolbar skip copyright legal".split()
)
#: Words that say nothing of what a box holds.
PLAIN = frozenset("area article articles bar block bottom box buttons container content form group icons inner item items left link links list outer page panel post posts right row section site slot stories text top unit user wrap wrapper".split())
#: tag -> the tags that its start closes, and those beyond which it closes nothing.
_SCOPE = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_SCOPE = {k: (a.split(), b.split()) for k, (a, b) in _SCOPE.items()}


@lru_cache(4096)
def _boxed(names: str) -> tuple[bool, bool]:
    """Whether a class or id names nothing but a box beside the text, and whether a word of any does."""
    only = some = False
    for name in names.split():
        parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        hit = any(p in BOXES for p in parts)
        some |= hit
        only |= hit and all(p in BOXES or p in PLAIN for p in parts)
    return only, some


class Node:
    __slots__ = ("tag", "kids", "parent", "out", "named", "hinted", "kind", "chars", "tags", "link_chars", "link_tags", "density", "at", "end")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, named: bool = False, hinted: bool = False, kind: str = ""):
        self.tag, self.parent, self.out, self.named, self.hinted, self.kind = tag, parent, out, named, hinted, kind
        self.kids: list = []  # nodes and strings


def tokens(page: str):
    """(text, "", "") and (None, tag with a slash if it ends one, attributes) in page order; comments and raw content are left out."""
    at, n, last = 0, len(page), page.rfind(">")
    quotes = True  # until a tag's quotes turn out to swallow the rest of the page
    text = 0  # where the text before the next tag starts
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last and not page.startswith("<!--", lt):
            break
        if page.startswith("<!--", lt):
            if lt > text:
                yield page[text:lt], "", ""
            end = page.find("-->", lt + 4)
            at = text = n if end < 0 else end + 3
            continue
        m = _NAME.match(page, lt + 1)
        if m is None:
            if page[lt + 1 : lt + 2] not in ("!", "?", "/"):
                at = lt + 1  # a plain <
                continue
            end = page.find(">", lt)
        else:
            end = m.end()
            while quotes:
                stop = _STOP.search(page, end)
                if stop is None:
                    quotes = False
                elif stop[0] == ">":
                    end = stop.start()
                    break
                else:
                    end = page.find(stop[0], stop.end()) + 1
                    if not end:
                        quotes = False
            if not quotes:
                end = page.find(">", m.end())
        if lt > text:
            yield page[text:lt], "", ""
        at = text = end + 1
        if m is None:
            continue
        tag = m[2].lower()
        yield None, m[1] + tag, page[m.end() : end]
        if tag in RAW and not m[1]:
            close = _close(tag).search(page, at)
            at = text = n if close is None else close.end()
            yield None, "/" + tag, ""
    if text < n:
        yield page[text:], "", ""


@lru_cache(64)
def _close(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


class Open:
    """The open elements: a stack, and the places in it of each tag and of blocks, so that no end tag has to climb."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all in it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()

    def last(self, tags: list[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first_after(self, tags: list[str], place: int) -> int:
        """The outermost element of these tags inside ``place``, or 0."""
        found = (p[k] for t in tags if (p := self.at.get(t)) and (k := bisect_right(p, place)) < len(p))
        return min(found, default=0)


def parse(page: str) -> Node:
    """The page's tree. Text is decoded; what scripts and the like hold is gone."""
    root = Node("body", None)
    up = Open(root)
    for text, tag, attrs in tokens(page):
        if text is not None:
            up.stack[-1].kids.append(html.unescape(text))
            continue
        if tag[0] == "/":
            tag = tag[1:]
            place = up.last([tag])
            # a stray end tag closes nothing; an end tag of an inline element doesn't close blocks
            if place and (tag in BLOCKS or not up.blocks or up.blocks[-1] < place):
                up.cut(place)
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS and tag not in ("li", "dd", "dt", "td", "th") and up.blocks:
            block = up.stack[up.blocks[-1]].tag
            if block == "p" or (tag in HEADINGS and block in HEADINGS):
                up.cut(up.blocks[-1])
        if tag in _SCOPE:
            own, bound = _SCOPE[tag]
            limit = up.last(bound)
            place = up.first_after(own, limit) if tag == "tr" else up.last(own)
            if place > limit:
                up.cut(place)
        out, named, hinted, kind = tag in LEFT_OUT, False, False, ""
        if "=" in attrs or "hidden" in attrs:
            a = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
            kind = a.get("class", "")
            named, hinted = _boxed(f"{kind} {a.get('id', '')}")
            out = out or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        node = Node(tag, up.stack[-1], out, named, hinted, kind)
        up.stack[-1].kids.append(node)
        # HTML has no self-closing blocks
        if tag not in VOID and (tag in BLOCKS or not attrs.rstrip().endswith("/")):
            up.push(node)
    return root


def _count(root: Node) -> list[Node]:
    """Characters, tags, link characters and link tags of each node, without what is left out; all nodes, parents first, in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        n.at = len(order)
        order.append(n)
        stack.extend(k for k in reversed(n.kids) if type(k) is Node)
    holds = set()
    for n in order:
        if n.tag in ("article", "main"):
            while n is not None and n not in holds:
                holds.add(n)
                n = n.parent
    for n in order:
        if n.named and n not in holds:
            n.out = True
        if n.parent is not None and n.parent.out:
            n.out = True
    for n in order:
        n.end = n.at
    for n in reversed(order):
        if n.parent is not None:
            n.parent.end = max(n.parent.end, n.end)
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        if n.out:
            continue
        for k in n.kids:
            if type(k) is str:
                n.chars += _chars(k)
            elif not k.out:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        elif n.tag in ("ul", "ol", "div", "section", "p", "table") and n.link_tags >= 3 and n.link_chars >= 0.8 * n.chars and n.parent is not None:
            # little else than links
            n.out = True
            n.chars = n.tags = n.link_chars = n.link_tags = 0
    return order


def _chars(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n")


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body: Node) -> float:
    """Characters per tag, times the logarithm of characters per link character and tags per link tag. A count of 0 below a fraction is 1, as in the paper."""
    if not chars:
        return 0.0
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    rest = max(chars - link_chars, 1)
    base = math.log(chars / rest * lc + body.link_chars / max(body.chars, 1) * chars + math.e)
    return max(chars / t * math.log(max(chars / lc * t / lt, 1.0)) / math.log(base), 0.0)


def heart(root: Node) -> list[Node | str]:
    """The subtrees and runs of text that hold the main text, in page order."""
    order = [n for n in _count(root) if not n.out]
    for n in order:
        n.density = composite_density(n.chars, n.tags, n.link_chars, n.link_tags, root) * (0.5 if n.hinted else 1.0)
    best, most = root, 0.0
    for n in order:
        total = sum(k.density if type(k) is Node else composite_density(_chars(k), 1, 0, 0, root) for k in n.kids if type(k) is str or not k.out)
        if total > most:
            best, most = n, total
    while best.tag not in CONTAINERS:
        best = best.parent
    path = [best]
    while path[-1] is not root:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    frame = _frame(path)
    found: list[tuple[int, int, Node | str]] = [(best.at, 0, best)]  # a run of text lies after the node before it
    for n in path[:-1]:
        inside = frame is not None and frame.at < n.at <= frame.end
        place = n.parent.at
        for j, k in enumerate(n.parent.kids):
            if type(k) is str:
                if inside and k.strip():
                    found.append((place, j + 1, k))
                continue
            place = k.end
            if k.out or k is n:
                continue
            alike = k.tag == n.tag and k.kind == n.kind and k.tag in CONTAINERS
            if alike and (k.kind or k.tag != "div" or not inside):
                take = k.density >= least
            elif inside:
                take = k.tag not in CONTAINERS or (k.density >= frame.density > 0)
            else:
                take = False
            if take:
                found.append((k.at, 0, k))
    found.sort(key=lambda x: x[:2])
    return [x for _, _, x in found]


def _frame(path: list[Node]) -> Node | None:
    """The article around the heart, else its <main>, else the box in which a heading stands before it; None if there is none but the heart itself."""
    for tag in ("article", "main"):
        for n in path:
            if n.tag == tag:
                return n
    if len(path) > 1:
        before = path[1].kids[: next(j for j, k in enumerate(path[1].kids) if k is path[0])]
        if any(type(k) is Node and k.tag in HEADINGS and not k.out for k in before):
            return path[1]
    return None


def block_texts(n: Node | str) -> list[str]:
    """The blocks of a subtree or a run of text in page order: white space turned into single spaces, empty blocks left out."""
    blocks: list[list[str]] = [[]]
    stack: list = [n]
    while stack:
        x = stack.pop()
        if type(x) is str:
            blocks[-1].append(x)
        elif x is None:
            blocks.append([])
        elif not x.out:
            if x.tag == "br":
                blocks[-1].append(" ")
            elif x.tag in BLOCKS:
                blocks.append([])
                stack.append(None)
                stack.extend(reversed(x.kids))
            else:
                stack.extend(reversed(x.kids))
    texts = (" ".join("".join(b).split()) for b in blocks)
    return [t for t in texts if t]


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    return "\n".join(t for n in heart(parse(page)) for t in block_texts(n))


def extracted(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the page), then text and n_chars. A kept column of these names is replaced."""
    keep = [c for c in (keep or pages.columns) if c not in (html_col, "text", "n_chars")]
    rows = pages.select(html_col, *keep)

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(1, batch.num_columns)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return arrow_map(rows, extract, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["text string, n_chars bigint"]), 0)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
