"""Main text of web pages by union-free wrappers of their hosts.

A page is read as a tree of block elements and text slots.  Neighbouring
siblings (or groups of up to ``GROUP`` siblings) that repeat become one
repeated group.  The pages of a host are aligned one after the other: matching
elements are merged, elements that only one side has become optional, and
slots whose text differs lose their constant text.  What is left is a
union-free expression, the wrapper of the host.

A page is then aligned with its host's wrapper.  Slots that hold the same text
on all pages, three different ones at least, are template; what remains in the main container, outside of
parts that are marked as menus, notices and the like, is the article.

Wrappers are merged inside each task first, so that a host, however many pages
it has, sends one wrapper for each task to the merge.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, utf8

#: Siblings in a repeated group at most, depth at which nesting is flattened, pages that make a text template.
GROUP, DEPTH, TEMPLATE_PAGES = 4, 120, 3
#: Bytes of wrappers up to which they are broadcast; beyond it pages and wrappers are joined by host.
BROADCAST_BYTES = 8 << 20

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|svg|iframe|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
WORD = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements inside a line of text, and those without an end tag.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = set("area base br col embed hr img input link meta param source track".split())
#: An opening tag of the first kind ends an open one of the second, up to the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"datalist"}),
}
#: Parts that are never the article: by element, by role, and by words of class and id.
OUTSIDE = set("nav footer aside form button head dialog fieldset menu figcaption".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
MARKED = set(
    """nav navbar navigation navi menu menubar breadcrumb breadcrumbs pagination pager toc skip footer foot bottombar topbar masthead header siteheader
    sidebar aside rail widget widgets related recommended recommendations trending popular teaser teasers more
    ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promoted banner banners
    cookie cookies consent gdpr notice notices alert alerts popup modal overlay subscribe subscription newsletter signup login paywall
    comment comments commentlist respond reply replies disqus discussion share sharing social follow likes form search hidden copyright legal""".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT = set("article content main post entry story body text maincontent articlebody postcontent entrycontent".split())


class Node:
    """An element, or a text slot (key ``#``)."""

    __slots__ = ("key", "tag", "marked", "content", "children", "text", "links")

    def __init__(self, key: str, tag: str = "", marked: bool = False, content: bool = False):
        self.key, self.tag, self.marked, self.content = key, tag, marked, content
        self.children: list[Node] = []
        self.text, self.links = "", 0


def _element(tag: str, attributes: str) -> Node:
    words, role, hidden = [], "", False
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = "".join(values).lower(), name.lower()
            if name in ("class", "id"):
                words += WORD.findall(value)
            elif name == "role":
                role = value.strip()
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "")
            else:
                hidden |= name == "hidden" or value == "true"
    named = set(words)
    marked = hidden or tag in OUTSIDE or role in ROLES or bool(named & MARKED) and tag not in ("body", "html", "article", "main")
    content = tag in ("article", "main") or role in ("main", "article") or bool(named & CONTENT) and tag in ("div", "section", "td")
    return Node(" ".join([tag, *sorted(named)]), tag, marked, content)


def parse(page: str | None) -> Node:
    """The tree of block elements; text between them becomes slots with decoded text."""
    root = Node("root")
    if not page:
        return root
    stack, parts, at, links, anchors = [root], [], 0, 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                slot = Node("#")
                slot.text, slot.links = text, min(links, len(text))
                stack[-1].children.append(slot)
            parts.clear()
        links = 0

    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if anchors:
                links += len(piece.strip())
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag not in INLINE and tag not in VOID:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        flush()
                        del stack[k:]
                        break
                else:
                    if tag == "p":
                        flush()
            continue
        if tag == "a":
            anchors = 1
            continue
        if tag in INLINE:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        anchors = 0
        if stack[-1].tag == "p":
            stack.pop()
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stop:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
                    break
        node = _element(tag, m.group(4))
        stack[-1].children.append(node)
        if len(stack) < DEPTH and not m.group(4).endswith("/"):
            stack.append(node)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return root


# Wrappers are plain lists, so that they travel as JSON:
#   [key, pages, constant text or None, repeated, children]
# While they grow, pages is a list of digests of different pages, TEMPLATE_PAGES at most; in the end it is their number.


def digest(page: str) -> int:
    return int.from_bytes(hashlib.blake2b(utf8(page), digest_size=6).digest())


def wrapper_of(node: Node, page: int = 0) -> list:
    """The expression of one page, whose digest is ``page``: repeated groups are folded."""
    if node.key == "#":
        return ["#", [page], node.text, False, []]
    return [node.key, [page], None, False, _folded([wrapper_of(c, page) for c in node.children])]


def counted(wrapper: list) -> list:
    """The wrapper with numbers of pages."""
    return [wrapper[0], len(wrapper[1]), wrapper[2], wrapper[3], [counted(c) for c in wrapper[4]]]


def _pages(a: list[int], b: list[int]) -> list[int]:
    """Different pages of both; equal pages are one, and more than ``TEMPLATE_PAGES`` need not be told apart."""
    if len(a) >= TEMPLATE_PAGES or a == b:
        return a
    return b if len(b) >= TEMPLATE_PAGES else sorted({*a, *b})[:TEMPLATE_PAGES]


def _folded(items: list[list]) -> list[list]:
    """Fold neighbouring groups of equal keys into one repeated group."""
    out: list[list] = []
    for item in items:
        out.append(item)
        for size in range(1, GROUP + 1):
            if len(out) >= 2 * size and all(out[-k][0] == out[-k - size][0] for k in range(1, size + 1)):
                last = out[-size:]
                del out[-size:]
                for k in range(size):
                    out[len(out) - size + k] = _joined(out[len(out) - size + k], last[k], same_page=True)
                break
    return out


def _joined(a: list, b: list, same_page: bool = False) -> list:
    pages = max(a[1], b[1], key=len) if same_page else _pages(a[1], b[1])
    constant = a[2] if a[2] == b[2] else None
    return [a[0], pages, constant, a[3] or b[3] or same_page, _aligned(a[4], b[4], same_page)]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of two lists of keys, as pairs of places."""
    start, ends = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while ends < min(len(a), len(b)) - start and a[-1 - ends] == b[-1 - ends]:
        ends += 1
    inner_a, inner_b = a[start : len(a) - ends], b[start : len(b) - ends]
    out = [(k, k) for k in range(start)]
    if inner_a and inner_b:
        n, m = len(inner_a), len(inner_b)
        if n * m <= 250_000:
            best = [[0] * (m + 1) for _ in range(n + 1)]
            for i in range(n - 1, -1, -1):
                for j in range(m - 1, -1, -1):
                    best[i][j] = best[i + 1][j + 1] + 1 if inner_a[i] == inner_b[j] else max(best[i + 1][j], best[i][j + 1])
            i = j = 0
            while i < n and j < m:
                if inner_a[i] == inner_b[j]:
                    out.append((start + i, start + j))
                    i, j = i + 1, j + 1
                elif best[i + 1][j] >= best[i][j + 1]:
                    i += 1
                else:
                    j += 1
        else:
            out += [(start + i, start + j) for i, j in _wide_matches(inner_a, inner_b)]
    return out + [(len(a) - ends + k, len(b) - ends + k) for k in range(ends)]


def _wide_matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The same pairs for wide lists: rows of the table as arrays; one in ``step`` is kept, the others are made again on the way."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(key, len(number)) for key in keys], np.int32) for keys in (a, b))
    n, m = len(x), len(y)
    step = math.isqrt(n) + 1

    def above(i: int, below: np.ndarray) -> np.ndarray:
        row = np.append(np.where(y == x[i], below[1:] + 1, below[:-1]), np.int32(0))
        return np.maximum.accumulate(row[::-1])[::-1]

    row = np.zeros(m + 1, np.int32)
    kept = {n: row}
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            kept[i] = row
    out, i, j, rows = [], 0, 0, {}
    while i < n and j < m:
        if i + 1 not in rows:
            end = min(n, (i // step + 1) * step)
            rows = {end: kept[end]}
            for k in range(end - 1, i - 1, -1):
                rows[k] = above(k, rows[k + 1])
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _aligned(a: list[list], b: list[list], same_page: bool) -> list[list]:
    """Merge two lists of items; what only one has stays, with fewer pages than its parent (optional)."""
    out, i, j = [], 0, 0
    for x, y in [*matches([n[0] for n in a], [n[0] for n in b]), (len(a), len(b))]:
        out += a[i:x] + b[j:y]
        if x < len(a):
            out.append(_joined(a[x], b[y], same_page))
        i, j = x + 1, y + 1
    return _folded(out) if same_page or len(out) > max(len(a), len(b)) else out


def template_slots(node: Node, wrapper: list, found: set[int]) -> None:
    """Collect the slots of a page that the wrapper has as constant text."""
    for i, j in matches(_runs(node.children), [c[0] for c in wrapper[4]]):
        item = wrapper[4][j]
        for child in _run(node.children, i):
            if child.key == "#":
                if item[2] is not None and item[1] >= TEMPLATE_PAGES:
                    found.add(id(child))
            else:
                template_slots(child, item, found)


def _runs(children: list[Node]) -> list[str]:
    return [c.key for k, c in enumerate(children) if not k or children[k - 1].key != c.key]


def _run(children: list[Node], n: int) -> list[Node]:
    out, k = [], -1
    for i, c in enumerate(children):
        if not i or children[i - 1].key != c.key:
            k += 1
        if k == n:
            out.append(c)
        elif k > n:
            break
    return out


def extract(page: str | None, wrapper: list | None) -> str:
    """The article of one page."""
    root = parse(page)
    template: set[int] = set()
    if wrapper is not None and wrapper[1] >= TEMPLATE_PAGES:
        template_slots(root, wrapper, template)
    blocks: list[tuple[Node, tuple[Node, ...], bool]] = []

    def walk(node: Node, path: tuple[Node, ...], outside: bool) -> None:
        for child in node.children:
            if child.key == "#":
                if not outside and id(child) not in template:
                    blocks.append((child, path, 2 * child.links > len(child.text) + 2))
            else:
                head = child.tag == "header" and not any(n.tag in ("article", "main") for n in path)
                walk(child, (*path, child), outside or child.marked or head)

    walk(root, (), False)
    if not blocks:
        return ""
    # The main container: the marked one with the most text that is not links, else the one whose own blocks have the most.
    weight: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for slot, path, linked in blocks:
        if linked:
            continue
        for depth, node in enumerate(reversed(path)):
            nodes[id(node)] = node
            weight[id(node)] = weight.get(id(node), 0.0) + (len(slot.text) if node.content else len(slot.text) / 4**depth / 1000)
    marked = [k for k, n in nodes.items() if n.content]
    deep = {id(n): d for _, path, _ in blocks for d, n in enumerate(path)}
    main = None
    if marked:
        articles = [k for k in marked if nodes[k].tag == "article"]
        most = max(weight[k] for k in marked)
        pool = [k for k in articles if weight[k] >= 0.4 * most] or [k for k in marked if weight[k] >= 0.7 * most]
        main = max(pool, key=lambda k: (weight[k], deep[k]))
    elif nodes:
        holders = [k for k in nodes if nodes[k].tag not in HEADINGS | {"p", "li", "html"}]
        main = max(holders, key=lambda k: (weight[k], deep[k]), default=None)
    kept = [(s, linked) for s, path, linked in blocks if main is None or any(id(n) == main for n in path)]
    out = [s.text for s, linked in kept if not linked]
    return "\n\n".join(out or [s.text for s, _ in kept])


def host(url: Column) -> Column:
    """Host of an address, lower case; null or none: empty."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, wrapper`` (JSON): every page counts, equal ones as one."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = wrapper_of(parse(text), digest(text))
                own[name] = _joined(own[name], page) if name in own else page
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([json.dumps(w) for w in own.values()], pa.string())], names=["host", "wrapper"])

    def merge(group: pa.Table) -> pa.Table:
        whole = None
        for text in sorted(group.column("wrapper").to_pylist()):
            one = json.loads(text)
            whole = one if whole is None else _joined(whole, one)
        return pa.table({"host": [group.column("host")[0].as_py()], "wrapper": [json.dumps(counted(whole))]})

    rows = pages.select(host(pages[url]).alias("host"), pages[html].cast("string").alias("html")).where(F.col("html").isNotNull())
    return rows.mapInArrow(fold, "host string, wrapper string").groupBy("host").applyInArrow(merge, "host string, wrapper string")


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page: ``key, url, text, n_chars``.

    Blocks stand in page order, two newlines between them.  A page that is
    null, empty or has no article gets an empty text.  Pages without a host
    share one wrapper; null keys and addresses and repeated rows stay as they
    are (identical pages are one example of their host); an empty table
    gives no rows; other columns are not read.
    """
    wrappers = cut_lineage(infer_wrappers(pages, url, html))
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (key, url)]
    rows = pages.select(pages[key], pages[url], host(pages[url]).alias("__host"), pages[html].cast("string").alias("__html"))
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, rows["__host"] == wrappers["host"], "left").select(key, url, "__html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            out = []
            for page, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if text is not None and text not in known:
                    if len(known) > 256:
                        known.clear()
                    known[text] = json.loads(text)
                out.append(extract(page, known.get(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[key, url, "text", "n_chars"])

    return joined.mapInArrow(run, ", ".join(kinds) + ", text string, n_chars long")
