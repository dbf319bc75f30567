"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged into one tree of style nodes: the path
of tags and classes that leads to an element, inner nodes as well as those
that hold text.  Copies of a page count once.  Over the host's pages a branch
(a style node with all below it) has

* presentation importance: the largest entropy of the child sequences of its
  nodes, as a share of the most that so many pages can have,
* content importance: one less ``log(pages with this text) / log(pages)``,
  averaged over the branch's characters,
* substance: its share of the characters of the pages that have it, and how
  much of it is not link text.

A branch is worth ``content * (1 - links) * max(presentation, share)``, which
needs no number of pages: on a host with one page content is 1, presentation
0, and the share decides.  Branches of less than ``least`` are cut whole.

A node most of whose text lies directly in its blocks is a text container:
what it holds is one run of text, so its blocks are not judged one by one and
a heading that every article has stays.  In the page's body itself they are,
by content and links only.

Elements that say what they are (``<nav>``, ``class="cookie-bar"``,
``<article>``) move their branch's worth by the weight ``prior``; with
``prior=0`` the tree decides alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN = re.compile(r"""[^>"']*+""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_MAIN = re.compile(r"""<main\b|\brole\s*=\s*["']?main\b""", re.I)
_DIGITS = re.compile(r"[0-9]+")

# Fixed values of HTML: elements without content, with raw content, that start
# a new block, and whose start ends an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
PARAGRAPH_SCOPE = ("td", "th", "table", "button", "object", "caption")
#: Elements that only shape a run of text.
FLOW = frozenset("ul ol dl li dd table tbody thead tfoot tr blockquote pre figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Elements, roles and words of classes and ids that name what is not main text.
NOISE_TAGS = frozenset(
    "head object embed canvas button input select nav footer aside menu dialog".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
NOISE_WORDS = frozenset(
    "ad ads nav side sidebar footer menu banner notice notices alert gdpr consent popup modal overlay share sharing social related"
    " recommended teaser teasers toolbar pager pagination login signup search copyright disclaimer reply replies respond disqus"
    " widget widgets".split()
)
NOISE_STARTS = (
    "advert", "breadcrumb", "comment", "cookie", "footer", "menu", "navbar", "navigation", "newsletter", "promo", "sidebar",
    "sponsor", "subscri",
)
#: Words that name the page's own header, which an article may have too.
HEADER_WORDS = frozenset(["header", "masthead"])
#: Words that may stand beside a noise word in one class without changing it.
FRAME_WORDS = frozenset(
    "area bar block bottom box button buttons container content footer global group header inner item items left links list main"
    " outer page panel post primary reader right section secondary site slot top user wrap wrapper".split()
)
#: Elements nested more deeply belong to the style node at this depth.
DEPTH = 512
NEUTRAL, NOISE, HEADER, FORM, MAIN, INSIDE = range(6)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def named_kind(names: str) -> int:
    """What a class or id attribute names: all parts of one of its words have
    to be noise or frame, so ``side-effects`` names nothing."""
    kind = NEUTRAL
    for word in names.lower().split():
        parts = [x for x in re.split(r"[-_0-9]+", word) if x]
        noise = [x in NOISE_WORDS or x.startswith(NOISE_STARTS) for x in parts]
        if any(noise) and all(n or x in FRAME_WORDS for n, x in zip(noise, parts)):
            return NOISE
        if parts and parts[-1] in HEADER_WORDS and all(x in HEADER_WORDS or x in FRAME_WORDS for x in parts):
            kind = HEADER
    return kind


class Node:
    """An element.  Elements alike in path are one style node."""

    __slots__ = ("tag", "parent", "kind", "path", "depth", "gone", "hidden", "linked", "children", "main", "noisy")

    def __init__(self, tag: str, style: str, parent: "Node | None", kind: int, gone: frozenset):
        self.tag, self.parent, self.kind = tag, parent, kind
        self.children = 0
        self.hidden = self.linked = self.main = self.noisy = False
        if parent is None:
            self.path, self.depth, self.gone = xxhash.xxh3_64_intdigest(style), 0, False
            return
        self.depth = min(parent.depth + 1, DEPTH)
        self.path = xxhash.xxh3_64_intdigest(style, parent.path) if parent.depth < DEPTH else parent.path
        self.gone = parent.gone or self.path in gone
        self.hidden, self.linked = parent.hidden, parent.linked or tag in ("a", "button", "option")
        self.main = kind in (MAIN, INSIDE)
        self.noisy = parent.noisy or kind == NOISE


_STYLES: dict[tuple[str, str], tuple[str, int, bool]] = {}


def style_of(tag: str, rest: str) -> tuple[str, int, bool]:
    """Style of an element, the kind that it says it is, and whether it is
    hidden.  Digits in classes are dropped."""
    known = _STYLES.get((tag, rest))
    if known:
        return known
    found = attributes(rest) if rest.strip(" /") else {}
    classes, role = found.get("class", "").lower(), found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    kind = max((named_kind(x) for x in (classes, found.get("id", ""))), key=(NEUTRAL, HEADER, NOISE).index)
    if tag in NOISE_TAGS or role in NOISE_ROLES:
        kind = NOISE
    elif kind == NEUTRAL and tag in ("header", "form"):
        kind = HEADER if tag == "header" else FORM
    elif kind != NOISE and (tag in ("main", "article") or role in ("main", "article")):
        kind = MAIN
    if tag in ("html", "body"):
        kind = NEUTRAL
    style = f"{tag}.{'.'.join(sorted(set(_DIGITS.sub('', classes).split())))}"
    if len(_STYLES) > 20_000:
        _STYLES.clear()
    _STYLES[tag, rest] = style, kind, hidden
    return style, kind, hidden


def parse(page: str, gone: frozenset = frozenset()) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """Blocks of text in page order, each with the element that holds it and
    its characters in links, and all elements.  Text of hidden elements and of
    style nodes in ``gone`` is left out.  Takes time linear in the page."""
    has_main = bool(_MAIN.search(page))
    root = Node("#root", "", None, NEUTRAL, gone)
    stack, nodes = [root], [root]
    open_at: dict[str, list[int]] = {}
    blocks: list[tuple[Node, str, int]] = []
    held: list[str] = []
    owner, links = root, 0
    last_end, last_quote, quoted = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}, True

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((owner, text, min(links, len(text))))
            links = 0

    def text(piece: str) -> None:
        nonlocal owner, links
        top = stack[-1]
        if top.hidden or top.gone:
            return
        if not held or held == [" "]:
            owner = top
        held.append(piece)
        if top.linked:
            links += len(piece)

    def close(depth: int) -> None:
        for node in stack[depth:]:
            open_at[node.tag].pop()
        del stack[depth:]

    def find(tags: tuple, stops: tuple) -> int:
        at = lambda names: max((open_at[t][-1] for t in names if open_at.get(t)), default=0)
        k = at(tags)
        return k if k > at(stops) else 0

    def tag_end(start: int) -> int:
        """Where the tag whose attributes start here ends, past quoted values;
        after a quote that never closes, quotes count for nothing."""
        nonlocal quoted
        at = start
        while quoted:
            at = _PLAIN.match(page, at).end()
            if at >= len(page):
                quoted = False
            elif page[at] == ">":
                return at
            elif last_quote[page[at]] <= at:
                quoted = False
            else:
                at = page.find(page[at], at + 1) + 1
        return page.find(">", start)

    at, end = 0, len(page)
    while at < end:
        begin = page.find("<", at)
        if begin < 0 or begin > last_end:
            text(page[at:])
            break
        if begin > at:
            text(page[at:begin])
        if page.startswith("<!--", begin):
            done = page.find("-->", begin + 4)
            at = done + 3 if done >= 0 else end
            continue
        found = _NAME.match(page, begin + 1)
        if not found:
            if page[begin + 1 : begin + 2] in ("!", "?", "/"):
                at = page.find(">", begin) + 1
            else:
                text("<")
                at = begin + 1
            continue
        tag = found[2].lower()
        stop = tag_end(found.end())
        rest, at = page[found.end() : stop], stop + 1
        if found[1]:
            k = open_at[tag][-1] if open_at.get(tag) else 0
            if k:
                if any(n.tag in BLOCK or n.kind == NOISE or n.hidden or n.gone for n in stack[k:]):
                    flush()
                close(k)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK:
            flush()
            # a block ends an open paragraph; items and cells end their like
            if open_at.get("p") and (k := find(("p",), PARAGRAPH_SCOPE)):
                close(k)
            if tag in ENDS and (k := find(*ENDS[tag])):
                close(k)
        top = stack[-1]
        if tag in RAW:
            shut = re.compile(rf"</{tag}\b[^>]*+>", re.I).search(page, at)
            at = shut.end() if shut else end
            top.children = xxhash.xxh3_64_intdigest(tag, top.children)
            continue
        style, kind, hidden = style_of(tag, rest)
        if top.main and kind in (NEUTRAL, HEADER, MAIN):
            kind = INSIDE
        elif kind == MAIN and (has_main or top.noisy) and tag != "main" and not _MAIN.search(f"<{tag}{rest}"):
            # an article beside the main part, or in a list of comments
            kind = NEUTRAL
        node = Node(tag, f"{style}.{kind}", top, kind, gone)
        node.hidden = node.hidden or hidden
        if (node.hidden, node.gone) != (top.hidden, top.gone):
            flush()
        top.children = xxhash.xxh3_64_intdigest(style, top.children)
        nodes.append(node)
        if tag not in VOID and not rest.endswith("/"):
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(node)
    flush()
    return blocks, nodes


def block_of(node: Node) -> Node:
    while node.parent and node.tag not in BLOCK:
        node = node.parent
    return node


def _host(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?", "", (url or "").lower()).partition("/")[0].partition("?")[0].partition("#")[0]


def host_of(url: Column) -> Column:
    """The same as a column."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?", "")
    return F.regexp_extract(bare, r"^[^/?#]*", 0)


NODE = "struct<path:long,parents:array<long>,near:array<long>,children:long,kind:int,place:int>"
TEXT = "struct<path:long,content:long,chars:long,links:long>"
PAGE_SCHEMA = f"host string, page long, chars long, nodes array<{NODE}>, texts array<{TEXT}>"
#: Where a style node stands: a block in a text container, a block in the
#: body, a heading, the page itself.
_ROOT, _FLOW, _HEADING = 1, 2, 4


def page_row(page: str) -> tuple[int, int, list, list] | None:
    """A page's part of the style tree: a hash of all its blocks, its
    characters, its style nodes and its blocks."""
    blocks, elements = parse(page)
    if not blocks:
        return None
    texts, total = [], 0
    for node, text, links in blocks:
        texts.append((block_of(node).path, xxhash.xxh3_64_intdigest(text), len(text), links))
        total += len(text)
    # elements alike in path are one style node with all their child sequences
    merged: dict[int, list] = {}
    for node in elements:
        own = merged.get(node.path)
        if own is None:
            parents, near, up, reaches = [], [], node.parent, True
            while up is not None:
                if up.path != node.path and (not parents or parents[-1] != up.path):
                    parents.append(up.path)
                    if reaches:
                        near.append(up.path)
                        reaches = up.tag in FLOW or up.tag not in BLOCK
                up = up.parent
            root = node.parent is None or node.tag in ("html", "body")
            place = root * _ROOT | (node.tag in FLOW) * _FLOW | (node.tag in HEADINGS) * _HEADING
            merged[node.path] = [node.path, parents, near, node.children, node.kind, place]
        else:
            own[3] = xxhash.xxh3_64_intdigest(node.children.to_bytes(8), own[3])
    shape = xxhash.xxh3_64_intdigest(np.array([x[:2] for x in texts], np.uint64).tobytes())
    return shape, total, list(merged.values()), texts


def _lists(rows: list[list], build) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), build([x for r in rows for x in r]))


def _longs(values) -> pa.Array:
    return pa.array(np.fromiter(values, np.uint64).view(np.int64))


def style_rows(pages: DataFrame) -> DataFrame:
    """``PAGE_SCHEMA`` rows of the pages with text."""

    def nodes(rows: list) -> pa.StructArray:
        parts = [_longs(r[0] for r in rows), *(_lists([r[k] for r in rows], _longs) for k in (1, 2)), _longs(r[3] for r in rows)]
        parts += [pa.array([r[k] for r in rows], pa.int32()) for k in (4, 5)]
        return pa.StructArray.from_arrays(parts, names=["path", "parents", "near", "children", "kind", "place"])

    def texts(rows: list) -> pa.StructArray:
        parts = [_longs(r[0] for r in rows), _longs(r[1] for r in rows), *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3))]
        return pa.StructArray.from_arrays(parts, names=["path", "content", "chars", "links"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, rows = [], []
            for url, page in zip(batch["url"].to_pylist(), batch["html"]):
                row = page_row(page.as_py() or "")
                if row:
                    hosts.append(_host(url))
                    rows.append(row)
            if rows:
                head = [pa.array(hosts, pa.string()), _longs(r[0] for r in rows), pa.array([r[1] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*head, _lists([r[2] for r in rows], nodes), _lists([r[3] for r in rows], texts)],
                    names=["host", "page", "chars", "nodes", "texts"],
                )

    return pages.mapInArrow(task, PAGE_SCHEMA)


def merged_trees(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The style tree of every host: ``(host, path, page_chars, presentation,
    parents, near, kind, place)`` per style node, and ``(host, path, chars,
    links, content)`` per style node that holds text itself."""
    # pages alike in all their blocks count once, so that copies make nothing common
    once = style_rows(pages).dropDuplicates(["host", "page"]).select("host", "chars", "nodes", "texts")
    once = common.stage_table(once, "sitetree-pages")
    hosts = once.groupBy("host").agg(F.count("*").alias("all_pages"))
    seen = once.select("host", "chars", F.explode("nodes").alias("node")).select("host", "chars", "node.*")
    shapes = seen.groupBy("host", "path", "children").agg(
        F.count("*").alias("n"), F.sum("chars").alias("page_chars"), F.min(F.struct("parents", "near", "kind", "place")).alias("as")
    )
    # the entropy of a node's child sequences from two sums
    styles = shapes.groupBy("host", "path").agg(
        F.sum("n").alias("pages"), F.sum("page_chars").alias("page_chars"), F.sum(F.col("n") * F.log("n")).alias("within"), F.min("as").alias("as")
    )
    entropy = F.greatest(F.lit(0.0), F.log("pages") - F.col("within") / F.col("pages"))
    presentation = F.when(F.col("pages") > 1, entropy / F.log("pages")).otherwise(0.0)
    styles = styles.select("host", "path", "pages", "page_chars", presentation.alias("presentation"), "as.*")
    texts = once.select("host", F.explode("texts").alias("t")).select("host", "t.*")
    held = texts.groupBy("host", "path", "content").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    part = F.when(F.col("all_pages") > 1, F.greatest(F.lit(0.0), 1 - F.log("n") / F.log("all_pages"))).otherwise(1.0)
    held = held.join(hosts, "host").groupBy("host", "path").agg(
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum(part * F.col("chars")).alias("content")
    )
    return common.stage_table(styles, "sitetree-styles"), common.stage_table(held, "sitetree-texts")


def worth(pages: DataFrame, least: float, prior: float) -> DataFrame:
    """The worth of every style node's branch: ``host, path, kind, content,
    links, share, presentation, contained, value, cut``."""
    styles, texts = merged_trees(pages)
    held = styles.join(texts, ["host", "path"], "left")
    # what a style node has counts for itself and each node above it
    up = held.withColumn("own", F.col("path")).withColumn("path", F.explode(F.array_distinct(F.concat(F.array("path"), "parents"))))
    branches = up.groupBy("host", "path").agg(
        F.max("presentation").alias("varied"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
        F.sum("content").alias("content"), F.max((F.col("kind") == MAIN) & (F.col("path") != F.col("own"))).alias("holds_main"),
    )
    # text in a node's own blocks, reached through elements that only shape it
    direct = held.select("host", "chars", F.explode(F.array_distinct(F.concat(F.array("path"), "near"))).alias("path"))
    direct = direct.groupBy("host", "path").agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("direct"))
    has = lambda bit: F.col("place").bitwiseAND(bit) > 0
    nodes = (
        styles.select("host", "path", "pages", "page_chars", "kind", "place", F.get("parents", F.lit(0)).alias("up"))
        .join(branches, ["host", "path"]).join(direct, ["host", "path"])
        .withColumn("chars", F.coalesce("chars", F.lit(0)))
    )
    outer = nodes.select("host", F.col("path").alias("up"), (2 * F.col("direct") >= F.col("chars")).alias("container"), has(_ROOT).alias("in_body"))
    placed = common.stage_table(nodes, "sitetree-nodes").join(outer, ["host", "up"], "left")
    empty = F.col("chars") == 0
    content = F.when(empty, 0.0).otherwise(F.col("content") / F.col("chars"))
    links = F.when(empty, 0.0).otherwise(F.col("links") / F.col("chars"))
    share = F.col("chars") / F.greatest("page_chars", F.lit(1))
    contained = F.coalesce(F.col("container"), F.lit(False)) & ((F.col("direct") == F.col("chars")) | has(_FLOW))
    value = content * (1 - links) * F.when(contained | has(_HEADING), 1.0).otherwise(F.greatest("varied", share))
    # in an article, headings recur; any other block has to differ from page to page
    value = F.when(contained & ~F.col("in_body"), F.when(has(_HEADING), 1.0).otherwise(content)).otherwise(value)
    lowered = (F.col("kind").isin(NOISE, HEADER) & ~F.col("holds_main")) | ((F.col("kind") == FORM) & (share < 0.5) & ~F.col("holds_main"))
    # what an element says it is multiplies the odds.  Pages are evidence for a
    # block of an article, so they can outvote its name; elsewhere names count more
    most = F.when(contained & ~F.col("in_body"), F.col("pages").cast("double")).otherwise(2.0)
    odds, factor = F.least(value / F.greatest(1 - value, F.lit(1e-9)), most), (1 + prior) / (1 - prior)
    odds = F.when(lowered, odds / factor).when(F.col("kind").isin(MAIN, INSIDE), odds * factor).otherwise(odds)
    value = odds / (1 + odds)
    return placed.select(
        "host", "path", "kind", content.alias("content"), links.alias("links"), share.alias("share"), F.col("varied").alias("presentation"),
        contained.alias("contained"), value.alias("value"), (~has(_ROOT) & ~empty & (value < least)).alias("cut"),
    )


def extract(pages: DataFrame, least: float = 0.1, prior: float = 0.9) -> DataFrame:
    """The main text of every page.

    ``pages`` needs ``page_id, url, html``; other columns are ignored.
    Character references are decoded, white space in a block becomes one
    space, and blocks are joined by a line feed in page order.  Branches worth
    less than ``least`` are cut; what elements say they are multiplies or
    divides the odds of their worth by (1 + ``prior``) / (1 - ``prior``).  Returns ``page_id, url, text, n_chars``.  A null or empty html
    has an empty text; pages without a url are a host of their own; repeated
    rows and copies of a page count once in the tree, and each has its text.
    Texts of any length are taken whole.  An empty table gives an empty
    result.  A host's cut style nodes go to its pages as one list: as many as
    its templates have branches, not as it has pages.
    """
    common.session(pages)
    rows = pages.select("page_id", "url", "html")
    cut = worth(rows, least, prior).filter("cut").groupBy("host").agg(F.collect_set("path").alias("paths"))
    cut = common.stage_table(cut, "sitetree-cut")
    size = cut.agg(F.sum(F.size("paths"))).first()[0] or 0
    joined = rows.withColumn("host", host_of(F.col("url"))).join(F.broadcast(cut) if size <= 500_000 else cut, "host", "left")
    out = "page_id long, url string, text string, n_chars long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, paths in zip(batch["html"], batch["paths"]):
                gone = frozenset(x & (1 << 64) - 1 for x in paths.as_py() or ())
                texts.append("\n".join(t for _, t, _ in parse(page.as_py() or "", gone)[0]))
            if texts:
                arrays = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in out.split(", ")])

    return joined.select("page_id", "url", "html", "paths").mapInArrow(task, out)
