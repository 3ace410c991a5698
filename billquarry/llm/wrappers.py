"""Main text by wrapper induction: trees of same-host pages are aligned, constant nodes are template, varying ones content.

A page becomes a tree of its block elements. Pages of a host with the same upper tree are a layout; those of rare layouts
are one group. A few pages of each group, chosen by hashes, lend their trees (tags, classes and hashed texts) as wrappers,
and every page of the group is aligned with them by simple tree matching, which of the largest mappings takes one with
the most equal texts. A wrapper node that most aligned pages hold with the same text is constant; pages with the same
texts count once. Counting runs as partial sums, so that a host with a third of all pages is in no single task. A page
keeps its blocks outside template nodes and outside elements that are never an article (menus, headers, footers,
sidebars, notices, adverts, forms, comments). An article or main element is evidence where the trees leave it open:
it bounds the text if it holds at least half of what is left, and it keeps paragraphs that only a few pages agree on.
"""

from __future__ import annotations

import html as references
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billquarry.llm.shared import small_batches, stash
from billquarry.llm.urls import host_of

#: Wrapper pages of a group; distinct pages from which on a layout is a group and agreement counts inside articles too;
#: fewest that make a node constant; share of the aligned pages with its text.
WRAPPERS, LEAST_PAGES, FEWEST, CONSTANT = 3, 5, 2, 0.6
#: Depth beyond which elements are read as part of the one above; levels of a tree that make its layout; cells of a table held at once.
DEPTH, UPPER, CELLS = 200, 4, 1 << 21
#: Elements that are nodes of the tree.
BLOCKS = frozenset(
    "html body div section article main header footer nav aside ul ol li dl dt dd table tbody thead tfoot tr td th caption p h1 h2 h3 h4 h5 h6"
    " pre blockquote form fieldset figure figcaption address details summary hr center menu dialog hgroup search noscript template".split()
)
#: Elements whose text is never part of an article, and those without an end tag.
NEVER = frozenset("head nav footer aside form menu dialog button select textarea option iframe object svg canvas audio video noscript template fieldset search label".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Parts of class, id and role names that mark what is not an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert alerts"
    " popup modal overlay toast menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead topbar toolbar"
    " comment comments respond reply replies disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login"
    " search searchform pagination pager skip complementary contentinfo".split()
)
#: A start tag ends an open element of these kinds.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOUNDS = frozenset("ul ol dl table tbody thead tfoot".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(script|style|textarea|title|xmp|noembed|noframes)\b[^>]*>(?:.*?</\1\s*>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_UNSEEN = re.compile(r"(?:^|[\s\"'])hidden(?:[\s=/]|$)|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """A block element: tag with its first class, child nodes, own pieces of text; whether it is never part of an article."""

    __slots__ = ("tag", "label", "children", "never", "number", "pieces")

    def __init__(self, tag: str, label: str, never: bool):
        self.tag, self.label, self.never = tag, label, never
        self.children: list[Node] = []
        self.pieces: list[tuple[int, str]] = []  # text before the child of this number
        self.number = -1


@lru_cache(maxsize=10_000)
def _kind(name: str, attributes: str) -> tuple[str, bool, bool]:
    """Label of an element; whether it is never part of an article; whether it is so unless it stands in one (headers)."""
    names = " ".join(m.strip("\"'") for m in _NAMED.findall(attributes)).split() if attributes else []
    words = {w.lower() for n in names for w in _PARTS.findall(n)}
    marked = bool(words & MARKS) and not words & {"no", "has", "with", "without"} or bool(attributes and _UNSEEN.search(attributes))
    marked = marked and name not in ("html", "body", "article", "main")
    return f"{name}.{names[0]}" if names else name, marked or name in NEVER, name == "header" or "header" in words


def parse(html: str | None) -> Node:
    """Tree of the block elements of a page; a missing or empty page is a root without children."""
    root = Node("#root", "#root", False)
    stack = [root]
    deeper: list[str] = []  # open elements beyond DEPTH
    hidden: list[str] = []  # open inline elements whose text is left out, such as buttons, up to the next block
    source = html or ""
    at = 0

    def text(to: int) -> None:
        if to > at and not hidden:
            value = source[at:to]
            if not value.isspace():
                top = stack[-1]
                top.pieces.append((len(top.children), value))
            elif stack[-1].pieces and stack[-1].pieces[-1][0] == len(stack[-1].children):
                stack[-1].pieces.append((len(stack[-1].children), " "))

    for m in _TAG.finditer(source):
        text(m.start())
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS or name == "head":
            if m[2]:
                if name in deeper:
                    del deeper[len(deeper) - 1 - deeper[::-1].index(name) :]
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == name:
                        del stack[depth:]
                        deeper.clear()
                        break
                continue
            hidden.clear()
            if len(stack) >= DEPTH:
                if name not in VOID:
                    deeper.append(name)
                stack[-1].pieces.append((len(stack[-1].children), " "))
                continue
            if stack[-1].tag == "p" or (stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6") and name in ("h1", "h2", "h3", "h4", "h5", "h6")):
                stack.pop()
            if name == "body" and stack[-1].tag == "head":
                stack.pop()
            for end in _ENDS.get(name, ()):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == end:
                        del stack[depth:]
                        break
                    if stack[depth].tag in _BOUNDS:
                        break
            label, never, header = _kind(name, m[4])
            node = Node(name, label, never or header and not any(n.tag == "article" or n.tag == "main" for n in stack))
            stack[-1].children.append(node)
            if name not in VOID:
                stack.append(node)
        elif m[2]:
            if name in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(name) :]
        elif name not in VOID and (name in NEVER or name in hidden or m[4] and _kind(name, m[4])[1]):
            hidden.append(name)  # an element within a hidden one of its kind is counted, so that its end is not the outer one's
        elif name == "br" and stack[-1].pieces:
            stack[-1].pieces.append((len(stack[-1].children), " "))
    text(len(source))
    return root


def _clean(pieces: list[str]) -> str:
    value = "".join(pieces)
    return " ".join((references.unescape(value) if "&" in value else value).split())


def _walk(root: Node) -> list[Node]:
    """Nodes in page order, numbered."""
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        node.number = len(out)
        out.append(node)
        waiting.extend(reversed(node.children))
    return out


def skeleton(nodes: list[Node]) -> list[tuple[str, int, int]]:
    """(label, number of children, hash of own text) of each node in page order."""
    return [(n.label, len(n.children), _hash(n.pieces) if n.pieces else 0) for n in nodes]


def _hash(pieces: list[tuple[int, str]]) -> int:
    return xxhash.xxh64_intdigest("".join([p for _, p in pieces]).strip().encode("utf-8", "surrogatepass")) | 1


def profile(nodes: list[Node]) -> tuple[int, int]:
    """Hashes of a page's layout (labels of the upper levels, repeats once) and of all its texts (0 if there is none)."""
    layout, texts = [], []
    waiting = [(nodes[0], 0)]
    while waiting:
        node, depth = waiting.pop()
        if node.never:
            continue
        if depth < UPPER and (not layout or layout[-1] != node.label):
            layout.append(node.label)
        if node.pieces:
            texts.append(_hash(node.pieces))
        waiting.extend((c, depth + 1) for c in reversed(node.children))
    signed = lambda value: value - (1 << 64) if value >> 63 else value
    found = signed(xxhash.xxh64_intdigest(np.array(texts, dtype=np.uint64).tobytes()) | 1) if texts else 0
    return signed(xxhash.xxh64_intdigest("\n".join(layout).encode("utf-8", "surrogatepass")) | 1), found


class Shape:
    """A page's tree: children of each node, nodes below it, and hashes of its form and of its form with all texts."""

    def __init__(self, labels: list[str], counts: list[int], hashes: list[int]):
        self.labels, self.hashes = labels, hashes
        self.children: list[list[int]] = [[] for _ in labels]
        waiting: list[list[int]] = []
        for n, count in enumerate(counts):
            while waiting and not waiting[-1][1]:
                waiting.pop()
            if waiting:
                self.children[waiting[-1][0]].append(n)
                waiting[-1][1] -= 1
            waiting.append([n, count])
        self.forms, self.texts, self.sizes = [0] * len(labels), [0] * len(labels), [1] * len(labels)
        for n in range(len(labels) - 1, -1, -1):
            below = self.children[n]
            self.forms[n] = hash((labels[n], *[self.forms[c] for c in below]))
            self.texts[n] = hash((labels[n], hashes[n], *[self.texts[c] for c in below]))
            self.sizes[n] += sum([self.sizes[c] for c in below])


def matched(a: Shape, b: Shape) -> list[tuple[int, int]]:
    """Pairs of nodes of the largest mapping that keeps labels, parents and the order of children (simple tree matching).

    Of mappings of the same size, children whose texts are equal are preferred. Sizes are worked out once for each pair
    of forms; lists of children of any length are aligned exactly, long ones in halves, so that no table is larger than
    ``CELLS``.
    """
    known: dict[tuple[int, int], int] = {}
    size_weight = 1 << 31  # a node more counts for more than any number of equal texts

    def size(x: int, y: int) -> int:
        if a.forms[x] == b.forms[y]:
            return a.sizes[x]
        if a.labels[x] != b.labels[y]:
            return 0
        if not a.children[x] or not b.children[y]:
            return 1
        key = (a.forms[x], b.forms[y])
        if key not in known:
            low, left, right = trimmed(a.children[x], b.children[y], a.forms, b.forms)
            shared = len(a.children[x]) - len(left)
            ends = a.children[x][:low] + a.children[x][len(a.children[x]) - (shared - low) :]
            known[key] = 1 + sum(a.sizes[c] for c in ends) + (int(scores(left, right, False)[-1]) if left and right else 0)
        return known[key]

    def trimmed(left: list[int], right: list[int], of_a: list[int], of_b: list[int]) -> tuple[int, list[int], list[int]]:
        """Equal nodes that begin or end both lists are matched in some largest mapping; how many begin them, and the rest."""
        most, low, tail = min(len(left), len(right)), 0, 0
        while low < most and of_a[left[low]] == of_b[right[low]]:
            low += 1
        while tail < most - low and of_a[left[-1 - tail]] == of_b[right[-1 - tail]]:
            tail += 1
        return low, left[low : len(left) - tail], right[low : len(right) - tail]

    def weights(left: list[int], right: list[int], equal: bool) -> Iterator[np.ndarray]:
        forms: dict[int, int] = {}
        place = np.array([forms.setdefault(b.forms[y], len(forms)) for y in right])
        some = {b.forms[y]: y for y in right}
        texts = np.array([b.texts[y] for y in right], dtype=np.int64)
        rows: dict[int, np.ndarray] = {}
        for x in left:
            form = a.forms[x]
            if form not in rows:
                rows[form] = np.array([size(x, some[f]) for f in forms], dtype=np.int64)[place]
            yield rows[form] * size_weight + (texts == a.texts[x]) if equal else rows[form]

    def scores(left: list[int], right: list[int], equal: bool, table: list | None = None) -> np.ndarray:
        """Best weight of all of ``left`` with the first nodes of ``right``."""
        row = np.zeros(len(right) + 1, dtype=np.int64)
        for w in weights(left, right, equal):
            if table is not None:
                table.append((row, w))
            new = row.copy()
            np.maximum(new[1:], row[:-1] + w, out=new[1:])
            row = np.maximum.accumulate(new)
        return row

    def pairs(left: list[int], right: list[int], out: list[tuple[int, int]]) -> None:
        def ends(inner: list[int], other: list[int], of_a: list[int], of_b: list[int]) -> tuple[list[int], list[int]]:
            low, rest, beside = trimmed(inner, other, of_a, of_b)
            tail = len(inner) - low - len(rest)
            out.extend(zip(inner[:low], other[:low]))
            if tail:
                out.extend(zip(inner[-tail:], other[-tail:]))
            return rest, beside

        inner, other = ends(left, right, a.texts, b.texts)
        if inner and other and {a.texts[x] for x in inner}.isdisjoint([b.texts[y] for y in other]):
            inner, other = ends(inner, other, a.forms, b.forms)  # no texts to prefer: equal forms will do
        if not inner or not other:
            return
        if len(inner) == len(other) == 1:
            if a.labels[inner[0]] == b.labels[other[0]]:
                out.append((inner[0], other[0]))
            return
        if len(inner) > 1 and len(inner) * len(other) > CELLS:
            half = len(inner) // 2
            before, after = scores(inner[:half], other, True), scores(inner[:half - 1 : -1], other[::-1], True)[::-1]
            cut = int((before + after).argmax())
            pairs(inner[:half], other[:cut], out)
            pairs(inner[half:], other[cut:], out)
            return
        table: list = []
        row, j = scores(inner, other, True, table), len(other)
        for x, (above, w) in zip(reversed(inner), reversed(table)):
            while j and row[j] == row[j - 1]:
                j -= 1
            if not j:
                break
            if row[j] != above[j]:
                out.append((x, other[j - 1]))
                j -= 1
            row = above

    out: list[tuple[int, int]] = []
    waiting = [(0, 0)] if a.labels[0] == b.labels[0] else []
    while waiting:
        x, y = waiting.pop()
        out.append((x, y))
        if a.children[x] and b.children[y]:
            pairs(a.children[x], b.children[y], waiting)
    return out


def _shape_of(nodes: list[Node]) -> Shape:
    parts = skeleton(nodes)
    return Shape([p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts])


def main_text(nodes: list[Node], template: set[int], thin: set[int] = frozenset()) -> str:
    """Blocks of a page that are content, one a line.

    ``template``: numbers of nodes that are constant on the host; ``thin``: those that only a few pages agree on, which
    go outside an article alone. Where more than half of an article is constant and the rest of the page holds less than
    it, page and wrapper are copies of one article, which stays; where nothing would be left, nothing is template.
    """
    bounds = {n.number for n in nodes if n.tag == "article" and not n.never} or {n.number for n in nodes if n.tag == "main" and not n.never}
    outside: dict[int, int] = {}
    inside: dict[int, int] = {}  # visible nodes with text, and its length
    waiting = [(nodes[0], False)]
    while waiting:
        node, within = waiting.pop()
        if node.never:
            continue
        within = within or node.number in bounds
        if node.pieces:
            (inside if within else outside)[node.number] = len("".join([p for _, p in node.pieces]).strip())
        waiting.extend((c, within) for c in node.children)
    constant = {n for n in outside if n in template or n in thin}
    shared = {n for n in inside if n in template}
    left_outside = sum(length for n, length in outside.items() if n not in constant)
    if 2 * sum(inside[n] for n in shared) <= sum(inside.values()) or sum(inside.values()) < left_outside:
        constant |= shared
    if len(constant) == len(inside) + len(outside):
        constant = set()
    in_bounds = sum(length for n, length in inside.items() if n not in constant)
    bounded = in_bounds and in_bounds >= sum(length for n, length in outside.items() if n not in constant)
    shown = ({*inside} if bounded else {*inside, *outside}) - constant
    blocks: list[str] = []

    def add(pieces: list[tuple[int, str]]) -> None:
        if pieces and (value := _clean([p for _, p in pieces])):
            blocks.append(value)

    def visit(node: Node) -> None:
        if node.never:
            return
        pieces = node.pieces if node.number in shown else []
        at = 0
        for n, child in enumerate(node.children):
            to = at
            while to < len(pieces) and pieces[to][0] <= n:
                to += 1
            add(pieces[at:to])
            at = to
            visit(child)
        add(pieces[at:])

    visit(nodes[0])
    return "\n".join(blocks)


# --- over all pages -------------------------------------------------------------------------------------------------


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host``, hashes of layout and texts, and the tree of every page."""
    for batch in batches:
        found = []
        for page in batch.column(1).to_pylist():
            nodes = _walk(parse(page))
            found.append((*profile(nodes), json.dumps(list(zip(*skeleton(nodes))), separators=(",", ":"))))
        columns = [pa.array([f[n] for f in found], type=t) for n, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["host", "layout", "texts", "tree"])


def _with_layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns stay; the hash of the page's layout is added."""
    for batch in batches:
        found = [profile(_walk(parse(page)))[0] for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, type=pa.int64())], ["page_id", "url", "html", "host", "layout"])


class _Shapes:
    """Wrappers of the groups a worker has met, a bounded number of them."""

    def __init__(self) -> None:
        self.known: dict[str, list[Shape]] = {}

    def __call__(self, wrappers: str) -> list[Shape]:
        if wrappers not in self.known:
            if len(self.known) > 500:
                self.known.clear()
            self.known[wrappers] = [Shape(*json.loads(w)) for w in wrappers.split("\n")]
        return self.known[wrappers]


def _agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pages of a batch align with each wrapper node that has text, and how many hold the same text there."""
    shapes = _Shapes()
    for batch in batches:
        counts: dict[tuple, list[int]] = {}
        for host, group, wrappers, tree in zip(*(batch.column(i).to_pylist() for i in range(4))):
            own = Shape(*json.loads(tree))
            for n, shape in enumerate(shapes(wrappers)):
                for x, y in matched(own, shape):
                    if shape.hashes[y]:
                        count = counts.setdefault((host, group, n, y), [0, 0])
                        count[0] += 1
                        count[1] += own.hashes[x] == shape.hashes[y]
        columns = [list(c) for c in zip(*((*k, *v) for k, v in counts.items()))] or [[]] * 6
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], ["host", "layout", "wrapper", "node", "pages", "same"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = _Shapes()
    for batch in batches:
        out = []
        for page, wrappers, constants in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            nodes, template, thin = _walk(parse(page)), set(), set()
            if constants:
                own, fixed = _shape_of(nodes), {tuple(map(int, c.split(":"))) for c in constants.split(" ")}
                for n, shape in enumerate(shapes(wrappers)):
                    if any(f[0] == n for f in fixed):
                        for x, y in matched(own, shape):
                            if own.hashes[x] == shape.hashes[y]:
                                if (n, y, 1) in fixed:
                                    template.add(x)
                                elif (n, y, 0) in fixed:
                                    thin.add(x)
            out.append(main_text(nodes, template, thin))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by a
    line break; nothing is cut. A missing or empty page, and one without an article, gives an empty text. Pages without
    a host (null, or a URL without ``://``) form one host. Repeated rows stay; for their host, pages of a layout with
    the same texts count as one. Other columns are not used. Elements nested deeper than ``DEPTH`` are read as text of the one above.
    """
    small_batches(pages.sparkSession)
    kind = pages.schema[page_id].dataType.simpleString()
    page = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host_of(F.col(url)).alias("host"))
    # trees, not pages, are shuffled: one for all pages of a layout that have the same texts
    trees = page.select("host", "html").mapInArrow(_profiled, "host string, layout long, texts long, tree string").where("texts <> 0")
    each = stash(trees.groupBy("host", "layout", "texts").agg(F.first("tree").alias("tree")), "page-trees")
    sizes = each.groupBy("host", "layout").agg(F.count("*").alias("n"))
    layouts = stash(sizes.where(F.col("n") >= LEAST_PAGES).select("host", "layout", F.lit(True).alias("own")), "page-layouts")

    def in_groups(rows: DataFrame) -> DataFrame:
        group = F.when(F.col("own"), F.col("layout")).otherwise(F.lit(0).cast("long"))
        return rows.join(layouts, ["host", "layout"], "left").withColumn("layout", group).drop("own")

    grouped = in_groups(each)
    picks = [F.min_by("tree", F.xxhash64(F.lit(n), "texts")) for n in range(WRAPPERS)]
    lent = grouped.groupBy("host", "layout").agg(F.count("*").alias("n"), F.sort_array(F.array_distinct(F.array(*picks))).alias("trees")).where(F.col("n") >= FEWEST)
    wrappers = stash(lent.select("host", "layout", F.array_join("trees", "\n").alias("wrappers")), "wrappers")
    agreed = grouped.join(wrappers, ["host", "layout"]).select("host", "layout", "wrappers", "tree").mapInArrow(
        _agreements, "host string, layout long, wrapper int, node int, pages long, same long"
    )
    totals = agreed.groupBy("host", "layout", "wrapper", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    constant = totals.where((F.col("pages") >= FEWEST) & (F.col("same") >= CONSTANT * F.col("pages")))
    many = (F.col("pages") >= LEAST_PAGES).cast("int")
    of_group = constant.groupBy("host", "layout").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "wrapper", "node", many))), " ").alias("constants"))
    known = stash(wrappers.join(of_group, ["host", "layout"]), "wrapper-constants")
    laid = in_groups(page.mapInArrow(_with_layout, f"page_id {kind}, url string, html string, host string, layout long"))
    texts = (
        laid.join(known, ["host", "layout"], "left").select("page_id", "url", "html", "wrappers", "constants")
        .mapInArrow(_texts, f"page_id {kind}, url string, text string")
    )
    return texts.withColumn("n_chars", F.length("text").cast("long"))
