"""HTML extraction by wrapper induction.

1. Each page becomes a tree; runs of siblings of one shape are folded into one node.  The
   trees of a host are laid over each other by simple tree matching (ordered children,
   equal shapes, largest number of matched nodes), within each partition first and then
   between partitions.  A node remembers on how many pages it stood and whether its text was
   ever another: a constant node is template, a varying one is a slot.
2. A host's wrapper, its tree with one flag a node, goes back to its pages.  Text of template
   nodes is left out, text of slots is content.  Two things narrow that.  Navigation, notices,
   adverts, forms, comments and the like vary from page to page as well, so their elements, roles
   and classes leave them out; and an article or main element bounds the content.  Inside one,
   constant text goes only if it stood on SURE_PAGES pages and most of the article varies, as pages
   that repeat an article make all of it constant.  Blocks of links alone stay where most of the
   varying text is, and go outside it.

A partial tree that reaches MAX_NODES nodes is passed on and a further one takes the next
pages, so every node of every layout is counted; the wrapper holds the nodes that stood on
LEAST_PAGES pages, and a page node that isn't in it counts as varying.  Partial trees of a host
are merged in a tree of tasks.  Numbers in the classes of html, body, article and main are alike,
as they often number the page.  Markup is scanned in linear time.

Defined cases: null or empty html gives an empty text; unclosed or stray tags are repaired as
browsers do for paragraphs, list items and cells; elements nested over DEEP levels belong to the
last one above; a page without a host, or alone on its host, is taken by structure alone; repeated
pages each give a row, pages without an id too; an empty table gives no rows; pages of any length are
read whole; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.runtime import input_bytes, short_batches, tree, written

MAX_NODES, MAX_DEPTH, DEEP = 1500, 40, 160
#: Pages on which a node must stand, always alike, to be template; and to be it inside an article.
LEAST_PAGES, SURE_PAGES = 3, 8
#: Input bytes for each group of the first level of a host's merge.
MERGE_INPUT = 1 << 30
#: Share of a page's varying text that its content subtree must hold, where no element names it.
MOST = 0.7
HELD = 20_000

#: No part of a tag gives back what it took, and outside quotes none goes on over a "<".
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|[^'"<>]++)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Element names by their part in a page.
RAW = frozenset("script style textarea title noscript iframe template svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("head nav footer aside form script style textarea title noscript iframe template svg math object canvas audio video button select option input label menu dialog".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPE = frozenset("ul ol table td th article section div body main aside nav footer header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adbox|adsense|advert\w*|banner\w*|promo\w*|sponsor\w*|sidebar|side-?bar|widget\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|footer|header|masthead|cookie\w*|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|reply|replies|disqus|pagination|pager|login|toolbar|legal|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    shape: str
    skip: bool
    children: list = field(default_factory=list)  # Node or str


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in ATTRIBUTE.findall(raw):
        out.setdefault(k.lower(), entities.unescape(v.strip("\"'")))
    return out


def element(tag: str, raw: str, within: bool) -> Node:
    """A node; skip if its name, role or class says that it isn't content.  within: inside an article or main."""
    skip = tag in SKIP or tag == "header" and not within
    if not raw or raw == "/":
        return Node(tag, tag, skip)
    a = attributes(raw)
    name = f"{a.get('class', '')} {a.get('id', '')}".strip()
    if not skip and tag not in ("html", "body", "article", "main"):
        skip = bool(name and HINTS.search(name)) or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(HIDDEN.search(a.get("style", "")))
    elif tag == "article" and name and re.search(r"(?:^|[\s_-])(?:comments?|reply|ad|ads|advert\w*|promo\w*|sponsor\w*|related)(?:$|[\s_-])", name, re.I):
        skip = True
    kind = a.get("class", "")
    if tag in ("html", "body", "article", "main"):
        kind = re.sub(r"\d+", "0", kind)
    return Node(tag, f"{tag}.{kind}" if kind else tag, skip)


def parse(page: str) -> Node:
    """The tree of a page; text stays undecoded."""
    root = Node("#root", "#root", False)
    stack, at, within = [root], 0, 0
    over: dict[str, int] = {}  # open elements that are too deep for the stack
    find = MARKUP.search
    while m := find(page, at):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if over.get(tag):
                over[tag] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    within -= sum(x.tag in ("article", "main") for x in stack[k:])
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            shut = CLOSES.get(tag, CLOSES["p"]) if tag in CLOSES else CLOSES["p"]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        node = element(tag, m[3].strip(), within > 0)
        stack[-1].children.append(node)
        if tag not in VOID and not m[3].endswith("/") or tag in BLOCK and tag not in VOID:
            if len(stack) < DEEP:
                stack.append(node)
                within += tag in ("article", "main")
            else:
                over[tag] = over.get(tag, 0) + 1
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


@dataclass(slots=True)
class Slot:
    """A node of a host's tree."""

    shape: str
    pages: int = 1
    text: str = ""
    varies: bool = False
    children: list[Slot] = field(default_factory=list)

    def count(self) -> int:
        return 1 + sum(c.count() for c in self.children)

    def dump(self) -> list:
        return [self.shape, self.pages, self.text, int(self.varies), [c.dump() for c in self.children]]

    @staticmethod
    def load(x: list) -> Slot:
        return Slot(x[0], x[1], x[2], bool(x[3]), [Slot.load(c) for c in x[4]])


def fold(node: Node, of: dict[int, Slot] | None = None, depth: int = 0) -> Slot:
    """The node with runs of siblings of one shape folded into one, and a digest of all direct text."""
    texts: list[str] = []
    parts: list[tuple[str, list[Node]]] = []
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                texts.append(c)
        elif c.tag != "br" and depth < MAX_DEPTH:
            if parts and parts[-1][0] == c.shape:
                parts[-1][1].append(c)
            else:
                parts.append((c.shape, [c]))
    kids = []
    for shape, nodes in parts:
        if len(nodes) == 1:
            kids.append(fold(nodes[0], of, depth + 1))
        else:
            merged = Node(nodes[0].tag, shape, nodes[0].skip, [x for n in nodes for x in n.children])
            s = fold(merged, of, depth + 1)
            kids.append(s)
            if of is not None:
                for n in nodes:
                    of[id(n)] = s
    s = Slot(node.shape, 1, blake2b("\0".join(texts).encode("utf-8", "replace"), digest_size=8).hexdigest() if texts else "", False, kids)
    if of is not None:
        of[id(node)] = s
    return s


def matching(a: list[Slot], b: list[Slot], memo: dict) -> list[tuple[int, int]]:
    """Pairs of children by simple tree matching."""
    if len(a) == len(b) and all(x.shape == y.shape for x, y in zip(a, b, strict=True)):
        return [(i, i) for i in range(len(a))]
    common = {x.shape for x in a} & {y.shape for y in b}
    of_a, of_b = [i for i, x in enumerate(a) if x.shape in common], [j for j, y in enumerate(b) if y.shape in common]
    a, b = [a[i] for i in of_a], [b[j] for j in of_b]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size(a[i], b[j], memo))
    out, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((of_a[i], of_b[j]))
    return out[::-1]


def size(a: Slot, b: Slot, memo: dict) -> int:
    """Most nodes that can be matched between two trees."""
    if a.shape != b.shape:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + sum(size(a.children[i], b.children[j], memo) for i, j in matching(a.children, b.children, memo))
    return memo[key]


def overlay(a: Slot, b: Slot, room: list[int], memo: dict | None = None) -> None:
    """Lay b over a; what has no counterpart is inserted and taken from the room, which may end below zero."""
    memo = {} if memo is None else memo
    a.varies |= b.varies or a.text != b.text
    a.pages += b.pages
    pairs = matching(a.children, b.children, memo)
    to = {j: i for i, j in pairs}
    merged, i = [], 0
    for j, y in enumerate(b.children):
        if j in to:
            merged += a.children[i : to[j]]
            i = to[j] + 1
            overlay(a.children[to[j]], y, room, memo)
            merged.append(a.children[to[j]])
        else:
            room[0] -= y.count()
            merged.append(y)
    a.children = merged + a.children[i:]


def flagged(s: Slot) -> list:
    """A wrapper: shape and whether the node is template (2: for sure), nested, without what stood on too few pages for template."""
    sure = (s.pages >= LEAST_PAGES) + (s.pages >= SURE_PAGES) if not s.varies and s.text != "" else 0
    return [s.shape, sure, [flagged(c) for c in s.children if c.pages >= LEAST_PAGES]]


def _slots(x: list) -> Slot:
    """A wrapper as slots; `pages` holds the flag."""
    return Slot(x[0], x[1], "", not x[1], [_slots(c) for c in x[2]])


def constant(page: Slot, wrapper: Slot, out: dict[int, int], memo: dict) -> None:
    """The page's folded nodes that the wrapper says are template, by id, with its flag."""
    if not wrapper.varies:
        out[id(page)] = wrapper.pages
    for i, j in matching(wrapper.children, page.children, memo):
        constant(page.children[j], wrapper.children[i], out, memo)


def blocks(root: Node, template: dict[int, int]) -> list[tuple[str, tuple[Node, ...], int, bool]]:
    """(text, ancestors, template, link) of each block that isn't skipped, in page order."""
    out: list[tuple[str, tuple[Node, ...], int, bool]] = []
    held: list[str] = []
    state = {"fixed": 2, "link": True}

    def flush(path: tuple[Node, ...]) -> None:
        text = " ".join(entities.unescape("".join(held)).split()) if held else ""
        if text:
            out.append((text, path, state["fixed"], state["link"]))
        held.clear()
        state["fixed"], state["link"] = 2, True

    def walk(node: Node, path: tuple[Node, ...], link: bool) -> None:
        path = (*path, node)
        fixed = template.get(id(node), 0)
        for c in node.children:
            if isinstance(c, str):
                held.append(c)
                if not c.isspace():
                    state["fixed"] = min(state["fixed"], fixed)
                    state["link"] &= link
            elif c.tag == "br":
                held.append(" ")
            elif c.tag in BLOCK or c.skip:
                flush(path)
                if not c.skip:
                    walk(c, path, link)
                    flush((*path, c))
            else:
                walk(c, path, link or c.tag == "a")

    walk(root, (), False)
    flush((root,))
    return out


def extract(page: str | None, wrapper: str | None = None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    template: dict[int, int] = {}
    if wrapper:
        of: dict[int, Slot] = {}
        folded = fold(root, of)
        fixed: dict[int, int] = {}
        constant(folded, _slots(json.loads(wrapper)), fixed, {})
        template = {k: fixed[id(s)] for k, s in of.items() if id(s) in fixed}
    found = blocks(root, template)
    named = [b for b in found if any(n.tag in ("article", "main") for n in b[1])]
    if any(n.tag == "article" for b in named for n in b[1]):
        named = [b for b in named if any(n.tag == "article" for n in b[1])]
    if named:
        sure = 2 * sum(len(b[0]) for b in named if not b[2]) > sum(len(b[0]) for b in named)
        return "\n".join(b[0] for b in named if not (b[2] and b[3] or sure and b[2] > 1))
    left = [b for b in found if not b[2] and not b[3]]
    total = sum(len(b[0]) for b in left)
    region: Node | None = root
    while region is not None and total:
        mass: dict[int, int] = {}
        for b in left:
            k = next((k for k, n in enumerate(b[1]) if n is region), None)
            if k is not None and k + 1 < len(b[1]):
                mass[id(b[1][k + 1])] = mass.get(id(b[1][k + 1]), 0) + len(b[0])
        best = max(mass, key=mass.__getitem__, default=None)
        if best is None or mass[best] < MOST * total:
            break
        down = next(n for b in left for n in b[1] if id(n) == best)
        if down.tag in ("p", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6"):
            break
        region = down
    return "\n".join(b[0] for b in found if not b[2] and (not b[3] or region is not root and any(n is region for n in b[1])))


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper a host, induced from all its pages."""

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Slot, list[int]]] = {}

        def out(trees: dict[str, tuple[Slot, list[int]]]) -> pa.RecordBatch:
            r = pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array([json.dumps(s.dump()) for s, _ in trees.values()], pa.string())], names=["part", "tree"])
            trees.clear()
            return r

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = fold(parse(page))
                if host in held:
                    overlay(held[host][0], s, held[host][1])
                else:
                    held[host] = s, [MAX_NODES - s.count()]
                if held[host][1][0] < 0:
                    yield out({host: held.pop(host)})
            if len(held) > HELD:
                yield out(held)
        if held:
            yield out(held)

    def unite(table: pa.Table) -> tuple:
        first = None
        for x in table.column("tree"):
            s = Slot.load(json.loads(x.as_py()))
            if first is None:
                first = s
            else:
                overlay(first, s, [0])
        return (json.dumps(first.dump()),)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(flagged(Slot.load(json.loads(x)))) for x in batch.column(1).to_pylist()], pa.string())], names=["host", "wrapper"])

    keyed = pages.where((F.col("host") != "") & (F.length("html") > 0)).select("host", "html")
    return tree(keyed.mapInArrow(induce, "part string, tree string"), unite, input_bytes(pages, "html") // MERGE_INPUT).mapInArrow(flag, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and `text`, the main text."""
    keyed = short_batches(pages).select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"))
    both = keyed.join(written(wrappers(keyed), "wrappers"), "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(h, w) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    return both.mapInArrow(run, f"page_id {kind}, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
