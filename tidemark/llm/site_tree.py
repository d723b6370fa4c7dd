"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element node is a path of tags with their
classes, and it keeps how often each sequence of children occurs below it (presentation)
and on how many pages each text of it occurs (content). A node whose pages all look alike
says little; its importance is the entropy of its presentation, mixed with the importance of its
children, and for text one minus the mean entropy of its texts over pages. Branches of low
importance, which are the menus, notices and footers that a site repeats, are cut out of
every page. Pages that equal each other count once, and a node seen on fewer than
``LEAST_PAGES`` pages is not judged by its numbers.

Numbers can't tell a form or an advert that changes with each page from an article, so two kinds of marks help.
Elements whose tag says so (``NOISE_TAGS``) are never text. A class or id that names a menu, an advert and
the like marks its branch, by whole words and not where it only speaks of one (``no-sidebar``,
``has-comments``); ``html``, ``body``, ``main`` and an outermost ``article`` can't be marked, and a
marked branch is text after all where it wraps ``WRAPS`` of a page without an unmarked article. Of the
``article`` and ``main`` elements the smallest that holds at least half of a page's text stands for it; where none
does (teasers, lists of articles), all is left to the tree.

Counting is per (host, node, text): a hot host is pre-aggregated and spread over its texts.
What a host has to cut is one short row. Null or empty html gives an empty text; a null
URL or one without host is a host of its own, the empty one. Repeated rows each get their text, an
empty table gives an empty one. Other columns pass through, whatever their names; one named like the result is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import arrow, free_name, keep
from tidemark.llm.url_filter import host

GAMMA = 0.9
LEAST_PAGES = 8
LEAST_IMPORTANCE = 0.2
WRAPS = 0.9

#: Elements that begin and end a block of text.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre
section select summary table tbody td tfoot th thead tr ul""".split())
#: Elements without content, and such whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noframes svg math".split())
#: Elements that are never part of an article.
NOISE_TAGS = RAW | frozenset("""head nav aside footer form button select option input label fieldset menu dialog
object canvas audio video""".split())
#: Words of a class or id that name a branch that is no article, and words that only speak of one.
_NOISE = re.compile(r"""(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|
side-?bar|aside|footer|site-?header|page-?header|masthead|cookies?|consent|notice|popup|modal|newsletter|subscribe|
social|share|sharing|related|recommend\w*|comments?|commentlist|respond|replies|disqus|pagination|pager|toolbar|
widget|login|signup|search)(?:$|[_-])""", re.I | re.X)
_ABOUT = re.compile(r"(?:^|[_-])(?:no|non|not|without|with|has|have|is|hide|show|enable|disable|supports?)[_-]", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: What an opening tag ends, if it is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"},
          "option": {"select"}}


class Node:
    """An open element that is a block: its path as a hash, whether it is noise, and the marks around it."""

    __slots__ = ("tag", "key", "noise", "marks", "regions", "children")

    def __init__(self, tag: str, key: int, noise: bool, marks: tuple[int, ...], regions: tuple[int, ...]) -> None:
        self.tag, self.key, self.noise, self.marks, self.regions = tag, key, noise, marks, regions
        self.children: list[int] = []


class Block:
    """A text of a page, its node with the path to it, and what surrounds it."""

    __slots__ = ("node", "path", "text", "noise", "marks", "regions", "inside")

    def __init__(self, path: tuple[int, ...], text: str, top: Node) -> None:
        self.node, self.path, self.text, self.noise = top.key, path, text, top.noise
        self.marks, self.regions, self.inside = top.marks, top.regions, True


def _marked(name: str) -> bool:
    return any(_NOISE.search(word) and not _ABOUT.search(word) for word in name.split())


def _settle(blocks: list[Block], bare: bool) -> None:
    """Decide, with the whole page known, which marks stand and what is inside its article.

    ``bare``: whether the page has an article that no mark surrounds.
    """
    def sizes(kind: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for b in blocks:
            if not b.noise:
                for i in getattr(b, kind):
                    out[i] = out.get(i, 0) + len(b.text)
        return out

    whole = sum(len(b.text) for b in blocks if not b.noise)
    void = set() if bare else {i for i, n in sizes("marks").items() if n >= WRAPS * whole}
    for b in blocks:
        b.noise = b.noise or not void.issuperset(b.marks)
    whole = sum(len(b.text) for b in blocks if not b.noise)
    fit = [(n, -i) for i, n in sizes("regions").items() if 2 * n >= whole]
    if fit:
        best = -min(fit)[1]
        for b in blocks:
            b.inside = best in b.regions


def _key(parent: int, tag: str, name: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent}/{tag}.{name}") - (1 << 63)


def walk(page: str) -> tuple[list[Block], list[tuple[int, int, int]]]:
    """Blocks of text, and elements, of a page.

    An element: (node, parent, hash of its children's sequence). Inline markup belongs to its block.
    """
    root = Node("", 0, False, (), ())
    stack, blocks, elements, words = [root], [], [], []
    opened, bare = 0, False

    def flush() -> None:
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if text:
            blocks.append(Block(tuple(x.key for x in stack[1:]), text, stack[-1]))

    def close(upto: int) -> None:
        flush()
        while len(stack) > upto:
            node = stack.pop()
            elements.append((node.key, stack[-1].key, hash_of(node.children)))

    at, inline_noise = 0, []
    while True:
        m = _TOKEN.search(page, at)
        if not inline_noise:
            words.append(page[at:m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                inline_noise.clear()
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if depth:
                    close(depth)
            elif inline_noise and inline_noise[-1] == tag:
                inline_noise.pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag in BLOCKS:
            inline_noise.clear()
            if stack[-1].tag == "p" or tag == "hr":
                close(len(stack) - (stack[-1].tag == "p"))
            if tag in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in _HOLDS[tag]:
                        break
                    if stack[i].tag in CLOSES[tag]:
                        close(i)
            flush()
            if tag in VOID:
                continue
            parent = stack[-1]
            name = " ".join(sorted(filter(None, (a or b or c for a, b, c in _CLASS.findall(m[3]))))).lower()
            key = _key(parent.key, tag, " ".join(c for c in name.split() if not any(x.isdigit() for x in c)))
            opened += 1
            region = tag in ("article", "main") or name == "main"
            noise = parent.noise or tag in NOISE_TAGS or tag == "header" and not parent.regions
            markable = tag not in ("html", "body", "main") and (tag != "article" or parent.regions)
            marks = parent.marks + ((opened,) if markable and _marked(name) else ())
            bare = bare or region and not noise and not marks
            parent.children.append(key)
            stack.append(Node(tag, key, noise, marks, parent.regions + ((opened,) if region else ())))
        elif tag in VOID:
            words.append(" ")
        elif tag in NOISE_TAGS and not m[3].endswith("/"):
            inline_noise.append(tag)
    close(1)
    _settle(blocks, bare)
    return blocks, elements


def hash_of(keys: list[int]) -> int:
    """A hash of a sequence; a repeated child counts as one."""
    short = [k for i, k in enumerate(keys) if not i or keys[i - 1] != k]
    return xxhash.xxh64_intdigest(repr(short)) - (1 << 63)


def main_text(page: str, cut: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of a page without noise and without the branches at the nodes of ``cut``."""
    blocks, _ = walk(page)
    return "\n".join(b.text for b in blocks if b.inside and not b.noise and cut.isdisjoint(b.path))


def counts(pages: DataFrame) -> DataFrame:
    """(host, kind, node, parent, item, n): on how many different pages of a host an item occurs.

    kind 0: a node's sequence of children; kind 1: a text of a node.
    """
    kind = "page bigint, kind int, node bigint, parent bigint, item bigint"

    @arrow(f"array<struct<{', '.join(x.replace(' ', ': ') for x in kind.split(', '))}>>")
    def seen(htmls: pa.Array) -> pa.Array:
        out = []
        for h in htmls:
            blocks, elements = walk(h.as_py() or "")
            page = xxhash.xxh64_intdigest("\n".join(b.text for b in blocks)) - (1 << 63)
            rows = {(0, node, parent, item) for node, parent, item in elements}
            rows |= {(1, b.node, b.path[-2] if len(b.path) > 1 else 0, xxhash.xxh64_intdigest(b.text) - (1 << 63))
                     for b in blocks if not b.noise}
            out.append([{"page": page, "kind": k, "node": n, "parent": p, "item": i} for k, n, p, i in rows])
        return pa.array(out, pa.list_(pa.struct([("page", pa.int64()), ("kind", pa.int32()), ("node", pa.int64()),
                                                 ("parent", pa.int64()), ("item", pa.int64())])))

    rows = pages.select(host(F.col("url")).alias("host"), F.explode(seen("html")).alias("r")).select("host", "r.*")
    # pages that equal each other have equal rows, which count once
    return (rows.distinct().groupBy("host", "kind", "node", "parent", "item")
            .agg(F.count(F.lit(1)).alias("n")))


def importance(found: DataFrame) -> DataFrame:
    """(host, node, parent, pages, own): each node's own importance from the counts."""
    m = F.col("m")
    total = (found.groupBy("host", "kind", "node", "parent")
             .agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("items"),
                  F.sum(F.col("n") * F.log("n")).alias("nlog"), F.sum(F.log("n")).alias("logs"),
                  F.max("n").alias("most")))
    pages = F.greatest(F.max(F.when(F.col("kind") == 0, F.col("s"))), F.max("most"))
    per = total.groupBy("host", "node", "parent").agg(
        pages.alias("m"),
        # entropy of the sequences, to the base of the number of pages
        F.max(F.when(F.col("kind") == 0, F.log("s") - F.col("nlog") / F.col("s"))).alias("shape"),
        # a text on k pages has entropy log k; the mean over the node's texts
        F.max(F.when(F.col("kind") == 1, F.col("logs") / F.col("items"))).alias("texts"))
    return per.select(
        "host", "node", "parent", F.col("m").alias("pages"),
        F.when(m > 1, F.col("shape") / F.log(m)).otherwise(1.0).alias("shape"),
        F.when(m > 1, 1 - F.col("texts") / F.log(m)).otherwise(1.0).alias("content"))


def branches_to_cut(pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, cut): the nodes whose branches a host's pages lose.

    What a branch is worth: the best of its node's texts and of its children, damped by
    ``GAMMA`` for each level, or the rest of the weight times its presentation's entropy. A node with a
    child that only few pages have is varied, so worth keeping.
    """
    nodes = keep(importance(counts(pages)))
    seldom = F.col("pages") < least_pages
    varied = nodes.where(seldom).select("host", F.col("parent").alias("node"), F.lit(True).alias("varied")).distinct()
    common = nodes.where(~seldom).join(varied, ["host", "node"], "left")

    def weigh(rows) -> list[int]:
        worth: dict[int, float] = {}
        below: dict[int, list[int]] = {}
        known = {r["node"]: r for r in rows}
        for r in rows:
            below.setdefault(r["parent"], []).append(r["node"])
        order, todo = [], [n for n in known if known[n]["parent"] not in known]
        while todo:
            n = todo.pop()
            order.append(n)
            todo += below.get(n, [])
        for n in reversed(order):
            r, own = known[n], [worth[c] for c in below.get(n, [])]
            if r["varied"]:
                own.append(1.0)
            if r["content"] is not None:
                own.append(r["content"])
            worth[n] = max([GAMMA * max(own, default=0.0), (1 - GAMMA) * (r["shape"] or 0.0)])
        return [n for n in order if worth[n] < least]

    @arrow("array<bigint>")
    def cut(trees: pa.Array) -> pa.Array:
        return pa.array([weigh(t) for t in trees.to_pylist()], pa.list_(pa.int64()))

    # nodes of the templates: what few pages have is only a mark on its parent
    return (common.groupBy("host").agg(F.collect_list(F.struct(
        "node", "parent", "varied", "shape", "content")).alias("tree"))
        .select("host", cut("tree").alias("cut")).where(F.size("cut") > 0))


def extract(pages: DataFrame, into: str = "main_text") -> DataFrame:
    """Pages (with url, html) and their main text in the column ``into``."""
    @arrow("string")
    def text(htmls: pa.Array, cuts: pa.Array) -> pa.Array:
        return pa.array([main_text(h.as_py() or "", frozenset(c.as_py() or ())) for h, c in zip(htmls, cuts)],
                        pa.string())

    site, cut = free_name(pages, "site"), free_name(pages, "cut")
    cuts = keep(branches_to_cut(pages.select("url", "html"))).select(F.col("host").alias(site), F.col("cut").alias(cut))
    out = pages.withColumn(site, host(F.col("url"))).join(cuts, site, "left").withColumn(into, text("html", cut))
    return out.drop(site, cut)


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"), "text").select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
