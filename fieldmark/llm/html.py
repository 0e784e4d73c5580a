"""Main text of web pages: page parts known by tag, role or class go, and so do element subtrees that recur over a host's pages."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import materialise, only, small_batches, str_column
from fieldmark.llm.shards import filed, load, new_folder, save

# HTML elements by kind, and names that pages give to what isn't their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
UNSEEN = frozenset("script style template noscript".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption summary".split())
NEVER = frozenset("head script style noscript template nav aside button select option textarea iframe object svg math canvas video audio footer dialog menu input title noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus respond pagination pager widget toolbar login search skip".split())
HEADER_NAMES = frozenset(("header",))
#: Of these, names that also count beside others; and words that only tell where or how a container stands.
SURE_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsored nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead cookie cookies gdpr newsletter comment comments disqus respond pagination pager".split())
LAYOUT = frozenset("area article articles bar block bottom box button buttons clearfix col column container content fixed form grid icon icons inner item items left link links list module outer page panel post posts right row section site small title top wrap wrapper".split())
CONTROLS = frozenset("input select textarea button".split())
#: Words of a form for each of its fields, and besides, beyond which it isn't one; words outside a named part that are a text.
FIELD_WORDS, FORM_WORDS, TEXT_WORDS = 10, 20, 50
#: Articles decide where they hold this share of a page's words, or more.
ARTICLE_SHARE = 0.25
#: Elements that end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
WORDS = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    role: str = ""  # what its attributes say it is
    items: list = field(default_factory=list)  # texts, nodes, and None where a block ends
    digest: int = 0
    main: bool = False  # holds an article or the main element
    words: int = 0  # of its text, without page parts that go by their tag
    fields: int = 0  # to fill in


def is_named(value: str) -> bool:
    """Whether a class or id names a page part: a name that is made of such names alone, beside words of layout or, if it is a sure one,
    beside anything; "related-work" and "market share" are none."""
    found = sure = other = False
    for token in value.split():
        words = [w for w in WORDS.findall(token) if not w.isdigit()]
        if words and all(w in NAMES or w in LAYOUT for w in words):
            found |= any(w in NAMES for w in words)
            sure |= any(w in SURE_NAMES for w in words)
        else:
            other |= bool(words)
    return sure or found and not other


def role_of(tag: str, attributes: str) -> str:
    """"skip" for page parts by their tag and what is hidden, "form" and "named" for containers that may be parts, which their content
    decides, "header" for headers, which only count as such outside an article. Paragraphs and inline elements are never named."""
    if tag in NEVER:
        return "skip"
    out = "form" if tag == "form" else "header" if tag == "header" else ""
    if attributes.strip(" /"):
        container = tag not in INLINE and tag not in TEXT_BLOCKS and tag not in ("html", "body")
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return "skip"
            if name == "role" and value in ROLES and container:
                out = "form" if value in ("form", "search") else "named"
            if name in ("class", "id") and container and tag != "main" and out != "form":
                if is_named(value):
                    out = "named"
                elif not out and not HEADER_NAMES.isdisjoint(WORDS.findall(value)):
                    out = "header"
    return out


def settle(root: Node, maybe: list[Node]) -> None:
    """Decide which containers are page parts: a form has few words for its fields, and a part leaves some text outside of it, a quarter of
    its own words or as many as a text has; what holds nearly all of a page is no part of it."""
    for node in maybe:
        form = node.role == "form" and node.words <= FORM_WORDS + FIELD_WORDS * node.fields
        rest = root.words - node.words
        node.role = "skip" if (form or node.role == "named") and (4 * rest >= node.words or rest >= TEXT_WORDS) else ""


def parse(page: str) -> Node:
    """A tree of the page; end tags that are missing, unknown or crossed do no harm."""
    root = Node("html")
    stack = [root]
    at, raw = 0, ""
    maybe: list[Node] = []
    open_: Counter[str] = Counter()  # elements on the stack by tag: the stack is only searched for what is there

    def close(upto: int) -> None:
        while len(stack) > upto:
            node = stack.pop()
            open_[node.tag] -= 1
            finish(node)
            if stack:
                stack[-1].main |= node.main or node.tag in ("article", "main")
                stack[-1].words += 0 if node.role == "skip" and not node.main else node.words
                stack[-1].fields += node.fields

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        tag = m[2] or m[5]
        if tag is None:
            if not raw and m.start() > at:
                stack[-1].items.append(page[at : m.start()])
            at = m.end()
            continue
        tag, ends = tag.lower(), bool(m[1] or m[4])
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        block = tag not in INLINE and tag not in UNSEEN
        if ends:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
            if block:
                stack[-1].items.append(None)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P or tag == "li":
            for i in range(len(stack) - 1, 0, -1) if open_["p"] + open_["li"] > 0 else ():
                if stack[i].tag in ("p", "li") and (stack[i].tag == "p" and tag in CLOSES_P or stack[i].tag == tag):
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag == "br":
            stack[-1].items.append(" ")
            continue
        if block:
            stack[-1].items.append(None)
        attributes = m[3] or m[6] or ""
        stack[-1].fields += tag in CONTROLS and "hidden" not in attributes
        if tag in VOID:
            continue
        node = Node(tag, role_of(tag, attributes))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack[-1].items.append(node)
        stack.append(node)
        if node.role in ("form", "named"):
            maybe.append(node)
        open_[tag] += 1
    if at < len(page):
        stack[-1].items.append(page[at:])
    close(0)
    settle(root, maybe)
    return root


def finish(node: Node) -> None:
    """The subtree's hash, from its own and its children's, and its words."""
    h = xxhash.xxh64(node.tag)
    for item in node.items:
        if isinstance(item, Node):
            h.update(item.digest.to_bytes(8, "little"))
        elif item and (text := " ".join(item.split())):
            h.update(text)
            node.words += len(item.split())
    node.digest = h.intdigest()


def dropped(node: Node, inside: bool) -> bool:
    return not node.main and (node.role == "skip" or node.role == "header" and not inside)


def outermost(root: Node, tag: str) -> list[Node]:
    """Elements of that tag in page order, not those inside another one or inside a page part."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == tag and node.role != "skip":
            out.append(node)
        elif not dropped(node, False):
            todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    return out


class Page(NamedTuple):
    """Blocks of a page that are in no page part, whether its articles hold them (if it has none: True), and its subtrees: the hash
    of each one that may be a template and the range of blocks inside it, which stand in a row."""

    texts: list[str]
    inside: list[bool]
    marks: list[int]
    first: list[int]
    end: list[int]


def mark_of(host: str, digest: int) -> int:
    return xxhash.xxh64_intdigest(f"{host} {digest:x}") - (1 << 63)


def host_mark(host: str) -> int:
    return xxhash.xxh64_intdigest(f"{host} ") - (1 << 63)


def read_page(page: str, host: str) -> Page:
    """One walk over the tree; each subtree is told by one range, so nested ones cost no more than others."""
    root = parse(page)
    tops = {id(x) for x in outermost(root, "article") or outermost(root, "main")}
    out = Page([], [], [], [], [])
    text: list[str] = []

    def flush(inside: bool) -> None:
        words = html.unescape("".join(text)).split()
        text.clear()
        if words:
            out.texts.append(" ".join(words))
            out.inside.append(inside)

    # a page part that holds an article is hidden up to it
    todo: list = [(root, iter(root.items), None, not tops, False)]
    while todo:
        node, items, own, inside, hidden = todo[-1]
        for item in items:
            if item is None:
                flush(inside)
            elif isinstance(item, str):
                if not hidden:
                    text.append(item)
            elif (top := id(item) in tops) or not dropped(item, inside and bool(tops)):
                place = None
                if item.tag not in INLINE and item.tag not in TEXT_BLOCKS:
                    flush(inside)
                    place = len(out.marks)
                    out.marks.append(mark_of(host, item.digest))
                    out.first.append(len(out.texts))
                    out.end.append(0)
                within = inside or top
                todo.append((item, iter(item.items), place, within, not within and (hidden or item.role != "")))
                break
        else:
            todo.pop()
            if node.tag not in INLINE:
                flush(inside)
            if own is not None:
                out.end[own] = len(out.texts)
    flush(not tops)
    return out


def main_text(texts: list[str], inside: list[bool], ranges: list[tuple[int, int]]) -> str:
    """Blocks that are in none of the ranges of templates; of these those that articles hold, if they hold ``ARTICLE_SHARE`` of the words."""
    edge = np.zeros(len(texts) + 1, np.int64)
    for first, end in ranges:
        edge[first] += 1
        edge[end] -= 1
    left = [(t, i) for t, i, n in zip(texts, inside, np.cumsum(edge)[:-1].tolist(), strict=True) if not n]
    words = [len(t.split()) for t, _ in left]
    within = sum(n for n, (_, i) in zip(words, left, strict=True) if i)
    return " ".join(t for t, i in left if i or within < ARTICLE_SHARE * sum(words))


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def extract_text(pages: DataFrame, min_pages: int = 5, min_share: float = 0.02, broadcast_rows: int = 200_000) -> DataFrame:
    """One row for each page: page_id, url, text (blocks of the main text joined by one space, empty if none), n_chars.

    Every element subtree of a page is hashed with the page's host. Those that stand in ``min_share`` of the host's pages, and in
    ``min_pages`` of them at least, are its template, and the blocks inside them go; pages with the same text are one page.
    Paragraphs, headings, list items and cells are never templates by themselves, for pages may share passages. Menus, sidebars,
    footers, headers outside articles, scripts, styles and what is hidden go by their tag. Containers whose role, class or id names a
    part (adverts, comments, notices) go unless they hold nearly all of the page, and forms unless they hold more text than their
    fields need; paragraphs and inline elements never go by name. Of what is left, article elements (else a main element) decide where
    they hold a quarter of the words or more: what is outside them goes. The law is the same for hosts of any size; one with fewer than
    ``min_pages`` pages only has no templates. A null html is empty; a null or odd url is the host "". Repeated rows are kept each
    for itself. Other columns are ignored. No rows: no rows.
    """
    pages = only(pages, "page_id", "url", "html")
    ids = pages.schema["page_id"].dataType.simpleString()
    folder = new_folder(pages.sparkSession, "templates")
    schema = f"page_id {ids}, url string, host long, content long, texts array<string>, inside array<boolean>, trees array<struct<mark: long, first: int, end: int>>"
    tree = pa.list_(pa.struct([("mark", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            out: list[list] = [[] for _ in range(5)]
            for url, page in zip(str_column(batch, "url"), str_column(batch, "html"), strict=True):
                p = read_page(page, host := host_of(url))
                trees = [{"mark": m, "first": a, "end": b} for m, a, b in zip(p.marks, p.first, p.end, strict=True) if a < b]
                for column, value in zip(out, (host_mark(host), xxhash.xxh64_intdigest("\n".join(p.texts)) - (1 << 63), p.texts, p.inside, trees), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), tree)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["page_id", "url", "host", "content", "texts", "inside", "trees"])

    parsed = pages.mapInArrow(read, schema).withColumn("row_", F.monotonically_increasing_id()).withColumn("part_", F.spark_partition_id())
    parsed = materialise(parsed, "pages").df
    hosts = parsed.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    hosts = hosts.select(F.col("host").alias("host_"), "pages")
    seen = parsed.select("host", "content", F.explode(F.array_distinct("trees.mark")).alias("mark")).distinct()
    counts = seen.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    templates = materialise(counts.join(hosts, F.col("host") == F.col("host_")).filter(F.col("n") >= min_share * F.col("pages")).select(F.col("mark").alias("mark_")), "templates").df
    small = templates.count() <= broadcast_rows  # 8 bytes each; beyond that the join is a shuffle, whose hot marks can be split
    own = parsed.select("part_", "row_", F.explode("trees").alias("t")).select("part_", "row_", "t.mark", "t.first", "t.end")
    hits = own.join(F.broadcast(templates) if small else templates, F.col("mark") == F.col("mark_")).select("part_", "row_", "first", "end")

    def write(part: int, table: pa.Table) -> None:
        table = table.filter(table["row_"].is_valid())
        save(f"{folder}/part-{part}", row=table["row_"].to_numpy(), first=table["first"].to_numpy(), end=table["end"].to_numpy())

    # what a page loses is sent to its part's file, so that texts aren't shuffled
    filed(hits, parsed, ["row_", "first", "end"], write)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, marks = None, {}
        for batch in small_batches(batches, 128):
            texts = []
            for own, inside, row, at in zip(*[batch.column(i).to_pylist() for i in range(2, 6)], strict=True):
                if at != part:
                    part, marks = at, load(f"{folder}/part-{at}")
                a, b = np.searchsorted(marks["row"], [row, row + 1])
                ranges = list(zip(marks["first"][a:b].tolist(), marks["end"][a:b].tolist(), strict=True))
                texts.append(main_text(own, inside, ranges))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return parsed.select("page_id", "url", "texts", "inside", "row_", "part_").mapInArrow(join, f"page_id {ids}, url string, text string, n_chars long")
