"""HTML extraction (operator 3): site templates are removed by counting hashed element subtrees per host.

A first pass hashes every element subtree (tag, class, text, children) and counts, in Spark, on how many
pages of its host it stands.  A subtree on at least ``least_pages`` pages and ``least_share`` of the host's
pages is part of the site's template; a host has at most (subtrees a page / ``least_share``) of them, so its
list is bounded.  A second pass deletes these subtrees and elements that by tag, role or class are menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments, and returns the text
blocks of the rest.  Pages, main elements and articles are not judged by parts of class names.  Subtrees inside ``article`` or ``main`` are content even where they recur (a site may
print one article on many pages); if a page has such an element outside of deleted ones, only its blocks are returned.

White space inside a block becomes one space; ``br`` is white space.  Null pages have empty text; null urls
belong to the host without name.  Pages are independent but for the counts, in which a repeated row is a page
of its own.  An empty table gives an empty one; extra columns are ignored."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefmill.llm.common import map_arrow, written
from briefmill.llm.url_filter import url_parts

LEAST_PAGES = 10
LEAST_SHARE = 0.1

# Fixed values of the markup language and of common class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = RAW | frozenset(
    "head nav header footer aside form button select option datalist input dialog menu object embed audio video canvas map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
DROPPED_CLASSES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices popup modal overlay "
    "newsletter subscribe sidebar side menu nav navbar navigation breadcrumb breadcrumbs share sharing social related comment comments "
    "disqus header footer masthead login signup form skip pagination pager toolbar widget".split())
CONTENT = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body", "main"))  # never dropped by class, nor is an article but by these
ARTICLE_CLASSES = frozenset("comment comments related teaser ad ads advert advertisement".split())
# An opening tag of the key closes open elements of the values.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"},
}
SCOPES = frozenset("article aside body div footer header html main nav ol section table td th ul".split())

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_CLASS_PARTS = re.compile(r"[\s_-]+")


class Element:
    __slots__ = ("tag", "marks", "role", "parts", "content")

    def __init__(self, tag: str, marks: str, role: str, content: bool):
        self.tag, self.marks, self.role = tag, marks, role
        self.parts: list[Element | str] = []  # children and raw text in page order
        self.content = content  # is or is inside an article or main element

    def dropped(self) -> bool:
        if self.tag in WHOLE:
            return False
        if self.tag == "article":
            return not ARTICLE_CLASSES.isdisjoint(self.marks.lower().split())
        return self.tag in DROPPED or self.role in DROPPED_ROLES or (
            bool(self.marks) and not DROPPED_CLASSES.isdisjoint(_CLASS_PARTS.split(self.marks.lower())))


def parse(html: str) -> Element:
    """A tree of elements; end tags left out are supplied, those without a start are ignored."""
    root = Element("html", "", "", False)
    stack, at, raw = [root], 0, {}
    while True:
        markup = _MARKUP.search(html, at)
        if markup is None:
            stack[-1].parts.append(html[at:])
            return root
        if markup.start() > at:
            stack[-1].parts.append(html[at : markup.start()])
        at = markup.end()
        if markup[2] is None:  # a comment or declaration
            continue
        tag = markup[2].lower()
        if markup[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in CONTENT and tag in ("p", "div", "span"):
                    break
            continue
        if tag in ("html", "body") and any(e.tag == tag for e in stack[1:]):
            continue
        if tag in BLOCKS:
            _close(stack, {"p"})
        if tag in CLOSES:
            _close(stack, CLOSES[tag])
        marks = role = ""
        if markup[3]:
            for found in _ATTRIBUTE.finditer(markup[3]):
                value = found[2] or found[3] or found[4] or ""
                if found[1].lower() == "role":
                    role = value.lower()
                else:
                    marks += " " + value
        element = Element(tag, marks, role, tag in CONTENT or stack[-1].content)
        stack[-1].parts.append(element)
        if tag in RAW:
            if tag not in raw:
                raw[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)
            end = raw[tag].search(html, at)
            element.parts.append(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
        elif tag not in VOID and not markup[3].endswith("/"):
            stack.append(element)
        elif tag not in VOID and tag in BLOCKS:
            stack.append(element)  # a slash means nothing on elements that have content


def _close(stack: list[Element], tags: set[str]) -> None:
    """Close the nearest open element of ``tags`` that no other container encloses."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in SCOPES:
            return


def subtree_hashes(root: Element) -> dict[int, int]:
    """Hash of each element (by ``id``) that is not inside content.  Walks without recursion."""
    order, stack = [], [root]
    while stack:
        element = stack.pop()
        order.append(element)
        stack.extend(p for p in element.parts if not isinstance(p, str))
    out: dict[int, int] = {}
    for element in reversed(order):
        parts = [element.tag, element.marks]
        for part in element.parts:
            parts.append(" ".join(part.split()) if isinstance(part, str) else f"\1{out[id(part)]}")
        out[id(element)] = xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)
    return {id(e): out[id(e)] for e in order if not e.content and e is not root}


def has_content(root: Element) -> bool:
    """Whether an article or main stands outside of dropped elements."""
    stack = [root]
    while stack:
        element = stack.pop()
        if element is not root and element.dropped():
            continue
        if element.tag in CONTENT:
            return True
        stack.extend(p for p in element.parts if not isinstance(p, str))
    return False


def main_text(html: str | None, template: frozenset[int] = frozenset()) -> tuple[str, int]:
    """Text blocks joined by newlines, and how many subtrees of the site's template were deleted."""
    if not html:
        return "", 0
    root = parse(html)
    hashes = subtree_hashes(root) if template else {}
    only_content = has_content(root)
    blocks: list[str] = []
    open_block: list[str] = []
    deleted = 0

    def end_block() -> None:
        text = " ".join(unescape("".join(open_block)).split())
        if text:
            blocks.append(text)
        open_block.clear()

    todo: list[Element | str | None] = [root]
    inside: list[bool] = [False]  # whether text at this depth is wanted
    while todo:
        part = todo.pop()
        if part is None:  # a block element ends
            end_block()
            inside.pop()
        elif isinstance(part, str):
            if inside[-1]:
                open_block.append(part)
        elif hashes.get(id(part)) in template and hashes:
            deleted += 1
            if part.tag in BLOCKS:
                end_block()
        elif part is not root and part.dropped():
            if part.tag in BLOCKS:
                end_block()
        elif part.tag == "br" or part.tag == "wbr":
            open_block.append(" " if part.tag == "br" else "")
        elif part.tag in BLOCKS or part is root:
            end_block()
            inside.append(part.content or not only_content)
            todo.append(None)
            todo.extend(reversed(part.parts))
        else:
            todo.extend(reversed(part.parts))
    end_block()
    return "\n".join(blocks), deleted


def _hosted(pages: DataFrame) -> DataFrame:
    host, _ = url_parts(F.col("url"))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host.alias("host"))


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, hashes): the recurring subtrees of each host that has any."""

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: Counter = Counter()
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                counts[host, 0] += 1  # the page itself
                if html:
                    counts.update((host, h) for h in set(subtree_hashes(parse(html)).values()) if h)
            keys = list(counts)
            return pa.record_batch([
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(counts.values()), pa.int64()),
            ], ["host", "hash", "n"])

        return step

    hosted = _hosted(pages)
    counted = map_arrow(hosted.select("host", "html"), start, "host string, hash bigint, n bigint").groupBy("host", "hash").agg(F.sum("n").alias("n"))
    counted = written(counted.filter((F.col("hash") == 0) | (F.col("n") >= least_pages)), "subtrees")
    sizes = counted.filter("hash = 0").select("host", F.col("n").alias("pages"))
    recurring = counted.filter("hash != 0").join(sizes, "host").filter(F.col("n") >= least_share * F.col("pages"))
    return written(recurring.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("hashes")), "templates")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per row: page_id, url, text and n_deleted, the number of template subtrees deleted."""
    known = templates(pages, least_pages, least_share)

    def start():
        sets: dict = {}

        def template(hashes: tuple[int, ...]) -> frozenset[int]:
            if hashes not in sets:
                if len(sets) > 1000:
                    sets.clear()
                sets[hashes] = frozenset(hashes)
            return sets[hashes]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [
                main_text(html, template(tuple(hashes or ())))
                for html, hashes in zip(batch.column("html").to_pylist(), batch.column("hashes").to_pylist())]
            return pa.record_batch([
                batch.column("page_id"), batch.column("url"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()),
            ], ["page_id", "url", "text", "n_deleted"])

        return step

    joined = _hosted(pages).join(known, "host", "left").select("page_id", "url", "html", "hashes")
    return map_arrow(joined, start, "page_id bigint, url string, text string, n_deleted bigint")


def articles(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
