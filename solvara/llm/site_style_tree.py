"""HTML extraction (13): a style tree per site, with entropy-based importance of presentation and content.

All pages of one host are merged into one tree.  A node is a position in the page (tags with their class and id names,
from the root down); it counts in how many pages it occurs, which child sequences it shows there (presentation) and
which texts it holds (content).

* Presentation importance: the entropy of a node's child sequences, as a share of the largest possible.  A menu looks
  the same on every page; an article does not.
* Content importance: one less the mean entropy of a text over the pages, again as a share of the largest possible.  A
  text that comes back on every page says nothing about any of them.

A branch in which every node has low importance is removed from each page of the host.  Of what a page says about
itself, elements that HTML or their names mark as menu, header, footer, sidebar, notice, advert, form or comments are
never main text, and where a page marks its article, the text lies in there.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialize, python_tasks
from .url_filter import host_of

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
             "span strike strong sub sup time tt u var wbr".split())
UNSEEN = set("script style template iframe noembed noframes noscript title head svg math canvas audio video object "
             "select textarea button datalist dialog".split())
RAW_TEXT = set("script style iframe noembed noframes title textarea xmp".split())
#: A start tag ends an open element of these kinds, unless one of the limits lies between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
LIMITS = set("ul ol dl table article main body".split())
#: These end tags do not reach out of a table cell.
CELLS, WITHIN_CELLS = {"td", "th", "table"}, {"p", "div", "li"}
# What is not main text, by element, by role, and by a word of a class or id name.
OTHER_ELEMENTS = set("nav footer aside form menu".split())
OTHER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OTHER_WORDS = set("ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion nav navbar "
                  "navigation menu breadcrumb breadcrumbs masthead footer sidebar aside comment comments disqus replies cookie "
                  "cookies consent gdpr notice notices alert newsletter subscribe signup login popup modal overlay share sharing "
                  "social related recommended widget pager pagination toolbar copyright search form".split())
COMMENT_WORDS = set("comment comments reply replies review reviews".split())

#: Share of a leaf's importance that comes from its content; the rest is its parent's presentation.
CONTENT_SHARE = 0.7
#: A leaf below is noise; within a marked article only what hardly ever changes is.
LEAST_IMPORTANCE, LEAST_IN_ARTICLE = 0.35, 0.1
#: Nodes on fewer pages of a host are not judged by entropy.
LEAST_PAGES = 8

_ATTRIBUTES = r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+"
#: Comments, declarations, elements whose content is not markup (both whole), end tags, start tags with attributes.
_RAW = "|".join(rf"<{t}(?=[\s/>]){_ATTRIBUTES}(?:>|\Z).*?(?:</{t}(?=[\s/>])[^>]*(?:>|\Z)|\Z)" for t in sorted(RAW_TEXT))
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|{_RAW}"
                    rf"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S | re.I)
_NAME = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = str.maketrans("123456789", "000000000")


@dataclass(frozen=True)
class Marks:
    """What a start tag says by itself: its key in the tree, and whether it names main text or something else."""

    key: str
    hash: int
    named: bool
    header: bool
    comments: bool
    article: bool
    other: bool
    unseen: bool
    passing: bool  # neither breaks nor holds a block of its own


@lru_cache(maxsize=1 << 14)
def _marks(tag: str, attributes: str) -> Marks:
    found = [(k.lower(), a or b or c) for k, a, b, c in _NAME.findall(attributes)]
    names = " ".join(sorted(v for k, v in found if k != "role")).lower().translate(_DIGITS)
    words = {w.lower() for k, v in found if k != "role" for w in _WORD.findall(v)}
    role = next((v.lower() for k, v in found if k == "role"), "")
    marked = tag in ("article", "main")
    article = marked and COMMENT_WORDS.isdisjoint(words) or role == "main"
    other = tag in OTHER_ELEMENTS or role in OTHER_ROLES or marked and not article
    key, named = f"{tag} {names}", not OTHER_WORDS.isdisjoint(words)
    return Marks(key, xxh64_intdigest(key), named and not marked and tag not in ("html", "body"),
                 tag == "header" or "header" in words and not article, not (COMMENT_WORDS.isdisjoint(words) or marked or tag in ("html", "body")), article, other, tag in UNSEEN, tag in VOID or tag in INLINE and not named)


@dataclass(eq=False, slots=True)
class Element:
    tag: str
    node: int
    parent: "Element | None"
    unseen: bool = False
    other: bool = False      # by its tag or role
    named: bool = False      # by a word of its class or id
    comments: bool = False   # likewise, as readers' comments
    article: bool = False
    holds_article: bool = False
    holds_title: bool = False
    inner: int = 0           # open elements of the same inline tag inside a named inline element
    children: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """Elements of a page, in order, and its blocks: ``(element, text)`` with references decoded and white space made one.

    Inline elements neither break nor join text.  Paragraphs, list items and table cells end where HTML ends them
    without an end tag; end tags without a start are passed over; what is cut off at the page's end counts as it stands.
    """
    root = Element("", 0, None)
    elements, blocks, stack, pieces = [root], [], [root], []
    top, open_tags = root, Counter()

    def close(i: int):
        for e in stack[i:]:
            open_tags[e.tag] -= 1
        del stack[i:]

    def flush():
        text = " ".join((pieces[0] if len(pieces) == 1 else "".join(pieces)).split())
        pieces.clear()
        if text and not top.unseen:
            blocks.append((top, text))

    tokens = _TOKEN.split(page)
    tokens += [None] * 3
    for at in range(0, len(tokens), 4):
        text, end, tag, attributes = tokens[at:at + 4]
        if text:
            pieces.append(html.unescape(text) if "&" in text else text)
        if end:
            if end != top.tag:
                end = end.lower()
            if end in INLINE:
                if end == top.tag:
                    if top.inner:
                        top.inner -= 1
                    else:
                        flush()
                        close(len(stack) - 1)
                        top = stack[-1]
                elif end == "br":
                    pieces.append(" ")
                continue
            if not open_tags[end]:  # an end without a start
                continue
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i].tag
                if open_tag == end:
                    if pieces:
                        flush()
                    close(i)
                    top = stack[-1]
                    break
                if open_tag in CELLS and end in WITHIN_CELLS:
                    break
        elif tag:
            tag = tag.lower()
            marks = _marks(tag, attributes if attributes and _NAME.search(attributes) else "")
            if marks.passing:
                if tag == "br":
                    pieces.append(" ")
                elif tag == "hr":
                    if pieces:
                        flush()
                elif tag == top.tag:
                    top.inner += 1
                continue
            if pieces:
                flush()
            if tag not in INLINE:
                ended = [t for t in ENDS.get(tag, ()) if open_tags[t]]
                for i in range(len(stack) - 1, 0, -1):
                    open_tag = stack[i].tag
                    if open_tag == "p" or open_tag in ended:
                        close(i)
                        ended = [t for t in ended if open_tags[t] and t != open_tag]
                    elif open_tag in LIMITS or open_tag not in INLINE and not ended:
                        break
            parent = stack[-1]
            e = Element(tag, xxh64_intdigest(marks.key, parent.node), parent, parent.unseen or marks.unseen, marks.other, marks.named, marks.comments, marks.article)
            parent.children.append(marks.hash)
            if marks.header and not _inside_article(parent):
                e.named = True
            elements.append(e)
            if tag == "h1":
                while parent is not None and not parent.holds_title:
                    parent.holds_title = True
                    parent = parent.parent
            if not (marks.unseen and attributes and attributes.rstrip().endswith("/")):
                stack.append(e)
                open_tags[tag] += 1
            top = stack[-1]
    if pieces:
        flush()
    return elements, blocks


def _inside_article(e: Element | None) -> bool:
    while e is not None:
        if e.article:
            return True
        e = e.parent
    return False


def main_blocks(page: str) -> tuple[list[Element], list[tuple[Element, str, bool, bool]]]:
    """``(element, text, may be main text, lies in an article)`` of each block, from the page alone."""
    elements, blocks = parse(page)
    for e in elements:
        if e.article and not _passed_over(e.parent):
            up = e.parent
            while up is not None and not up.holds_article:
                up.holds_article = True
                up = up.parent
    judged: dict[int, tuple[bool, bool]] = {}
    for e in elements:  # a parent comes before its children
        ok, inside = judged[id(e.parent)] if e.parent is not None else (True, False)
        holds = e.holds_article or e.article
        by_name = (e.comments or e.named and not holds) and not e.holds_title
        by_tag = e.other and not (e.holds_article or e.tag == "form" and e.holds_title)
        judged[id(e)] = (ok and not by_name and not by_tag and not e.unseen, inside or (ok and e.article and not by_tag))
    out = [(e, text, *judged[id(e)]) for e, text in blocks]
    if any(ok and inside for _, _, ok, inside in out):
        out = [(e, text, ok and inside, inside) for e, text, ok, inside in out]
    return elements, out


def _passed_over(e: Element | None) -> bool:
    while e is not None:
        if e.other or e.unseen or e.comments and not e.holds_title:
            return True
        e = e.parent
    return False


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


CONTENT, PRESENTATION, PAGES = range(3)


def page_counts(host: int, page: str, into: dict) -> None:
    """Add one page to the counts of its host's tree: (host, node, kind, item) -> [n, sum of n ln n, parent]."""
    elements, blocks = parse(page)
    nodes: dict[int, tuple[Counter, int]] = {}
    for e, text in blocks:
        counts, _ = nodes.setdefault(e.node, (Counter(), e.parent.node if e.parent else 0))
        counts[xxh64_intdigest(text.translate(_DIGITS))] += 1
    for node, (counts, parent) in nodes.items():
        _add(into, (host, node, PAGES, 0), 1, 0.0, parent)
        for item, n in counts.items():
            _add(into, (host, node, CONTENT, item), n, n * log(n), parent)
    shown = Counter((e.node, xxh64_intdigest(",".join(map(str, e.children)))) for e in elements if e.children and not e.unseen)
    for (node, item), n in shown.items():
        _add(into, (host, node, PRESENTATION, item), n, 0.0, 0)


def _add(into: dict, key: tuple, n: int, e: float, parent: int) -> None:
    old = into.get(key)
    if old is None:
        into[key] = [n, e, parent]
    else:
        old[0] += n
        old[1] += e


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, node, pages, importance)`` of every node that holds text, over all pages of its host.

    ``host`` and ``node`` are 64-bit hashes of the host's name and of the position.  Counts are added up within tasks
    before the shuffle, and no host is gathered anywhere: a host with most of the pages is many (node, text) groups.
    """
    python_tasks(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            into: dict = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page_counts(host, page, into)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in into], pa.int64()), pa.array([_signed(k[1]) for k in into], pa.int64()),
                 pa.array([k[2] for k in into], pa.int8()), pa.array([_signed(k[3]) for k in into], pa.int64()),
                 pa.array([v[0] for v in into.values()], pa.int64()), pa.array([v[1] for v in into.values()], pa.float64()),
                 pa.array([_signed(v[2]) for v in into.values()], pa.int64())],
                names=["host", "node", "kind", "item", "n", "e", "parent"])

    counts = pages.select(host_key(F.col(url_col)).alias("host"), _html(html_col)).mapInArrow(
        run, "host long, node long, kind byte, item long, n long, e double, parent long")
    items = (counts.groupBy("host", "node", "kind", "item")
             .agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.max("parent").alias("parent")))
    n, kind = F.col("n"), F.col("kind")
    nodes = materialize(items.groupBy("host", "node").agg(
        F.sum(F.when(kind == PAGES, n)).alias("pages"),
        F.avg(F.when(kind == CONTENT, F.log(n) - F.col("e") / n)).alias("spread"),
        F.sum(F.when(kind == PRESENTATION, n)).alias("shown"),
        F.sum(F.when(kind == PRESENTATION, n * F.log(n))).alias("shown_e"),
        F.max(F.when(kind != PRESENTATION, F.col("parent"))).alias("parent")), "nodes")  # narrow: a row per host and position
    looks = nodes.where("shown is not null").select(
        "host", F.col("node").alias("parent"),
        F.when(F.col("shown") >= LEAST_PAGES, (F.log("shown") - F.col("shown_e") / F.col("shown")) / F.log("shown"))
        .otherwise(1.0).alias("presentation"))
    content = F.when(F.col("pages") >= LEAST_PAGES, 1 - F.col("spread") / F.log("pages")).otherwise(1.0)
    return (nodes.where("pages is not null").select("host", "node", "parent", "pages", F.greatest(F.lit(0.0), content).alias("content"))
            .join(looks, ["host", "parent"], "left")
            .select("host", "node", "pages",
                    (CONTENT_SHARE * F.col("content") + (1 - CONTENT_SHARE) * F.coalesce("presentation", F.lit(1.0))).alias("importance")))


def host_key(url: Column) -> Column:
    return F.xxhash64(host_of(url))


def _html(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("html")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every row, blocks joined by one space; empty if there is none.

    A null or empty page has an empty text; a null url counts to the host without a name; repeated rows stay; an empty
    table gives an empty result; other columns are not read.  Where entropy would leave a page without any text (a host
    whose pages are all copies of each other), the page keeps what it does not itself mark as something else.  Per host, the list of
    low-importance nodes travels to the pages: its size follows the site's templates, not its pages.
    """
    tree = style_tree(pages, url_col, html_col).where(F.col("importance") < max(LEAST_IMPORTANCE, LEAST_IN_ARTICLE))
    # written, so that its size is known before the pages are read: small enough, it goes to them; else both are dealt by host
    noise = materialize(tree.groupBy("host").agg(F.collect_list(F.struct("node", "importance")).alias("noise")), "noise")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_key(F.col(url_col)).alias("host"), _html(html_col))
    joined = rows.join(noise, "host", "left").select("page_id", "url", "html", "noise.node", "noise.importance")
    id_type = joined.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, nodes, importance in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                low = dict(zip(nodes, importance)) if nodes else {}
                blocks = [(_signed(e.node), text, inside) for e, text, ok, inside in main_blocks(page)[1] if ok]
                kept = [text for node, text, inside in blocks
                        if low.get(node, 1.0) >= (LEAST_IN_ARTICLE if inside else LEAST_IMPORTANCE)]
                texts.append(" ".join(kept or [text for _, text, _ in blocks]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
