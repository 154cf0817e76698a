"""Main-text extraction with a site style tree.

Pages of one host are merged into a style tree: a node for each element path (tags with their class, id and role), its
presentation styles (the sequences of child elements seen there) and the contents of its text leaves.

* Content importance: one minus the mean normalised entropy of the leaf contents at and below a node.  A content seen
  on one page only weighs one, a content seen on all m pages of the node weighs nothing: 1 - log(k) / log(m).
* Presentation importance: the entropy of the node's styles, to the base of their number; 0 on fewer than MIN_PAGES
  pages, where one style proves nothing.
* A node's importance is (1 - GAMMA) * presentation + GAMMA * content.

Branches of low importance are removed from each page, and nothing else that has text but what is never shown (scripts,
styles, form controls, hidden elements).  What is low depends on what supports the judgement:

* LOW for a node without any sign, on MIN_PAGES pages at least; text elements (paragraphs, headings, ...) without a
  sign are not judged, as a passage that pages share is no boilerplate.
* SIGNED_LOW for a node whose element or names say that it is no article (menus, forms, adverts, ...), or that stands
  outside the articles of pages that have one.  It stays only where its importance says otherwise: if nearly every page
  presents it in a way of its own.

Headings' containers in an article are no page headers.  Elements nested deeper than FOLD are merged with the element of
the same name above them, and beyond DEEPEST with the one that holds them; they are judged as those are.

Text: character references decoded, white space inside a block one space, trimmed, blocks joined by one ``\\n``.
Null and empty html give an empty text; broken markup is read as browsers do (implied end tags, stray end tags
ignored); white space is Unicode white space.  Repeated pages and null ids stay separate rows, each a page of its host;
pages without a host are judged together; extra columns are ignored.  Tree statistics are aggregated by hash with
map-side combination, so a host with a third of all pages is no hot spot; the low branches are broadcast up to
BROADCAST_BRANCHES rows and beyond that joined by host.  A page is held whole by one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, passed, table
from .url_filters import url_host

GAMMA = 0.9
MIN_PAGES = 8
LOW = 0.4
SIGNED_LOW = 0.97
FOLD, DEEPEST = 64, 1000
BROADCAST_BRANCHES = 100_000

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "search section summary table tbody td tfoot th thead title tr ul caption".split()
)
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
NO_ARTICLE = frozenset("nav footer aside form menu dialog search".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption article main body html section".split())
FOREIGN = frozenset("svg math".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]), "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]), "tfoot": frozenset(["tr", "td", "th", "thead", "tbody"]),
}
#: Beyond these an implied end tag does not reach.
FENCE = frozenset("ul ol dl table div article section main aside nav body html td th blockquote form header footer".split())
#: Words in class, id or role that mark what is no article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr notice notices alert notification popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside widget footer header masthead topbar toolbar comment comments commentlist reply replies respond disqus share sharing social related recommended teaser promo promotion subscribe newsletter signup login "
    "search searchbox form pagination pager skip contentinfo complementary".split()
)
#: Marks that name the container of a heading inside an article.
HEADERS = frozenset("header masthead".split())
#: Rows of the tree that a worker sends at a time.
ROWS = 100_000
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


class Place:
    """A node of a page's share of the tree: an element path."""

    __slots__ = ("id", "name", "up", "depth", "kids", "tag", "sign", "styles", "leaves", "main")

    def __init__(self, up: Place | None, name: str, tag: str, sign: bool) -> None:
        self.up, self.name, self.tag, self.sign = up, name, tag, sign
        self.id = _path_id(0 if up is None else up.id, name)
        self.depth = 0 if up is None else up.depth + 1
        self.kids: dict[str, Place] = {}
        self.styles: set[int] = set()
        self.leaves: set[int] = set()
        self.main = False

    def kid(self, name: str, tag: str, sign: bool) -> Place:
        if self.depth >= FOLD:
            if self.depth >= DEEPEST:
                return self
            at: Place | None = self
            while at is not None and at.name != name:
                at = at.up
            if at is not None:
                return at
        if name not in self.kids:
            self.kids[name] = Place(self, name, tag, sign)
        return self.kids[name]


@lru_cache(1 << 16)
def _path_id(up: int, name: str) -> int:
    return digest(f"{up}\n{name}")


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Node:
    __slots__ = ("tag", "hidden", "items", "parent", "place")

    def __init__(self, tag: str, place: Place, hidden: bool, parent: Node | None) -> None:
        self.tag, self.place, self.hidden, self.parent = tag, place, hidden, parent
        self.items: list[Node | str] = []


@lru_cache(1 << 14)
def _sign(tag: str, names: str, inside: bool) -> bool:
    """Whether an element's tag or names say that it is no article."""
    if tag in NO_ARTICLE or (tag == "header" and not inside):
        return True
    if not names or tag in ("html", "body", "article", "main") and not (tag == "article" and "comment" in names):
        return False
    words = {w.lower() for part in re.split(r"[^A-Za-z]+", names) for w in _NAMES.findall(part)} | set(re.split(r"[^a-z]+", names.lower()))
    return bool(words & (MARKS - HEADERS if inside else MARKS))


@lru_cache(1 << 14)
def _name(tag: str, names: str) -> str:
    return tag + ("." + re.sub(r"\d+", "0", names.strip().lower()) if names.strip() else "")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#", Place(None, "#", "#", False), False, None)
        self.at, self.articles = self.root, 0

    def _empty(self, tag: str) -> None:
        self.at.items.append(Node(tag, self.at.place, False, self.at))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self._empty(tag)
            return
        if tag in BLOCK and tag != "option":
            self._imply(frozenset(["p"]), FENCE)
        if tag in CLOSED_BY:
            self._imply(CLOSED_BY[tag], FENCE - {"td", "th"} if tag in ("td", "th", "tr", "tbody", "tfoot") else FENCE)
        names, hidden = "", tag in HIDDEN
        if attrs:
            names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
            hidden = hidden or any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        sign = _sign(tag, names, self.articles > 0)
        at = self.at.place
        node = Node(tag, at if hidden else at.kid(_name(tag, names), tag, sign), hidden, self.at)
        if tag in ("article", "main") and not hidden:
            self.articles += 1
            node.place.main = node.place.main or not sign
        self.at.items.append(node)
        self.at = node

    def _close(self) -> None:
        self.articles -= self.at.tag in ("article", "main") and not self.at.hidden
        self.at = self.at.parent

    def _imply(self, tags: frozenset, fence: frozenset) -> None:
        """Ends the innermost of these elements, if no fence stands before it."""
        node, last = self.at, None
        while node is not self.root and node.tag not in fence - tags:
            if node.tag in tags:
                last = node
                if tags != CLOSED_BY["tr"] and tags != CLOSED_BY["tbody"]:
                    break
            node = node.parent
        if last is not None:
            while self.at is not last.parent:
                self._close()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in FOREIGN:  # only these end themselves; elsewhere the slash means nothing
            self._empty("img")
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is self.root:
            if tag == "p":  # a stray end tag is an empty paragraph
                self._empty("hr")
            return
        while self.at is not node.parent:
            self._close()

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def tree_rows(root: Node) -> Iterator[tuple[int, list[int] | None, int, int, bool, bool]]:
    """Of a page: (path, ids of the path from the root, kind, digest, sign, textual), each once.

    Kind 0 is the content of a text leaf, 1 a style, 2 the path itself; the last three columns but digest say what it is.
    """
    stack = [root]
    while stack:
        node = stack.pop()
        kids = [x for x in node.items if not isinstance(x, str)]
        if node is not root:
            names = [x.tag if x.place is node.place else x.place.name for x in kids if not x.hidden]
            node.place.styles.add(digest("\n".join(k for i, k in enumerate(names) if not i or names[i - 1] != k)))
            text = " ".join(" ".join(x for x in node.items if isinstance(x, str)).split())
            if text:
                node.place.leaves.add(digest(text))
        stack += [x for x in kids if not x.hidden and x.tag not in VOID]
    # places from the root, so that one comes after those above it
    places, holds = [root.place], set()
    for place in places:
        places += place.kids.values()
    for place in reversed(places):
        if place.main or place.id in holds:
            holds.add(place.id)
            if place.up is not None:
                holds.add(place.up.id)
    articles, inside = root.place.id in holds, set()
    above: dict[int, list[int]] = {root.place.id: []}
    for place in places[1:]:
        chain = above[place.id] = [*above[place.up.id], place.id]
        if place.main or place.up.id in inside:
            inside.add(place.id)
        outside = articles and place.id not in holds and place.id not in inside
        yield place.id, chain, 2, 0, place.sign or outside, place.tag in TEXTUAL
        for kind, digests in ((0, place.leaves), (1, place.styles)):
            for d in digests:
                yield place.id, None, kind, d, False, False


def extract(root: Node, low: frozenset[int] = frozenset()) -> str:
    """Text of the page without what is hidden and without branches whose path is in low."""

    def gone(node: Node) -> bool:
        return node.hidden or (node.place.id in low and node.tag not in VOID)

    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = " ".join("".join(held).split())
        if text:
            blocks.append(text)
        held.clear()

    todo: list = [root]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            held.append(item)
        elif item.tag in VOID:
            held.append(" ")
            if item.tag == "hr":
                end()
        else:
            if item.tag in BLOCK:
                end()
                todo.append(None)
            for x in reversed(item.items):
                if isinstance(x, str) or not gone(x):
                    todo.append(x)
                elif x.tag in BLOCK:
                    todo.append(None)
    end()
    return "\n".join(blocks)


_TREE = {"host": pa.string(), "path": pa.int64(), "above": pa.list_(pa.int64()), "kind": pa.int32(), "digest": pa.int64(), "sign": pa.bool_(), "textual": pa.bool_()}


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            for row in tree_rows(parse(html)):
                rows.append((host, *row))
                if len(rows) >= ROWS:
                    yield _table(rows)
        yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in _TREE]
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _TREE.values(), strict=True)], names=list(_TREE))


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, m, sign, textual, importance) of the nodes of each host's tree.  pages: host, html."""
    rows = pages.mapInArrow(_tree, "host string, path long, above array<long>, kind int, digest long, sign boolean, textual boolean")
    seen = rows.groupBy("host", "path", "kind", "digest").agg(F.count("*").alias("k"), F.max("above").alias("above"), F.max("sign").alias("sign"), F.max("textual").alias("textual"))
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0.0))
    k = F.col("k").cast("double")
    own = [of(2, k).alias("m"), of(1, k).alias("s"), of(1, k * F.log(k)).alias("slogs"), of(0, k).alias("n"), of(0, k * F.log(k)).alias("klogk")]
    counted = seen.groupBy("host", "path").agg(*own, F.max("above").alias("above"), F.max("sign").alias("sign"), F.max("textual").alias("textual"))
    # a leaf's contents count for it and for all nodes above it
    here = F.col("path") == F.col("at")
    spread = counted.select("*", F.explode("above").alias("at"))
    nodes = spread.groupBy("host", "at").agg(
        F.sum("n").alias("n"), F.sum("klogk").alias("klogk"), *[F.max(F.when(here, F.col(c))).alias(c) for c in ("m", "s", "slogs", "sign", "textual")]
    )
    # a content on k of m pages has an entropy of log k / log m
    content = F.when((F.col("m") > 1) & (F.col("n") > 0), 1 - F.least(F.lit(1.0), F.col("klogk") / F.col("n") / F.log("m"))).otherwise(1.0)
    presentation = F.when(F.col("m") >= MIN_PAGES, F.coalesce((F.log("s") - F.col("slogs") / F.col("s")) / F.nullif(F.log("s"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return nodes.select("host", F.col("at").alias("path"), "m", "sign", "textual", ((1 - GAMMA) * presentation + GAMMA * content).alias("importance"))


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, path): the low-importance branches of each host.  pages: host, html."""
    unsigned = (F.col("m") >= MIN_PAGES) & (F.col("importance") < LOW) & ~F.col("textual")
    return importance(pages).filter((F.col("sign") & (F.col("importance") < SIGNED_LOW)) | unsigned).select("host", "path")


def main_text(pages: DataFrame, html: str = "html", url: str = "url", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The columns of keep and text, for every row.  Outputs go before keep."""
    spark = pages.sparkSession
    keep = passed(keep, ("text",))
    bounded_batches(spark)
    source = pages.select(*[F.col(c).alias(f"keep_{c}") for c in keep], url_host(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    from .common import cut_lineage

    branches = cut_lineage(low_branches(source.select("host", "html")))
    n = branches.count()
    by_host = branches.groupBy("host").agg(F.collect_set("path").alias("low"))
    joined = source.join(F.broadcast(by_host) if n <= BROADCAST_BRANCHES else by_host, "host", "left").drop("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = batch.column("low").to_pylist()
            texts = [extract(parse(h), frozenset(x or ())) for h, x in zip(batch.column("html").to_pylist(), lows, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f"keep_{c}") for c in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = StructType([pages.schema[c] for c in keep] + StructType.fromDDL("text string").fields)
    return joined.mapInArrow(run, schema)


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
