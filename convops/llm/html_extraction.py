"""Main-text extraction with removal of site templates.

A small parser turns a page into an element tree. Every block element of its body is the root of a subtree, hashed over
its elements, classes and words; Spark counts on how many different pages of its host each hash occurs, and the subtrees
that recur on many of them go. Inside an article a recurring passage may be content, so a heading, paragraph or list
item there counts only together with its place: the same words as the n-th block from the article's start or end on many
pages are a notice. Pages with the same main text count as one, so copies of a page don't make its text a template.

On how many pages a subtree must recur grows with the root of the host's pages, not in proportion (``needed``).

Rules only supplement the counts: elements, roles and whole class names or ids that say what they are (menus, headers,
footers, sidebars, forms, scripts, comments, adverts, notices) go also where a host has too few pages to count; class
names never remove a heading or paragraph. What is left is the text of all articles of the page in order, else of its
main element, else of its body.

A page is parsed once for the count and once for the result, and its markup is never shuffled; a host's list of
templates holds at most its pages' blocks times pages / needed.

Defined cases: null html is empty and gives an empty text; null urls have no host and no templates; unclosed and stray
tags are tolerated; repeated rows count once and are extracted each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convops.llm.shared import stored

#: A subtree is no template on fewer pages than this.
MIN_PAGES = 5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/)?(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_RAW = frozenset({"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed"})
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav footer aside form script style textarea title noscript iframe template button select "
                     "svg canvas object dialog menu audio video".split())
_BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot "
                    "tr td th caption blockquote pre figure figcaption header hgroup address details summary center "
                    "hr fieldset nav footer aside form".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
#: Elements that hold text of their own, which no class name removes.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
_ROOTS = frozenset("html body article main".split())
#: element -> open elements that its start tag ends
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_SCOPES = frozenset("html body article main section div table td th ul ol dl blockquote nav aside footer header".split())
_UNWANTED = frozenset("ad ads advert advertisement advertising adbox adslot sponsor sponsored promo promotion banner "
                      "sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus cookie cookies "
                      "consent notice notices gdpr popup modal newsletter subscribe share sharing social related "
                      "recommended footer header masthead widget pagination pager toolbar site-header site-footer "
                      "page-header page-footer main-nav site-nav nav-menu main-menu skip-link sidebar-left "
                      "sidebar-right cookie-banner cookie-notice cookie-consent ad-box ad-slot ad-container ad-banner "
                      "share-buttons social-share social-links social-media related-posts related-articles "
                      "comment-list commentlist comments-area comments-section comment-form comment-respond "
                      "newsletter-signup newsletter-form subscribe-form".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def unwanted(self, inside: bool) -> bool:
        """inside: within an article, whose own header holds its title."""
        if self.name in _DROPPED or (self.name == "header" and not inside):
            return True
        names = f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".lower().split()
        if self.name in _ROOTS:
            return "comment" in names or "comments" in names
        if self.attrs.get("role", "").lower() in _ROLES or "hidden" in self.attrs:
            return True
        return (self.name not in _TEXT and any(n in _UNWANTED for n in names)
                and not (inside and self.name in ("header", "hgroup")))


def parse(page: str) -> Node:
    root = Node("html", {})
    open_ = [root]
    at = 0
    skip_to = None  # name of a raw element whose end is awaited
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        name = (m["name"] or m["name2"] or "").lower()
        closing = bool(m["close"] or m["close2"])
        if skip_to and not (closing and name == skip_to):
            continue
        if m.start() > at and not skip_to:
            open_[-1].children.append(page[at:m.start()])
        at = m.end()
        if not name:
            if m[0].startswith("<![CDATA["):
                open_[-1].children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if closing:
            skip_to = None
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name == name:
                    del open_[k:]
                    break
                if name not in _SCOPES and open_[k].name in _SCOPES:
                    break
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        node = Node(name, {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(attrs or "")})
        ends = _ENDS.get(name, frozenset()) | ({"p"} if name in _BLOCKS else set())
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].name in ends:
                del open_[k:]
                break
            if open_[k].name in _SCOPES:
                break
        open_[-1].children.append(node)
        if name in _RAW and not attrs.endswith("/"):
            skip_to = name
            open_.append(node)
        elif name not in _VOID and not attrs.endswith("/"):
            open_.append(node)
    if at < len(page) and not skip_to:
        open_[-1].children.append(page[at:])
    return root


def is_article(node: Node) -> bool:
    return node.name == "article" or node.attrs.get("itemprop") == "articleBody"


def is_main(node: Node) -> bool:
    return node.name == "main" or node.attrs.get("role") == "main"


def _number(h: hashlib._Hash, place: bool) -> int:
    """A hash as a signed number; odd ones are those of a place in an article."""
    return int.from_bytes(h.digest(), "big", signed=True) & ~1 | place


class Block:
    """A run of text between block elements, with the hashes of the subtrees around it.

    part: 2 inside an article, 1 inside a main element, 0 elsewhere; dropped: inside an element that goes by rule.
    """
    __slots__ = ("text", "around", "part", "dropped", "article", "places")

    def __init__(self, text: str, around: tuple, part: int, dropped: bool, article: Node | None):
        self.text, self.around, self.part, self.dropped, self.article = text, around, part, dropped, article
        self.places: list[int] = []

    def within(self) -> list[int]:
        return [_number(h, False) for h in self.around] + self.places


def blocks(page: str | None) -> list[Block]:
    """All blocks of the page's body with text, in order."""
    tree = parse(page or "")
    out: list[Block] = []
    current: list[str] = []
    around: list = []
    inside: list[Node] = []  # articles and main elements that are open
    gone = [0]  # elements that go by rule and are open

    def flush() -> None:
        text = " ".join("".join(current).split())
        current.clear()
        if text:
            article = next((n for n in inside if is_article(n)), None)
            out.append(Block(text, tuple(around), 2 if article else 1 if inside else 0, gone[0] > 0, article))
    stack: list = [(tree, None)]
    while stack:
        item, opened = stack.pop()
        if isinstance(item, str):
            text = html.unescape(item)
            current.append(text)
            for h in around:
                h.update(" ".join(text.split()).encode("utf-8", "replace") + b"\x00")
            continue
        article = any(map(is_article, inside))
        if opened is not None:  # its end
            hashed, root, unwanted = opened
            if unwanted or item.name in _BLOCKS:
                flush()
            if hashed:
                around.pop()
            if root:
                inside.pop()
            gone[0] -= unwanted
            continue
        if item.name in _RAW or item.name == "head":
            flush()
            continue
        if item.name == "br":
            current.append("\n")
            continue
        unwanted = item.unwanted(article)
        block = item.name in _BLOCKS
        if unwanted and not block and item.name not in _DROPPED:
            continue  # a few words of a paragraph
        if unwanted or block:
            flush()
        root = is_article(item) or is_main(item)
        hashed = (block or unwanted) and item.name not in _ROOTS and not root and not (article and item.name in _PROSE)
        if hashed:
            around.append(hashlib.blake2b(digest_size=8))
        mark = f"<{item.name} {item.attrs.get('class', '')}>".encode("utf-8", "replace")
        for h in around:
            h.update(mark)
        if root:
            inside.append(item)
        gone[0] += unwanted
        stack.append((item, (hashed, root, unwanted)))
        stack.extend((c, None) for c in reversed(item.children))
    flush()
    by_article: dict[int, list[Block]] = {}
    for b in out:
        if b.article is not None and not b.dropped:
            by_article.setdefault(id(b.article), []).append(b)
    for own in by_article.values():
        for i, b in enumerate(own):
            for place in (f"s{i}", f"e{len(own) - i}"):
                b.places.append(_number(hashlib.blake2b(f"{place} {b.text}".encode("utf-8", "replace"), digest_size=8), True))
    return out


def chosen(found: list[Block]) -> list[Block]:
    """The blocks of the main text by rule: of all articles, else of the main element, else of the body."""
    left = [b for b in found if not b.dropped]
    best = max((b.part for b in left), default=0)
    return [b for b in left if b.part == best]


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.when(host != "", host).alias("host"), F.col("html").cast("string"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks array<struct<text, within>> of the main text of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("within", pa.list_(pa.int64()))]))
        for batch in batches:
            found = [[{"text": b.text, "within": b.within()} for b in chosen(blocks(page.as_py()))]
                     for page in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, kind)],
                                             ["page_id", "url", "host", "blocks"])
    schema = "page_id long, url string, host string, blocks array<struct<text:string,within:array<bigint>>>"
    return _with_host(pages).mapInArrow(run, schema)


def subtrees(pages: DataFrame) -> DataFrame:
    """host, print, hashes: of every page with a host a hash of its main text, and those of all subtrees of its body."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, hashes = [], []
            for page in batch.column(1):
                found = blocks(page.as_py())
                whole = hashlib.blake2b("\n".join(b.text for b in chosen(found)).encode("utf-8", "replace"), digest_size=8)
                prints.append(_number(whole, False))
                hashes.append(list({n for b in found for n in b.within()}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()),
                                              pa.array(hashes, pa.list_(pa.int64()))], ["host", "print", "hashes"])
    return (_with_host(pages).where("host IS NOT NULL").select("host", "html")
            .mapInArrow(run, "host string, print long, hashes array<bigint>"))


def needed(pages: Column, place: Column, min_pages: int = MIN_PAGES) -> Column:
    """On how many of a host's ``pages`` a subtree must recur; a block at its place in an article on more."""
    root = F.sqrt(pages.cast("double"))
    return F.greatest(F.lit(float(min_pages)), F.when(place, F.least(pages / F.lit(2.0), root * 4))
                      .otherwise(F.least(pages / F.lit(5.0), root)))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, template: the hashes that recur on enough different pages of the host."""
    every = F.concat(F.array(F.lit(None).cast("long")), F.col("hashes"))  # null: the page itself
    counts = stored(subtrees(pages).select("host", "print", F.explode(every).alias("hash")).distinct()
                    .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages"))
                    .where(F.col("hash").isNull() | (F.col("pages") >= min_pages)), "html-counts")
    hosts = counts.where("hash IS NULL").select("host", F.col("pages").alias("all_pages"))
    return (counts.where("hash IS NOT NULL").join(hosts, "host")
            .where(F.col("pages") >= needed(F.col("all_pages"), F.col("hash").bitwiseAND(F.lit(1)) == 1, min_pages))
            .groupBy("host").agg(F.collect_list("hash").alias("template")))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text of every page."""
    found = stored(templates(pages, min_pages), "html-templates")
    parsed = page_blocks(pages)
    if found.take(1):
        parsed = (parsed.join(found, "host", "left")
                  .withColumn("blocks", F.when(F.col("template").isNull(), F.col("blocks")).otherwise(F.filter(
                      "blocks", lambda b: ~F.arrays_overlap(b["within"], F.col("template"))))))
    return parsed.select("page_id", "url", F.array_join("blocks.text", "\n\n").alias("text"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
