"""Main text of web pages by site template removal.

Every page is parsed into its element tree once, and every element subtree of it is hashed before anything
is left out. Spark counts on how many different pages of a host each subtree occurs; blocks inside a subtree
that recurs across the host go. What markup itself names (scripts, navigation, forms, adverts, comments,
...) goes too, as sites of few pages, or whose menus differ from page to page, show no recurrence.

A name counts if a whole token of class, id or role is made of listed words; inside `article` and `main`
only adverts and comments named by their class count. Text outside an article stays unless one of the two
says otherwise. Running text inside an article, its paragraphs, headings and list items, is never taken for
template by itself, only with a container around it: passages that many articles quote stay. Pages of equal
article (or text, without one) count once, so copies of a page do not make its text a template.

Cases: null or empty html gives an empty text; a null url, or one without a host, has no site, so
nothing recurs; pages of any length or depth are read whole in linear time; repeated rows give repeated
results; unclosed and stray tags are closed as browsers do; empty tables give empty results; other columns
are kept, whatever their names, but for `main_text` and the html.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

#: A subtree is template if it is on so many different pages of the host and on so large a share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.2

# Element names and attribute words.
_SILENT = "script style noscript template iframe svg math textarea select object canvas audio video title"
SILENT = frozenset(_SILENT.split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form button dialog menu".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption address summary".split())
CONTAINERS = frozenset("div section ul ol dl table thead tbody tfoot tr figure fieldset details header hgroup center main article body html".split())
BLOCKS = TEXTUAL | CONTAINERS | DROPPED | {"hr"}
BARRIERS = CONTAINERS - {"thead", "tbody", "tfoot"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROOTS = frozenset(("article", "main"))
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal newsletter "
    "subscribe signup share sharing social related recommended comment comments respond disqus replies widget "
    "pagination pager toolbar login search".split()
)
#: Words that may stand beside a listed word in a name made of several, as in `left-sidebar-2`.
BESIDE = frozenset(
    "site main page top bottom left right inner outer primary secondary global bar box block list area wrap wrapper "
    "container section slot unit post posts links form buttons".split()
)
#: What a class may remove inside an article.
WITHIN = frozenset("ad ads advert adverts advertisement advertising comment comments disqus replies respond sponsored".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_SILENT.replace(' ', '|')})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^<>]*+)>|<[!?][^<>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z]+")


def listed(token: str, words: frozenset[str]) -> bool:
    """Is the token a listed word, or several words of which one is listed and the rest say only where it stands?"""
    parts = PARTS.findall(token)
    return any(w in words for w in parts) and all(w in words or w in BESIDE for w in parts)


def named_out(tag: str, attributes: str, inside: bool) -> bool:
    """Do the element's name, class, id or role say that it is no main text?"""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("main", "body", "html"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        tokens = "".join(values).lower().split()
        name = name.lower()
        if name == "role":
            if not inside and not ROLES.isdisjoint(tokens):
                return True
        elif not (inside or tag == "article"):
            if any(listed(t, NAMED) for t in tokens):
                return True
        elif name == "class" and any(listed(t, WITHIN) for t in tokens):
            return True
    return False


class Frame:
    """An open element: the block element it belongs to holds the parts of the hash."""

    __slots__ = ("first", "holder", "inside", "out", "parts", "removable", "tag")

    def __init__(self, tag: str, out: bool, inside: bool, removable: bool, first: int):
        self.tag, self.out, self.inside, self.removable, self.first = tag, out, inside, removable, first
        self.parts: list[str] = []
        self.holder: Frame = self


class Page:
    """Blocks of one page as (text, named out), and its subtrees as (hash, first block, end): each
    covers a run of blocks, so nothing grows with the depth of the tree."""

    __slots__ = ("article", "blocks", "buffer", "containers", "open", "stack", "subtrees")

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool]] = []
        self.subtrees: list[tuple[int, int, int]] = []
        self.article: list[str] = []
        self.buffer: list[str] = []
        self.stack = [Frame("", False, False, False, 0)]
        self.open: dict[str, list[int]] = {}  # places of the open elements of each name
        self.containers: list[int] = []
        at = 0
        for match in TOKEN.finditer(source):
            if match.start() > at:
                self.text(source[at : match.start()])
            at = match.end()
            tag = match[3]
            if not tag:
                continue
            tag = tag.lower()
            if match[2]:
                self.end(tag)
            else:
                self.start(tag, match[4])
        self.text(source[at:])
        self.close_down(1)
        self.flush()

    def text(self, text: str) -> None:
        frame = self.stack[-1]
        if frame.out == frame.holder.out:  # else an inline element is named out: its text is of no block
            self.buffer.append(text)

    def flush(self) -> None:
        if not self.buffer:
            return
        text = " ".join(entities.unescape("".join(self.buffer)).split())
        self.buffer.clear()
        if text:
            holder = self.stack[-1].holder
            holder.parts.append(text)
            self.blocks.append((text, holder.out))
            if holder.inside and not holder.out:
                self.article.append(text)

    def close_down(self, depth: int) -> None:
        """Close elements until `depth` frames are left."""
        while len(self.stack) > depth:
            frame = self.stack[-1]
            if frame.tag in BLOCKS:
                self.flush()
            self.stack.pop()
            self.open[frame.tag].pop()
            if frame.tag in BARRIERS:
                self.containers.pop()
            if frame.tag in BLOCKS:
                content = "\x1f".join([frame.tag, *frame.parts])
                code = xxhash.xxh3_64_intdigest(content.encode("utf-8", "surrogatepass"))
                self.stack[-1].holder.parts.append(f"\x1e{code:x}")
                if frame.removable and frame.first < len(self.blocks):
                    self.subtrees.append((code - 2**63, frame.first, len(self.blocks)))

    def unwind(self, tags: set[str] | frozenset[str]) -> None:
        """Close the innermost of these elements, unless a container lies between."""
        at = max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)
        if at and at >= (self.containers[-1] if self.containers else 0):
            self.close_down(at)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        if tag in BLOCKS:
            self.unwind({"p"})
            if tag == "body":
                self.unwind({"head"})
            if tag in CLOSED_BY:
                self.unwind(CLOSED_BY[tag])
            self.flush()
        if tag in VOID:
            return
        above = self.stack[-1]
        out = above.out or named_out(tag, attributes, above.inside)
        inside = above.inside or (tag in ROOTS and not out)
        removable = tag in BLOCKS and tag not in ROOTS and tag not in ("body", "html") and not (inside and tag in TEXTUAL)
        frame = Frame(tag, out, inside, removable, len(self.blocks))
        if tag not in BLOCKS:
            frame.holder = above.holder
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BARRIERS:
            self.containers.append(len(self.stack))
        self.stack.append(frame)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text(" ")
        if tag not in VOID and self.open.get(tag):
            self.close_down(self.open[tag][-1])

    def result(self) -> tuple[list[tuple[str, bool]], list[tuple[int, int, int]], int]:
        own = "\n".join(self.article or (text for text, out in self.blocks if not out))
        return self.blocks, self.subtrees, xxhash.xxh3_64_intdigest(own.encode("utf-8", "surrogatepass")) - 2**63


def kept(blocks: list, subtrees: list, templates: set[int]) -> list[str]:
    """Texts of the blocks that neither a name nor a template covers."""
    change = [0] * (len(blocks) + 1)
    for code, first, end in subtrees:
        if code in templates:
            change[first] += 1
            change[end] -= 1
    return [text for (text, out), covered in zip(blocks, accumulate(change)) if not out and not covered]


_BLOCK = pa.struct([("text", pa.string()), ("out", pa.bool_())])
_SUBTREE = pa.struct([("code", pa.int64()), ("first", pa.int32()), ("until", pa.int32())])
_PAGE = pa.struct([("blocks", pa.list_(_BLOCK)), ("subtrees", pa.list_(_SUBTREE)), ("digest", pa.int64())])
KIND = from_arrow_type(_PAGE)


@F.arrow_udf(KIND)
def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        out = []
        for source in pages:
            blocks, subtrees, digest = Page(source.as_py() or "").result()
            row = {
                "blocks": [{"text": text, "out": named} for text, named in blocks],
                "subtrees": [{"code": code, "first": first, "until": until} for code, first, until in subtrees],
                "digest": digest,
            }
            out.append(pa.scalar(row, type=_PAGE))
        yield pa.array(out, type=_PAGE)


@F.arrow_udf(T.StringType())
def joined(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        out = []
        for blocks, subtrees, templates in zip(*columns):
            blocks = [(b["text"], b["out"]) for b in blocks.as_py()]
            subtrees = [(s["code"], s["first"], s["until"]) for s in subtrees.as_py()]
            out.append("\n".join(kept(blocks, subtrees, set(templates.as_py() or ()))))
        yield pa.array(out, type=pa.string())


def host_of(url: str):
    host = F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(host) > 0, host)


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, digest, codes) of pages -> (host, templates): recurring subtree hashes of each host that has any.

    Each takes up at least `least_share` of the host's pages, so a host has at most 1 / least_share
    times the subtrees of an average page.
    """
    sites = pages.filter("host is not null")
    different = sites.select("host", "digest").distinct()
    sizes = different.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    met = sites.select("host", "digest", F.explode(F.array_distinct("codes")).alias("subtree")).distinct()
    counts = met.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("on")).filter(F.col("on") >= least_pages)
    recurring = counts.join(sizes, "host").filter(F.col("on") >= least_share * F.col("pages"))
    return recurring.groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html", scratch=None) -> DataFrame:
    """Replaces the html by `main_text`: kept blocks in page order, joined by line feeds."""
    named = [c for c in pages.columns if c not in (html, "main_text")]
    row = F.struct(*[F.col(f"`{c}`") for c in named]) if named else F.struct()
    read = pages.select(row.alias("given"), host_of(url).alias("host"), parsed(F.col(f"`{html}`")).alias("page"))
    read = scratch(read) if scratch else read
    templates = site_templates(read.select("host", F.col("page.digest").alias("digest"), F.col("page.subtrees.code").alias("codes")))
    templates = scratch(templates) if scratch else templates  # its size is known then: pages are only shuffled if it is large
    text = joined("page.blocks", "page.subtrees", "templates")
    both = read.join(templates, "host", "left").select("given", text.alias("text"))
    return both.select(*[F.col(f"given.`{c}`").alias(c) for c in named], F.col("text").alias("main_text"))
