"""Main text of web pages by template deduction over equivalence classes.

Pages of a host come from a template. The tokens of a page are its elements, each by its
path from the root (names with class and id), and the text blocks under a path. Tokens that
occur equally often in every page of a host share an *occurrence vector* and form an
equivalence class; the vector is summed as a digest, so Spark groups the tokens of a host
without gathering them. A class is *valid* if it is found in at least ``SUPPORT`` of the host's
pages, has ``CLASS_TOKENS`` tokens (an article is one by itself), and its elements stand in the same order in
all of these pages. Valid classes are nested into the template: an element belongs to it
if the element around it does, too. A block of text that ``TEXT_PAGES`` pages repeat in a class with
elements is text of the template.

What is left are the slots. If the template has articles (``article``, ``main``), the slots are the articles
of a page, all of them. Else the slot is the lowest common ancestor of all blocks of the host
that are not the template's and of all its articles, and what it holds of the template's
texts is left out. A page without the slot of its host is read whole, by the same rules.

Parts that are no article go: elements such as menus, headers, footers, sidebars, forms,
scripts and styles; elements whose class, id or role says so in all its words (``site-footer``, ``ad``,
``comment-list``); and, outside of articles, elements of which a single word says so (``menu-item-review``) if
they are part of the template. A word in a class name alone never removes text.

A block is the text between two block-level tags; character references are decoded and
white space is one space. Blocks are joined by a line feed. Nothing is cut or capped.

Null html is empty and has the text ''. A null or odd url makes the host ''. Markup that
never closes is read as far as it goes. Rows that repeat stay rows. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import cut_lineage
from .texts import portions

SUPPORT = 0.5
CLASS_TOKENS = 2
#: templates up to this size are broadcast to the pages; larger ones are joined by host
BROADCAST_BYTES = 32 << 20
#: pages of a host that must repeat a text block before it counts as part of the template
TEXT_PAGES = 3

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: an element that a start tag of the same kind ends
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div article main section body html aside nav footer header form td".split())
ARTICLES = frozenset("article main".split())
APART = frozenset(
    "head script style title textarea noscript iframe template svg canvas object nav footer aside form button select "
    "option input menu dialog audio video map".split()
)
#: words of a class, id or role that name what is no article
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert newsletter subscribe subscription popup modal overlay sidebar sidenav side menu "
    "navbar nav navigation breadcrumb breadcrumbs footer masthead comment comments commentlist respond reply replies "
    "discussion disqus related recommended share sharing social login signup search pagination pager toolbar widget skip "
    "complementary contentinfo dialog".split()
)
#: words that may stand beside them in a name
NEUTRAL_WORDS = frozenset(
    "site page main global top bottom left right box block wrapper wrap container section area list item items links link bar "
    "inner outer primary secondary slot unit buttons button form post posts thread text content panel column col row group".split()
)
HEADERS = frozenset({"header", "topbar"})


@lru_cache(maxsize=20000)
def label(name: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """How an element is named in a path; is it no article; may it be none; is it a header; is it an article."""
    found = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    classes, ident, role = found.get("class", ""), found.get("id", ""), found.get("role", "").lower()
    names = [set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", n).lower())) - {""} for n in f"{classes} {ident} {role}".split()]
    style = re.sub(r"\s", "", found.get("style", "").lower())
    hidden = "display:none" in style or found.get("aria-hidden", "").lower() == "true"
    article = name in ARTICLES or role in ("main", "article")
    by_name = name not in ("html", "body") and not article
    apart = name in APART or hidden or role == "navigation" or (by_name and any(n & APART_WORDS and n <= APART_WORDS | NEUTRAL_WORDS for n in names))
    doubtful = by_name and not apart and any(n & APART_WORDS for n in names)
    header = name == "header" or (by_name and any(n & HEADERS and n <= HEADERS | NEUTRAL_WORDS for n in names)) or role == "banner"
    own = re.sub(r"\d+", "", name + "".join(f".{c}" for c in sorted(classes.split())) + (f"#{ident}" if ident else ""))
    return own.replace("/", "|"), apart, doubtful, header, article


class Page:
    """The elements and text blocks of a page, in page order."""

    def __init__(self, html: str):
        #: path, parent, is it an article, may it be no article (and stands outside of articles)
        self.paths: list[str] = []
        self.parents: list[int] = []
        self.articles: list[bool] = []
        self.doubtful: list[bool] = []
        #: text, element that holds it
        self.blocks: list[tuple[str, int]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        paths, parents, articles = self.paths, self.parents, self.articles
        stack: list[tuple[str, int, bool, bool]] = [("", -1, False, False)]  # name, element, apart, in an article
        parts: list[str] = []
        place, at, end = -1, 0, len(html)

        def close_block():
            nonlocal parts
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((text, place))
                parts = []

        def pop_to(depth: int):
            del stack[depth:]

        while at < end:
            m = TAG.search(html, at)
            stop = m.start() if m else end
            if stop > at and not stack[-1][2]:
                if not parts:
                    place = stack[-1][1]
                parts.append(unescape(html[at:stop]))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:  # an end tag
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if name not in INLINE:
                    close_block()
                if depth:
                    pop_to(depth)
                continue
            attributes = m[3] if m[2] else m[6]
            if name == "br":
                if not stack[-1][2]:
                    parts.append(" ")
                continue
            if name not in INLINE:
                close_block()
                ends = SIBLINGS.get(name)
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p" or (ends and stack[i][0] in ends):
                        pop_to(i)
                        if not ends or stack[-1][0] not in ends:
                            break
                    elif stack[i][0] in SCOPES and not (ends and stack[i][0] in ends):
                        break
            own, apart, doubtful, header, article = label(name, attributes)
            _, parent, outer_apart, inside = stack[-1]
            apart = apart or outer_apart or (header and not inside)
            if name in VOID or attributes.endswith("/") and name not in SCOPES:
                continue
            element = parent
            if name not in INLINE or apart:
                element = len(paths)
                paths.append(f"{paths[parent]}/{own}" if parent >= 0 else own)
                parents.append(parent)
                articles.append(article and not apart)
                self.doubtful.append(doubtful and not apart and not inside)
            if name in RAW:
                raw_end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                at = raw_end.end() if raw_end else end
                continue
            if name in INLINE and not apart:
                stack.append((name, element, outer_apart, inside))
            else:
                stack.append((name, element, apart, inside or (article and not apart)))
        close_block()

    def under(self, chosen: list[bool]) -> list[bool]:
        """Which elements are one of the chosen or inside one."""
        out = list(chosen)
        for i, parent in enumerate(self.parents):
            out[i] = out[i] or (parent >= 0 and out[parent])
        return out


def number(text: str) -> int:
    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass(frozen=True)
class Template:
    """What is known of a host: are its slots articles, the path of the slot, texts and doubtful elements of the template."""

    articles: bool = True
    slot: str | None = None
    texts: frozenset[int] = frozenset()
    doubtful: frozenset[str] = frozenset()


def main_text(html: str, template: Template = Template()) -> str:
    """The text of a page of a host with this template."""
    page = Page(html)
    gone = page.under([d and p in template.doubtful for d, p in zip(page.doubtful, page.paths)])
    article = page.under(page.articles)
    blocks = [b for b in page.blocks if b[1] < 0 or not gone[b[1]]]
    if template.articles and any(page.articles):
        return "\n".join(text for text, at in blocks if at >= 0 and article[at])
    slot = page.under([path == template.slot for path in page.paths])
    if any(slot):
        blocks = [b for b in blocks if b[1] >= 0 and slot[b[1]]]
    return "\n".join(text for text, at in blocks if (at >= 0 and article[at]) or number(text) not in template.texts)


TOKENS = "page long, path string, text long, times long, article boolean, doubtful boolean, place long"


def tokens(pages: DataFrame) -> DataFrame:
    """(host, page, path, text, times, article, doubtful, place): the different tokens of each page.

    ``text`` is null for elements; blocks of text inside articles are none. ``page`` is a digest of the
    page's address and content, ``place`` the first element of the page that is or holds the token.
    """

    def run(batches):
        for batch in portions(batches, 2):
            out = []
            for host, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                page = Page(html)
                key = number(f"{url}\n{html}")
                seen: dict[tuple[str, int | None], list] = {}
                for i, path in enumerate(page.paths):
                    seen.setdefault((path, None), [0, page.articles[i], page.doubtful[i], i])[0] += 1
                article = page.under(page.articles)
                for text, place in page.blocks:
                    if place >= 0 and not article[place]:
                        seen.setdefault((page.paths[place], number(text)), [0, False, False, place])[0] += 1
                out += [(host, key, path, text, *row) for (path, text), row in seen.items()]
            if out:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())
                names = ["host", "page", "path", "text", "times", "article", "doubtful", "place"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return pages.select("host", "url", "html").mapInArrow(run, f"host string, {TOKENS}")


def equivalence_classes(found: DataFrame) -> DataFrame:
    """The tokens of each host's valid classes: (host, path, text, vector, pages, article, doubtful).

    Elements inside one that is not there are left out.
    """
    rows = found.groupBy("host", "path", "text").agg(
        # equal sums of page digests times counts: the same count in the same pages
        F.sum(F.xxhash64("page", "times").cast("decimal(38,0)")).alias("vector"),
        F.count("*").alias("pages"),
        F.max("article").alias("article"),
        F.max("doubtful").alias("doubtful"),
    )
    # the root of every page is an element; the host has as many pages as roots
    roots = rows.where("text is null and path not like '%/%'").groupBy("host").agg(F.sum("pages").alias("host_pages"))
    rows = rows.join(roots, "host").where(F.col("pages") >= F.greatest(F.lit(1), F.ceil(SUPPORT * F.col("host_pages"))))
    # the elements of a class in the order of each page: one digest over all pages (a set, as equal pages are one)
    elements = rows.where("text is null").select("host", "path", "vector")
    lined = found.where("text is null").join(elements, ["host", "path"]).groupBy("host", "vector", "page").agg(
        F.xxhash64(F.concat_ws("\n", F.transform(F.array_sort(F.collect_set(F.struct("place", "path"))), lambda e: e["path"]))).alias("line")
    )
    ordered = lined.groupBy("host", "vector").agg((F.min("line") == F.max("line")).alias("ordered"))
    # one token says nothing of a template, unless it is an article
    classes = rows.groupBy("host", "vector").agg(F.count("*").alias("tokens"), F.max("article").alias("any_article"))
    classes = classes.join(ordered, ["host", "vector"], "left").where(
        ((F.col("tokens") >= CLASS_TOKENS) | F.col("any_article")) & F.coalesce("ordered", F.lit(True))
    )
    valid = rows.join(classes.select("host", "vector"), ["host", "vector"], "left_semi")
    around = F.when(F.col("text").isNotNull(), F.col("path")).otherwise(F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    outer = valid.where("text is null").select("host", F.col("path").alias("_around"))
    nested = valid.withColumn("_around", around).join(outer, ["host", "_around"], "left_semi")
    return nested.unionByName(valid.where("text is null and path not like '%/%'").withColumn("_around", F.lit(""))).drop("_around")


def templates(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, articles, slot, texts, doubtful): one row per host.

    A row holds the texts and doubtful elements of a template, which are no more than those of a few pages.
    """
    text = F.col("text")
    with_elements = classes.where("text is null").select("host", "vector").distinct()
    boiler = classes.where(text.isNotNull() & (F.col("pages") >= TEXT_PAGES)).join(with_elements, ["host", "vector"], "left_semi")
    known = classes.groupBy("host").agg(
        F.max("article").alias("articles"), F.collect_set(F.when(F.col("doubtful"), F.col("path"))).alias("doubtful")
    )
    texts = boiler.groupBy("host").agg(F.collect_set("text").alias("texts"))
    # the common beginning of many paths is that of the first and the last in order
    own = found.where(text.isNotNull()).join(boiler.select("host", "path", "text"), ["host", "path", "text"], "left_anti")
    held = own.unionByName(found.where("article")).groupBy("host").agg(
        F.min(F.split("path", "/")).alias("first"), F.max(F.split("path", "/")).alias("last")
    )
    same = F.filter(
        F.sequence(F.lit(1), F.least(F.size("first"), F.size("last"))),
        lambda n: F.slice("first", F.lit(1), n) == F.slice("last", F.lit(1), n),
    )
    slot = F.array_join(F.slice("first", F.lit(1), F.size(same)), "/")
    slots = held.select("host", F.when(slot != "", slot).alias("slot"))
    none = F.array().cast("array<bigint>")
    return (
        known.join(texts, "host", "left")
        .join(slots, "host", "left")
        .select("host", "articles", "slot", F.coalesce("texts", none).alias("texts"), "doubtful")
    )


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, slot): the main text of each page and the template slot of its host."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        host.alias("host"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    )
    found = cut_lineage(tokens(rows))
    known = cut_lineage(templates(found, cut_lineage(equivalence_classes(found))))
    size = F.octet_length("host") + F.coalesce(F.octet_length("slot"), F.lit(0)) + 8 * F.size("texts") + F.octet_length(F.array_join("doubtful", " ")) + 100
    # beyond the bound the pages meet their template by host
    if (known.agg(F.sum(size.cast("bigint"))).head()[0] or 0) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "articles", "slot", "texts", "doubtful")

    def run(batches):
        for batch in portions(batches, 2):
            texts = []
            for html, articles, slot, boiler, doubtful in zip(*(c.to_pylist() for c in batch.columns[2:])):
                known = Template(bool(articles), slot, frozenset(boiler or ()), frozenset(doubtful or ()))
                texts.append(main_text(html, known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(4)], names=["page_id", "url", "text", "slot"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, slot string")
