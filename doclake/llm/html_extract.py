"""Main text of web pages by templates of equivalence classes.

Tokens of a page are its tags by their place in the element tree, and its text blocks, those of the same place and words told apart by
their number. Over the pages of one host, tokens with the same occurrence vector (the same count in every page) form a class; large
classes found in enough pages, whose tokens occur once a page, are the host's template. On a page a class counts where its tokens stand in
the order of the class and nest with the larger classes. What lies between template tokens are slots. The template decides first, inside an
article and outside: its text blocks go. Slots inside menus, headers, footers, notices, adverts, forms and comments go after it, and the
remaining slots are the text. Tags are sure, names in class, id and role are evidence: an element that holds most of what is left of a
page's articles, or of the whole page where no article has text, is kept whatever its name.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import with_fields

#: A template is learnt from tokens that so many pages of a host have, three different ones among them, in classes of so many tokens. A class
#: whose texts stand only inside articles may be an article that the host has several times; it counts where so large a share of its pages has it.
MIN_PAGES, MIN_CLASS, MIN_SHARE = 4, 3, 0.5
#: Hosts with over LARGE pages and over one in LARGE_HOSTS of all pages are dealt to SALTS tasks.
LARGE, LARGE_HOSTS, SALTS = 200, 1000, 64

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
#: Elements that never hold main text.
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "svg", "math", "object", "audio", "video", "canvas",
           "template", "dialog", "menu", "fieldset", "label", *RAW}
#: Elements that start and end a block; all others run on inside it.
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
          "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
          "thead", "tr", "ul"}
#: Names in class, id or role that mark an element as no part of the article, alone or with words of place and form.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie",
         "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "menubar",
         "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "aside", "complementary", "widget", "widgets", "related", "recommended", "share", "sharing",
         "social", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "comment", "comments", "disqus", "replies",
         "respond", "footer", "footnav", "copyright", "header", "masthead", "topbar", "toolbar", "skip", "contentinfo", "toc"}
#: Words that do not change what a marking name says.
PLACES = {"site", "global", "main", "primary", "secondary", "top", "bottom", "left", "right", "upper", "lower", "sticky", "mobile", "desktop", "js",
          "box", "container", "wrap", "wrapper", "inner", "outer", "block", "area", "bar", "list", "item", "items", "links", "link", "buttons", "button",
          "icons", "slot", "unit", "zone", "panel", "posts", "articles", "stories", "thread", "section", "row", "col", "group"}
#: Marks that say nothing inside an article, where notes, headings and tables of contents are text.
ARTICLE_PARTS = {"header", "notice", "notices", "alert", "form", "search", "banner", "aside", "toc", "overlay", "promotion"}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: A start tag of the key closes an open element of the value.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _marks(tag: str, attributes: str) -> str:
    """Name of an element in a token: its tag and the values of class, id and role."""
    found = _ATTRIBUTE.findall(attributes) if attributes else []
    return " ".join([tag, *sorted({v.lower() for _, a, b, c in found for v in (a or b or c).split()})])


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element surely holds no text of the page: by its tag, or as it is hidden."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    return bool(attributes) and tag not in ("html", "body", "article", "main") and bool(_HIDDEN.search(attributes))


def _marked(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether a whole name in class, id or role marks an element."""
    if not attributes or tag in ("html", "body", "article", "main") or (in_article and tag == "header"):
        return False
    marks = MARKS - ARTICLE_PARTS if in_article else MARKS
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        for name in (a or b or c).split():
            words = {w.lower() for w in _WORDS.findall(name)}
            if words & marks and words <= MARKS | PLACES and (not in_article or not words & ARTICLE_PARTS):
                return True
    return False


class Block(NamedTuple):
    """A text block of a page: the place (a digest of the chain of open block elements), the text, whether it is wanted, whether it stands
    inside an article or main element, and the number of the innermost marked element around it (0: none)."""

    place: int
    text: str
    wanted: bool
    inside: bool
    mark: int


class Open(NamedTuple):
    """An open element, with what holds for text inside it."""

    tag: str
    place: int
    wanted: bool
    inside: bool
    mark: int


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """Every text block of a page, in page order, and the next marked element around each marked element (0: none).

    Text inside an unwanted element is marked so, not left out. Unclosed, crossed and cut tags are read as a browser would roughly do:
    an end tag closes what is open inside its element, one without a start is ignored. Time and memory are linear, however deep
    elements nest.
    """
    out: list[Block] = []
    stack = [Open("", 0, True, False, 0)]
    opened: Counter[str] = Counter()
    held: list[str] = []
    around = [0]

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                _, place, wanted, inside, mark = stack[-1]
                out.append(Block(place, text, wanted, inside, mark))
            held.clear()

    def close(depth: int) -> None:
        if any(x.tag in BLOCKS or x.tag in RAW for x in stack[depth:]) or not stack[-1].wanted or stack[-1].mark:
            flush()
        for x in stack[depth:]:
            opened[x.tag] -= 1
        del stack[depth:]

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            held.append(" ")
            continue
        parent = stack[-1]
        wanted, marked = parent.wanted and not _unwanted(tag, attributes, parent.inside), _marked(tag, attributes, parent.inside)
        if tag in BLOCKS or wanted != parent.wanted or marked:
            flush()
        if tag in BLOCKS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p" or stack[depth].tag in _CLOSES.get(tag, ()):
                    close(depth)
                    break
                if stack[depth].tag in BLOCKS:
                    break
            parent = stack[-1]
            wanted, marked = parent.wanted and not _unwanted(tag, attributes, parent.inside), _marked(tag, attributes, parent.inside)
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        place = _digest(f"{parent.place}/{_marks(tag, attributes)}") if tag in BLOCKS else parent.place
        mark = parent.mark
        if marked:
            around.append(mark)
            mark = len(around) - 1
        opened[tag] += 1
        stack.append(Open(tag, place, wanted, parent.inside or (tag in ("article", "main") and wanted), mark))
    flush()
    return out, around


def _digest(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def tokens(found: list[Block]) -> list[tuple[int, bool, bool]]:
    """(token, is a text block, inside an article) in page order: each place when it is entered, and each text block at its place."""
    out, last, met = [], None, Counter()
    for place, text, _, inside, _ in found:
        if place != last:
            out.append((_digest(f"<{place}"), False, inside))
            last = place
        own = f"{place}>{text}"
        met[own] += 1
        out.append((_digest(own if met[own] == 1 else f"{own}\0{met[own]}"), True, inside))
    return out


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def occurrence_classes(pages: DataFrame) -> DataFrame:
    """(host, template): the host's classes, the ones of most pages first; each is the array of its tokens in their order.

    Counts are combined before they are shuffled. A token's occurrence vector is kept as a sum of hashes of (page, count). Two pages and
    their copies make no template: a sum of no more than two different hashes is a mixture of the least and the greatest of them. Classes are
    formed before they are gathered by host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, keys, counts, places, ids, inner = [], [], [], [], [], []
            for host, page_id, page in zip(b.column("host").to_pylist(), b.column("page_key").to_pylist(), b.column("html")):
                own = tokens(blocks(page.as_py() or "")[0])
                first = {t: (i, inside or not is_text) for i, (t, is_text, inside) in reversed(list(enumerate(own)))}
                for t, n in Counter(t for t, _, _ in own).items():
                    hosts.append(host), keys.append(t), counts.append(n), places.append(first[t][0] / len(own)), ids.append(page_id)
                    inner.append(first[t][1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(places, pa.float64()),
                 pa.array(ids, pa.int64()), pa.array(inner, pa.bool_())],
                names=["host", "token", "n", "place", "page_key", "inner"])

    seen = pages.mapInArrow(run, "host string, token bigint, n bigint, place double, page_key bigint, inner boolean")
    hashed = F.xxhash64("page_key", "n").cast("decimal(19,0)")
    vectors = seen.groupBy("host", "token").agg(
        F.count("*").alias("support"), F.max("n").alias("most"), F.avg("place").alias("place"), F.bool_and("inner").alias("inner"),
        F.sum(hashed.cast("decimal(38,0)")).alias("vector"), F.min(hashed).alias("lo"), F.max(hashed).alias("hi"))
    least = (F.col("support").cast("decimal(19,0)") * F.col("lo")).cast("decimal(38,0)")
    several = F.when(F.col("lo") != F.col("hi"), (F.col("vector") - least) % (F.col("hi") - F.col("lo")) != 0).otherwise(False)
    frequent = vectors.filter((F.col("support") >= MIN_PAGES) & (F.col("most") == 1) & several)
    classes = frequent.groupBy("host", "vector", "support").agg(
        F.array_sort(F.collect_list(F.struct("place", "token"))).alias("all"), F.bool_and("inner").alias("inner")).filter(F.size("all") >= MIN_CLASS)
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    valid = classes.join(sizes, "host").filter(~F.col("inner") | (F.col("support") >= F.col("pages") * MIN_SHARE))
    return valid.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(
        "support", F.size("all").alias("n"), F.transform("all", lambda x: x["token"]).alias("tokens"))), asc=False).alias("c")).select(
            "host", F.transform("c", lambda x: x["tokens"]).alias("template"))


def _nested(inner: list[int], outer: list[int]) -> bool:
    """Whether all places of one class lie in one slot of the other."""
    return bisect(outer, inner[0]) == bisect(outer, inner[-1])


def template_tokens(found: list[int], template: list[list[int]]) -> set[int]:
    """Those tokens of a page that belong to a class of the template that is valid in the page: its tokens are all there, in the order of
    the class, and it nests with every class that was valid before it."""
    at = {t: i for i, t in enumerate(found)}
    valid: list[list[int]] = []
    for own in template:
        if own[0] not in at:
            continue
        places = [at.get(t, -1) for t in own]
        if places[0] >= 0 and all(x < y for x, y in zip(places, places[1:])) and all(_nested(places, v) or _nested(v, places) for v in valid):
            valid.append(places)
    return {found[i] for places in valid for i in places}


def _text(page: str, template: list[list[int]] | None) -> str:
    """Text of the slots of one page."""
    found, outer = blocks(page)
    own = tokens(found)
    fixed = template_tokens([t for t, _, _ in own], template or [])
    texts = [t for t, is_text, _ in own if is_text]
    slots = [x for x, t in zip(found, texts) if x.wanted and t not in fixed]
    judged = [x for x in slots if x.inside] or slots
    sizes = [0] * len(outer)
    for x in judged:
        sizes[x.mark] += len(x.text)
    for k in range(len(outer) - 1, 0, -1):  # an element's number is above that of the one around it
        sizes[outer[k]] += sizes[k]
    most = sum(len(x.text) for x in judged) / 2
    kept = [True] * len(outer)
    for k in range(1, len(outer)):
        kept[k] = kept[outer[k]] and sizes[k] > most
    return "\n\n".join(x.text for x in slots if kept[x.mark])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, …) with ``text`` and ``n_chars``; own columns of these names are replaced, ``html`` is left out.

    A null or empty page has an empty text. Pages without a readable host share one template. Copies of one page, whatever their
    ids, make no template by themselves.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars", "html")]
    keyed = pages.withColumn("__host", _host(F.col("url")))
    own = keyed.select(F.col("__host").alias("host"), F.xxhash64("html").alias("page_key"), "html")
    templates = occurrence_classes(own).withColumnRenamed("host", "__host").withColumnRenamed("template", "__template")
    # pages of a host with very many are dealt to SALTS tasks, each of which gets the host's template
    total = own.count()
    counts = own.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > max(LARGE, total // LARGE_HOSTS))
    large = [r["host"] for r in counts.select("host").collect()]  # at most LARGE_HOSTS
    salt = lambda value: F.when(F.col("__host").isin(large), value).otherwise(0) if large else F.lit(0)
    keyed = keyed.withColumn("__salt", salt(F.pmod(F.xxhash64("html", "page_id"), F.lit(SALTS)).cast("int")))
    every = F.sequence(F.lit(0), salt(F.lit(SALTS - 1)))
    templates = templates.withColumn("__salt", F.explode(every))
    joined = keyed.join(templates.hint("merge"), ["__host", "__salt"], "left").select(*kept, "html", "__template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_text(p.as_py() or "", t) for p, t in zip(b.column("html"), b.column("__template").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return joined.mapInArrow(run, with_fields(pages.select(*kept), "text string, n_chars bigint"))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
