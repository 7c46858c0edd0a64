"""Main text of web pages by removing what a site repeats.

Each page is parsed to a tree of its block elements and every container's subtree is hashed. Spark counts, for each host,
in how many different pages a subtree occurs; subtrees in MIN_PAGES or more, however many pages the host has, are the
site's template, and are deleted along with elements that are no article text by their tag, class or role. Of what is
left, the article (or main) elements are the text, or the body where a page has neither. Pages with the same content count
once, so that copies of an article are no template; neither is a paragraph, heading, table or quotation inside an article,
nor an element that holds an article.

A class, id or role never deletes an element that holds an article, nor one that holds over MOST of the text that tags
leave on a page (readers' comments: over MOST_COMMENTS), and a paragraph, heading, list, table or quotation inside an
article only if it is marked as an advert. A form that holds over MOST of it is the page itself.

Blocks are joined by a line feed in page order; inside a block white space is one space, and character references are
decoded.

Defined results: null or empty html gives the empty string; a null or odd url has the empty host; repeated rows count as
one page and each get their text; unclosed or broken markup is read as far as it goes; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recospark.llm.common import checkpoint, chunks, tidy

#: A template occurs in so many different pages of its host.
MIN_PAGES = 5
#: Templates are broadcast up to this many; beyond, each page is joined to those of its own subtrees that are templates,
#: and copies of a page are dealt over SALTS parts.
BROADCAST_ROWS, SALTS = 20_000, 4
#: Shares of a page's text from which on an element is no more taken for what its class says.
MOST, MOST_COMMENTS = 0.5, 0.9

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*"|'[^']*'|[^"'<>])*+)>|<[!?/][^>]*>?|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")

# Fixed sets of HTML element names.
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote table thead tbody tfoot tr td th caption li dt dd figcaption ul ol dl".split())
_CONTAINERS = frozenset("html head body div section article main nav header footer aside form fieldset figure address details summary dialog center hgroup menu search".split())
_DROPPED = frozenset("head nav aside form footer fieldset dialog menu search button select option canvas object audio video".split())
_WRAPPERS = frozenset("form fieldset".split())
_BLOCKS = _TEXT_BLOCKS | _CONTAINERS | _DROPPED
_ENDS_P = _BLOCKS - {"button", "select", "option", "canvas", "object", "audio", "video", "p"}
#: Elements whose end tag may be left out: what opens, and which open element of the same parent that ends.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words in a class, id or role that mark an element as no part of an article.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sidebar cookie cookies notice consent gdpr popup modal overlay comment comments disqus "
    "reply replies respond nav navbar navigation menu breadcrumb breadcrumbs footer share sharing social newsletter subscribe related recommended "
    "promo promotion sponsor sponsored widget toolbar pagination pager login signup masthead complementary contentinfo alert skip".split()
)
#: Those of them that mark readers' comments, and adverts.
_COMMENTS = frozenset("comment comments disqus reply replies respond".split())
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising promo promotion sponsor sponsored".split())


@dataclass
class Page:
    """A parsed page: for each element its tag, parent, marks and subtree hash; the text blocks as (element, text)."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    marks: list[frozenset] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str | None) -> Page:
    """The block elements and text blocks of a page."""
    page, opened, stack, hashers, text = Page(), Counter(), [-1], [xxhash.xxh64()], []

    def flush() -> None:
        if text:
            if said := " ".join(unescape("".join(text)).split()):
                page.blocks.append((stack[-1], said))
                hashers[-1].update(b"\0" + said.encode("utf-8", "surrogatepass"))
            text.clear()

    def close() -> None:
        flush()
        node, h = stack.pop(), hashers.pop()
        opened[page.tags[node]] -= 1
        page.hashes[node] = h.intdigest() - (1 << 63)
        hashers[-1].update(h.digest())

    def near(tags: tuple[str, ...]) -> bool:
        return len(stack) > 1 and page.tags[stack[-1]] in tags

    html, at = html or "", 0
    while m := _TOKEN.match(html, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                text.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag] > 0:
                while page.tags[stack[-1]] != tag:
                    close()
                close()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(html, at)
            close_at = html.find(">", end.end() - 1) if end else -1
            at = close_at + 1 if close_at >= 0 else len(html)
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
        if tag not in _BLOCKS or tag in _VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        if tag in _ENDS_P and opened["p"] > 0 and not near(("button", "object")):
            while near(("p",)):
                close()
        if tag == "p":
            while near(("p",)):
                close()
        while near(_SIBLINGS.get(tag, ())):
            close()
        if tag == "body" and near(("head",)):
            close()
        if m[3].rstrip().endswith("/") and tag in ("canvas", "object"):
            continue
        found = dict(_ATTRIBUTE.findall(m[3]))
        marks = frozenset(w for v in found.values() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()))
        page.tags.append(tag)
        page.parents.append(stack[-1])
        page.marks.append(marks)
        page.hashes.append(0)
        stack.append(len(page.tags) - 1)
        hashers.append(xxhash.xxh64(" ".join([tag, *sorted(marks)]).encode("utf-8", "surrogatepass")))
        opened[tag] += 1
    while len(stack) > 1:
        close()
    flush()
    return page


def _articles(page: Page) -> tuple[list[bool], list[bool]]:
    """For each element: is it an article or main, and does it hold one; comments are none."""
    own = [(t in ("article", "main") or "main" in m and t == "div" and len(m) == 1) and not (m & _MARKS) for t, m in zip(page.tags, page.marks, strict=True)]
    holds = [False] * len(own)
    for i in range(len(own) - 1, -1, -1):
        if (own[i] or holds[i]) and page.parents[i] >= 0:
            holds[page.parents[i]] = True
    return own, holds


def subtrees(page: Page) -> set[int]:
    """Hashes of the subtrees that may be a template."""
    own, holds = _articles(page)
    inside = [False] * len(own)
    out = set()
    for i, tag in enumerate(page.tags):
        p = page.parents[i]
        inside[i] = own[i] or (p >= 0 and inside[p])
        if not (own[i] or holds[i]) and tag not in ("html", "body", "head") and not (inside[i] and tag in _TEXT_BLOCKS):
            out.add(page.hashes[i])
    return out


def _shares(page: Page) -> list[float]:
    """For each element, how much of the text that tags leave on the page it holds."""
    sizes, out = [0] * len(page.tags), [False] * len(page.tags)
    for i, (tag, p) in enumerate(zip(page.tags, page.parents, strict=True)):
        out[i] = p >= 0 and out[p] or tag in _DROPPED and tag not in _WRAPPERS
    total = 0
    for i, said in page.blocks:
        if i < 0 or not out[i]:
            total += len(said)
            if i >= 0:
                sizes[i] += len(said)
    for i in range(len(sizes) - 1, -1, -1):
        if page.parents[i] >= 0:
            sizes[page.parents[i]] += sizes[i]
    return [n / max(1, total) for n in sizes]


def _marked(page: Page, template: set[int]) -> tuple[list[bool], list[bool], bool]:
    """For each element: is it deleted, and may its own text be main text; and does an article live."""
    own, holds = _articles(page)
    shares = _shares(page)
    allowed = subtrees(page) & template if template else template
    dead, inside = [False] * len(own), [False] * len(own)
    for i, (tag, p, marks) in enumerate(zip(page.tags, page.parents, page.marks, strict=True)):
        within = p >= 0 and inside[p]
        inside[i] = own[i] or within
        kept = own[i] or holds[i] or tag in ("html", "body")
        said = marks & (_ADVERTS if within and tag in _TEXT_BLOCKS else _MARKS)
        dropped = (
            tag in _DROPPED and not (tag in _WRAPPERS and shares[i] > MOST)
            or (tag == "header" or "header" in marks and tag in _CONTAINERS and shares[i] <= MOST) and not within
            or bool(said) and shares[i] <= (MOST_COMMENTS if said & _COMMENTS else MOST)
        )
        dead[i] = p >= 0 and dead[p] or not kept and (dropped or page.hashes[i] in allowed)
    living = any(o and not d for o, d in zip(own, dead, strict=True))
    return dead, [x or not living for x in inside], living


def effective(page: Page) -> set[int]:
    """Hashes of the elements that their tag, class or role leaves in the main text."""
    dead, main, _ = _marked(page, set())
    return {h for h, d, m in zip(page.hashes, dead, main, strict=True) if m and not d}


def main_text(page: Page, template: set[int]) -> str:
    """The page's main text without the template's subtrees."""
    dead, main, living = _marked(page, template)
    return "\n".join(said for i, said in page.blocks if (i < 0 and not living) or (i >= 0 and not dead[i] and main[i]))


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _seen(pages: DataFrame, html: str, url: str) -> DataFrame:
    """host, source (a hash of the html), page (a hash of its content) and hash of each subtree that may be a template;
    alive: its deletion may change the page's main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                hosts, sources, digests, hashes, alive = [], [], [], [], []
                for text, host, source in zip(*(part.column(c).to_pylist() for c in ("html", "host", "source")), strict=True):
                    if not text:
                        continue
                    page = parse(text)
                    content = xxhash.xxh64("\n".join(t for _, t in page.blocks).encode("utf-8", "surrogatepass")).intdigest() - (1 << 63)
                    found = subtrees(page)
                    hosts += [host] * len(found)
                    sources += [source] * len(found)
                    digests += [content] * len(found)
                    hashes += found
                    left = effective(page)
                    alive += [h in left for h in found]
                columns = [pa.array(hosts, pa.string()), *(pa.array(c, pa.int64()) for c in (sources, digests, hashes)), pa.array(alive, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["host", "source", "page", "hash", "alive"])

    rows = pages.select(F.col(html).alias("html"), _host(F.col(url)).alias("host"), F.xxhash64(html).alias("source"))
    return rows.mapInArrow(tidy(run), "host string, source long, page long, hash long, alive boolean")


def templates(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """host, hash: the subtrees of each host's template, but those that tags, classes and roles delete on all pages anyway."""
    by_page = _seen(pages, html, url).groupBy("host", "page", "hash").agg(F.max("alive").alias("alive"))
    counted = by_page.groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("alive").alias("alive"))
    return counted.filter((F.col("n") >= MIN_PAGES) & F.col("alive")).select("host", "hash")


def extract(pages: DataFrame, html: str = "html", url: str = "url", into: str = "main_text") -> DataFrame:
    """pages with the column `into`: each page's main text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if into in pages.columns:
        raise ValueError(f"there is a column {into} already")
    found = checkpoint(templates(pages, html, url))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), _host(F.col(url)).alias("host"))
    few = found.limit(BROADCAST_ROWS + 1).collect()
    if len(few) <= BROADCAST_ROWS:
        by_host: dict[str, set[int]] = {}
        for r in few:
            by_host.setdefault(r.host, set()).add(r.hash)
        shared = pages.sparkSession.sparkContext.broadcast(by_host)
        joined = rows.select("row", "host", F.lit(None).cast("array<long>").alias("hashes"))
    else:
        # A host may have any number of templates, a page only has those among its own subtrees.
        shared = None
        own = _seen(pages, html, url).filter("alive").select("host", "source", "hash").distinct().join(found, ["host", "hash"])
        marked = own.groupBy("host", "source").agg(F.collect_list("hash").alias("hashes"))
        salted = marked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("source", F.xxhash64(F.col("row")[html])).withColumn("salt", salt)
        joined = joined.join(salted, ["host", "source", "salt"], "left").select("row", "host", "hashes")
    inner = pages.schema
    schema = StructType([*inner.fields]).add(into, "string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            columns = dict(zip([f.name for f in row.type], row.flatten(), strict=True))
            if shared is not None:
                template = [shared.value.get(h, set()) for h in batch.column("host").to_pylist()]
            else:
                template = [set(h or ()) for h in batch.column("hashes").to_pylist()]
            said = [main_text(parse(x), t) for x, t in zip(columns[html].to_pylist(), template, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(said, pa.string())], schema=arrow)

    return joined.select("row", "host", "hashes").mapInArrow(tidy(run), schema)
