"""Main text of web pages, with site templates removed (operator 9).

Each page is parsed once into blocks of text; every block knows the hashes of the element
subtrees it lies in. Spark counts the subtrees per host, and those that recur on many of its pages,
with other text around them, are deleted from all of its pages. Menus, forms and the like, which differ from page
to page, go by their tags and class names.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.batches import slices
from timberline.llm.url_filter import host_of
from timberline.sources.scratch import materialize

#: A subtree is a template if it is on more than ``MIN_PAGES`` pages of a host and on this share of
#: them, which keeps the table of a large host's templates small; the second one is for articles,
#: where a quoted line may recur. On half of the pages, ``MIN_PAGES`` are enough.
SHARE = 0.01
ARTICLE_SHARE = 0.05
MOST = 0.5
MIN_PAGES = 10
#: What is around a subtree has to differ so often at least; else its pages are copies of one page.
DIFFERENT = 5
#: Blocks around a subtree that are looked at, longest first. It is the longest that has to differ;
#: outside the article, what is on ``MOST`` pages may have others of the site's templates around it.
AROUND = 3

# Element names and words of class names, ids and roles.
DROPPED = set(
    "head title script style noscript template nav footer aside form button select option "
    "textarea input label iframe object embed svg canvas math audio video map dialog menu "
    "datalist fieldset legend".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
ENDS_P = BLOCKS - {"body", "html", "caption", "legend", "tbody", "tfoot", "thead", "tr", "li", "dd", "dt"}
SPACED = {"br", "td", "th", "img", "wbr"}
CLUTTER = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar comment comments reply replies respond disqus "
    "footer header masthead share sharing social related recommended newsletter subscribe "
    "subscription signup login search widget pagination pager toolbar contentinfo complementary "
    "dialog".split()
)
#: Names of readers' comments; whatever they hold is no article.
COMMENTS = set("comment comments reply replies respond disqus".split())
#: Dropped elements that are wrapped around whole pages now and then.
WRAPPERS = {"form", "fieldset"}
SIBLINGS = {"li": ("ul", "ol"), "dd": ("dl",), "dt": ("dl",), "option": ("select",),
            "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


class _Element:
    __slots__ = ("tag", "dropped", "article", "wrapper", "digest", "blocks", "filled")

    def __init__(self, tag: str, dropped: bool, article: bool, wrapper: int = 0):
        self.tag, self.dropped, self.article, self.wrapper = tag, dropped, article, wrapper
        self.digest = xxhash.xxh3_64(tag.encode())
        self.blocks: list[int] = []
        self.filled = False


class _Reader(HTMLParser):
    """Collects blocks ``[text, hashes, in article, in main, wrapper]`` in page order.

    What is to be dropped by a class name or the like is read all the same, with the number of its
    ``wrapper``, as it may turn out to hold the article; 0 is what is not in question. Text, blocks
    and hashes of one number never enter those of another.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.open: list[_Element] = [_Element("#page", False, False)]
        self.text: dict[int, list[str]] = {}
        self.wrappers = 0
        self.articles: set[int] = set()
        self.names: Counter[str] = Counter()

    def read(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        while len(self.open) > 1:
            self._leave()
        self._end_block()
        return self.blocks

    def _end_block(self) -> None:
        texts, self.text = self.text, {}
        for wrapper, parts in texts.items():
            text = " ".join("".join(parts).split())
            if not text:
                continue
            n = len(self.blocks)
            self.blocks.append(
                [text, [], self.names["article"] > 0, self.names["main"] > 0, wrapper]
            )
            begun = False
            for element in reversed(self.open[1:]):
                if element.wrapper == wrapper:
                    begun = True
                    element.blocks.append(n)
                elif begun:
                    break

    def _end_block_of(self, element: _Element) -> None:
        """All blocks end with a block element, with another one those of its wrapper."""
        if element.tag in BLOCKS:
            self._end_block()
        else:
            others, self.text = self.text, {element.wrapper: self.text.pop(element.wrapper)}
            self._end_block()
            self.text = others

    def _add(self, data: str) -> None:
        self.text.setdefault(self.open[-1].wrapper, []).append(data)

    def _leave(self) -> None:
        element = self.open[-1]
        if element.tag in BLOCKS or element.wrapper != self.open[-2].wrapper and (
            element.wrapper in self.text
        ):
            self._end_block_of(element)
        self.open.pop()
        self.names[element.tag] -= 1
        if element.filled:
            digest = element.digest.intdigest()
            for n in element.blocks:
                self.blocks[n][1].append(digest - (1 << 63))
            if self.open[-1].wrapper == element.wrapper:
                self.open[-1].digest.update(digest.to_bytes(8, "little"))
                self.open[-1].filled = True

    def _leave_upto(self, tag: str, within: tuple[str, ...]) -> None:
        """Close the nearest open element of a name unless one of ``within`` lies nearer."""
        if not self.names[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                while len(self.open) > i:
                    self._leave()
                return
            if self.open[i].tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_block()
        if tag in ENDS_P:
            self._leave_upto("p", ("button", "td", "th", "caption"))
        if tag in SIBLINGS:
            for other in ("td", "th") if tag in ("td", "th") else ("dd", "dt") if tag in ("dd", "dt") else (tag,):
                self._leave_upto(other, SIBLINGS[tag])
        if tag == "body":
            self._leave_upto("head", ())
        if tag in SPACED:
            self._add(" ")
        if tag in VOID:
            return
        above = self.open[-1]
        self.names[tag] += 1
        article = above.article or tag in ("article", "main")
        dropped = above.dropped or self._hard(tag, attrs, article)
        wrapper = above.wrapper
        if not dropped:
            if tag == "main":
                wrapper = 0  # a page has one; nothing around it is clutter
            elif tag == "article" and wrapper and wrapper not in self.articles:
                self.wrappers = wrapper = self.wrappers + 1
                self.articles.add(wrapper)
            elif tag in WRAPPERS or self._named(tag, attrs, CLUTTER):
                self.wrappers = wrapper = self.wrappers + 1
        self.open.append(_Element(tag, dropped, article, wrapper))

    @staticmethod
    def _hard(tag: str, attrs: list[tuple[str, str | None]], article: bool) -> bool:
        """Whether an element goes whatever it holds."""
        if tag in DROPPED - WRAPPERS or tag == "header" and not article:
            return True
        if tag in ("html", "body"):
            return False
        if tag in ("article", "main"):
            return any(
                name in ("class", "id", "role") and not {"comment", "comments"}.isdisjoint((value or "").lower().split())
                for name, value in attrs
            )
        return _Reader._named(tag, attrs, COMMENTS) or any(
            name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs
        )

    @staticmethod
    def _named(tag: str, attrs: list[tuple[str, str | None]], names: set[str]) -> bool:
        """Whether a class, id or role is made of such words only; parts of a name do not count."""
        if tag in ("html", "body", "article", "main"):
            return False
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for token in value.split():
                    words = re.findall(r"[^\W\d_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
                    if words and names.issuperset(words):
                        return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        self._leave_upto(tag, () if tag in BLOCKS else ("article", "body", "td", "th"))
        if tag in SPACED:
            self._add(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        element = self.open[-1]
        if element.dropped:
            return
        self._add(data)
        if data.strip():
            element.digest.update(" ".join(data.split()).encode("utf-8", "surrogatepass"))
            element.filled = True


def page_blocks(html: str) -> list[list]:
    """Blocks of the article where the page marks one, else of the whole page.

    An element with the name of clutter is kept if more than half of the page's text is directly
    in it, and so are articles in such elements where no other article is marked and they hold
    more than the rest of the page.
    """
    reader = _Reader()
    blocks = reader.read(html)
    if reader.wrappers:
        size: Counter[int] = Counter()
        for b in blocks:
            size[b[4]] += len(b[0])
        keep = {0} | {w for w, n in size.items() if 2 * n > size.total() and w not in reader.articles}
        if not any(b[2] and not b[4] for b in blocks):
            if sum(size[w] for w in reader.articles) > size[0]:
                keep |= reader.articles
        blocks = [b for b in blocks if b[4] in keep]
    for place in (2, 3):
        inside = [b for b in blocks if b[place]]
        if inside:
            return inside
    return blocks


_BLOCK = pa.struct(
    [("text", pa.string()), ("hashes", pa.list_(pa.int64())), ("article", pa.bool_())]
)


def parse_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, url, host, blocks)`` per page; null html has no blocks."""
    picked = pages.select(
        F.col(key).cast("long").alias(key),
        F.col(url).cast("string").alias("url"),
        host_of(F.col(url)).alias("host"),
        F.col(html).cast("string").alias("html"),
    )
    names = [key, "url", "host", "blocks"]

    def run(batches):
        for batch in slices(batches):
            rows = [
                [{"text": t, "hashes": h, "article": a or m} for t, h, a, m, _ in page_blocks(x or "")]
                for x in batch.column(3).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(rows, pa.list_(_BLOCK))], names=names
            )

    return picked.mapInArrow(
        run,
        f"{key} bigint, url string, host string, "
        "blocks array<struct<text:string,hashes:array<bigint>,article:boolean>>",
    )


def around(blocks: list[list]) -> list[tuple[int, bool, list[int]]]:
    """``(hash, in article, bits)`` per subtree of a page.

    The bits are those of the longest blocks outside the subtree, each in a word of 64 by hash.
    """
    inside: dict[tuple[int, bool], set[int]] = {}
    for n, (_, hashes, article, main, _) in enumerate(blocks):
        for h in hashes:
            inside.setdefault((h, article or main), set()).add(n)
    longest = sorted(range(len(blocks)), key=lambda n: (-len(blocks[n][0]), blocks[n][0]))
    bits = [
        1 << xxhash.xxh3_64_intdigest(b[0].encode("utf-8", "surrogatepass")) % 64 for b in blocks
    ]
    bits = [x - (1 << 64) if x >> 63 else x for x in bits]
    out = []
    for (h, article), own in inside.items():
        found = []
        for n in longest:
            if n not in own:
                found.append(bits[n])
                if len(found) == AROUND:
                    break
        out.append((h, article, found + [0] * (AROUND - len(found))))
    return out


def page_subtrees(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, hash, article, around0, ...)`` per page and subtree; see :func:`around`."""
    words = [f"around{i}" for i in range(AROUND)]

    def run(batches):
        for batch in slices(batches):
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = around(page_blocks(page or ""))
                columns = [
                    pa.array([host] * len(rows), pa.string()),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.bool_()),
                    *(pa.array([r[2][i] for r in rows], pa.int64()) for i in range(AROUND)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "hash", "article", *words])

    picked = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    return picked.mapInArrow(
        run, "host string, hash bigint, article boolean, " + ", ".join(f"{w} bigint" for w in words)
    )


def site_templates(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    share: float = SHARE,
    article_share: float = ARTICLE_SHARE,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``(host, hashes)``: subtrees that recur on many pages of a host that differ otherwise.

    Counts combine before their shuffle, so a host with a third of all pages is no burden. How
    often the text around a subtree differs is told by the bits that its hashes set, which is never
    more than the true number.
    """
    sizes = pages.groupBy(host_of(F.col(url)).alias("host")).agg(F.count("*").alias("pages"))
    words = [f"around{i}" for i in range(AROUND)]
    counts = (
        page_subtrees(pages, url, html)
        .groupBy("host", "hash", "article")
        .agg(F.count("*").alias("n"), *(F.bit_or(w).alias(w) for w in words))
        .where(F.col("n") >= min_pages)
    )
    most = F.col("n") >= MOST * F.col("pages")
    low = F.when(F.col("article"), article_share).otherwise(share) * F.col("pages")
    different = F.when(
        most & ~F.col("article"), F.greatest(*(F.bit_count(w) for w in words))
    ).otherwise(F.bit_count(words[0]))
    return (
        counts.join(sizes, "host")
        .where(most | (F.col("n") >= low) & (F.col("n") > min_pages))
        .where(different >= DIFFERENT)
        .groupBy("host")
        .agg(F.collect_set("hash").alias("hashes"))
    )


def extract_text(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    share: float = SHARE,
    article_share: float = ARTICLE_SHARE,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``(key, url, text, n_chars)`` per page.

    White space within a block becomes one space; blocks are joined by line breaks. Null or empty
    html and pages without an article text give the empty text. A host with fewer than
    ``min_pages`` pages has no templates; pages without a host are one host. Rows with a null or
    repeated key are rows like any other. The templates of a large host are at most ``1 / share``
    times the subtrees of its average page; their table is written first, so that Spark sends it
    to the tasks only where it is small.
    """
    parsed = parse_pages(pages, key, url, html)
    templates = materialize(
        site_templates(pages, url, html, share, article_share, min_pages), "templates"
    ).withColumnRenamed("host", "site")
    kept = F.filter(
        "blocks",
        lambda b: ~F.arrays_overlap(
            b["hashes"], F.coalesce(F.col("hashes"), F.array().cast("array<bigint>"))
        ),
    )
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    joined = parsed.join(templates, F.col("host") == F.col("site"), "left")
    return joined.select(key, "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
