"""Main text of web pages, with the parts that a site repeats removed.

1. Each page is parsed into a tree of elements (optional end tags, void
   elements, raw text and cut-off markup as browsers read them). Menus, headers,
   footers, sidebars, notices, adverts, forms, comments and hidden parts go where
   the page names them as such: by element, by role, or by a word of a class or id.
2. The main part is the outermost ``article`` elements left; else what is
   marked as the article's body; else ``main``; else what a class or id calls
   content; else all of the page.
3. Every block element of the main part gets a hash of its subtree: names, text
   and order, without attributes. Spark counts each host's hashes, over pages of
   different main text: copies of a page count once, so that an article that is
   published often does not become a template.
4. A subtree is a template of its host if at least ``min_pages`` pages have it
   and at least the share ``min_share`` of the host's pages. Where a page marks its
   main part, most of that is the author's, and articles may well quote the same
   passage; there, only what ``marked_pages`` and the share ``marked_share`` of
   the pages have goes.
5. The pages are parsed once more, now with their host's templates, and the text
   of what is left is written block by block.

Pages do not move: only hashes are shuffled, combined before it, and a host's
templates are joined to its pages. Their number is bounded: each is on a share
``min_share`` of the pages, so a host has at most as many as a page has blocks,
divided by ``min_share``. The join is left to Spark, which broadcasts the
written templates if they are small and splits a host with many pages if not.

A header inside the main part keeps its headings. White space in a block, line
breaks included, becomes one space; table cells are parted by a space, rows are
blocks. Comparison is by 64-bit hashes within a host.

Defined cases: null and empty pages, and pages of markup only, have an empty
text; a null url, or one without a host, belongs to no site, and only rules 1
and 2 apply to it; repeated rows each get their text; an empty table stays
empty; very long pages are read whole, in time linear in their length. Input
columns are carried in one nested column, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gradeloom.llm.common import carried, pieces, require, ship_code, written
from gradeloom.operators.scale import skew_join

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr legend li main menu nav ol"
    " optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("caption legend optgroup option tbody tfoot thead tr".split())
SCOPES = frozenset("button caption marquee object table td template th".split())
UNSEEN = frozenset("html head body".split())
IN_TABLE = frozenset("tbody td tfoot th thead tr".split())
# What a start tag ends, and up to which open element.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}

# What names a part of a page that is not its main text.
DROPPED_TAGS = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form iframe input label legend menu nav noembed noframes noscript object option optgroup"
    " script search select style svg template textarea title video xmp".split()
)
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar tooltip".split())
DROPPED_WORDS = frozenset(
    "ad ads adsense advert advertisement advertisements advertising adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer"
    " gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promotion recommended related replies"
    " respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar tracking widget widgets".split()
)
HEADER_WORDS = frozenset({"header"})
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:(?:article|post|entry|story|page|main)[_-]?(?:body|content|text)|content|article|post|entry|story)(?:$|\s)")
ABOUT_OTHERS = re.compile(r"^(?:has|with|without|no|is|show|hide)[_-]")

TAG = re.compile(r"""</?([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
CUT = re.compile("</?[A-Za-z]")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
NAMING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
COMMENT_END = re.compile(r"--!?>")
RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}

KEEP, DROP, HEADINGS_ONLY = 0, 1, 2


def _attributes(given: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(given):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


@lru_cache(maxsize=4096)
def _judged(tag: str, given: str) -> tuple[int, int, bool]:
    """How an element is treated, how good a main part it is (3: article, 0: none), and whether a class or id decided."""
    treat = DROP if tag in DROPPED_TAGS else HEADINGS_ONLY if tag == "header" else KEEP
    rank = 4 if tag == "article" else 2 if tag == "main" else 0
    if not NAMING.search(given):
        return treat, rank, False
    has = _attributes(given)
    role = has.get("role", "").lower().strip()
    if role in DROPPED_ROLES or "hidden" in has or has.get("aria-hidden", "").lower() == "true" or NO_DISPLAY.search(has.get("style", "")):
        treat = DROP
    if has.get("itemprop", "").lower() == "articlebody":
        rank = max(rank, 3)
    if role == "main":
        rank = max(rank, 2)
    names = [n for v in (has.get("class", ""), has.get("id", "")) for n in re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", v).lower().split()]
    names = [n for n in names if not ABOUT_OTHERS.match(n)]
    words = {w for n in names for w in re.split(r"[^a-z0-9]+", n)}
    if rank == 0 and CONTENT_NAMES.search(" ".join(names)):
        rank = 1
    if treat == KEEP and words & DROPPED_WORDS:
        return DROP, rank if tag == "article" else 0, True
    if treat == KEEP and words & HEADER_WORDS:
        return HEADINGS_ONLY, rank, True
    return treat, rank, False


class Page:
    """A page's elements in order; ``events`` are texts, ``i`` where element i starts and ``~i`` where it ends."""

    def __init__(self, source: str):
        self.tags: list[str] = []
        self.treat: list[int] = []
        self.rank: list[int] = []
        self.by_name: list[bool] = []
        self.events: list = []
        self._stack: list[int] = []
        self._open: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        self._scopes: list[int] = []
        self._parse(source)
        while self._stack:
            self._pop()

    def _last(self, tags) -> int:
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=-1)

    def _scope(self) -> int:
        return self._scopes[-1] if self._scopes else -1

    def _pop(self) -> None:
        node = self._stack.pop()
        at = len(self._stack)
        self._open[self.tags[node]].pop()
        for places in (self._blocks, self._scopes):
            if places and places[-1] == at:
                places.pop()
        self.events.append(~node)

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._pop()

    def _start(self, tag: str, given: str) -> None:
        if tag in UNSEEN:
            return
        if tag == "br":
            self.events.append(" ")
            return
        if tag in ENDS_P and (p := self._open.get("p")) and p[-1] > self._scope():
            self._pop_to(p[-1])
        if tag in HEADINGS and self._stack and self.tags[self._stack[-1]] in HEADINGS:
            self._pop()
        if tag in CLOSES:
            ended, limits = CLOSES[tag]
            limit = self._last(limits) if tag in IN_TABLE else max(self._last(limits), self._scope())
            while (at := self._last(ended)) > limit:
                self._pop_to(at)
        node = len(self.tags)
        treat, rank, by_name = _judged(tag, given) if len(given) < 200 else _judged.__wrapped__(tag, given)
        self.tags.append(tag)
        self.treat.append(treat)
        self.rank.append(rank)
        self.by_name.append(by_name)
        self.events.append(node)
        if tag in VOID:
            self.events.append(~node)
            return
        if tag in BLOCKS:
            self._blocks.append(len(self._stack))
        if tag in SCOPES:
            self._scopes.append(len(self._stack))
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(node)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.events.append(" ")
        places = self._open.get(tag)
        if not places:
            if tag == "p":
                self._start("p", "")
                self._pop()
            return
        at = places[-1]
        if tag in BLOCKS or tag in SCOPES:
            if tag in SCOPES or tag in IN_TABLE or at > self._scope():
                self._pop_to(at)
        elif not self._blocks or self._blocks[-1] < at:  # an inline end tag ends no block
            self._pop_to(at)

    def _text(self, text: str) -> None:
        if text:
            self.events.append(html.unescape(text) if "&" in text else text)

    def _parse(self, source: str) -> None:
        at = said = 0
        while (lt := source.find("<", at)) >= 0:
            m, kind = TAG.match(source, lt), source[lt + 1 : lt + 2]
            if m or CUT.match(source, lt):
                self._text(source[said:lt])
                if not m:
                    return  # cut off inside a tag
                tag, at = m[1].lower(), m.end()
                if kind == "/":
                    self._end(tag)
                else:
                    self._start(tag, m[2])
                    if tag in RAW and self._stack and self.tags[self._stack[-1]] == tag:
                        if not (m := RAW_ENDS[tag].search(source, at)):
                            return
                        at = m.start()
                said = at
            elif kind in ("!", "?", "/"):
                self._text(source[said:lt])
                if source.startswith("<!--", lt):
                    short = re.compile(r"-?>").match(source, lt + 4)
                    m = short or COMMENT_END.search(source, lt + 4)
                    end = m.end() if m else -1
                else:
                    end = source.find(">", lt) + 1 or -1
                if end < 0:
                    return
                at = said = end
            else:
                at = lt + 1
        self._text(source[said:])

    # -- the main part -----------------------------------------------------

    def settle(self) -> None:
        """Choose the main part: sets ``dropped`` (by element), ``main`` (the elements it consists of; none: the whole page) and its events."""
        stack: list[int] = []
        parent = [-1] * len(self.tags)
        for e in self.events:
            if isinstance(e, str):
                continue
            if e >= 0:
                parent[e] = stack[-1] if stack else -1
                stack.append(e)
            else:
                stack.pop()
        holds = [0] * len(self.tags)
        for node in range(len(self.tags) - 1, -1, -1):  # children come after their parents
            own = self.rank[node] if self.treat[node] != DROP and self.rank[node] >= 2 else 0
            best = max(holds[node], own)
            if self.by_name[node] and holds[node]:  # a class on a frame around the main part says nothing about it
                self.treat[node] = KEEP
            if self.treat[node] == DROP:
                best = 0
            if parent[node] >= 0:
                holds[parent[node]] = max(holds[parent[node]], best)
        gone = [False] * len(self.tags)
        for node, up in enumerate(parent):
            gone[node] = self.treat[node] == DROP or up >= 0 and gone[up]
        self.dropped, self.main = gone, frozenset()
        text = self._has_text(gone)
        for rank in (4, 3, 2, 1):
            some, within = set(), [False] * len(self.tags)
            for node, up in enumerate(parent):
                within[node] = up >= 0 and (within[up] or up in some)
                if self.rank[node] == rank and not gone[node] and not within[node]:
                    some.add(node)
            if any(text[n] for n in some):
                self.main = frozenset(some)
                break
        self.seen = list(self._seen())

    def _has_text(self, gone: list[bool]) -> list[bool]:
        out, stack = [False] * len(self.tags), []
        for e in self.events:
            if isinstance(e, str):
                if stack and not gone[stack[-1]] and not e.isspace():
                    out[stack[-1]] = True
            elif e >= 0:
                stack.append(e)
            else:
                stack.pop()
                if stack and out[~e]:
                    out[stack[-1]] = True
        return out

    def _seen(self) -> Iterator:
        """The events of the main part, without what is dropped."""
        main = 0 if self.main else 1
        hidden = headers = 0
        headings = 0
        for e in self.events:
            if isinstance(e, str):
                if main and not hidden and (not headers or headings):
                    yield e
                continue
            node = e if e >= 0 else ~e
            step = 1 if e >= 0 else -1
            if step > 0 and node in self.main:
                main += 1
            visible = main and not hidden and not self.dropped[node]
            hidden += step * (self.treat[node] == DROP)
            headers += step * (self.treat[node] == HEADINGS_ONLY and node not in self.main)
            headings += step * (self.tags[node] in HEADINGS)
            if visible:
                yield e
            if step < 0 and node in self.main:
                main -= 1

    def subtrees(self) -> dict[int, int]:
        """Hashes of the main part's block elements that have text."""
        out: dict[int, int] = {}
        open_: list[list[bytes]] = [[]]
        run: list[str] = []

        def flush() -> None:
            if words := "".join(run).split():
                open_[-1].append(b"t" + hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest())
            run.clear()

        for e in self.seen:
            if isinstance(e, str):
                run.append(e)
                continue
            flush()
            if e >= 0:
                open_.append([])
                continue
            parts = open_.pop()
            if not parts:
                continue
            digest = hashlib.blake2b(self.tags[~e].encode("utf-8", "surrogatepass") + b"\0" + b"".join(parts), digest_size=8).digest()
            open_[-1].append(b"e" + digest)
            if self.tags[~e] in BLOCKS and ~e not in self.main:
                out[~e] = int.from_bytes(digest, "big", signed=True)
        return out

    def blocks(self, without: frozenset = frozenset()) -> list[str]:
        """The text of the main part by block, without the elements named."""
        out: list[str] = []
        run: list[str] = []
        hidden = 0

        def flush() -> None:
            if words := "".join(run).split():
                out.append(" ".join(words))
            run.clear()

        for e in self.seen:
            if isinstance(e, str):
                if not hidden:
                    run.append(e)
                continue
            node = e if e >= 0 else ~e
            if self.tags[node] in BLOCKS:
                flush()
            elif self.tags[node] in ("td", "th"):
                run.append(" ")
            if node in without:
                hidden += 1 if e >= 0 else -1
        flush()
        return out


def parsed(source: str | None) -> Page:
    page = Page(source or "")
    page.settle()
    return page


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        digests, marked, hashes = [], [], []
        for source in batch.column("text").to_pylist():
            page = parsed(source)
            text = "\n".join(page.blocks()).encode("utf-8", "surrogatepass")
            digests.append(hashlib.blake2b(text, digest_size=16).digest())
            marked.append(bool(page.main))
            hashes.append(sorted(set(page.subtrees().values())))
        out = [batch.column("host"), pa.array(digests, pa.binary()), pa.array(marked, pa.bool_()), pa.array(hashes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, ["host", "page", "marked", "hashes"])


def host_of(url: Column) -> Column:
    """The host of an absolute url in lower case, else an empty string."""
    found = F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def templates(pages: DataFrame, min_pages: int, min_share: float, marked_pages: int, marked_share: float) -> DataFrame:
    """``(host, common, everywhere)``: hashes of each host's template subtrees, and of those that go from marked main parts too.

    ``pages`` is ``(host, text)``.
    """
    found = pages.filter("host <> ''").mapInArrow(_subtrees, "host string, page binary, marked boolean, hashes array<bigint>")
    # copies count once; of their differing markups the least is taken, whatever the order of the rows
    distinct = found.groupBy("host", "page").agg(F.min(F.struct("marked", "hashes")).alias("of"))
    distinct = written(distinct.select("host", F.col("of.hashes").alias("hashes")), "template-subtrees")
    totals = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = distinct.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.filter(F.col("n") >= min(min_pages, marked_pages)), "template-counts")
    shares = skew_join(counts, totals, ["host"], ["hash"])
    common = (F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("pages"))
    everywhere = (F.col("n") >= marked_pages) & (F.col("n") >= marked_share * F.col("pages"))
    return shares.filter(common | everywhere).groupBy("host").agg(
        F.collect_list(F.when(common, F.col("hash"))).alias("common"), F.collect_list(F.when(everywhere, F.col("hash"))).alias("everywhere"),
    )


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = []
        for source, common, everywhere in zip(*(batch.column(c).to_pylist() for c in ("text", "common", "everywhere"))):
            page = parsed(source)
            known = set((everywhere if page.main else common) or ())
            gone = frozenset(n for n, h in page.subtrees().items() if h in known) if known else frozenset()
            texts.append("\n".join(page.blocks(gone)).encode("utf-8", "replace").decode())
        yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(texts, pa.string())], ["record", "main"])


def main_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html",
    min_pages: int = 5, min_share: float = 0.01, marked_pages: int = 10, marked_share: float = 0.9,
) -> DataFrame:
    """``record`` (the other columns of the input) and ``main``, the page's main text."""
    require(pages, url_col, html_col)
    ship_code(pages.sparkSession)
    rows = carried(pages, html_col)
    host = host_of(F.col(f"record.`{url_col}`"))
    known = written(templates(rows.select(host.alias("host"), "text"), min_pages, min_share, marked_pages, marked_share), "templates")
    schema = StructType([StructField("record", rows.schema["record"].dataType), StructField("main", StringType())])
    return rows.withColumn("host", host).join(known, "host", "left").select("record", "text", "common", "everywhere").mapInArrow(_extracting, schema)
