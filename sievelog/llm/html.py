"""Main text of web pages by paths that the pages of a host agree on.

Each page scores its containers by the plain text in them; boilerplate elements, and elements whose class, id or role
names boilerplate, score nothing and are never part of a text. Inside an article only a class or role that is such a
name as a whole counts and no id, and no heading counts there or in a main. Containers inside an article or main score
for the outermost one, which is what pages vote for, so that its heading and lead stay with it. A container's path is the chain of tags and first
classes down to it, digits removed, so pages of one template share it. Every page spreads one vote over its paths, the
votes are summed per host in Spark, and each page is extracted again from the containers on its host's winning path,
or from its own best one where it has none on it.

Character references are decoded, white space inside a block becomes one space and blocks are joined by one space.
Null or empty html and pages without text give an empty text. A missing url counts as one host. Repeated rows vote each
and have the same text; ties of paths go to the greater one. Paths longer than ``LONG_PATH`` go on as digests, so pages of
any size, depth and brokenness are read whole, in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievelog.operators.lookup import spread_lookup
from sievelog.session import ship_package, written

BROADCAST_HOSTS = 100_000
LONG_PATH = 400

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body center div main section td".split())
DROPPED = frozenset(
    "aside button canvas dialog fieldset footer form head iframe input label menu nav noscript object option script "
    "select style svg template textarea title video audio".split()
)
#: Parts of class, id and role names that mark what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising aside banner bottombar breadcrumb breadcrumbs byline-share comment "
    "comments commentlist consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification pagination paywall popup promo promoted related "
    "replies responses search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe tags "
    "teaser toolbar topbar widget widgets".split()
)
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "option": {"option"}}
_PARTS = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")


@dataclass
class Container:
    """A container on a page: its path, and its stretch of the page's blocks, apart from boilerplate."""

    path: str
    main: bool
    parent: Container | None
    blocks: list[str]
    inner: bool = False
    score: float = 0.0
    credit: float = 0.0

    def __post_init__(self) -> None:
        self.start = self.end = len(self.blocks)
        self.after = 0

    @property
    def texts(self) -> list[str]:
        return self.blocks[self.start : self.end]

    def finish(self, opened: int) -> None:
        """All blocks are there; ``opened`` containers have been opened on the page."""
        self.end, self.after = len(self.blocks), opened
        passed = self.credit
        # what is inside an article scores for the outermost one only
        if not self.inner:
            self.score = self.credit * (1.2 if self.main else 1.0)
            passed *= 0.3 if self.main else 0.6
        if self.parent is not None:
            self.parent.credit += passed


class Page(HTMLParser):
    """Containers of one page, outermost first. Time and memory are linear in the page, however deep or broken it is."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        root = Container("", False, None, self.blocks)
        self.containers = [root]
        self._open: list[tuple[str, Container | None, bool]] = []  # tag, container it opens, whether it drops
        self._counts: dict[str, int] = {}  # open tags by name
        self._mains = 0
        self._inside = root
        self._dropped = self._links = 0
        self._block: list[str] = []
        self._linked = 0
        self.feed(html)
        self.close()
        self._end_block()
        while self._open:
            self._close()
        root.finish(len(self.containers))

    def _end_block(self) -> None:
        text = " ".join("".join(self._block).split())
        if text:
            self.blocks.append(text)
            self._inside.credit += max(0, len(text) - 2 * self._linked)
        self._block, self._linked = [], 0

    def _drops(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in DROPPED or (tag == "header" and not self._mains):
            return True
        if tag in ("html", "body", "main", "article"):
            named = [v for k, v in attrs if k in ("class", "role") and v]
            return tag == "article" and any("comment" in v.lower() for v in named)
        values = [v for k, v in attrs if k in ("class", "id", "role") and v]
        if any(k == "hidden" for k, _ in attrs) or any(k == "aria-hidden" and v == "true" for k, v in attrs):
            return True
        if tag in HEADINGS and (self._inside.inner or self._inside.main):
            return False
        if values and self._counts.get("article"):
            return any(p.lower() in NAMES for k, v in attrs if k in ("class", "role") and v for p in v.split())
        return any(p.lower() in NAMES for v in values for p in _PARTS.findall(v))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self._open and tag in CLOSED_BY.get(self._open[-1][0], ()):
            self._close()
        if tag in BLOCKS:
            self._end_block()
        if tag in VOID:
            return
        drops, opened = self._drops(tag, attrs), None
        if tag in CONTAINERS and not drops and not self._dropped:
            first = next((v.split()[0] for k, v in attrs if k == "class" and v and v.split()), "")
            step = _DIGITS.sub("", f"{tag}.{first}" if first else tag)
            role = any(k == "role" and v == "main" for k, v in attrs)
            path = f"{self._inside.path}/{step}"
            if len(path) > LONG_PATH:  # parent and step, as one digest
                path = f"#{hashlib.blake2b(path.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"
            inner = self._inside.inner or self._inside.main
            opened = Container(path, tag in ("article", "main") or role, self._inside, self.blocks, inner)
            self.containers.append(opened)
            self._inside = opened
            self._mains += opened.main
        self._dropped += drops
        self._links += tag == "a"
        self._open.append((tag, opened, drops))
        self._counts[tag] = self._counts.get(tag, 0) + 1

    def _close(self) -> None:
        tag, opened, drops = self._open.pop()
        self._counts[tag] -= 1
        if tag in BLOCKS:
            self._end_block()
        if opened:
            self._end_block()
            opened.finish(len(self.containers))
            self._mains -= opened.main
            self._inside = opened.parent
        self._dropped -= drops
        self._links -= tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_block()
        if self._counts.get(tag):
            while self._open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if not self._dropped:
            self._block.append(data)
            if self._links:
                self._linked += len(data.strip())


def votes(html: str | None) -> dict[str, float]:
    """One vote spread over the paths of a page by their scores."""
    scores: dict[str, float] = {}
    for c in Page(html or "").containers:
        if c.score > 0:
            scores[c.path] = scores.get(c.path, 0.0) + c.score
    total = sum(scores.values())
    return {p: s / total for p, s in scores.items()}


def text_on(html: str | None, path: str | None) -> str:
    """Text of the outermost containers on a path, or of the page's best container."""
    containers = Page(html or "").containers
    found = [(i, c) for i, c in enumerate(containers) if c.path == path and c.end > c.start]
    if not found:
        best = max(containers, key=lambda c: c.score)
        found = [(0, best if best.end > best.start else containers[0])]
    out, until = [], 0
    for i, c in found:
        # a container on the path inside another one on it is part of that one
        if i >= until:
            out += c.texts
            until = c.after
    return " ".join(out)


def host_of(url):
    """Host of a url column, empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes on each host; a tie goes to the greater path."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # summed within the batch, so that a frequent host sends few rows
            sums: dict[tuple[str, str], float] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                for path, share in votes(html.as_py()).items():
                    sums[host, path] = sums.get((host, path), 0.0) + share
            hosts, paths = [h for h, _ in sums], [p for _, p in sums]
            yield pa.record_batch(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(sums.values()), pa.float64())], ["host", "path", "share"]
            )

    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, share double")
    # rounded, so that the order of adding never decides
    summed = cast.groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("votes"))
    return summed.groupBy("host").agg(F.max(F.struct("votes", "path")).alias("best")).select("host", "best.path")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    winners = written(host_paths(pages), "paths")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_host"))
    winners = winners.withColumnRenamed("host", "_host")
    if winners.count() <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(winners), "_host", "left")
    else:
        rows = spread_lookup(rows, ["_host"], winners, ["page_id", "url"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_on(h.as_py(), p.as_py()) for h, p in zip(batch.column("html"), batch.column("path"))]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return rows.select("page_id", "url", "html", "path").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
