"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's streaming parser turns a page into lines: runs of text between tags that break a line. Each
line's ratio of text to tags is smoothed over its neighbours by a Gaussian; two clusters of the smoothed ratios give
the threshold, and the lines above it that aren't mostly links are the core. The outermost article and main elements
are the content region if they hold most of the core's text, else the whole page is. The region's lines are the main
text, short ones too, except those inside elements that by their tag, class or id are menus, headers, footers,
sidebars, notices, adverts, forms or reader comments. Lines mostly made of links go where no article or main element
says that they belong to the text.

Classes and ids of wrappers often name what else is in them. They don't count on elements around the main element, nor
on those that hold over half of the page's text, if no article or main element is free of them or hardly any text is.

Missing pages count as empty and give an empty text, as do pages without content. Rows keep their order and
multiplicity, and rows without an id or address stay. An empty table gives an empty result. Columns other than the
three named ones are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailscope.llm.common import parts_of

BREAKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header main menu nav ol search section table tbody td th thead tfoot tr ul".split())
SILENT = frozenset("applet audio button canvas datalist head iframe math noembed noframes noscript object select svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements outside the main text; a header inside an article belongs to it.
OUTSIDE = frozenset("aside dialog footer form menu nav search".split())
CUES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice overlay pagination popup promo promoted promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
HEADS = frozenset(("header", "masthead"))
#: Standard deviation of the smoothing, in lines, and the share of link text that makes a line a link.
SIGMA = 1.0
LINKS = 0.5
#: Share of the core's text that article and main elements hold to be the content region.
HELD = 0.7
#: Shares of the page's text: of a wrapper, and of what is hardly any.
MOST, HARDLY = 0.5, 0.1

_TOKENS = re.compile(r"[a-z0-9]+(?:-share)?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Lines(HTMLParser):
    """Collects lines (text, tags, link characters, region) and regions: parent, tag, outside but for cues, own cue."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parents, self.outside, self.content, self.tags_of = [-1], [False], [False], [""]
        self.cued = [False]
        self.open: list[tuple[str, int]] = []
        self.counts: dict[str, int] = {}
        self.region, self.silent, self.links = 0, 0, 0
        self.within = 0
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.headings: set[int] = set()

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.region))
        if text or self.text:
            self.tags = 0
        self.text, self.linked = [], 0

    def is_outside(self, tag: str, attributes: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Outside by tag, role or being hidden, and by a cue."""
        cued = False
        if tag in ("html", "body", "main", "article"):
            return False, False
        if tag in OUTSIDE or tag == "header" and not self.within:
            return True, False
        for name, value in attributes:
            value = (value or "").lower()
            if name in ("class", "id"):
                tokens = _TOKENS.findall(value)
                cued = cued or not CUES.isdisjoint(tokens) or not self.within and not HEADS.isdisjoint(tokens)
            elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                return True, False
        return False, cued

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in BREAKS:
            self.end_line()
        if tag in VOID:
            return
        if tag in SILENT:
            self.silent += 1
        if tag == "a":
            self.links += 1
        if tag == "article" or tag == "main":
            self.within += 1
        outside = self.is_outside(tag, attributes) if attributes or tag in REGIONS else (False, False)
        if tag in REGIONS or any(outside):
            self.parents.append(self.region)
            self.outside.append(self.outside[self.region] or outside[0])
            self.cued.append(outside[1])
            self.tags_of.append(tag)
            self.content.append(self.content[self.region] or tag in ("article", "main"))
            self.open.append((tag, self.region))
            self.region = len(self.parents) - 1
        elif tag in SILENT or tag == "a":
            self.open.append((tag, self.region))
        else:
            return
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BREAKS:
            before = len(self.lines)
            self.end_line()
            if tag in HEADINGS and len(self.lines) > before:
                self.headings.add(before)
        if not self.counts.get(tag):
            return
        while True:  # what was left open inside ends with it
            name, region = self.open.pop()
            self.counts[name] -= 1
            if name in BREAKS or name in REGIONS or self.region != region:
                self.end_line()
            self.region = region
            if name in SILENT:
                self.silent -= 1
            if name == "a":
                self.links -= 1
            if name == "article" or name == "main":
                self.within -= 1
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.silent and self.cdata_elem is None:  # scripts and styles aren't text
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def done(self) -> list[tuple[str, int, int, int]]:
        if self.rawdata.startswith("<!--"):  # a comment that never ends
            self.rawdata = ""
        self.close()
        self.end_line()
        return self.lines


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbours; the weights are renewed at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weight


def threshold(values: np.ndarray) -> float:
    """Midpoint of the means of two clusters; the least value if there is nothing to part."""
    low, high = float(values.min()), float(values.max())
    while high > low:
        middle = (low + high) / 2
        upper = values >= middle
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            return middle
        low, high = new
    return low


def excluded(parser: Lines, sizes: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Regions outside the main text, those within others too."""
    hard, cued, parents, n = np.array(parser.outside), np.array(parser.cued), parser.parents, len(parser.parents)
    if not cued.any():
        return hard
    under = cued.copy()
    for k in range(1, n):  # parents come before their children
        under[k] |= under[parents[k]]
    held = np.bincount(regions, np.where(hard[regions], 0, sizes), n)
    clear = held[~under].sum()
    is_main = np.array([t == "main" for t in parser.tags_of]) & ~hard
    is_content = np.array([t in ("main", "article") for t in parser.tags_of]) & ~hard
    free = bool((is_content & ~under).any())
    for k in range(n - 1, 0, -1):
        held[parents[k]] += held[k]
        is_main[parents[k]] |= is_main[k]
        is_content[parents[k]] |= is_content[k]
    most = held > MOST * held[0]
    out = hard | cued & ~(is_main | most & (is_content & (not free) | (clear < HARDLY * held[0])))
    for k in range(1, n):
        out[k] |= out[parents[k]]
    return out


def clustered(parser: Lines, allowed: np.ndarray, core: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """The lines that belong to the core where no element says so.

    From the first core line, and headings right before it, to the last one nothing allowed goes, however short. What lies before or after them stays if
    its own region, smaller than the page, holds core lines; other runs (menus, imprints) go.
    """
    at = np.flatnonzero(core)
    first = at[0]
    while first - 1 in parser.headings:
        first -= 1
    between = np.zeros(len(core), bool)
    between[first : at[-1] + 1] = True
    holds = np.zeros(len(parser.parents), bool)
    holds[regions[core]] = True
    for k in range(len(holds) - 1, 0, -1):  # parents come before their children
        holds[parser.parents[k]] |= holds[k]
    holds[[k for k, tag in enumerate(parser.tags_of) if k == 0 or tag == "body"]] = False
    return allowed & (between | holds[regions])


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    lines = parser.done()
    if not lines:
        return ""
    sizes = np.array([len(x[0]) for x in lines], float)
    ratios = sizes / np.maximum(1, [x[1] for x in lines])
    linked = np.array([x[2] for x in lines]) > LINKS * sizes
    regions = np.array([x[3] for x in lines])
    inside = ~excluded(parser, sizes, regions)[regions]
    content = inside & np.array(parser.content)[regions]
    allowed = inside & ~linked
    if not allowed.any():
        return "\n".join(x[0] for x, ok in zip(lines, content, strict=True) if ok)
    even = smoothed(np.log1p(np.where(allowed, ratios, 0.0)))
    core = allowed & (even >= threshold(even))
    if not core.any():
        core = allowed
    chosen = content if sizes[core & content].sum() >= HELD * sizes[core].sum() else content | clustered(parser, allowed, core, regions)
    return "\n".join(x[0] for x, ok in zip(lines, chosen, strict=True) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 500):
                texts = [main_text(h) if h else "" for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(job, "page_id long, url string, text string, n_chars long")
