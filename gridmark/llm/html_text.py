"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser reads a page in pieces and its events make lines: one for each block of text, with
the tags met since the line before. Elements that never hold the article (menus, notices, forms, scripts and so
on, by tag, role or class) mark their lines. Ratios of characters to tags are smoothed along the page, lines over a
threshold (a share of the ratios' standard deviation) are seeds, and runs of seeds are clusters. The region is
1. the article elements with one parent, if these hold more than MOST of all seed text, else all article elements,
   else the main elements, if these hold more than half; several are joined (seeds of articles that don't win are
   left aside in 2);
2. else the smallest container (an element around other blocks, not a paragraph, list, quote or the like) that has
   MOST of the seed text, widened to the smallest around it that holds every cluster that reaches into it (without
   lines that are seeds by their neighbours alone) and the seeds of sections next to it.
All unmarked lines of that region are the text, short ones too, in page order; where no element bounds the
region, those from the first seed of its clusters to the last.

Classes and ids mark by any of their parts; inside an article or main element, where names as "social-history" or
"header" belong to the story, words that such names are made of mark as a whole class only, and headings by none of them.

Work and memory grow with the page, however broken it is: what can't be closed any more is settled beforehand, pieces
grow with what the parser still holds, and elements are kept as a tree, not as a path for each line.

Defined results. Null or empty html, and pages without text: an empty text and 0. Null ids or urls and repeated rows:
a row each, as any other. Broken markup: read as far as it can be; a tag that the page ends in is dropped, a comment
that is never closed ends at the next ">". Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridmark.llm.common import prepare, row_slices

PIECE, FEED = 2_000_000, 1 << 16
SIGMA, THRESHOLD, MOST = 1.0, 0.25, 0.6

#: Elements and names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
NEVER = frozenset("script style noscript template head title nav footer aside form button select option textarea iframe object canvas svg math audio video map menu dialog".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARTS = frozenset("html body p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr".split())  # bound no region
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_ALWAYS = r"ads?|advert\w*|adsense|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|login|modal|nav|navbar|navigation|newsletter|pager|pagination|popup|promo|promotion|related|replies|share|sharing|sidebar|signup|sponsor|sponsored|subscribe"
_LOOSE = r"banner|disclaimer|menu|notice|notification|reply|respond|skip|social|teaser|toolbar|widget"
_OUTSIDE = r"header|masthead"
OUTER_NAMES = re.compile(rf"(?:^|[\s_-])(?:{_ALWAYS}|{_LOOSE}|{_OUTSIDE})(?:$|[\s_-])", re.I)
INNER_NAMES = re.compile(rf"(?:^|[\s_-])(?:{_ALWAYS})(?:$|[\s_-])|(?:^|\s)(?:{_LOOSE})(?:$|\s)", re.I)


class _Lines(HTMLParser):
    """Lines of a page: text, tags before and in it, whether marked, and the innermost open block element.

    Block elements are numbered as they open: those inside e are e + 1 to last[e].
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, number of the innermost block element, whether marked
        self.blocks: Counter[str] = Counter()  # open block elements of each tag
        self.inside: list[Counter[str]] = [Counter()]  # open inline elements since each open block element
        self.kinds, self.parent = ["html"], [0]  # of element 0, around all
        self.lines: list[tuple[str, int, bool, int]] = []
        self.parts: list[str] = []
        self.tags = 0

    def _end_line(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                _, element, marked = self.open[-1] if self.open else ("", 0, False)
                self.lines.append((text, self.tags, marked, element))
                self.tags = 0
            self.parts = []

    def _pop(self, at: int) -> None:
        while len(self.open) > at:
            tag = self.open.pop()[0]
            if tag in INLINE:
                self.inside[-1][tag] -= 1
            else:
                self.blocks[tag] -= 1
                self.inside.pop()

    def _push(self, tag: str, kind: str, marked: bool) -> None:
        around = self.open[-1][1] if self.open else 0
        if tag in INLINE:
            self.inside[-1][tag] += 1
            self.open.append((tag, around, marked))
        else:
            self.blocks[tag] += 1
            self.inside.append(Counter())
            self.kinds.append(kind)
            self.parent.append(around)
            self.open.append((tag, len(self.kinds) - 1, marked))

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self._end_line()
            return
        if tag not in INLINE:
            self._end_line()
            closed = CLOSES.get(tag, {"p"})
            at = len(self.open) - 1
            while at >= 0 and self.open[at][0] in INLINE:
                at -= 1
            if at >= 0 and self.open[at][0] in closed:
                self._pop(at)
        around = bool(self.open) and self.open[-1][2]
        marked = around or self._marks(tag, attrs)
        if marked and tag in INLINE and not around:
            self._end_line()
        self._push(tag, "main" if ("role", "main") in attrs else tag, marked)

    def _marks(self, tag: str, attrs: list) -> bool:
        if tag in NEVER:
            return True
        within = self.blocks["article"] > 0 or self.blocks["main"] > 0
        if tag == "header":
            return not within
        if tag in ("html", "body") or tag in ("article", "main") and not self.blocks["article"]:
            return False
        names = INNER_NAMES if within else OUTER_NAMES
        for k, v in attrs:
            v = v or ""
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v.lower() in ROLES or k == "style" and "display:none" in v.replace(" ", "").lower():
                return True
            if k in ("class", "id") and not (within and tag in HEADINGS) and names.search(v):
                return True
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in VOID:
            return
        if not (self.inside[-1][tag] if tag in INLINE else self.blocks[tag]):
            if tag == "p":
                self._end_line()
            return
        at = len(self.open) - 1
        while self.open[at][0] != tag:
            at -= 1
        if tag not in INLINE or self.open[at][2]:
            self._end_line()
        self._pop(at)

    def handle_data(self, data):
        if data and not (self.open and self.open[-1][0] in ("script", "style")):
            self.parts.append(data)

    def parse_marked_section(self, i, report=1):  # as in HTML, where such a section is a comment up to ">"
        return self.parse_bogus_comment(i, report)

    def read(self, html: str) -> None:
        """All of a page, in pieces that grow with what is still held back."""
        at, step, html = 0, FEED, settled(html)
        while at < len(html):
            self.feed(html[at : at + step])
            at, step = at + step, max(FEED, len(self.rawdata))
        self.close()
        self._end_line()


def settled(html: str) -> str:
    """html without a tag that it ends in; a comment that nothing closes becomes a declaration, which the next ">" closes."""
    if (tail := _TAG.search(html, html.rfind(">") + 1)) is not None:
        html = html[: tail.start()]
    at = html.rfind("-->") + 1
    return html[:at] + html[at:].replace("<!--", "<!") if "<!--" in html[at:] else html


_TAG = re.compile(r"<[a-zA-Z/!?]")


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel's weight on what there is."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    part = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[part] / np.convolve(np.ones(len(ratios)), kernel)[part]


def _region(page: _Lines) -> list[str]:
    lines, kinds, parent = page.lines, page.kinds, page.parent
    free = np.array([not x[2] for x in lines])
    of = np.array([x[3] for x in lines])
    size = np.array([len(x[0]) for x in lines], float)
    ratios = size / np.maximum(1, [x[1] for x in lines])
    curve = smooth(np.where(free, ratios, 0.0))
    bound = min(THRESHOLD * curve.std(), curve.max())
    seeds = free & (curve >= bound)
    if not seeds.any():
        return []
    n = len(kinds)
    last = list(range(n))
    for e in range(n - 1, 0, -1):
        last[parent[e]] = max(last[parent[e]], last[e])

    def inside(element: int) -> np.ndarray:
        return (of >= element) & (of <= last[element])

    def texts(wanted: np.ndarray) -> list[str]:
        return [lines[k][0] for k in np.flatnonzero(wanted & free).tolist()]

    def outermost(kind: str) -> np.ndarray:
        """Of each line the outermost element of a kind around it, or 0."""
        found = [0] * n
        for e in range(1, n):
            found[e] = found[parent[e]] or (e if kinds[e] == kind else 0)
        return np.array(found)[of]

    all_seeds = size[seeds].sum()
    article, main = outermost("article"), outermost("main")
    held = sorted(set(article[seeds].tolist()) - {0})
    by_parent: dict[int, list[int]] = {}
    for e in held:
        by_parent.setdefault(parent[e], []).append(e)
    mains = sorted(set(main[seeds].tolist()) - {0})
    for around, elements, share in [*((article, x, MOST) for x in by_parent.values()), (article, held, 0.5), (main, mains, 0.5)]:
        within = np.isin(around, elements) & (around > 0)
        if size[seeds & within].sum() > share * all_seeds:
            return texts(within)

    own = seeds & (article == 0)
    if not own.any():  # in articles that hold half of the seeds' text: no other line is one
        return texts(article > 0)
    weight, deeper, level = np.zeros(n), np.zeros(n), [0] * n
    np.add.at(weight, of[own], size[own])
    for e in range(n - 1, 0, -1):
        weight[parent[e]] += weight[e]
        deeper[parent[e]] += weight[e]
    for e in range(1, n):
        level[e] = level[parent[e]] + 1
    least = (MOST - 1e-9) * size[own].sum()
    chosen = max((e for e in range(1, n) if deeper[e] > 0 and weight[e] > least and kinds[e] not in PARTS), key=lambda e: (level[e], e), default=0)
    at = np.flatnonzero(own)
    wanted = at
    if chosen:
        # Marked lines don't part clusters, other lines do. Lines that are seeds by their neighbours alone don't widen the region.
        place = np.cumsum(free)[at]
        cluster = np.cumsum(np.diff(place, prepend=place[0]) > 1)
        here = inside(chosen)[at]
        reached = np.isin(cluster, cluster[here])
        beside = np.zeros(len(at), bool)
        if kinds[chosen] == "section":
            next_to = np.zeros(n, bool)
            for e in range(1, n):
                next_to[e] = next_to[parent[e]] or parent[e] == parent[chosen] and kinds[e] == "section"
            beside = next_to[of[at]]
        wanted = at[here | (ratios[at] >= bound) & (reached | beside)]
        e = chosen
        while e:
            if kinds[e] not in PARTS and e <= of[wanted].min() and of[wanted].max() <= last[e]:
                return texts(inside(e))
            e = parent[e]
    return [lines[k][0] for k in range(wanted[0], wanted[-1] + 1) if free[k]]


def main_text(html: str) -> str:
    if not html:
        return ""
    page = _Lines()
    page.read(html)
    return "\n\n".join(_region(page)) if page.lines else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, pages in row_slices(batch, "html", PIECE):
            texts = [main_text(x) for x in pages.to_pylist()]
            yield pa.record_batch({"page_id": rows.column("page_id"), "url": rows.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    prepare(pages.sparkSession)
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return read.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
