"""Main-text extraction from web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one for each block of text between block-level tags.
A line's ratio is its text outside links over its tags (at least one). The ratios are smoothed with a Gaussian, and the
logarithms of the smoothed ratios split into two clusters; lines of the high cluster are seeds. Seeds select regions: in
an article (or main) element the lines from its first heading or seed to its last seed, without one those in the lowest
container of all seeds; and a region grows over neighbouring lines that are text rather than links.

Elements that can be no content (menus, asides, scripts, ...) have the ratio 0. Names of classes of boxes, and forms, are hints
only: what they mark has the ratio 0 too, unless it holds most of the text of all seeds, when the hint is misleading.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrid.functions.markup import Markup
from citegrid.llm.common import Shield

#: HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("script style noscript template head title svg math iframe object embed canvas audio video map select option optgroup datalist textarea button input nav aside footer dialog menu noframes applet".split())
CONTAINERS = frozenset("article main".split())
SECTIONS = frozenset("section div td body table".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
HINTED = frozenset("div section aside ul ol dl table form fieldset legend figure header footer nav details article".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id values that hint at what is not the article; readers' comments apart.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|pop-up|modal|overlay|newsletter|subscri\w*|signup|sign-up|login|paywall|"
    r"sidebar|side-bar|widget\w*|rail|related\w*|recommend\w*|trending|popular|breadcrumbs?|crumbs?|menu\w*|nav|navbar|navigation|topbar|toolbar|masthead|site-header|page-header|site-footer|page-footer|"
    r"footer|copyright|legal|disclaimer|social|share|sharing|sharebar|tags?|pagination|pager|skip-link|hidden|sr-only|visually-hidden|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
_TALK = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|comment-\w+|replies|reply|respond|disqus|discussion)(?=$|[\s_-])", re.I)
_TALK_HEADING = re.compile(r"(?:\d+\s+)?(?:readers?'?\s+)?(?:comments?|replies|responses)(?:\s*\(\d+\))?\s*:?|leave a (?:reply|comment)\.?", re.I)
_BARS = re.compile(r"[|·•»›/]")
_HEADER = re.compile(r"(?:^|\s)(?:header|top)(?=$|\s)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
SIGMA = 1.0
#: A hint is misleading if what it marks holds more than this share of the text of all seeds.
MISLEADING = 0.5


class Line(NamedTuple):
    text: str
    own: int  # characters outside links
    tags: int
    box: int
    never: bool  # in an element that can be no content
    mark: int  # the innermost hint, 0 for none
    heading: bool

    @property
    def is_text(self) -> bool:
        return 2 * self.own >= len(self.text)


class Open(NamedTuple):
    name: str
    never: bool
    box: int  # what was the box, and the mark, around the element
    mark: int


class _Lines(Markup):
    """Collects lines. Every tag costs constant time, however many elements are open: of each name, and of the elements
    that are no inline ones, the places in the stack are at hand."""

    def __init__(self):
        super().__init__()
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # of elements that are not inline
        self.walls: list[int] = []  # of those that an inline end tag does not close
        self.never = self.links = self.box = self.mark = self.in_article = 0
        self.boxes: list[tuple[int, str, str]] = [(-1, "", "")]  # parent, name, class
        self.box_end = [0]  # the last box inside each
        self.articles: set[int] = set()
        self.marks: list[tuple[int, bool]] = [(0, False)]  # parent, whether it marks readers' comments
        self.parts: list[str] = []
        self.linked = self.tags = 0
        self.lines: list[Line] = []

    def end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                heading = bool(self.blocks) and self.open[self.blocks[-1]].name in HEADINGS
                self.lines.append(Line(text, max(0, len(text) - self.linked), self.tags, self.box, self.never > 0, self.mark, heading))
            self.parts, self.linked, self.tags = [], 0, 0
        # tags without text count for the next line

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
            if tag in CLOSES_P:
                self.close_implied(frozenset(["p"]))
            elif tag in CLOSES:
                self.close_implied(CLOSES[tag])
        elif tag == "br" and self.parts:
            self.parts.append(" ")
        if tag in VOID:
            return
        never = tag in NEVER or self.hidden(attrs) or (tag == "header" and not self.in_article)
        hint = None if never else self.hint(tag, attrs)
        at = len(self.open)
        self.open.append(Open(tag, never, self.box, self.mark))
        self.places.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
            if tag not in ("p", "li"):
                self.walls.append(at)
        self.never += never
        self.links += tag == "a"
        if hint is not None:
            self.marks.append((self.mark, hint))
            self.mark = len(self.marks) - 1
        self.in_article += tag in CONTAINERS
        if tag in CONTAINERS or (tag in SECTIONS and not self.in_article):
            self.boxes.append((self.box, tag, next((v or "" for n, v in attrs if n == "class"), "")))
            self.box = len(self.boxes) - 1
            self.box_end.append(self.box)
            if tag in CONTAINERS:
                self.articles.add(self.box)

    @staticmethod
    def hidden(attrs: list[tuple[str, str | None]]) -> bool:
        return any(n == "hidden" or (n == "aria-hidden" and v == "true") or (n == "role" and (v or "").lower() in ROLES) or (n == "style" and _HIDDEN.search(v or "")) for n, v in attrs)

    def hint(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool | None:
        """None, or whether the element's hint is one of readers' comments."""
        found = False if tag in ("form", "fieldset", "legend") else None
        if tag not in HINTED:  # a name never takes out a paragraph or a heading, only boxes around them
            return None
        if tag in ("body", "html", "main") or (tag == "article" and not self.in_article):
            return found
        for name, value in attrs:
            if name in ("class", "id") and value:
                if _TALK.search(value):
                    return True
                if _MARKS.search(value) or (not self.in_article and _HEADER.search(value)):
                    found = False
        return found

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def close_implied(self, names: frozenset[str]) -> None:
        """Close an open element of these names if only inline elements are open inside it."""
        if self.blocks and self.open[self.blocks[-1]].name in names:
            self.pop_to(self.blocks[-1])

    def pop_to(self, k: int) -> None:
        while len(self.open) > k:
            tag, never, box, self.mark = self.open.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
                if tag not in ("p", "li"):
                    self.walls.pop()
            if box != self.box:
                self.box_end[self.box] = len(self.boxes) - 1
            self.box = box
            self.never -= never
            self.links -= tag == "a"
            self.in_article -= tag in CONTAINERS

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        places = self.places.get(tag)
        if places and not (tag in INLINE and self.walls and self.walls[-1] > places[-1]):
            self.pop_to(places[-1])

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def finish(self, html: str | None) -> None:
        self.read(html)
        self.end_line()
        self.pop_to(0)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian of three sigmas each way, its weights made to sum to one at the ends too."""
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    full = slice(reach, reach + len(ratios))
    return np.convolve(ratios, weights)[full] / np.convolve(np.ones(len(ratios)), weights)[full]


def cluster_threshold(values: np.ndarray) -> float:
    """Where two clusters of the values part (2-means in one dimension, started at the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        cut = (low + high) / 2
        upper = values > cut
        if upper.all() or not upper.any():
            return cut
        a, b = float(values[~upper].mean()), float(values[upper].mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2


def seeds_of(lines: list[Line], out: np.ndarray) -> np.ndarray:
    """Lines of text whose smoothed ratio is in the high cluster; ``out`` are those whose ratio counts as 0."""
    ratios = np.array([x.own / max(1, x.tags) for x in lines]) * ~out
    if not ratios.any():
        return np.zeros(len(lines), bool)
    scores = np.log1p(smooth(ratios))
    can = (ratios > 0) & np.array([x.is_text for x in lines])
    if not can.any():
        return can
    return can & (scores >= min(cluster_threshold(scores[can]), scores[can].max()))


def misled(lines: list[Line], never: np.ndarray, marks: list[tuple[int, bool]]) -> np.ndarray:
    """For each line whether a hint takes it out. One that marks most of the seeds' text does not hold; nor does one of
    readers' comments that marks all of it."""
    weights = np.array([x.own for x in lines]) * seeds_of(lines, never)
    inside = np.bincount([x.mark for x in lines], weights=weights, minlength=len(marks))
    for m in range(len(marks) - 1, 0, -1):  # an inner hint comes after the one around it
        inside[marks[m][0]] += inside[m]
    takes = np.zeros(len(marks), bool)
    for m in range(1, len(marks)):
        parent, talk = marks[m]
        takes[m] = takes[parent] or not (inside[m] == inside[0] > 0 if talk else inside[m] > MISLEADING * inside[0])
    return takes[[x.mark for x in lines]]


def _grown(lines: list[Line], group: np.ndarray, seeds: np.ndarray, joins) -> list[int]:
    """The lines of a group from its first to its last seed, and on either side of these as long as joins(line)."""
    at = np.flatnonzero(seeds[group])
    low, high = int(at[0]), int(at[-1])
    while low and joins(lines[group[low - 1]]):
        low -= 1
    while high + 1 < len(group) and joins(lines[group[high + 1]]):
        high += 1
    return [int(i) for i in group[low : high + 1]]


def _article(lines: list[Line], group: np.ndarray, seeds: np.ndarray) -> list[int]:
    """The lines of an article: from its first heading, if that comes before the seeds, to its last text, lists of links
    under a heading included, but not what stands behind a heading of readers' comments."""
    talk = next((k for k, i in enumerate(group) if lines[i].heading and _TALK_HEADING.fullmatch(lines[i].text)), len(group))
    if seeds[group[:talk]].any():
        group = group[:talk]
    kept = _grown(lines, group, seeds, lambda x: x.is_text or (x.own >= 4 and not _BARS.search(x.text)))
    first = next((k for k, i in enumerate(group) if lines[i].heading), len(group))
    low, high = min(first, int(np.searchsorted(group, kept[0]))), int(np.searchsorted(group, kept[-1]))
    while high + 1 < len(group) and lines[group[high]].heading:  # a list of links under the last heading, and what follows
        while high + 1 < len(group) and not lines[group[high + 1]].is_text:
            high += 1
        while high + 1 < len(group) and lines[group[high + 1]].is_text:
            high += 1
    return [int(i) for i in group[low : high + 1]]


def main_blocks(html: str | None) -> list[str]:
    """The blocks of the page's main text, in page order."""
    parser = _Lines()
    parser.finish(html)
    lines = parser.lines
    if not lines:
        return []
    never = np.array([x.never for x in lines])
    out = never | misled(lines, never, parser.marks)
    seeds = seeds_of(lines, out)
    if not seeds.any():
        return []
    box = np.array([x.box for x in lines])
    of_seeds = set(box[seeds].tolist())
    like = {parser.boxes[b] for b in of_seeds}  # boxes with a seed, and others of their parent, name and class
    kept: list[int] = []
    if articles := of_seeds & parser.articles:  # seeds in an article outweigh text that stands around it
        for b in sorted(articles):
            kept += _article(lines, np.flatnonzero(~out & (box == b)), seeds)
        kept += [i for i, x in enumerate(lines) if not out[i] and x.box not in of_seeds and x.box in parser.articles and x.is_text and parser.boxes[x.box] in like]
    else:
        top, last = min(of_seeds), max(of_seeds)  # boxes are numbered as they open, so this is the lowest one around all seeds
        while parser.box_end[top] < last:
            top = parser.boxes[top][0]
        group = np.flatnonzero(~out & (box >= top) & (box <= parser.box_end[top]))
        region = _grown(lines, group, seeds, lambda x: x.is_text and (x.heading or x.box in of_seeds or parser.boxes[x.box] in like))
        kept = [i for i in region if lines[i].is_text or lines[i].box in of_seeds]
    return [lines[i].text for i in sorted(kept)]


@F.pandas_udf(T.StringType())
def main_text(html: pd.Series) -> pd.Series:
    """Blocks of the main text, joined by two newlines; empty for null, empty and text-free pages."""
    return pd.Series(["\n\n".join(main_blocks(h)) for h in html], dtype=object)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text in ``out`` (replaced if there). Pages are independent: no shuffle.

    Null and empty pages, and those without text, give an empty text; an empty table gives no rows; equal rows give equal
    rows; other columns, whatever their names, pass through. Broken markup is read as far as the parser goes, without an
    error. Time is linear in the length of a page, and so is memory, a small multiple of it.
    """
    shield = Shield(pages)
    return shield.restored(shield.df, **{out: main_text(F.col(shield(html)))})


def op2(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
