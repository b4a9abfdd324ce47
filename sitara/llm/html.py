"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Every block is a line
with its text, its number of tags, the share of its text in links and the
containers it lies in. A line's ratio is its characters outside links per
tag, less where class names speak against it; ratios are smoothed by a
Gaussian over neighbouring lines and parted in two clusters by a threshold.

The content region is found from the upper cluster on every page: articles
(or a main element) if they hold most of it, else the smallest container that
no clustered line and no paragraph or heading lies beside. Inside the region
all lines stay, short ones too, but those that are no paragraph or heading,
whose own ratio lies in the lower cluster, and that links or class names
speak against. Navigation, page headers, footers, asides, forms and hidden
elements never are content. A container that class names mark as an advert, a
comment list or the like is none either, unless it holds nearly all of the
clustered text of a page without an article.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitara.llm.common import bounded_batches, pick_columns

SIGMA = 1.0
#: Articles are the region if they hold so much of the clustered text; a marked container of nearly all loses its mark.
HOLDS = 0.5
NEARLY = 0.8
#: A line of a low ratio that is no prose goes if so much speaks against it: the share of its text in links, and WEAK for a doubtful class name.
AGAINST = 0.8
WEAK = 0.5

#: Elements whose text is no content.
_HIDDEN = frozenset("script style noscript template iframe object svg canvas math head title select option textarea button datalist dialog audio video map".split())
_FURNITURE = frozenset("nav footer aside form menu fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog".split())
#: A class or id is a boilerplate's if one of these is its first or its last part, between hyphens, underscores and case changes ...
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager footer masthead topbar sidebar sidebars widget widgets aside "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist disqus replies respond sharing".split()
)
#: ... and doubtful if it is one of these.
_DOUBTS = frozenset("header side rail notice notices notification alert reply discussion share social related recommended recommendations more trending tags toolbar links".split())
#: Parts of names that speak for content or layout, and so against a mark.
_PLAIN = frozenset("article articles body content contents main text story entry post page wrapper wrap layout container has with without no grid row col column columns section price".split())
_UNSHOWN = re.compile(r"(?i)\b(display\s*:\s*none|visibility\s*:\s*hidden)\b")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that begin and end a line.
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("html body main article section div table tbody tr td center blockquote figure details".split())
_PROSE = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre")
_STRONG = frozenset(("article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes when it is still open, as browsers do.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES |= dict.fromkeys(_BLOCKS - {"br"} - set(_CLOSES), {"p"})


@dataclass
class _Element:
    tag: str
    bad: bool
    hidden: bool
    box: int
    mark: int  # the box whose class name marks it as boilerplate, or 0
    doubt: bool
    link: bool


@dataclass
class _Line:
    text: str
    tags: int
    linked: int  # characters in links
    bad: bool
    box: int
    mark: int
    doubt: bool
    prose: bool  # in a paragraph, heading or the like
    score: float = 0.0

    @property
    def ratio(self) -> float:
        plain = max(0, len(self.text) - self.linked)
        return 0.0 if self.bad else plain / self.tags * (WEAK if self.doubt else 1.0)

    @property
    def against(self) -> float:
        return min(1.0, self.linked / len(self.text)) + (WEAK if self.doubt else 0.0)


@dataclass
class _Box:
    tag: str
    parent: int
    children: list[int] = field(default_factory=list)
    held: float = 0.0
    prose: int = 0


class PageLines(HTMLParser):
    """Streams a page into lines and a tree of containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Element] = [_Element("", False, False, 0, 0, False, False)]
        self.open: Counter[str] = Counter()
        self.boxes = [_Box("", -1)]
        self.lines: list[_Line] = []
        self._text: list[str] = []
        self._tags = self._linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            top = self.stack[-1]
            self.lines.append(_Line(text, max(1, self._tags), self._linked, top.bad, top.box, top.mark, top.doubt, any(self.open[t] for t in _PROSE)))
            self._tags = 0
        self._linked = 0
        self._text.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self.flush()
        self._tags += 1
        if tag in _VOID:
            return
        if tag in _CLOSES and len(self.stack) > 1:
            self._close_implied(_CLOSES[tag])
        top = self.stack[-1]
        if tag in _STRONG and top.bad and not top.hidden:
            self._leave_unclosed()
            top = self.stack[-1]
        mark, doubt, gone = _signs(attrs) if attrs and tag not in ("html", "body") else (False, False, False)
        hidden = top.hidden or tag in _HIDDEN or gone
        # The header of an article holds its headline; that of a page does not.
        bad = top.bad or hidden or tag in _FURNITURE or (tag == "header" and not any(self.open[t] for t in _STRONG)) or _has_role(attrs)
        if bad != top.bad and not hidden:
            self.flush()
        box, marked = top.box, top.mark
        if (tag in _CONTAINERS or mark) and not hidden:
            self.boxes.append(_Box(tag, box))
            box = len(self.boxes) - 1
            self.boxes[top.box].children.append(box)
            if mark:
                self.flush()  # a marked element that is no block parts the line it stands in
                marked = marked or box
        if tag in _STRONG:
            marked = 0
        self.stack.append(_Element(tag, bad, hidden, box, marked, top.doubt or doubt, top.link or tag == "a"))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.flush()
        self._tags += 1
        if not self.open[tag]:  # closes nothing
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                top, below = self.stack[-1], self.stack[i - 1]
                if (top.bad, top.mark) != (below.bad, below.mark) and not top.hidden:
                    self.flush()
                self._cut(i)
                return
            if self.stack[i].tag in _STRONG and tag not in ("body", "html", "main", "article"):
                return

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if not top.hidden:
            self._text.append(data)
            if top.link:
                self._linked += len(data.strip())

    def _cut(self, i: int) -> None:
        for e in self.stack[i:]:
            self.open[e.tag] -= 1
        del self.stack[i:]

    def _close_implied(self, tags: set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self._cut(i)
                return
            if self.stack[i].tag in _BLOCKS:
                return

    def _leave_unclosed(self) -> None:
        """An article that starts inside navigation or a page header: those were never closed."""
        for i in range(1, len(self.stack)):
            if self.stack[i].bad:
                if self.stack[i].tag in ("nav", "header", "menu"):
                    self._cut(i)
                return


def _name_signs(value: str) -> tuple[bool, bool]:
    """(marked, doubtful) by the names of a class or id."""
    mark = doubt = False
    for name in value.split():
        parts = [w.lower() for w in _WORD.findall(name)]
        if parts and not _PLAIN.intersection(parts):
            mark |= parts[0] in _MARKS or parts[-1] in _MARKS
            doubt |= parts[0] in _DOUBTS or parts[-1] in _DOUBTS
    return mark, doubt


def _signs(attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool]:
    """(marked, doubtful, hidden) by an element's attributes."""
    mark = doubt = hidden = False
    for name, value in attrs:
        if name in ("class", "id") and value:
            m, d = _name_signs(value)
            mark, doubt = mark or m, doubt or d
        elif name == "hidden":
            hidden |= (value or "").strip().lower() != "until-found"
        elif name == "aria-hidden":
            hidden |= (value or "").strip().lower() == "true"
        elif name == "style" and value:
            hidden |= bool(_UNSHOWN.search(value))
    return mark, doubt, hidden


def _has_role(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "role" and (value or "").strip().lower() in _ROLES for name, value in attrs)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over three deviations; at the ends the kernel is cut and weighed anew."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-((k / sigma) ** 2) / 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        ks = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(k * v for k, v in zip(ks, values[lo:hi], strict=True)) / sum(ks))
    return out


def threshold(values: list[float]) -> float:
    """The border of two clusters: moved to the middle of the means on either side until it rests."""
    if not values:
        return 0.0
    t = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < t], [v for v in values if v >= t]
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2 if low and high else t
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def main_text(html: str) -> str:
    """The main text of a page, blocks joined by one space; empty if there is none."""
    page = PageLines()
    page.feed(html)
    page.close()
    page.flush()
    lines, boxes = page.lines, page.boxes
    for x, s in zip(lines, smooth([x.ratio for x in lines]), strict=True):
        x.score = s
    cut = threshold([x.score for x in lines])
    good = _unmarked([x for x in lines if not x.bad], boxes, cut)
    if not good:
        return ""
    _hold(boxes, [x for x in good if x.score >= cut])
    for x in good:
        boxes[x.box].prose += x.prose and x.against < AGAINST
    for i in range(len(boxes) - 1, 0, -1):
        boxes[boxes[i].parent].prose += boxes[i].prose
    inside = _region(boxes)
    return " ".join(x.text for x in good if x.box in inside and (x.prose or x.against < AGAINST or x.ratio >= cut))


def _in_strong(boxes: list[_Box], at: int) -> bool:
    while at > 0 and boxes[at].tag not in _STRONG:
        at = boxes[at].parent
    return at > 0


def _hold(boxes: list[_Box], lines: list[_Line]) -> None:
    """The text of lines in the containers that they lie in."""
    for b in boxes:
        b.held = 0.0
    for x in lines:
        boxes[x.box].held += len(x.text)
    for i in range(len(boxes) - 1, 0, -1):  # children come after their parents
        boxes[boxes[i].parent].held += boxes[i].held


def _unmarked(lines: list[_Line], boxes: list[_Box], cut: float) -> list[_Line]:
    """Lines outside marked containers; where no article or main element holds text, also those in a container of nearly all clustered text."""
    if not any(x.mark for x in lines):
        return lines
    if any(not x.mark and _in_strong(boxes, x.box) for x in lines):
        return [x for x in lines if not x.mark]
    _hold(boxes, [x for x in lines if x.score >= cut])
    total = boxes[0].held
    return [x for x in lines if not x.mark or (total > 0 and boxes[x.mark].held >= NEARLY * total)]


def _region(boxes: list[_Box]) -> set[int]:
    """Containers of the content region."""
    total, tops = boxes[0].held, []
    for i, b in enumerate(boxes):
        if b.tag in _STRONG:
            at = b.parent
            while at >= 0 and boxes[at].tag not in _STRONG:
                at = boxes[at].parent
            if at < 0:
                tops.append(i)
    if tops and sum(boxes[t].held for t in tops) >= HOLDS * total:
        return _below(boxes, tops)
    at = 0
    while True:  # into the one child that holds all clustered text and all prose
        best = max(boxes[at].children, key=lambda c: boxes[c].held, default=None)
        if best is None or total == 0 or boxes[best].held < boxes[at].held or boxes[best].prose < boxes[at].prose:
            break
        at = best
    return _below(boxes, [at])


def _below(boxes: list[_Box], roots: list[int]) -> set[int]:
    out, todo = set(), list(roots)
    while todo:
        at = todo.pop()
        if at not in out:
            out.add(at)
            todo.extend(boxes[at].children)
    return out


@F.arrow_udf(T.StringType())
def extract(html: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py() or "") for x in html], pa.string())


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    Null or empty html, and pages without content, give the empty text. Null
    ids and urls stay; repeated rows are extracted each; other columns are
    ignored.
    """
    pick_columns(pages, "page_id", "url", "html")
    out = bounded_batches(pages).select("page_id", "url", extract("html").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
