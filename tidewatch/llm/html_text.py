"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams a page's events into lines, one for each
block of text.  A line knows its characters, its characters inside links, the
tags since the line before and its container.  Its ratio is
its characters outside links over its tags; lines inside page furniture (menus,
footers, forms, adverts, comments and the like, by tag, role or class name) have
ratio zero.  A class name is evidence only: an element that outweighs the text which
no name covers (four times over, or once if it holds an article or main) is a wrapper
such as "layout with-sidebar", and only names inside it count.  The ratios are smoothed with a Gaussian and split into two clusters;
lines of the upper one are content on every page, and the content region is every
container (the outermost article or main around, or else the smallest block
element) that holds them.  All lines of these regions outside furniture are
returned, so a short paragraph of a chosen article stays whatever its own ratio.
Neighbouring elements of one line each and of one parent and tag are one region.

Defined cases: null or empty html, and pages of furniture alone, give the empty
text; markup that is not closed ends with the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

_SKIP = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button".split())
_FURNITURE = frozenset("nav footer aside form menu dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_HOLDER = frozenset("article main section div td body".split())
_MAIN = frozenset(("article", "main"))
#: What a head may hold; any other element ends a head that is not closed.
_HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark furniture.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|sidebar|side-bar"
    r"|nav|navbar|navigation|menu|breadcrumbs?|footer|foot|masthead|topbar|share|sharing|social|related|recommend\w*|comments?|commentlist|replies|reply"
    r"|disqus|widget|toolbar|login|signup|search|pagination|pager|skip-link)(?:$|[\s_-])",
    re.I,
)
#: Of an article element itself, only these.
_REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|ads?|advert\w*|sponsor\w*|promo\w*)(?:$|[\s_-])", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Lines(HTMLParser):
    """Collects (text, link characters, tags, container number, is furniture, named element) in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, bool, int]] = []  # tag, in furniture, container, skipped, named
        self.out: list[tuple[str, int, int, int, bool, int]] = []
        self.holders: list[tuple[str, bool, int, int]] = [("body", False, 0, -1)]  # tag, inside article or main, region, parent
        self.named: list[list[int]] = []  # elements with a name of furniture: the named one around (-1: none), holds article or main
        self.parts: list[str] = []
        self.links = self.tags = self.depth_a = 0

    def _state(self) -> tuple[bool, int, bool, int]:
        return self.stack[-1][1:] if self.stack else (False, 0, False, -1)

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                furniture, holder, _, named = self._state()
                self.out.append((text, self.links, self.tags, holder, furniture, named))
                self.tags = 0
            self.parts, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in _HEAD:
            self._end_head()
        if tag in _BLOCK:
            self._end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        if tag == "p" or tag in _CLOSES:
            self._close_implied(tag)
        furniture, holder, skipped, named = self._state()
        if tag in _SKIP:
            skipped = True
        elif not furniture:
            furniture = tag in _FURNITURE or (tag == "header" and not self.holders[holder][1])
            if not furniture and attrs and tag not in ("html", "body"):
                marks = _REMARKS if tag in _MAIN else _NAMES
                called = False
                for name, value in attrs:
                    if value and name in ("class", "id") and marks.search(value):
                        called = True
                    elif value and name == "role" and value.lower() in _ROLES:
                        furniture = True
                    elif name == "hidden" or name == "aria-hidden" and value == "true":
                        furniture = True
                if called and tag in _MAIN:
                    furniture = True
                elif called:
                    self.named.append([named, 0])
                    named = len(self.named) - 1
            if tag in _MAIN and not furniture:
                at = named
                while at >= 0 and not self.named[at][1]:
                    self.named[at][1] = 1
                    at = self.named[at][0]
        if tag in _HOLDER:
            _, inside, region, _ = self.holders[holder]
            self.holders.append((tag, tag in _MAIN or inside, region if inside else len(self.holders), holder))
            holder = len(self.holders) - 1
        if tag == "a":
            self.depth_a += 1
        self.stack.append((tag, furniture, holder, skipped, named))

    def _end_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self.stack.pop()

    def _close_implied(self, tag: str) -> None:
        ends = _CLOSES.get(tag, {"p"})
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in ends:
                del self.stack[at:]
            elif self.stack[at][0] in _BLOCK:
                break

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in _BLOCK:
            self._end_line()
        if tag == "a" and self.depth_a:
            self.depth_a -= 1
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                del self.stack[at:]
                break
            if tag not in _BLOCK and self.stack[at][0] in _BLOCK:
                break  # an inline tag never closes a block

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        if self.stack and self.stack[-1][3]:
            return
        self.parts.append(data)
        if self.depth_a:
            self.links += len(data)


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the kernel is renormalised."""
    reach = min(max(1, round(3 * sigma)), 50)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(values.size), kernel)[reach : reach + values.size]
    return np.convolve(values, kernel)[reach : reach + values.size] / weight


def split_point(values: np.ndarray) -> float:
    """Threshold between two clusters: the mean of their means, until it stays (at most 50 rounds)."""
    at = float(values.mean())
    for _ in range(50):
        low, high = values[values < at], values[values >= at]
        if not low.size or not high.size:
            break
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at


def _covered(lines: list, named: list[list[int]]) -> list[bool]:
    """Which named elements are furniture, or lie in furniture, after their names are weighed against their text."""
    own = [0] * len(named)
    free = 0
    for text, links, _, _, furniture, at in lines:
        size = 0 if furniture else max(0, len(text) - links)
        if at < 0:
            free += size
        else:
            own[at] += size
    whole = list(own)
    for at in range(len(named) - 1, -1, -1):
        if named[at][0] >= 0:
            whole[named[at][0]] += whole[at]
    marked = [True] * len(named)
    for at in sorted(range(len(named)), key=lambda i: (-whole[i], i)):  # an element comes before those in it
        held = whole[at] if named[at][1] else own[at]
        if held and held * (1 if named[at][1] else 0.25) > free:
            marked[at] = False
            free += own[at]
    for at, (around, _) in enumerate(named):
        marked[at] = marked[at] or around >= 0 and marked[around]
    return marked


def _merged(lines: list, holders: list, region: list[int]) -> list[int]:
    """Regions with neighbours of one line each, of one parent and tag, as one; furniture between them is passed over."""
    count = [0] * len(holders)
    for line in lines:
        count[line[3]] += 1
    inner = {h[3] for h in holders}
    out, last, kind = list(region), None, None
    for i, (text, links, _, h, furniture, _) in enumerate(lines):
        if furniture:
            continue
        tag, inside, _, parent = holders[h]
        now = (parent, tag) if h and not inside and count[h] == 1 and h not in inner and len(text) > links else None
        if now and now == kind:
            out[i] = last
        last, kind = out[i], now
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    lines = parser.out
    if not lines:
        return ""
    if parser.named:
        marked = _covered(lines, parser.named)
        lines = [(*line[:4], line[4] or line[5] >= 0 and marked[line[5]], line[5]) for line in lines]
    ratios = np.array([0.0 if f else max(0, len(t) - k) / max(tags, 1) for t, k, tags, _, f, _ in lines])
    if not ratios.any():
        return ""
    smoothed = smooth(ratios)
    content = (smoothed >= split_point(smoothed)) & (ratios > 0)
    if not content.any():
        content = ratios == ratios.max()
    region = _merged(lines, parser.holders, [parser.holders[h][2] for _, _, _, h, _, _ in lines])
    chosen = {r for r, c in zip(region, content) if c}
    return "\n".join(t for (t, _, _, _, f, _), r in zip(lines, region) if r in chosen and not f)


def extract(df: DataFrame, html_col: str = "html", key_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The key columns, text and n_chars (its code points) of every row."""
    names = [*key_cols, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts(batches, 64):
            found = [main_text(h) for h in b.column(len(key_cols)).to_pylist()]
            keys = [b.column(i) for i in range(len(key_cols))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names)

    rows = df.select(*key_cols, F.col(html_col).alias("html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "text string", "n_chars long"])
    return rows.mapInArrow(run, schema)
