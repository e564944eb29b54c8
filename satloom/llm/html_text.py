"""Main text of web pages (operator 6).

The standard library's parser streams events; block elements end a line.  Every line has its text, the tags seen
in it and whether it stands in a marked element (article, main).  The logarithm of the text-to-tag ratio of the lines
is smoothed with a Gaussian; where a page marks an element, ``MARK`` is added to its lines and taken from all others; a
threshold on the sum clusters lines into content and the rest, on every page alike.  Elements that are never
content (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers) are
left out by name, role, class or id before that.

White space inside a block becomes one space, blocks are joined by a line feed.  A null or empty page,
and one without content, gives an empty text; broken or unclosed markup is read as browsers' parsers
read it for these purposes: an unclosed element ends with its parent or the page.  Repeated rows give
repeated results, lines of equal score are content together or not at all; a very long page is read whole in one
worker, an empty table gives no rows; a kept column named ``text`` or ``n_chars`` gives way to the one made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset(["td", "th"])
NEVER = frozenset("head title script style noscript template svg math canvas iframe object audio video nav header footer aside menu form button select option textarea input label dialog".split())
MARKED = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: A class or id of one of these words, or that has one of them as its first part, is never content ...
_words = "ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|banner|sidebar|side-bar|nav|navbar|navigation|menu|breadcrumbs?|masthead|cookies?|consent|gdpr|popup|modal|overlay|comments?|disqus|newsletter|pagination|pager|skip-link|toolbar"
#: ... and one of these only where the class or id is nothing else, or names a box, bar, list, block and the like of it.
_alone = "promo(?:tion)?|header|footer|notice|alert|replies|respond|share|sharing|social|related|recommended|subscribe|signup|login|widget"
_names = re.compile(
    rf"(?:^|[\s_-])(?:{_words})(?:$|[\s_-])|^(?:site-|page-)?(?:{_alone})(?:s|[_-](?:box|bar|list|links?|block|area|section|posts?|articles?|buttons?|icons?|content|widget|form|text))?$",
    re.I,
).search
#: Width of the smoothing, share of the page's best line that separates content, and what a mark adds.
SIGMA, THRESHOLD, MARK = 1.0, 0.4, 20.0


class Lines(HTMLParser):
    """Collects lines as (text, tags, inside a marked element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool]] = []
        self.text: list[str] = []
        self.tags = 0
        self.skip = ""
        self.depth = 0
        self.marked = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.marked > 0))
                self.tags = 0
            self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skip:
            if tag == self.skip:
                self.depth += 1
            elif tag in MARKED and self.skip in ("head", "nav", "header", "menu"):
                self.skip = ""  # was never closed
            if self.skip:
                return
        self.tags += 1
        if tag in BREAKS:
            self.flush()
        elif tag in CELLS:
            self.text.append(" ")
        if tag in NEVER or attrs and tag not in ("html", "body") and tag not in MARKED and self.outside(attrs):
            if tag not in VOID:
                self.skip, self.depth = tag, 1
        elif tag in MARKED:
            self.marked += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag in BREAKS or tag in CELLS:
            # <p/> opens an element as <p> does: the slash means nothing in HTML.
            self.handle_starttag(tag, attrs)

    @staticmethod
    def outside(attrs: list) -> bool:
        for k, v in attrs:
            if v and (k in ("class", "id") and _names(v) or k == "role" and v.lower() in ROLES) or k == "hidden" or k == "aria-hidden" and v == "true":
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip:
                self.depth -= 1
                if not self.depth:
                    self.skip = ""
            elif tag in ("body", "html") or tag in MARKED and self.marked:
                self.skip = ""
                self.handle_endtag(tag)
            return
        self.tags += 1
        if tag in BREAKS:
            self.flush()
        elif tag in CELLS:
            self.text.append(" ")
        if tag in MARKED and self.marked:
            self.marked -= 1

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends are those of the page."""
    r = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    sums = np.convolve(ratios, kernel)[r : r + len(ratios)]
    return sums / np.convolve(np.ones(len(ratios)), kernel)[r : r + len(ratios)]


def regions(lines: list[tuple[str, int, bool]]) -> list[str]:
    """Lines of the clusters whose score reaches the threshold."""
    if not lines:
        return []
    score = smoothed(np.log1p([len(t) / max(1, n) for t, n, _ in lines]))
    cut = THRESHOLD * score.max()
    marked = np.array([m for _, _, m in lines])
    if marked.any():
        score += np.where(marked, MARK, -MARK)
    return [lines[i][0] for i in np.flatnonzero(score >= cut)]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n".join(regions(parser.lines))


def extract(pages: DataFrame, keep: list[str], column: str = "html") -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, end in common.pieces(batch, column):
            texts = [main_text(x) for x in batch.column(column)[start:end].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k)[start:end] for k in keep], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    keep = [k for k in keep if k not in ("text", "n_chars")]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for k in keep for f in pages.schema if f.name == k)
    return common.arrow_map(pages.select(*keep, column), run, head + "text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6 over all pages."""
    return extract(common.table(spark, sf_dir, "pages"), ["page_id", "url"])


QUERIES = {"op6_html_text": op6_html_text}
SQL: dict[str, str] = {}
