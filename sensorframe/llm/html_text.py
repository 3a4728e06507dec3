"""Main text of web pages.

The standard library's parser streams a page as events. Every block element ends a line; a line has its text and its number
of tags. Lines in menus, headers, footers, sidebars, notices, adverts, forms and comments have no content by markup
and count as empty. The ratio of text to tags per line is smoothed with a Gaussian, and lines above a threshold
from the page's own spread form clusters of content. A cluster brings in the other lines of its region (its article or main
element, else its nearest container), so short lines between long ones stay. On a page without article and main, lines
between the clusters stay as well if they lie in the innermost container that holds all clusters.

Class, id and role hint at what is beside the article. A hint is withdrawn from an element as soon as an article or main opens
in it, unless it marks reader comments; it does not apply to states ("no-sidebar", "has-comments"), nor inside an
article to the id of a heading or paragraph or to a part of any other id.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that end a line.
BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd div section article main blockquote pre table caption tr thead tbody tfoot figure "
    "figcaption address hr body html nav header footer aside form fieldset details summary dialog".split()
)
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas select option button textarea".split())
#: Elements beside the article.
ASIDE = frozenset("nav footer aside form menu dialog".split())
#: Words of class, id and role that mark parts beside the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification "
    "alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead topbar toolbar comment comments discussion disqus reply replies related recommended share sharing social widget pagination "
    "pager search complementary contentinfo dialog skip".split()
)
#: Hints that hold articles of their own, which are no articles of the page.
COMMENTS = frozenset("comment comments discussion disqus reply replies".split())
#: Words that make a name the state of a page or article.
STATES = frozenset("no not has with without is open closed enabled disabled".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening block element ends when they were left open.
OPEN_ENDED = frozenset("p li dt dd tr td th option".split())
CLOSES_P = BLOCKS - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption"}
REGIONS = frozenset("article main".split())
CONTAINERS = frozenset("body section div td".split())
SPLIT_NAMES = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")
KERNEL = np.exp(-0.5 * np.arange(-3, 4) ** 2.0)
KERNEL /= KERNEL.sum()


def _hints(tag: str, attrs: list, inside: bool) -> frozenset:
    """The hint words of an element's class, id and role."""
    found = set()
    for kind, value in attrs:
        if kind not in ("class", "id", "role") or not value or inside and kind == "id" and tag in TEXTUAL:
            continue
        for name in value.lower().split():
            words = {name} if inside and kind == "id" else set(SPLIT_NAMES.split(name))
            if STATES.isdisjoint(words):
                found |= HINTS & words
    return frozenset(found)


class _Lines(HTMLParser):
    """Lines of a page: text, tags, whether markup sets it aside, and the region it is in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # name, aside by its tag, aside by hints (2: of comments), region, in an article, innermost container
        self.open: list[tuple[str, bool, int, int, bool, int]] = [("", False, 0, 0, False, 0)]
        self.lines: list[tuple[str, int, bool, int, int]] = []
        # Regions are numbered as they open: one holds the numbers from its own to its last.
        self.parent, self.last = [0], {0: 0}
        self.text: list[str] = []
        self.tags = 0
        self.silent: str | None = None
        self.depth = 0
        self.regions = self.articles = 0

    def _end_line(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                _, aside, hinted, region, _, within = self.open[-1]
                self.lines.append((text, self.tags, aside or hinted > 0, region, within))
                self.tags = 0
            self.text = []

    def _leave(self, at: int) -> None:
        for element in self.open[at:]:
            self.last[element[5]] = self.regions
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.silent:
            self.depth += tag == self.silent
            if tag not in ("body", "article", "main"):  # a head that was never closed ends here
                return
            self.silent = None
        if tag in SILENT:
            self.silent, self.depth = tag, 1
            return
        if tag in VOID or tag not in BLOCKS and tag not in ("td", "th"):
            if tag in ("br", "hr", "img", "input"):
                self.text.append(" ")
            if tag == "hr":
                self._end_line()
            return
        if tag in ("td", "th"):
            self.text.append(" ")
        else:
            self._end_line()
        if tag in CLOSES_P:
            for at in range(len(self.open) - 1, 0, -1):
                name = self.open[at][0]
                if name == "p" or name == tag == "li" or name in ("dt", "dd") and tag in ("dt", "dd"):
                    self._leave(at)
                    break
                if name not in OPEN_ENDED:
                    break
        if tag in REGIONS:  # menus and the like hold no article: one left open ends here
            for at in range(1, len(self.open)):
                if self.open[at][0] in ("nav", "header", "menu"):
                    self._leave(at)
                    break
        _, aside, hinted, region, inside, within = self.open[-1]
        if tag in REGIONS:
            # An article inside an article, as reader comments are marked up, is no region of its own.
            if not inside:
                if hinted == 1:  # what holds the article is not beside it
                    self.open = [(n, a, h if h == 2 else 0, r, i, w) for n, a, h, r, i, w in self.open]
                    hinted = 0
                self.regions += 1
                self.articles += 1
                self.parent.append(within)
                region, inside = self.regions, True
        elif not inside and tag in CONTAINERS:
            self.regions += 1
            self.parent.append(within)
            region = within = self.regions
        if tag not in ("html", "body", "main"):
            aside = aside or tag in ASIDE or tag == "header" and not inside
            if hints := _hints(tag, attrs, inside):
                hinted = max(hinted, 1 if COMMENTS.isdisjoint(hints) else 2)
        self.open.append((tag, aside, hinted, region, inside, within))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if self.silent:
            if tag == self.silent:
                self.depth -= 1
                if self.depth <= 0:
                    self.silent = None
            return
        if tag not in BLOCKS and tag not in ("td", "th"):
            return
        if tag in ("td", "th"):
            self.text.append(" ")
        else:
            self._end_line()
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] == tag:
                self._leave(at)
                break

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def main_text(html: str) -> str:
    """The page's content lines, joined by two line feeds; empty if there are none."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    lines = parser.lines
    if not lines:
        return ""
    ratio = np.array([0.0 if aside else len(text) / max(tags, 1) for text, tags, aside, _, _ in lines])
    smooth = np.convolve(np.pad(ratio, 3), KERNEL, mode="valid")
    threshold = min(smooth.std(), smooth.mean()) * 0.5
    seeds = [i for i, (line, r, s) in enumerate(zip(lines, ratio, smooth)) if not line[2] and s > threshold and r > threshold]
    regions = {lines[i][3] for i in seeds}
    around, first, last = 0, 0, -1
    if len(regions) > 1 and not parser.articles:
        parser._leave(0)
        around, furthest = (f(lines[i][4] for i in seeds) for f in (min, max))
        while around and parser.last[around] < furthest:
            around = parser.parent[around]
        first, last = seeds[0], seeds[-1]
    return "\n\n".join(
        text for i, (text, _, aside, region, within) in enumerate(lines) if not aside and (region in regions or first < i < last and around <= within <= parser.last[around])
    )


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text of every row. Null and empty pages, and pages without content, have the empty text.

    Rows are read one by one, so repeated rows get equal results and page_id may be null. White space inside a line becomes
    one space; nothing is cut off. Other columns of ``pages`` are ignored.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                text = [main_text(h.as_py() or "") for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
