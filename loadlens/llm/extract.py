"""Main text of web pages by text-to-tag ratios of parser events.

The standard library's parser streams its events once. Block tags and line breaks
end a line; each line has its text, the number of tags met in it, and how much of
the text is inside links. A line's ratio is its text outside of links over its tags.
The ratios are smoothed with a Gaussian and cut at a threshold; runs of lines above
it are regions of content, which neither begin nor end with a line that the smoothing
alone has lifted. Short lines within a region are carried along by the smoothing.

Markup sets how high the threshold is. Lines within menus, footers, asides, forms,
scripts, styles, headers outside an article, and within elements whose class, id or
role names an advert, notice, sidebar, menu or comments have no ratio and are never
content. On a page without an article the threshold is a share of the page's mean
ratio. Within a marked article it is ``PROSE`` characters a tag, which a heading or a
paragraph of a few letters meets: nothing of the prose is lost, while runs of links
fall below it, and a single linked line amid paragraphs stays. Within an article,
class names that may also name a part of the text (``share``, ``header``) raise the
threshold to that of the page: a row of buttons goes, a paragraph stays. A page with
several articles keeps those with a line above the page's threshold, or all if none
has one; an article of nothing but links stays whole. Lines outside are not kept.
A linked heading counts as text.

A class or id is compared word by word, cut at spaces, hyphens and underscores; the
first or the last part of a compound has to match, and compounds that begin with a
negation or a state (``no-sidebar``, ``has-ads``) name nothing.

Null, empty and tag-only html gives an empty text. Unclosed tags are closed where the
page ends. Rows are extracted one by one; repeated rows and null ids stay. An empty
table gives an empty one. Extra columns are ignored.
"""

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
# A line is content from this share of the page's mean ratio on.
THRESHOLD = 0.5
# And a region's first and last line have at least this share themselves.
EDGE = 0.1
# Within an article a line is content from this many unlinked characters a tag on.
PROSE = 0.25

BLOCKS = frozenset(
    "address article aside blockquote body br center caption dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol "
    "option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
DROPPED = frozenset(
    "aside button canvas dialog fieldset footer form head iframe input label menu nav noscript "
    "object script select style svg template textarea title video audio".split()
)
CONTENT = frozenset(("article", "main"))
# Fixed words of class names and ids.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos "
    "promotion sidebar menu nav navigation navbar breadcrumb breadcrumbs masthead footer cookie cookies "
    "notice notices consent gdpr popup modal newsletter subscribe comment comments disqus replies "
    "respond related".split()
)
# Within an article these may name a part of its text.
_VAGUE = frozenset("header side alert share sharing social widget".split())
_NEGATED = frozenset("no not without non has have with hide is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"))
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[-_]+")

# What markup says of a line.
FREE, DOUBTED, EXCLUDED = 0, 1, 2


class Line(NamedTuple):
    text: str
    ratio: float  # characters outside of links over tags
    verdict: int
    article: int  # from 1; 0 is outside


def named(value: str) -> int:
    """What the words of a class or an id say of their element."""
    found = FREE
    for word in value.lower().split():
        parts = [part for part in _PARTS.split(word) if part]
        if not parts or (len(parts) > 1 and parts[0] in _NEGATED):
            continue
        ends = {parts[0], parts[-1]}
        if ends & _NAMES:
            return EXCLUDED
        if ends & _VAGUE:
            found = DOUBTED
    return found


class LineParser(HTMLParser):
    """The lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, int]] = []  # tag, verdict from here on, article
        self.articles = 0
        self.links = self.headings = 0
        self.text: list[str] = []
        self.linked = 0
        self.tags = 0

    @property
    def state(self) -> tuple[int, int]:
        return self.open[-1][1:] if self.open else (FREE, 0)

    def end_line(self) -> None:
        line = _SPACE.sub(" ", "".join(self.text)).strip()
        if line:
            ratio = max(0, len(line) - self.linked) / max(1, self.tags)
            self.lines.append(Line(line, ratio, *self.state))
            self.tags = 0
        self.text = []
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        # Paragraphs and list items end where the next one begins.
        if tag in ("p", "li") and self.open and self.open[-1][0] == tag:
            self.end_line()
            self.open.pop()
        verdict, article = self.state
        own = max(verdict, self._verdict(tag, attrs, article))
        if tag in BLOCKS or own != verdict:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag in CONTENT and own != EXCLUDED and not article:
            self.articles += 1
            article = self.articles
        self.links += tag == "a"
        self.headings += tag in HEADINGS
        self.open.append((tag, own, article))

    def _verdict(self, tag, attrs, article) -> int:
        if tag in DROPPED or (tag == "header" and not article):
            return EXCLUDED
        found = FREE
        for name, value in attrs:
            if value and name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                found = max(found, named(value))
            elif value and name == "role" and value.strip().lower() in _ROLES:
                return EXCLUDED
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return EXCLUDED
        return EXCLUDED if found == DOUBTED and not article else found

    def handle_endtag(self, tag):
        changes = tag in BLOCKS
        for n in range(len(self.open) - 1, -1, -1):
            if self.open[n][0] == tag:
                changes |= self.open[n][1:] != (self.open[n - 1][1:] if n else (FREE, 0))
                if changes:
                    self.end_line()
                closed = [name for name, *_ in self.open[n:]]
                self.links -= closed.count("a")
                self.headings -= sum(name in HEADINGS for name in closed)
                del self.open[n:]
                break
        else:
            if changes:
                self.end_line()
        self.tags += 1

    def handle_data(self, data):
        self.text.append(data)
        if self.links and not self.headings:
            self.linked += len(_SPACE.sub(" ", data).strip())

    def unknown_decl(self, data):
        """Declarations of other languages are markup."""


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios averaged with their neighbours by a Gaussian, weights renewed at the ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach:reach + len(ratios)] / weights


def content_lines(lines: list[Line], sigma: float = SIGMA) -> list[int]:
    """Numbers of the lines that are the main text."""
    verdicts = np.array([line.verdict for line in lines])
    usable = verdicts != EXCLUDED
    if not usable.any():
        return []
    articles = np.array([line.article for line in lines])
    ratios = np.array([line.ratio for line in lines]) * usable
    mean = ratios[usable].mean()
    smooth = smoothed(ratios, sigma) if sigma else ratios
    marked = usable & (articles > 0)
    limits = np.full(len(lines), THRESHOLD * mean)
    if marked.any():
        chosen = set(articles[marked & (smooth >= limits)].tolist()) or set(articles[marked].tolist())
        usable = marked & np.isin(articles, list(chosen))
        limits[usable & (verdicts == FREE)] = min(PROSE, THRESHOLD * mean)
    high = usable & (smooth >= limits)
    # Smoothing also lifts the links next to a region; a region does not end with them.
    thin = ratios < limits * (EDGE / THRESHOLD)
    for order in (range(len(lines)), range(len(lines) - 1, -1, -1)):
        inside = False
        for n in order:
            if not high[n]:
                inside = False
            elif not inside:
                high[n] = inside = not thin[n]
    if not high.any() and marked.any():
        high = usable
    return np.flatnonzero(high).tolist()


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return "\n".join(parser.lines[n].text for n in content_lines(parser.lines))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [main_text(h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(
        run, "page_id BIGINT, url STRING, text STRING, n_chars BIGINT"
    )
