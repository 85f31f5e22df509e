"""Main text of HTML pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines, one for each block of text. Each line has a
text-to-tag ratio: its characters for each tag event since the line before. The ratios are smoothed with a Gaussian
along the page and split into two clusters by their threshold. A line is *content* if its ratio, smoothed and by itself,
is in the high cluster, or is a paragraph's (``PARAGRAPH`` characters a tag), where the threshold is higher still.

The content lines choose the region: the innermost element that holds all of them, but never a list, a part of a table,
a figure or a single block of text. An article element around it, or an element that only adds headings and lines like
them, is taken whole. An article's short lines have low ratios, so all lines of the region are kept, but for two kinds:

* parts that HTML itself sets apart (``nav``, ``aside``, ``footer``, ``form`` and the like, their roles, hidden ones) and
  readers' comments, which a ratio can't tell from an article: they have ratio 0 and are never text;
* lines whose class or id names an advert, a notice or the like, *if they aren't content*. Such names have no say over
  content lines, except that those need a paragraph's ratio.

The time is linear in the page, however deep its elements are. Null or empty HTML gives an empty text. Unclosed and
cut-off markup is read as far as it goes. Pages don't affect each other, so repeated rows and ties change nothing. Other
columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import map_batches, utf8

# Fixed values of HTML: elements that start a new line, that have no end tag, whose text is never shown.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe object svg math canvas select textarea button title".split())
#: Elements and roles that HTML sets apart from main text.
APART = frozenset("nav header footer aside form dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Names of readers' comments, of other parts beside a text, and words that may stand with either in one name.
READERS = frozenset("comment comments commentlist disqus replies respond".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted promotion related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar tracking widget".split()
)
PLACES = frozenset("area bar block bottom box container content footer header inner left list main outer page panel post right section site slot thread top unit wrap wrapper".split())
#: A start tag of the first kind closes an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {tag: {"p"} for tag in BLOCK - {"li", "dt", "dd", "tr", "td", "th", "option", "html", "body"}}
WORD = re.compile(r"[a-z]+")
HEADINGS = frozenset("h1 h2 h3".split())
#: Elements that may hold a whole text by themselves.
WHOLE = frozenset("html body center div section article main".split())
#: What is said of a line beside its ratio.
NOTHING, NAMED, SET_APART = 0, 1, 2
#: Characters a tag that make a paragraph.
PARAGRAPH = 30.0


def named(value: str) -> int:
    """What a class or id says: a name counts if all its words are known ones, so ``ad-slot`` does and ``ad-hoc`` doesn't."""
    said = NOTHING
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        words = set(WORD.findall(name))
        if words & READERS and words <= READERS | NAMES | PLACES:
            return SET_APART
        if words & NAMES and words <= NAMES | PLACES:
            said = NAMED
    return said


def says(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """What an element's own tag and attributes say of its lines."""
    if tag in APART and not (tag == "header" and in_article):
        return SET_APART
    said = NOTHING
    for name, value in attrs:
        if name == "hidden" or value and (name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true"):
            return SET_APART
        if value and name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            said = max(said, named(value))
    return said


class Lines(HTMLParser):
    """``lines``: (text, tags, innermost element, what is said of it) of each block, in page order.

    Elements are numbered in page order from 1; 0 is the page. ``names``, ``parents`` and ``ends`` (the last element
    inside) describe them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.names, self.parents, self.ends = ["html"], [0], [0]
        self.open: list[tuple[str, int, int, bool, bool]] = []  # name, number, said, unseen, in an article
        self.at: dict[str, list[int]] = {}  # depths of open elements by name
        self.blocks: list[int] = []  # depths of open blocks
        self.text: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            _, number, said, _, _ = self.open[-1] if self.open else ("", 0, NOTHING, False, False)
            self.lines.append((text, self.tags, number, said))
            self.tags = 0

    def close_to(self, depth: int) -> None:
        if self.blocks and self.blocks[-1] >= depth:
            self.flush()
        while len(self.open) > depth:
            name, number, *_ = self.open.pop()
            self.ends[number] = len(self.names) - 1
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def deepest(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if closes := CLOSES.get(tag):
            depth = self.deepest(closes)
            if depth >= 0 and depth >= (self.blocks[-1] if self.blocks else 0):
                self.close_to(depth)
        if tag == "br":
            self.text.append(" ")
        if tag not in VOID:
            _, parent, said, unseen, in_article = self.open[-1] if self.open else ("", 0, NOTHING, False, False)
            self.names.append(tag)
            self.parents.append(parent)
            self.ends.append(0)
            self.at.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append((tag, len(self.names) - 1, max(said, says(tag, attrs, in_article)), unseen or tag in UNSEEN, in_article or tag == "article"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        depth = self.deepest((tag,))
        if depth >= 0 and (tag in BLOCK or not self.blocks or self.blocks[-1] <= depth):
            self.close_to(depth)

    def handle_data(self, data):
        if not (self.open and self.open[-1][3]):
            self.text.append(data)

    def finish(self) -> None:
        self.close()
        self.flush()
        self.close_to(0)
        self.ends[0] = len(self.names) - 1


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Convolution with a Gaussian; past either end of the page the weights that are left count."""
    reach = np.arange(-int(3 * sigma), int(3 * sigma) + 1)
    weights = np.exp(-(reach**2) / (2 * sigma**2))
    same = lambda x: np.convolve(x, weights)[len(reach) // 2 : len(reach) // 2 + len(ratios)]
    return same(ratios) / same(np.ones(len(ratios)))


def threshold(values: np.ndarray) -> float:
    """The middle between two cluster means (one-dimensional 2-means, begun at both ends)."""
    low, high = values.min(), values.max()
    for _ in range(32):
        cut = (low + high) / 2
        below, above = values[values <= cut], values[values > cut]
        if not len(above):
            break
        now = below.mean(), above.mean()
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def content_lines(ratios: np.ndarray, said: np.ndarray, sigma: float) -> np.ndarray:
    """Which lines are content: those of the high cluster."""
    ratios = np.where(said == SET_APART, 0.0, ratios)
    soft = smoothed(ratios, sigma)
    cut = min(threshold(soft), PARAGRAPH)  # on a page of paragraphs alone all are content
    return (soft >= cut) & (ratios >= cut) & (said != SET_APART) & ((said != NAMED) | (ratios >= PARAGRAPH))


def region_of(page: Lines, content: np.ndarray) -> int:
    """The element whose lines are the text."""
    where = [number for (_, _, number, _), ok in zip(page.lines, content, strict=True) if ok]
    if not where:
        return 0
    names, parents, ends = page.names, page.parents, page.ends
    low, high, at = min(where), max(where), where[0]
    while at and not (at <= low and high <= ends[at] and names[at] in WHOLE):
        at = parents[at]
    up = at
    while up and names[up] != "article":
        up = parents[up]
    if up:
        return up
    # an element around it that adds a heading, and nothing that is set apart or named
    at_number = np.array([number for _, _, number, _ in page.lines])
    heading = np.array([names[number] in HEADINGS for number in at_number])
    other = np.array([what != NOTHING for *_, what in page.lines])
    up_to = [np.append(0, np.cumsum(np.bincount(at_number[kind], minlength=len(names)))) for kind in (heading, other)]
    while at and names[parents[at]] in WHOLE - {"html", "body"}:
        up = parents[at]
        headings, others = (n[ends[up] + 1] - n[up] - n[ends[at] + 1] + n[at] for n in up_to)
        if others or not headings:
            break
        at = up
    return at


def main_text(html: str, sigma: float = 1.0) -> str:
    """The blocks of the main text, joined by line breaks."""
    page = Lines()
    page.feed(html)
    page.finish()
    if not page.lines:
        return ""
    said = np.array([x[3] for x in page.lines])
    content = content_lines(np.array([len(text) / max(1, tags) for text, tags, *_ in page.lines]), said, sigma)
    region = region_of(page, content)
    last = page.ends[region]
    return "\n".join(text for (text, _, number, what), ok in zip(page.lines, content, strict=True) if region <= number <= last and (ok or what == NOTHING))


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text (empty if none) and n_chars (its code points) of each page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def of_batch(batch: pa.RecordBatch) -> dict:
        texts = [main_text((x or b"").decode("utf-8", "replace")) for x in utf8(batch.column(2))]
        return {"id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    made = map_batches(rows, of_batch, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
    return made.withColumnsRenamed({"id": id_col, "url": url_col})
