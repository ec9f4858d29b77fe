"""Main text of web pages: text-to-tag ratios, smoothed and clustered, over the events of the standard library's parser.

The parser's events make blocks, which take the part of lines in pages that have none: a block ends where a block-level
element starts or ends. A block's ratio is its text, without that of links, per tag. Menus, footers and other furniture
that markup names have ratio 0. The ratios are smoothed by a Gaussian kernel and parted by 2-means. What lies above the
threshold says where the content is: the smallest box that holds nearly all of it is the region, and all of a region that
is no furniture is the main text, however short its lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import small_batches

#: Fixed values of HTML: elements without content, and elements that begin and end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
UNSEEN = frozenset("script style head title noscript template iframe object svg annotation annotation-xml canvas audio video select option textarea button input".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset(("article", "main"))
#: What can stand in a head. Anything else begins the body, whether the head was closed or not.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: What the end of an element that needs no end tag looks like: the start of one of these.
CLOSES = {"p": BLOCK, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "tr": frozenset(("tr",))}
CLOSED_BY = {tag: tuple(c for c, of in CLOSES.items() if tag in of) for tag in BLOCK}
HOLDS = frozenset("article aside body div footer header html main nav section table ul ol dl form td th blockquote".split())
#: Names in class, id or role that mark furniture.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline-links|comments?|commentlist|cookies?|consent|disclaimer|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|"
    r"pagination|pager|popup|promo\w*|recommended|related|replies|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|tags|teasers?|toolbar|widget|contentinfo|complementary)(?:$|[\s_-])", re.I
)
#: Of these, also what claims to be an article is none.
NEVER = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|respond|related|recommended|sidebar|teasers?)(?:$|[\s_-])", re.I)
#: In an article, a header holds its title, and of what holds no further blocks only adverts are furniture: a paragraph named
#: `notice` or `related-work` is the article's own.
INSIDE = re.compile(NAMED.pattern.replace("header|masthead|", ""), re.I)
ADVERT = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertisement|promo|promotion|sponsor|sponsored|share|newsletter|subscribe|signup)(?:$|\s)", re.I)
#: Names that also stand for content: what has them is furniture only beside other text of which there is enough.
WEAK = re.compile(r"(?:^|[\s_-])(?:search|share|sharing|social|tags|widget|notices?|banner|popup|modal|toolbar|skip|pager|promo\w*|pagination|disclaimer)(?:$|[\s_-])", re.I)
#: Elements that can be the region; others, such as lists and sections, are parts of one.
BOXES = frozenset("article main body div td".split())
#: Part of the chosen text that the region holds at least, and how many times the open text named text must have to be open, too.
SHARE, NAMED_TIMES = 0.9, 4
SIGMA, RADIUS = 1.0, 3
TAGLIKE = re.compile(r"<[a-zA-Z/!?]")
#: A slash right behind an element's name parts it from attributes; the parser takes quadratic time over many of them.
SLASHED = re.compile(r"(<[a-zA-Z][^\s/>]*)/+(?=[^\s/>])")


def hidden(attrs: list) -> bool:
    return any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v, re.I) for k, v in attrs)


class Blocks(HTMLParser):
    """Collects blocks (text, length outside links, tags, holder, state, heading), and the holders around them.

    State 3 is in an article, 2 in main, 0 in furniture, -1 in what only a weak name says to be furniture, else 1. heading is 1
    to 6 in h1 to h6, else 0. holders are (parent, element, state), numbered from 0, the page, in the order of their starts.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, int, int, int]] = []
        self.holders: list[tuple[int, str, int]] = [(0, "body", 1)]
        self.heads: list[tuple[int, str]] = []  # h1 in a header that is furniture: number of the next block, text
        self.stack: list[tuple[str, int, int, bool, bool]] = []  # element, holder, state, whether nothing inside can be content, whether unseen
        self.open: Counter[str] = Counter()
        self.levels: list[tuple[str, Counter[str]]] = [("", Counter())]  # elements of HOLDS, and what is open in each: no search is in vain
        self.text: list[str] = []
        self.title: list[str] = []
        self.free = self.tags = self.links = self.hidden = 0

    def state(self) -> tuple[int, int, bool]:
        return self.stack[-1][1:4] if self.stack else (0, 1, False)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            holder, state, never = self.state()
            heading = next((k for k in range(1, 7) if self.open[f"h{k}"]), 0)
            if heading == 1 and state == 0 and not never and self.open["header"]:
                self.heads.append((len(self.blocks), text))
            self.blocks.append((text, self.free, self.tags, holder, state, heading))
            self.tags = 0
        self.text, self.free = [], 0

    def push(self, element: str, holder: int, state: int, never: bool) -> None:
        unseen = element in UNSEEN and not (element == "button" and state > 1)
        self.hidden += unseen
        self.links += element == "a"
        self.open[element] += 1
        if element in HOLDS:
            self.levels.append((element, Counter()))
        else:
            self.levels[-1][1][element] += 1
        self.stack.append((element, holder, state, never, unseen))

    def pop_to(self, elements: tuple[str, ...]) -> None:
        """Closes what was opened last, up to one of these, which is open."""
        while True:
            element, *_, unseen = self.stack.pop()
            self.hidden -= unseen
            self.links -= element == "a"
            self.open[element] -= 1
            if element in HOLDS:
                self.levels.pop()
            else:
                self.levels[-1][1][element] -= 1
            if element in elements:
                return

    def end_head(self) -> None:
        if self.open["head"]:
            self.pop_to(("head",))

    def parse_html_declaration(self, i: int) -> int:
        """Any <![ is a comment up to the next '>', as in browsers; the standard library raises on unknown ones."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        close = self.rawdata.find(">", i)
        return close + 1 if close >= 0 else len(self.rawdata)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
        if tag == "body" or tag not in HEAD and self.stack and self.stack[-1][0] == "head":
            self.end_head()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if ends := CLOSED_BY.get(tag):
            holder, inside = self.levels[-1]
            if holder in ends or any(inside[e] for e in ends):
                self.pop_to(ends)
        holder, state, never = self.state()
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")) if attrs else ""
        outer = state
        if tag in MAIN or ("role", "main") in attrs:
            never = never or bool(NEVER.search(names))
            state = 0 if never else 3 if tag == "article" else max(2, outer)
        elif tag in FURNITURE and not (tag == "header" and outer > 1) or hidden(attrs) or names and tag not in ("html", "body") and (NAMED if outer <= 1 else INSIDE if tag in HOLDS else ADVERT).search(names):
            weak = outer == 1 and tag not in FURNITURE and not hidden(attrs) and not NAMED.search(WEAK.sub(" ", names))
            state, never = -1 if weak else 0, never or tag == "aside" or bool(NEVER.search(names))
        if tag in HOLDS:
            self.holders.append((holder, tag, state))
            holder = len(self.holders) - 1
        self.push(tag, holder, state, never)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if self.open[tag] if tag in HOLDS else self.levels[-1][1][tag]:  # others end nothing: they began outside, or never
            self.pop_to((tag,))

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.end_head()
        if self.stack and self.stack[-1][0] == "title":
            self.title.append(data)
        if not self.hidden:
            self.text.append(data)
            self.free += 0 if self.links else len(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.array([math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)])
    weight = np.convolve(np.ones(len(ratios)), kernel)[RADIUS:-RADIUS]
    return np.convolve(ratios, kernel)[RADIUS:-RADIUS] / weight


def threshold(values: np.ndarray) -> float:
    """Half way between the centres of 2-means, from the extremes on; the value itself if all are equal."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        near = values < (low + high) / 2
        if not near.any() or near.all():
            break
        a, b = float(values[near].mean()), float(values[~near].mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2


def blocks_of(html: str) -> Blocks:
    """The parser after a page. Behind the last '>' no tag can end, so that the parser would look for one in vain at each '<'."""
    parser, cut = Blocks(), html.rfind(">") + 1
    parser.feed(SLASHED.sub(r"\1 ", html[:cut]))
    parser.close()
    rest = html[cut:]
    unfinished = TAGLIKE.search(rest)
    parser.handle_data(unescape(rest[: unfinished.start()] if unfinished else rest))
    parser.flush()
    return parser


def above(parser: Blocks, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the open blocks have a smoothed ratio of the threshold or more, which have one before or after smoothing, and
    which have half of it before."""
    ratios = np.array([b[1] / max(1, b[2]) if o else 0.0 for b, o in zip(parser.blocks, open_, strict=True)])
    smooth = smoothed(ratios)
    limit = threshold(smooth[open_])
    return open_ & (smooth >= limit), open_ & ((smooth >= limit) | (ratios >= limit)), open_ & (ratios >= limit / 2)


def within(parser: Blocks, values: Iterable[int]) -> list[int]:
    """Sums of the blocks' values over all that each holder holds."""
    out = [0] * len(parser.holders)
    for b, v in zip(parser.blocks, values, strict=True):
        out[b[3]] += int(v)
    for k in range(len(out) - 1, 0, -1):
        out[parser.holders[k][0]] += out[k]
    return out


def region(parser: Blocks, chosen: np.ndarray, full: np.ndarray) -> int:
    """The smallest box that holds SHARE of the chosen text, and the larger ones around it that hold further full blocks; of
    what lies in an article or main, the article or main."""
    holders, held, rich = parser.holders, within(parser, (len(b[0]) * c for b, c in zip(parser.blocks, chosen, strict=True))), within(parser, full)
    best = up = max(k for k, (_, tag, _) in enumerate(holders) if tag in BOXES and held[k] >= SHARE * held[0])
    if holders[best][2] > 1:
        while best and holders[holders[best][0]][2] == holders[best][2]:
            best = holders[best][0]
        return best
    while up:
        up = holders[up][0]
        if holders[up][1] in BOXES and rich[up] > rich[best]:
            best = up
    return best


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = blocks_of(html)
    states = np.array([b[4] for b in parser.blocks])
    length = np.array([b[1] for b in parser.blocks])
    open_ = states > 0
    if length[states < 0].sum() > NAMED_TIMES * length[open_].sum():
        open_ = states != 0
    if not open_.any():
        return ""
    (chosen, rich, full), holders = above(parser, open_), parser.holders
    if (own := region(parser, chosen, full)) and holders[own][1] == "article" and (up := holders[own][0]) and holders[up][2] > 1:
        own = up if len({b[3] for b, c in zip(parser.blocks, rich, strict=True) if c and holders[b[3]][1] == "article" and holders[b[3]][0] == up}) > 1 else own
    inside, article, free, some = [False] * len(holders), [0] * len(holders), within(parser, length), within(parser, full)
    linked = [False] * len(holders)  # in a list of links beside an article that markup doesn't name
    for k, (parent, tag, _) in enumerate(holders):
        inside[k] = k == own or k > own and inside[parent]
        article[k] = 0 if k <= own else article[parent] or (k if tag == "article" else 0)
        linked[k] = k > own and (linked[parent] or holders[own][2] <= 1 and not free[k])
    told = {article[b[3]] for b, c in zip(parser.blocks, rich, strict=True) if c}  # other articles are other stories
    first, last = (np.flatnonzero(full)[[0, -1]] if full.any() else (0, 0))
    apart = lambda k, b: holders[own][1] == "body" and not first <= k <= last and b[3] != own and not some[b[3]]  # noqa: E731  before or behind the text of a page without a box for it
    kept = [k for k, (b, o) in enumerate(zip(parser.blocks, open_, strict=True)) if o and inside[b[3]] and not linked[b[3]] and not apart(k, b) and (not article[b[3]] or article[b[3]] in told)]
    if not kept:
        return ""
    return "\n".join([*title(parser, kept[0]), *(parser.blocks[k][0] for k in kept)])


def title(parser: Blocks, first: int) -> list[str]:
    """A heading of the first level before the region, if that doesn't begin with one: of a header, only that which the page's title begins with."""
    if parser.blocks[first][5] in (1, 2, 3):
        return []
    name = " ".join("".join(parser.title).split())
    known = [(k, b[0]) for k, b in enumerate(parser.blocks[:first]) if b[5] == 1 and b[4] > 0] + [(k, t) for k, t in parser.heads if k < first and name.startswith(t)]
    return [max(known)[1]] if known else []


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    A null or empty page, or one without content, has an empty text. Blocks whose ratio equals the threshold are content. A very
    long page is parsed whole, in time that grows with its length alone, however its elements are nested or left open. Ids and
    urls come out as they are, null or repeated; an empty table gives no rows; other columns aren't read.
    """

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    small_batches(pages.sparkSession)
    text = F.pandas_udf(texts, "string")
    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
