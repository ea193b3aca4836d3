"""The main text of web pages.

Parser events of the standard library become lines, one for each block. The
text-to-tag ratio of the lines, smoothed with a Gaussian, is cut by a threshold
into content and the rest; the content picks the container whose blocks make up
the text. Menus, notices, forms and comments are left out by their elements and
the words of their class, unless such an element holds most of the page's text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video select textarea button".split())
FRAME = frozenset("nav aside footer form menu dialog".split())
CONTAINERS = frozenset(("article", "main"))
GAPS = frozenset(("br", "td", "th"))
# What can stand in a head; any other start tag ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
# Words of class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related "
    "replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# Words before a mark that only speak of it, as in no-sidebar or category-social.
BESIDE = frozenset("no not without with has have hide hidden is in on category categories cat tag tags tagged topic type format post term author layout".split())
# Headings of what readers wrote.
REPLIES = frozenset("comment comments reply replies response responses discussion kommentar kommentare kommentaires commentaire commentaires comentario comentarios".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(r"[A-Za-z]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
# An element that is left out for its words, or as a form, is kept with this share of the page's text.
MOST = 0.8
# A start tag of the key ends open elements of the value.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

SPREAD = 2  # lines to each side that the smoothing sees, as the deviation of the Gaussian
LINKED = 0.6  # share of characters in links from which a line is a list of links


@dataclass
class Line:
    """One block: its text, its tags, its characters in links and the container it stands in."""

    text: str
    tags: int
    linked: int
    container: int
    heading: bool


def marks(token: str) -> bool:
    """Whether one class name, id or role says that its element is not the article: a mark before or after all other words."""
    parts = [p.lower() for p in _PARTS.findall(token)]
    return bool(parts) and BESIDE.isdisjoint(parts[:-1]) and (parts[0] in MARKS or parts[-1] in MARKS)


@dataclass
class _Open:
    """An open element: whether its text is left out, its container, and the containers begun in it as a frame."""

    name: str
    out: bool
    container: int
    begun: set[int]
    soft: int = 0  # its number among the elements that are kept if they hold most of the text
    before: int = 0  # characters of the page before it


class _Lines(HTMLParser):
    def __init__(self, kept: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[_Open] = []
        self.containers = 0
        self.framed: set[int] = set()  # containers in a frame that has an end
        self.kept = kept
        self.softs = self.seen = 0
        self.sizes: dict[int, int] = {}
        self._reset()

    def _reset(self):
        self.parts, self.tags, self.linked, self.heading = [], 0, 0, False

    def _left_out(self) -> bool:
        return bool(self.open) and self.open[-1].out

    def _break(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.open[-1].container if self.open else 0, self.heading))
        elif self.lines and not self._left_out():
            self.lines[-1].tags += self.tags
        self._reset()

    def _soft(self) -> int:
        """The next number of an element left out for a weak reason, or 0 if it is to be kept."""
        self.softs += 1
        return 0 if self.softs in self.kept else self.softs

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self._end_head()
        if tag in BLOCKS:
            self._break()
            self._close_open("p", until=CONTAINERS | {"table", "button", "blockquote", "div", "section"})
        for other in _ENDS.get(tag, ()):
            self._close_open(other, until={"ul", "ol", "dl", "table", "select"})
        self.tags += 1
        if tag in GAPS:
            self.parts.append(" ")
        if tag in VOID:
            return
        out, container, soft = (self.open[-1].out, self.open[-1].container, 0) if self.open else (False, 0, 0)
        hidden, marked = self._marks(attrs)
        # An article within an article is a comment on it.
        if marked or (tag == "article" and any(o.name == "article" and o.container for o in self.open)):
            soft = self._soft() if tag not in ("html", "body") else 0
        if tag in CONTAINERS and not hidden and not soft:
            # An article ends what was left open before it; only unseen elements hold it back, and frames with
            # an end after it. A form may go around the whole page.
            out = any(o.name in UNSEEN or o.soft for o in self.open if o.name != "form")
            frames = [o.begun for o in self.open if o.name in FRAME and o.name != "form"]
            if not out and (frames or not container):
                self.containers += 1
                container = self.containers
                for begun in frames:
                    begun.add(container)
        if tag == "form" and not soft:
            soft = self._soft()
        out = out or tag in UNSEEN or (tag in FRAME and tag != "form") or (tag == "header" and not container)
        out = out or bool(soft) or (tag not in ("html", "body") and hidden)
        self.open.append(_Open(tag, out, container, set(), soft, self.seen))
        self.heading = self.heading or tag in ("h1", "h2")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        before = len(self.lines)
        if tag in BLOCKS:
            self._break()
        self.tags += 1
        if closed := self._close_open(tag):
            self.framed |= closed.begun
            if tag in HEADINGS and len(self.lines) > before:
                self._heading_of_replies()

    def _heading_of_replies(self):
        """Leaves out the element around a heading such as ``3 comments``."""
        words = [w.lower() for w in _WORDS.findall(self.lines[-1].text)]
        around = self.open[-1] if self.open else None
        if not around or around.name in CONTAINERS or around.name in ("html", "body") or around.out:
            return
        if len(words) <= 3 and not REPLIES.isdisjoint(words) and (soft := self._soft()):
            self.lines.pop()
            around.out, around.soft, around.before = True, soft, self.seen

    def _end_head(self):
        """The end tag of a head may be left out."""
        if self.open and self.open[-1].name == "head":
            self.open.pop()

    def parse_html_declaration(self, i):
        """A marked section that the library gives up on, or that has no end, is a comment up to the next ``>``."""
        try:
            end = super().parse_html_declaration(i)
        except AssertionError:
            end = -1
        return self.parse_bogus_comment(i) if end < 0 else end

    def _close_open(self, tag: str, until=frozenset()):
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k].name
            if name == tag:
                closed = self.open[k]
                self._close_from(k)
                return closed
            if name in until:
                return None
        return None

    def _close_from(self, k: int):
        for o in self.open[k:]:
            if o.soft:
                self.sizes[o.soft] = self.seen - o.before
        del self.open[k:]

    @staticmethod
    def _marks(attrs) -> tuple[bool, bool]:
        """Whether an element is hidden, and whether a word of its names marks it."""
        hidden = any(name in ("hidden", "aria-hidden") and value != "false" for name, value in attrs)
        return hidden, any(value and name in ("class", "id", "role") and any(map(marks, value.split())) for name, value in attrs)

    def handle_data(self, data):
        size = len(data.strip())
        if size:
            self._end_head()
            if not any(o.name in UNSEEN for o in self.open):
                self.seen += size
        if self._left_out():
            return
        self.parts.append(data)
        if any(o.name == "a" for o in self.open[-4:]):
            self.linked += size

    def page(self, html: str) -> None:
        self.feed(html)
        self.close()
        self._break()
        self._close_from(0)


def lines_of(html: str) -> list[Line]:
    """The blocks of a page in page order."""
    kept: frozenset[int] = frozenset()
    while True:
        parser = _Lines(kept)
        parser.page(html)
        most = {n for n, size in parser.sizes.items() if size > MOST * parser.seen}
        if not most:
            break
        # The outermost first: what is left out within it is judged anew.
        kept = kept | {min(most)}
    return [x for x in parser.lines if x.container not in parser.framed]


def content(lines: list[Line], spread: int = SPREAD) -> np.ndarray:
    """Whether each line's smoothed text-to-tag ratio reaches the threshold.

    The threshold is the smaller of the deviation and the mean of the smoothed
    ratios, so at least the line with the highest ratio is content.
    """
    ratio = np.array([len(x.text) / max(x.tags, 1) for x in lines], dtype=np.float64)
    reach = np.arange(-2 * spread, 2 * spread + 1)
    weights = np.exp(-(reach**2) / (2 * spread**2))
    smooth = np.convolve(ratio, weights, "full")[2 * spread : 2 * spread + len(ratio)]
    smooth /= np.convolve(np.ones(len(ratio)), weights, "full")[2 * spread : 2 * spread + len(ratio)]
    return smooth >= min(smooth.std() or smooth.mean(), smooth.mean())


def main_blocks(html: str | None) -> list[str]:
    """The blocks of the main text in page order.

    Containers (article, main) that hold a content line give all their blocks.
    A page without them gives the blocks from its first content line, with a
    heading before it, to the last, except lists of links.
    """
    lines = lines_of(html) if html else []
    if not lines:
        return []
    chosen = content(lines)
    held = {x.container for x, c in zip(lines, chosen, strict=True) if c and x.container}
    if not held:
        # A container of short lines only may lie under the threshold beside a long frame.
        held = {x.container for x in lines if x.container}
    if held:
        return [x.text for x in lines if x.container in held]
    chosen &= np.array([x.linked < LINKED * len(x.text) for x in lines])
    where = np.flatnonzero(chosen)
    if not len(where):
        return []
    first, last = int(where[0]), int(where[-1])
    while first > 0 and lines[first - 1].heading:
        first -= 1
    return [x.text for x in lines[first : last + 1] if x.linked < LINKED * len(x.text)]


def _main_text(html: pd.Series) -> pd.DataFrame:
    blocks = [main_blocks(x) for x in html]
    return pd.DataFrame({"text": ["\n".join(b) for b in blocks], "n_blocks": np.array([len(b) for b in blocks], dtype=np.int32)})


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Every row with its main text in ``text`` and the number of its blocks in ``n_blocks``.

    Null or empty html gives an empty text. Rows are worked on one by one and
    whole, in memory that grows with the longest page, so repeated rows stay, and columns other than ``html`` pass through; one with
    the name of a result is replaced.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (html, text, "n_blocks", "_main")]
    main_text = F.pandas_udf(_main_text, "struct<text string, n_blocks int>")
    found = pages.select(*kept, main_text(F.col(f"`{html}`").cast("string")).alias("_main"))
    return found.select(*kept, F.col("_main.text").alias(text), F.col("_main.n_blocks").alias("n_blocks"))
