"""Main text of web pages from streaming parser events.

The parser's events give a page's blocks, its lines, with their text and tag
counts and what encloses them.  Blocks of menus, headers, footers, sidebars,
notices, adverts, forms, comments and code are left out by element, role and
class name (``named_out``).  Each block's text-to-tag ratio is smoothed by a
Gaussian along the page, and the blocks above a threshold from the smoothed
ratios' spread form the content clusters.  The clusters select regions: every
outermost ``article`` or ``main`` of whose text they hold half or more (all, if
they do of none); on a page without such elements the smallest container that holds at
least ``SHARE`` of the clusters' text.  The text is that of all blocks of the
selected regions, so short paragraphs and headings of an article are kept.

One pass, no shuffle, time in proportion to the page.  Defined cases: null and
empty html, and pages without content, give an empty text; unclosed and
misnested tags and cut pages are read as far as they go; rows that repeat are
extracted each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("script style noscript template head title nav header footer aside form button select textarea iframe svg math object canvas audio video dialog menu".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond replies share sharing social related recommended newsletter subscribe subscription signup popup modal overlay footer header masthead widget widgets toolbar pagination pager login search hidden".split()
)
#: Words of a class name that say nothing of what it holds, and those before a part that only is mentioned.
GENERIC = frozenset("container wrapper wrap box block area section inner outer holder body list item items content unit slot row col column group zone top bottom left right".split())
MENTIONING = frozenset("has no with without".split())
#: What holds a title or byline of the article itself, and elements of running text, whose id says nothing.
OWN_HEADS = frozenset("article post entry story chapter".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dl dt dd td th tr table figcaption figure ul ol".split())
CONTAINERS = frozenset("body section div td center".split())
ALIKE = frozenset("li dd dt tr td th option".split())
WIDTH = 1.0
SHARE = 0.7


def named_out(name: str) -> bool:
    """Whether a class or id names a part that is left out: its last word that says anything does, unless it only mentions it."""
    words = "".join(c if c.isalnum() else " " for c in name.lower()).split()
    if not words or words[0] in MENTIONING:
        return False
    while words and (words[-1] in GENERIC or words[-1].isdigit()):
        words.pop()
    if not words or (words[-1] in ("header", "footer") and words[0] in OWN_HEADS and len(words) > 1):
        return False
    return words[-1] in LEFT_OUT_WORDS


class Blocks(HTMLParser):
    """Collects (text, tags, region, container) of each block; region numbers the outermost article or main around it, container the nearest other one, -1 without any; ``above`` has each container's own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, left out, region, container
        self.wide: list[int] = []  # places in the stack of elements that are not inline
        self.open: Counter[str] = Counter()
        self.blocks: list[tuple[str, int, int, int]] = []
        self.above: list[int] = []
        self.parts: list[str] = []
        self.tags = 0
        self.regions = 0

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.tags, *(self.stack[-1][2:] if self.stack else (-1, -1))))
            self.tags = 0
        self.parts = []

    def cut(self, place: int) -> None:
        """Close all elements from a place of the stack on."""
        while len(self.stack) > place:
            self.open[self.stack.pop()[0]] -= 1
        while self.wide and self.wide[-1] >= place:
            self.wide.pop()

    @staticmethod
    def left_out(tag: str, attrs: list[tuple[str, str | None]], region: int) -> bool:
        if tag in LEFT_OUT:
            return True
        own = {k: v or "" for k, v in attrs}
        if "hidden" in own or own.get("role", "").lower() in LEFT_OUT_ROLES or "display:none" in own.get("style", "").replace(" ", "").lower():
            return True
        if tag in ("html", "body", "main") or (tag == "article" and region < 0):
            return False
        names = own.get("class", "").split() + ([] if tag in RUNNING else own.get("id", "").split())
        return any(map(named_out, names))

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.end_block()
            if self.wide:  # a new block ends an open paragraph, an item the open item
                last = self.stack[self.wide[-1]][0]
                if last == "p" or (tag == last and tag in ALIKE):
                    self.cut(self.wide[-1])
        out, region, container = self.stack[-1][1:] if self.stack else (False, -1, -1)
        gone = out or (tag not in VOID and self.left_out(tag, attrs, region))
        self.tags += not gone
        if tag in VOID:
            return
        if tag in ("article", "main") and not gone and region < 0:
            region, self.regions = self.regions, self.regions + 1
        elif tag in CONTAINERS and not gone:
            self.above.append(container)
            container = len(self.above) - 1
        if tag not in INLINE:
            self.wide.append(len(self.stack))
        self.stack.append((tag, gone, region, container))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.tags += not (self.stack and self.stack[-1][1])
        if tag not in INLINE:
            self.end_block()

    def handle_endtag(self, tag):
        self.tags += not (self.stack and self.stack[-1][1])
        if tag not in INLINE:
            self.end_block()
        if self.open[tag] > 0:
            place = len(self.stack) - 1
            while self.stack[place][0] != tag:
                place -= 1
            self.cut(place)

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][1]):
            self.parts.append(data)


def smoothed(ratio: np.ndarray, width: float = WIDTH) -> np.ndarray:
    reach = int(np.ceil(3 * width))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), "valid")


def smallest_holder(containers: np.ndarray, weight: np.ndarray, above: list[int], share: float = SHARE) -> np.ndarray:
    """Which blocks are in the smallest container that holds ``share`` of the weight; a container is numbered after the one around it."""
    mass = np.zeros(len(above) + 1)  # the last stands for the page
    np.add.at(mass, containers, weight)
    for c in range(len(above) - 1, -1, -1):
        mass[above[c]] += mass[c]
    holder = max((c for c in range(len(above)) if mass[c] >= share * mass[-1]), default=-1)
    inside = np.zeros(len(above) + 1, bool)
    inside[-1] = holder < 0
    for c in range(len(above)):
        inside[c] = c == holder or inside[above[c]]
    return inside[containers]


def main_text(html: str | None) -> str:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.end_block()
    if not parser.blocks:
        return ""
    texts, tags, regions, containers = zip(*parser.blocks, strict=True)
    size = np.array([len(t) for t in texts])
    ratio = smoothed(size / np.maximum(tags, 1))
    region = np.array(regions)
    cluster = ratio >= min(ratio.std(), ratio.max())
    inside = region >= 0
    if inside.any():
        held = np.bincount(region[inside], (size * cluster)[inside], parser.regions)
        rich = inside & (held >= 0.5 * np.bincount(region[inside], size[inside], parser.regions))[region]
        chosen = rich if rich.any() else inside
    else:
        chosen = smallest_holder(np.array(containers), size * cluster, parser.above)
    return " ".join(t for t, c in zip(texts, chosen, strict=True) if c)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
