"""Main text of web pages: flat text blocks, their neighbours, a decision tree.

A page is cut into blocks at block-level tags.  Each block is described by its
word count and link density, those of the blocks before and after it, and where
it stands (inside an article, inside a menu, footer, advert, form, comment, …).  A
small decision tree, trained when the operator is built on the labelled table
:data:`LABELLED`, keeps or drops each block.

Null and empty pages give an empty text.  Markup that is cut off or never closed
ends with the page; a script or comment that never ends swallows the rest of the
page, as browsers have it.  Pages are independent: repeated rows give repeated
results.  Time is linear in a page's length, whatever its markup is.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrays import text_blocks

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
#: Block tags without an inside.
EMPTY_TAGS = frozenset(["hr"])
#: What an opening tag ends if it stands on top: a paragraph ends at any block, the parts of lists and tables at the next one.
ENDS = {
    tag: frozenset(group.split())
    for group in ("li", "dd dt", "option optgroup", "td th")
    for tag in group.split()
} | {tag: frozenset("td th tr".split()) for tag in ("tr", "tbody", "thead", "tfoot")}
RAW_TAGS = frozenset("script style textarea xmp iframe noembed noframes noscript template svg math object".split())
#: What browsers show in place of the text inside; without an end tag they hold nothing.
SHOWN_TAGS = frozenset("audio video canvas".split())
#: Inline tags that may be marked as no content; they do not end a block.
INLINE_TAGS = frozenset("span button".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog head title select fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: How surely a region is no content: words that articles use as well, layout, adverts and comments, tags and roles.
HINT, LAYOUT, SURE, TAG = 1, 2, 3, 4
HINT_WORDS = frozenset(
    "promotion advertising consent notice notices alert subscription discussion share sharing social related recommended "
    "recommendations skip disclaimer respond reply replies".split()
)
LAYOUT_WORDS = frozenset(
    "banner overlay modal sidebar rail menu nav navbar navigation footer masthead topbar toolbar widget widgets".split()
)
SURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adslot adsense sponsor sponsored sponsors promo cookie cookies gdpr popup "
    "newsletter subscribe signup login breadcrumb breadcrumbs pagination pager comment comments commentlist disqus paywall".split()
)
#: A compound names an aside only if its other words are of these, or one letter.
PART_WORDS = frozenset(
    "site main page primary secondary left right top bottom side box block wrap wrapper container area list item items link "
    "links button buttons bar section header head inner outer slot unit zone post posts article articles story stories text "
    "title form icon icons group panel column col mobile desktop sticky fixed global wp md".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_MARK = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)|<[!?/][^>]*+>")
_OPEN_END = re.compile(r"<(?:[!?/]|[a-zA-Z])[^<>]*\Z")
#: A whole attribute: its name, and its value as it stands.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["'][^"']*["']?""")
_WORD_CASE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    linked: int
    words: int
    article: bool
    aside: int  #: 0, 1 for a hint only, 2
    heading: bool


def _named_aside(token: str) -> int:
    """What a class or an id says: ``sidebar`` and ``main-menu`` name an aside, ``no-sidebar`` and ``related-work`` do not."""
    words = [word.lower() for word in _WORD_CASE.findall(token)]
    levels = [
        SURE if word in SURE_WORDS else LAYOUT if word in LAYOUT_WORDS else HINT if word in HINT_WORDS else 0 for word in words
    ]
    others = (word for word, level in zip(words, levels, strict=True) if not level)
    return max(levels, default=0) if all(len(word) == 1 or word in PART_WORDS for word in others) else 0


def _aside_level(tag: str, attributes: str, in_article: bool) -> int:
    if tag in ASIDE_TAGS or (tag == "header" and not in_article):
        # Some pages wrap all they have in one form.
        return LAYOUT if tag == "form" else TAG
    if tag == "button":
        return TAG
    if tag in ("html", "body", "main", "article") or "=" not in attributes and "hidden" not in attributes:
        return 0
    level = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ASIDE_ROLES):
            return TAG
        if name in ("class", "id"):
            level = max(level, *map(_named_aside, value.split()), 0)
    # A heading's id is its title.
    return 0 if tag in HEADINGS else level


def _inherited(tag: str, level: int) -> int:
    """What of a region's level goes on to a region inside: an article is none of the layout around it."""
    if tag == "main":
        return level if level == TAG else 0
    return 0 if tag == "article" and level == LAYOUT else level


class _Page:
    """Blocks found so far, the regions that are open, and the text of the block that is being read."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.regions: list[tuple[str, int, bool]] = []  # tag, level, article
        self.open: Counter[str] = Counter()
        self.parts: list[tuple[str, bool, int]] = []  # text, link, level
        self.link = self.heading = False
        self.link_depth = 0  # how many regions were open where the link began

    def region(self) -> tuple[int, bool]:
        return self.regions[-1][1:] if self.regions else (0, False)

    def add(self, text: str) -> None:
        self.parts.append((text, self.link, self.region()[0]))

    def end_block(self) -> None:
        whole = "".join(part for part, _, _ in self.parts)
        text = " ".join(entities.unescape(whole).split())
        if text:
            shown = [part for part in self.parts if part[0].strip()]
            linked = sum(len(entities.unescape(part).split()) for part, link, _ in shown if link)
            # A part of a sentence that is marked does not mark the sentence.
            level = min(part[2] for part in shown)
            self.found.append(Block(text, linked, len(text.split()), self.region()[1], min(level, 2), self.heading))
        self.parts.clear()

    def enter(self, tag: str, attributes: str) -> None:
        level, article = self.region()
        own = _aside_level(tag, attributes, article)
        level = max(_inherited(tag, level), own)
        article = article or (tag in ("article", "main") and level <= HINT)
        self.regions.append((tag, level, article))
        self.open[tag] += 1

    def leave(self) -> str:
        tag = self.regions.pop()[0]
        self.open[tag] -= 1
        self.link = self.link and len(self.regions) >= self.link_depth
        return tag

    def anchor(self, opens: bool) -> None:
        """A link lasts to its end tag, or to the end of the region it begins in."""
        self.link, self.link_depth = opens, len(self.regions)

    def start(self, tag: str, attributes: str) -> None:
        """A block tag opens."""
        self.end_block()
        # No block stands inside of a paragraph, so an open one has nothing but inline tags above it.
        if self.open["p"]:
            while self.leave() != "p":
                pass
        ended = ENDS.get(tag, frozenset())
        top = next((k for k in range(1, min(4, len(self.regions)) + 1) if self.regions[-k][0] not in INLINE_TAGS), 0)
        while ended and top and self.regions and self.regions[-min(top, len(self.regions))][0] in ended:
            for _ in range(top):
                self.leave()
            top = 1
        self.heading = tag in HEADINGS
        if tag not in EMPTY_TAGS:
            self.enter(tag, attributes)

    def end(self, tag: str) -> None:
        """A block tag closes, with all that is open inside of it."""
        self.end_block()
        self.heading = False
        if self.open[tag]:
            while self.leave() != tag:
                pass


def blocks_of(text: str) -> list[Block]:
    """The page's text blocks in order, white space turned into single spaces."""
    page = _Page()
    ended: dict[str, re.Pattern[str]] = {}
    never: set[str] = set()  # tags that are not closed any more

    def after(tag: str, at: int) -> int | None:
        """The place after the next end tag."""
        if tag in never:
            return None
        if tag not in ended:
            ended[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE)
        end = ended[tag].search(text, at)
        if end is None:
            never.add(tag)
            return None
        return end.end()

    at, size = 0, len(text)
    # Behind the last > there are no tags: looking for one there would go to the end each time.
    last = text.rfind(">")
    while at < size:
        mark = _MARK.search(text, at, last + 1)
        if mark is None:
            rest = text[at:]
            cut = _OPEN_END.search(rest, max(0, rest.rfind("<")))
            open_at = min(cut.start(), rest.find("<!--")) if cut and "<!--" in rest else cut.start() if cut else rest.find("<!--")
            page.add(rest if open_at < 0 else rest[:open_at])
            break
        if mark.start() > at:
            page.add(text[at : mark.start()])
        at = mark.end()
        if mark.group() == "<!--":
            close = text.find("-->", at)
            at = size if close < 0 else close + 3
            continue
        if mark.group(2) is None:
            continue
        closing, tag, attributes = bool(mark.group(1)), mark.group(2).lower(), mark.group(3)
        if tag == "a":
            page.anchor(not closing)
        elif tag == "br":
            page.add(" ")
        elif tag in RAW_TAGS or tag in SHOWN_TAGS:
            if not closing and not attributes.endswith("/>"):
                close = after(tag, at)
                at = close if close is not None else size if tag in RAW_TAGS else at
        elif tag in INLINE_TAGS:
            if not closing:
                page.enter(tag, attributes)
            elif page.regions and page.regions[-1][0] == tag:
                page.leave()
        elif tag in BLOCK_TAGS:
            if closing:
                page.end(tag)
            else:
                page.start(tag, attributes)
    page.end_block()
    return page.found


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "article", "aside",
            "heading", "page_has_article")

#: The labelled table: the features of a block, and whether it is main text.
LABELLED = [
    # menus, headers, footers, adverts, forms, comments inside or outside of an article
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 2, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 2, 0, 1, 0), (3, 1.0, 2, 1.0, 9, 0.0, 0, 2, 0, 1, 0),
    (9, 0.0, 2, 1.0, 8, 0.0, 0, 2, 0, 1, 0), (14, 0.0, 60, 0.0, 0, 0.0, 0, 2, 0, 1, 0), (25, 0.1, 80, 0.0, 30, 0.0, 0, 2, 0, 1, 0),
    (45, 0.0, 30, 0.0, 50, 0.0, 1, 2, 0, 1, 0), (120, 0.0, 90, 0.0, 70, 0.0, 1, 2, 0, 1, 0), (6, 0.0, 40, 0.0, 90, 0.0, 1, 2, 0, 1, 0),
    (12, 0.5, 3, 0.0, 2, 1.0, 0, 2, 0, 0, 0), (60, 0.0, 30, 0.0, 40, 0.0, 0, 2, 0, 0, 0), (4, 0.0, 50, 0.0, 9, 0.0, 0, 2, 1, 1, 0),
    (200, 0.0, 40, 0.0, 60, 0.0, 0, 2, 0, 0, 0), (5, 0.0, 20, 0.0, 8, 0.2, 1, 2, 1, 1, 0), (30, 0.0, 10, 0.0, 0, 0.0, 1, 2, 0, 1, 0),
    # where only a word hints that it is no content: long text without links is kept
    (45, 0.0, 30, 0.0, 50, 0.0, 1, 1, 0, 1, 1), (120, 0.0, 5, 0.0, 70, 0.0, 1, 1, 0, 1, 1), (12, 0.0, 60, 0.0, 0, 0.0, 1, 1, 0, 1, 1),
    (300, 0.05, 90, 0.0, 0, 0.0, 1, 1, 0, 1, 1), (25, 0.2, 40, 0.0, 9, 0.0, 1, 1, 0, 1, 1), (14, 0.0, 1, 0.0, 80, 0.0, 1, 1, 0, 1, 1),
    (1, 0.0, 60, 0.0, 45, 0.0, 1, 1, 1, 1, 1), (2, 0.0, 90, 0.0, 12, 0.0, 1, 1, 1, 1, 1), (4, 0.0, 30, 0.0, 120, 0.0, 1, 1, 1, 1, 1),
    (1, 0.0, 60, 0.0, 40, 0.0, 1, 1, 0, 1, 0), (5, 0.0, 120, 0.0, 0, 0.0, 1, 1, 0, 1, 0), (8, 0.0, 60, 0.0, 30, 0.0, 1, 1, 0, 1, 0),
    (3, 1.0, 60, 0.0, 3, 1.0, 1, 1, 0, 1, 0), (12, 1.0, 60, 0.0, 14, 1.0, 1, 1, 0, 1, 0), (30, 0.8, 40, 0.0, 20, 0.0, 1, 1, 0, 1, 0),
    (9, 0.0, 80, 0.0, 3, 1.0, 0, 1, 0, 1, 0), (60, 0.0, 80, 0.0, 40, 0.0, 0, 1, 0, 1, 0), (3, 0.0, 80, 0.0, 12, 1.0, 0, 1, 1, 1, 0),
    (40, 0.0, 60, 0.0, 30, 0.0, 0, 1, 0, 0, 1), (150, 0.0, 30, 0.0, 0, 0.0, 0, 1, 0, 0, 1), (1, 0.0, 60, 0.0, 45, 0.0, 0, 1, 1, 0, 1),
    (1, 0.0, 60, 0.0, 45, 0.0, 0, 1, 0, 0, 0), (3, 0.0, 60, 0.0, 40, 0.0, 0, 1, 0, 0, 0), (9, 1.0, 60, 0.0, 8, 1.0, 0, 1, 0, 0, 0), (30, 0.8, 60, 0.0, 9, 1.0, 0, 1, 0, 0, 0),
    # inside an article
    (8, 0.0, 9, 0.0, 60, 0.0, 1, 0, 1, 1, 1), (1, 0.0, 2, 0.0, 90, 0.0, 1, 0, 0, 1, 1), (60, 0.0, 8, 0.0, 70, 0.0, 1, 0, 0, 1, 1),
    (150, 0.02, 60, 0.0, 1, 0.0, 1, 0, 0, 1, 1), (1, 0.0, 150, 0.0, 1, 0.0, 1, 0, 0, 1, 1), (40, 0.2, 30, 0.1, 12, 0.0, 1, 0, 0, 1, 1),
    (500, 0.0, 8, 0.0, 14, 0.0, 1, 0, 0, 1, 1), (2, 0.0, 9, 0.0, 14, 0.0, 1, 0, 0, 1, 1), (20, 0.4, 50, 0.0, 60, 0.0, 1, 0, 0, 1, 1),
    (5, 0.0, 30, 0.0, 40, 0.0, 1, 0, 0, 1, 1), (3, 0.0, 1, 1.0, 40, 0.0, 1, 0, 1, 1, 1), (12, 0.0, 90, 0.0, 25, 0.0, 1, 0, 0, 1, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1, 1), (7, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1, 1), (1, 0.0, 1, 0.0, 14, 0.0, 1, 0, 0, 1, 1),
    (8, 1.0, 40, 0.0, 60, 0.0, 1, 0, 0, 1, 1), (15, 0.9, 70, 0.0, 30, 0.0, 1, 0, 0, 1, 1), (6, 0.7, 25, 0.0, 22, 0.0, 1, 0, 0, 1, 1),
    (60, 0.0, 30, 0.0, 2, 1.0, 1, 0, 0, 1, 1), (90, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0, 1, 1), (4, 0.0, 20, 0.0, 6, 1.0, 1, 0, 0, 1, 1),
    (9, 0.0, 3, 1.0, 2, 1.0, 1, 0, 1, 1, 1), (25, 0.1, 2, 1.0, 50, 0.0, 1, 0, 0, 1, 1), (12, 0.3, 40, 0.0, 8, 1.0, 1, 0, 0, 1, 1),
    (2, 1.0, 2, 1.0, 3, 1.0, 1, 0, 0, 1, 0), (4, 1.0, 5, 1.0, 2, 1.0, 1, 0, 0, 1, 0), (6, 1.0, 60, 0.0, 5, 1.0, 1, 0, 0, 1, 0),
    (5, 1.0, 4, 1.0, 9, 0.0, 1, 0, 0, 1, 0), (3, 1.0, 3, 1.0, 0, 0.0, 1, 0, 0, 1, 0),
    # outside of the page's article
    (9, 0.0, 1, 1.0, 60, 0.0, 0, 0, 0, 1, 0), (40, 0.0, 1, 1.0, 60, 0.0, 0, 0, 0, 1, 0), (90, 0.0, 70, 0.0, 8, 0.0, 0, 0, 0, 1, 0),
    (5, 0.0, 70, 0.0, 8, 0.0, 0, 0, 1, 1, 0), (2, 1.0, 3, 1.0, 9, 0.0, 0, 0, 0, 1, 0), (20, 0.5, 80, 0.0, 3, 1.0, 0, 0, 0, 1, 0),
    (150, 0.0, 9, 0.0, 12, 0.0, 0, 0, 0, 1, 0), (1, 0.0, 90, 0.0, 14, 0.0, 0, 0, 0, 1, 0), (8, 0.0, 2, 1.0, 40, 0.0, 0, 0, 1, 1, 0),
    # pages that name no article
    (70, 0.0, 60, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (40, 0.1, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 1),
    (60, 0.0, 8, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (150, 0.05, 60, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (25, 0.1, 60, 0.0, 90, 0.0, 0, 0, 0, 0, 1),
    (30, 0.0, 2, 1.0, 40, 0.0, 0, 0, 0, 0, 1), (16, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 1), (12, 0.0, 60, 0.0, 80, 0.0, 0, 0, 0, 0, 1),
    (6, 0.0, 60, 0.0, 80, 0.0, 0, 0, 0, 0, 1), (1, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (7, 0.0, 2, 1.0, 50, 0.0, 0, 0, 1, 0, 1),
    (5, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1, 0, 1), (12, 0.0, 9, 0.0, 11, 0.0, 0, 0, 0, 0, 1), (25, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (5, 0.6, 2, 1.0, 60, 0.0, 0, 0, 0, 0, 0),
    (30, 0.9, 20, 0.0, 4, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (4, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 0, 0),
    (18, 0.7, 50, 0.0, 40, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 60, 0.0, 2, 1.0, 0, 0, 0, 0, 0), (8, 1.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
]

# The same blocks in what surely is an aside are dropped, and those to be dropped are so where there is a hint, too.
LABELLED += [(*row[:7], 2, *row[8:10], 0) for row in LABELLED if row[7] == 0]
LABELLED += [(*row[:7], 1, *row[8:]) for row in LABELLED if row[7] == 0 and not row[10]]


def features(page_blocks: list[Block]) -> np.ndarray:
    """One row of :data:`FEATURES` for each block; at the page's ends the missing neighbour is 0."""
    size = len(page_blocks)
    table = np.zeros((size, len(FEATURES)))
    if not size:
        return table
    words = np.array([block.words for block in page_blocks], float)
    density = np.array([block.linked for block in page_blocks], float) / words
    table[:, 0], table[:, 1] = words, density
    table[1:, 2], table[1:, 3] = words[:-1], density[:-1]
    table[:-1, 4], table[:-1, 5] = words[1:], density[1:]
    table[:, 6] = [block.article for block in page_blocks]
    table[:, 7] = [block.aside for block in page_blocks]
    table[:, 8] = [block.heading for block in page_blocks]
    table[:, 9] = table[:, 6].any()
    return table


def train_tree(rows: np.ndarray, wanted: np.ndarray, depth: int = 8):
    """A binary tree by Gini impurity: ``(feature, threshold, low, high)``, or a leaf's answer."""
    share = wanted.mean()
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for threshold in (values[:-1] + values[1:]) / 2:
            low = rows[:, feature] <= threshold
            parts = [wanted[low], wanted[~low]]
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in parts)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, float(threshold), low)
    if best is None:
        return bool(share >= 0.5)
    _, feature, threshold, low = best
    return (feature, threshold, train_tree(rows[low], wanted[low], depth - 1), train_tree(rows[~low], wanted[~low], depth - 1))


def decide(tree, rows: np.ndarray) -> np.ndarray:
    """The tree's answer for each row."""
    if isinstance(tree, bool):
        return np.full(len(rows), tree)
    feature, threshold, low_tree, high_tree = tree
    low = rows[:, feature] <= threshold
    out = np.empty(len(rows), bool)
    out[low] = decide(low_tree, rows[low])
    out[~low] = decide(high_tree, rows[~low])
    return out


def labelled_tree():
    table = np.array(LABELLED, float)
    return train_tree(table[:, :-1], table[:, -1])


def main_text(page: str | None, tree) -> str:
    """The kept blocks of a page, joined by line feeds."""
    found = blocks_of(page or "")
    return "\n".join(block.text for block, keep in zip(found, decide(tree, features(found)), strict=True) if keep)


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` and ``text``, the main text of each row's page."""
    rows = pages.select(*keep, pages[html].alias("_html"))
    tree = labelled_tree()

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "_html"):
            texts = [main_text(page, tree) for page in block.column("_html").to_pylist()]
            kept = [block.column(name) for name in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*keep, "text"])

    kept = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in keep)
    return rows.mapInArrow(extract, f"{kept}, text string")
