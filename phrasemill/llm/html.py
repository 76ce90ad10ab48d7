"""Main text of web pages: the maximum-scoring contiguous region of a page's tokens.

A page is a sequence of words and tags. Words score positive; tags negative, the run of them between two words
no more than RUN; and words that cannot be the article's negative: those of page furniture (nav, header, footer),
of menus (blocks of nothing but links, side by side) and, on a page that marks its article or main part, all
words outside it. The weights are log-odds fitted on labelled pages. One linear scan finds the contiguous region
of the largest sum, and the blocks in it are the text, without containers of other matter (adverts, asides,
forms, notices, comments, scripts and the like, by tag, role, class or id), which score like a run of tags: they
interrupt a text and do not end it. So a block of one word or more in the article's flow always raises the
sum, and nothing else is dropped.

Defined results: null html is empty; a page without a positive region has an empty text; where all words
stand in containers that only a doubtful name (SOFT) marks, these count as text; markup that never ends is
closed at the end of the page; ties go to the first region; very long and deep pages take time linear in
their length; repeated rows are extracted one by one; an empty table gives an empty result. Other columns do
not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm.html_labels import LABELLED
from phrasemill.session import table

# Element and class names of HTML pages.
RAW = frozenset("script style noscript template iframe svg math textarea object canvas xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE_TAGS = frozenset("nav header footer".split())
OTHER = frozenset("head title aside form button select label input dialog menu".split())
CENTRAL = frozenset(("article", "main"))
FURNITURE_ROLES = frozenset("navigation banner contentinfo menu menubar".split())
OTHER_ROLES = frozenset("complementary search dialog alert alertdialog".split())
STATES = frozenset("has no not with without is are open closed enabled disabled free layout".split())
OTHER_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising promo promotion sponsor sponsored banner cookie cookies consent gdpr notice notices notification alert "
    "newsletter subscribe signup login comment comments reply replies respond disqus sidebar widget widgets related recommended share sharing social nav navbar "
    "navigation menu breadcrumb breadcrumbs footer header masthead topbar toolbar popup modal overlay pagination pager skip paywall toc tags trending popular".split()
)
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table div section article main body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_NAME = re.compile(r"[a-z]+")
# Class names and ids that only ever mean other matter, even where nothing else is there. Names that say something
# of a page's main part ("has-sidebar", "comments-open") hold a word of STATES; other names with one of
# OTHER_NAMES are doubtful.
_SURE = re.compile(
    r"(?:(?:the|user|reader|post|article|page|entry|blog)[-_]+)?(?:ads?|adverts?|advertisements?|cookies?|comments?|reply|replies|respond|disqus|related|recommended)"
    r"(?:[-_]+(?:list|section|area|threads?|wrap|wrapper|container|box|block|body|content|items?|posts|articles|stories|links|slot|unit|banner|notice|bar|consent|\d+))*|adbox|sidebar"
)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
FURNITURE, HARD, SURE, SOFT = 4, 3, 2, 1
RUN = 0.4  # what the tags between two words cost at most; less than a word scores at least


def _kind(tag: str, attributes: str, central: bool) -> int:
    """Whether an element holds other matter: FURNITURE or HARD by its tag or role, SURE or SOFT by its class or id."""
    if tag in FURNITURE_TAGS and not (central and tag == "header"):
        return FURNITURE
    if tag in OTHER:
        return HARD
    if not attributes or tag in ("html", "body") or tag in CENTRAL and "comment" not in attributes.lower():
        return 0
    kind = 0
    for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if hidden or name == "aria-hidden" and value == "true" or name == "role" and value in OTHER_ROLES or name == "style" and "display:none" in value.replace(" ", ""):
            return HARD
        if name == "role" and value in FURNITURE_ROLES:
            return FURNITURE
        if name in ("class", "id"):
            for one in value.split():
                words = _NAME.findall(one)
                if not OTHER_NAMES.isdisjoint(words) and STATES.isdisjoint(words):
                    kind = max(kind, SURE if _SURE.fullmatch(one) else SOFT)
    return kind


class Page:
    """Blocks of text and the elements they stand in. events: (element, words, block, ""), or of a tag
    (element, 0, -1, its class)."""

    def __init__(self, html: str):
        self.events: list[tuple[int, int, int, str]] = []
        self.blocks: list[list[str]] = []
        self.owner: list[int] = []  # of a block: its innermost element
        self.parent, self.tag, self.kind, self.link, self.titled = [-1], [""], [0], [False], [False]
        stack, fresh = [0], True
        depths: dict[str, list[int]] = defaultdict(list)  # of a tag: where in the stack it is open
        scopes = [0]
        at, n = 0, len(html)

        def say(text: str) -> None:
            nonlocal fresh
            if not text:
                return
            here = stack[-1]
            if "&" in text:
                text = unescape(text)
            words = len(text.split())
            if fresh:
                if not words:
                    return
                self.blocks.append([])
                self.owner.append(here)
                fresh = False
            self.blocks[-1].append(text)
            if words:
                self.events.append((here, words, len(self.blocks) - 1, ""))

        def close(depth: int) -> None:
            while len(stack) > depth:
                name = self.tag[stack.pop()]
                depths[name].pop()
                if name in SCOPE:
                    scopes.pop()

        while at < n:
            found = _TOKEN.search(html, at)
            if not found:
                say(html[at:])
                break
            say(html[at : found.start()])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            closing, attributes = found[1] or found[4], found[3] or found[6] or ""
            if tag in BLOCK:
                fresh = True
            self.events.append((stack[-1], 0, -1, _tag_class(tag)))
            if closing:
                if depths[tag]:
                    close(depths[tag][-1])
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else n
                continue
            if tag in VOID:
                continue
            for old in CLOSES.get(tag, ()):
                if depths[old] and depths[old][-1] > scopes[-1]:
                    close(depths[old][-1])
            kind = _kind(tag, attributes, bool(depths["article"] or depths["main"]))
            up = stack[-1]
            self.parent.append(up)
            self.tag.append(tag)
            self.kind.append(kind)
            self.link.append(tag == "a")
            self.titled.append(tag in CENTRAL and not kind or tag == "h1")
            depths[tag].append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            stack.append(len(self.tag) - 1)
        for e in stack:
            self.link[e] = False  # never closed
        for e in range(1, len(self.tag)):
            self.link[e] |= self.link[self.parent[e]]
        for e in range(len(self.tag) - 1, 0, -1):
            self.titled[self.parent[e]] |= self.titled[e]
        self.plain = [False] * len(self.blocks)  # whether it has words outside links
        for e, words, block, _ in self.events:
            if words and not self.link[e]:
                self.plain[block] = True

    def marks(self, doubtful: bool) -> tuple[list[int], list[bool]]:
        """Of each element: what other matter it is or stands in (0: none), SOFT ones included if doubtful;
        and whether it is or stands in the article or main part."""
        other, main = [0] * len(self.tag), [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            up, kind = self.parent[e], self.kind[e]
            if kind <= SURE and (self.titled[e] or kind == SOFT and not doubtful):
                kind = 0
            other[e] = other[up] or kind
            main[e] = not other[e] and (main[up] or self.tag[e] in CENTRAL)
        return other, main

    def text(self, block: int) -> str:
        return " ".join("".join(self.blocks[block]).split())

    def classes(self, doubtful: bool = True) -> tuple[list[str], list[bool]]:
        """The class of each event, and of each block whether it may be text."""
        other, main = self.marks(doubtful)
        marked = any(main[self.owner[b]] for b in range(len(self.blocks)))
        clear = [not other[e] and (main[e] or not marked) for e in self.owner]
        menu = [False] * len(self.blocks)
        if not marked:
            open_ = [b for b in range(len(self.blocks)) if clear[b]]
            for a, b in zip(open_, open_[1:], strict=False):
                if not self.plain[a] and not self.plain[b]:
                    menu[a] = menu[b] = True
        out = []
        for e, words, block, tag in self.events:
            if other[e]:
                aside = marked and main[self.parent[e]] or other[e] != FURNITURE
                out.append("tag:other" if aside or not words else "word:furniture")
            elif not words:
                out.append(tag)
            elif marked and not main[e]:
                out.append("word:outside")
            else:
                out.append("word:menu" if menu[block] else "word:link" if self.link[e] else "word")
        return out, [c and not m for c, m in zip(clear, menu, strict=True)]


def _tag_class(tag: str) -> str:
    if tag in ("p", "br", "blockquote", "pre"):
        return "tag:p"
    if tag in ("li", "ul", "ol", "dl", "dt", "dd"):
        return "tag:list"
    if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
        return "tag:heading"
    if tag == "a":
        return "tag:link"
    return "tag:block" if tag in BLOCK else "tag:inline"


@cache
def weights() -> dict[str, float]:
    """Log-odds of each token class inside against outside the main text of the labelled pages (one added
    to each count), held between 0.5 and 1 for the words that may be text, between -0.1 and -0.01 for tags, and at
    -0.5 or less for other words."""
    inside, outside = Counter(), Counter()
    for html, first, last in LABELLED:
        page = Page(html)
        texts = [page.text(b) for b in range(len(page.blocks))]
        a = next(b for b, t in enumerate(texts) if t.startswith(first[:40]))
        z = max(b for b, t in enumerate(texts) if t.endswith(last[-40:]))
        block = -1
        for (_, words, own, _), c in zip(page.events, page.classes()[0], strict=True):
            block = max(block, own)
            (inside if a <= block <= z else outside)[c] += max(1, words)
    total_in, total_out = sum(inside.values()), sum(outside.values())
    out = {}
    for c in ("word", "word:link", "word:menu", "word:furniture", "word:outside", "tag:p", "tag:list", "tag:heading", "tag:link", "tag:block", "tag:inline", "tag:other"):
        odds = math.log((inside[c] + 1) / (total_in + 10)) - math.log((outside[c] + 1) / (total_out + 10))
        out[c] = min(1.0, max(0.5, odds)) if c in ("word", "word:link") else min(-0.01, max(-0.1, odds)) if c[0] == "t" else min(-0.5, odds)
    return out


def scores(page: Page, classes: list[str]) -> list[float]:
    """The score of each event; a run of tags costs RUN at most."""
    weight, out, left = weights(), [], RUN
    for (_, words, _, _), c in zip(page.events, classes, strict=True):
        if c[0] == "t":
            cost = min(left, -weight[c])
            left -= cost
            out.append(-cost)
        else:
            left = RUN
            out.append(weight[c] * words)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run of the largest positive sum (the first of equals); (0, 0) if none."""
    best, at, total, region = 0.0, 0, 0.0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, at = 0.0, i
        total += s
        if total > best:
            best, region = total, (at, i + 1)
    return region


def extract(html: str | None) -> str:
    page = Page(html or "")
    for doubtful in (True, False):
        classes, clear = page.classes(doubtful)
        start, end = best_region(scores(page, classes))
        if start < end:
            chosen = dict.fromkeys(block for _, _, block, _ in page.events[start:end] if block >= 0 and clear[block])
            return "\n".join(map(page.text, chosen))
    return ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
