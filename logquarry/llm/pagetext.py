"""Main text of web pages by tag-path ratios.

A page is cut into blocks (text between block-level tags), each with its path of block-level tags
from the root. Blocks under markup that names menus, page headers, footers, sidebars, notices,
adverts, forms or reader comments are no candidates. For each path the text length and punctuation
of its blocks are added up and divided by their number; both ratios are smoothed over the page in
the order of its blocks and fused, and paths whose fused ratio passes a threshold are content.
The content region is the deepest element that holds nearly all text of those paths, or the
``article`` around it; inside it all candidates stay (headings, short paragraphs), but paths that
are mostly links.

Pages are independent, so the work is one narrow pass; a task holds one batch of pages.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import arrow_batches

# Elements of the HTML language by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
SCOPE = tuple("html body table td th caption button select".split())
_LISTS = tuple("ul ol dl menu table select section article div body td th".split())
_ROWS, _TABLE = ("tr", "td", "th"), ("table",)
# a start tag ends the outermost open element of these names above the nearest of those bounds
ENDS = {
    "li": (("li",), _LISTS), "dt": (("dt", "dd"), _LISTS), "dd": (("dt", "dd"), _LISTS), "option": (("option",), ("select",)),
    "td": (("td", "th"), (*_TABLE, "tr")), "th": (("td", "th"), (*_TABLE, "tr")), "tr": (_ROWS, _TABLE), "tbody": (("tbody", "thead", "tfoot", *_ROWS), _TABLE),
    "thead": (("tbody", "thead", "tfoot", *_ROWS), _TABLE), "tfoot": (("tbody", "thead", "tfoot", *_ROWS), _TABLE),
}
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
# never part of the text, whatever stands in them
HIDDEN = frozenset(
    "head script style noscript template iframe svg math object canvas audio video select textarea button noembed noframes "
    "xmp title datalist dialog".split()
)
# elements that are named for what is no article
ASIDE = frozenset("nav footer aside form menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# words in class names and ids of what is no article
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner nav navi "
    "navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices "
    "notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments commentlist disqus reply replies respond discussion search searchbox form toolbar "
    "pagination pager copyright skip disclaimer widget widgets teaser teasers trending".split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table tbody thead tfoot tr th caption blockquote pre address figure figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_PLAIN = re.compile(r"[^>\"']*")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*)")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?=[\s=/>]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WHOLE_PAGE = re.compile(r"aspnetform", re.I)  # such a form holds the whole page
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NOT_WORD = re.compile(r"[^a-z0-9]+")
_PUNCT = re.compile(r"[.,;:!?…。、，；：！？«»“”\"()]")


@dataclass(frozen=True)
class Settings:
    """Rows of the smoothing to each side, its width, the share of the best fused ratio that makes a path
    content, the share of content text that the region must hold, and the share of link text of a menu."""

    radius: int = 2
    sigma: float = 1.0
    threshold: float = 0.15
    hold: float = 0.9
    links: float = 0.6


@dataclass
class Block:
    """Text between block-level tags, with the numbers of its tag path and of the element it stands in."""

    path: int
    element: int
    tag: str
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _labelled(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether a start tag names something that is no article text."""
    if (tag in ASIDE and not (tag == "form" and _WHOLE_PAGE.search(attrs))) or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            return True
        if name == "aria-hidden":
            if value.lower() == "true":
                return True
        elif name == "style":
            if _NONE.search(value):
                return True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        else:
            known = COMMENTS if tag == "article" else LABELS
            for one in value.split():
                words = _NOT_WORD.split(_CAMEL.sub("-", one).lower())
                words = [w for w in words if w]
                # the last word of a name says what a thing is, the first one what it belongs to
                if words and (words[-1] in known or (words[0] in known and words[-1] not in ("content", "article", "body", "text"))) and words[0] not in ("has", "no", "with", "without", "is"):
                    return True
    return False


class _Page:
    """One pass over the tags of a page.

    Open elements are a stack; ``open`` has the places of each name in it, so every lookup is short
    however deep a page nests. Paths and elements are numbered as they appear, parents before children.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int, bool, bool]] = []  # tag, path and element before it, skipped, block level
        self.open: dict[str, list[int]] = {}
        self.levels: list[int] = [-1]  # places of block-level elements in the stack
        self.paths: dict[tuple[int, str], int] = {}
        self.tags = [""]
        self.parents = [0]
        self.named = [""]  # tags of the elements
        self.path, self.element, self.skip, self.links = 0, 0, 0, 0
        self.blocks: list[Block] = []
        self.now: Block | None = None

    def text(self, raw: str) -> None:
        if self.skip:
            return
        if self.now is None:
            if not raw.strip():
                return
            self.now = Block(self.path, self.element, self.tags[self.path])
            self.blocks.append(self.now)
        said = html.unescape(raw) if "&" in raw else raw
        self.now.parts.append(said)
        if self.links:
            self.now.linked += len(said)

    def start(self, tag: str, attrs: str) -> None:
        if self.open.get("head") and tag not in IN_HEAD:
            self._back_to(self.open["head"][0])
        if tag in CLOSES_P:
            self._close(("p",), SCOPE)
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag == "br":
            if self.now is not None:
                self.now.parts.append(" ")
            return
        block = tag in BLOCK
        if block:
            self.now = None
        if tag in VOID:
            return
        skipped = tag in HIDDEN or _labelled(tag, attrs, bool(self.open.get("article") or self.open.get("main")))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, self.path, self.element, skipped, block))
        self.skip += skipped
        self.links += tag == "a"
        if block:
            self.levels.append(len(self.stack) - 1)
            key = (self.path, tag)
            if key not in self.paths:
                self.paths[key] = len(self.tags)
                self.tags.append(tag)
            self.path = self.paths[key]
            self.parents.append(self.element)
            self.named.append(tag)
            self.element = len(self.parents) - 1

    def _back_to(self, place: int) -> None:
        while len(self.stack) > place:
            tag, path, element, skipped, block = self.stack.pop()
            self.open[tag].pop()
            self.skip -= skipped
            self.links -= tag == "a"
            if block:
                self.levels.pop()
                self.path, self.element, self.now = path, element, None

    def _close(self, names: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """End the outermost open element of ``names`` above the nearest one of ``bounds``."""
        bound = max((self.open[b][-1] for b in bounds if self.open.get(b)), default=-1)
        found = [places[k] for n in names if (places := self.open.get(n)) and (k := bisect_right(places, bound)) < len(places)]
        if found:
            self._back_to(min(found))

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        elif self.open.get(tag):
            place = self.open[tag][-1]
            # an inline end tag does not reach out of the block it stands in
            if tag in BLOCK or place > self.levels[-1]:
                self._back_to(place)
        elif tag in BLOCK:
            self.now = None


def blocks_of(page: str) -> tuple[list[Block], list[int], list[str]]:
    """Candidate blocks of a page in order, and of each element its parent and tag."""
    at, n, out = 0, len(page), _Page()
    lost: set[str] = set()  # what does not come any more

    def find(what: str, start: int) -> int:
        k = -1 if what in lost else page.find(what, start)
        if k < 0:
            lost.add(what)
        return k

    while at < n:
        k = find("<", at)
        if k < 0:
            out.text(page[at:])
            break
        m = _TAG.match(page, k)
        if m is None:
            sign = page[k + 1 : k + 2]
            plain = sign not in ("!", "?", "/") or not sign
            out.text(page[at : k + 1] if plain else page[at:k])
            if plain:  # a sign of the text
                at = k + 1
                continue
            end = find("-->", k + 2) + 2 if page.startswith("<!--", k) and not page.startswith("<!-->", k) else find(">", k)
            at = n if end < k else end + 1
            continue
        out.text(page[at:k])
        end = m.end()
        while end < n and page[end] != ">":  # at a quote
            close = find(page[end], end + 1)
            end = _PLAIN.match(page, (end if close < 0 else close) + 1).end()
        tag, attrs = m[2].lower(), page[m.start(3) : end]
        at = min(n, end + 1)
        if m[1]:
            out.end(tag)
            continue
        out.start(tag, attrs)
        if tag in RAW:
            close = None if tag in lost else _RAW_END[tag].search(page, at)
            if close:
                at = close.start()
                continue
            lost.add(tag)
            if tag in ("script", "style"):
                break
            out.end(tag)
    for b in out.blocks:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out.blocks if b.text], out.parents, out.named


def _smooth(values: list[float], s: Settings) -> list[float]:
    """Gaussian mean over the neighbouring blocks."""
    weight = [math.exp(-(k * k) / (2 * s.sigma * s.sigma)) for k in range(-s.radius, s.radius + 1)]
    out = []
    for i in range(len(values)):
        near = [(weight[k + s.radius], values[i + k]) for k in range(-s.radius, s.radius + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def path_scores(blocks: list[Block], s: Settings) -> dict[int, float]:
    """Fused ratio of each path: text and punctuation for each block, smoothed over the page."""
    length: dict[int, int] = {}
    punct: dict[int, int] = {}
    count: dict[int, int] = {}
    for b in blocks:
        length[b.path] = length.get(b.path, 0) + max(0, len(b.text) - b.linked)
        punct[b.path] = punct.get(b.path, 0) + (len(_PUNCT.findall(b.text)) if b.linked < s.links * len(b.text) else 0)
        count[b.path] = count.get(b.path, 0) + 1
    text = _smooth([length[b.path] / count[b.path] for b in blocks], s)
    marks = _smooth([punct[b.path] / count[b.path] for b in blocks], s)
    fused: dict[int, float] = {}
    for b, t, m in zip(blocks, text, marks, strict=True):
        fused[b.path] = fused.get(b.path, 0.0) + t * (1 + m)
    # what the path has itself counts too, so that a neighbour alone lifts no menu
    return {p: math.sqrt(f / count[p] * (length[p] / count[p]) * (1 + punct[p] / count[p])) for p, f in fused.items()}


def content_blocks(blocks: list[Block], parents: list[int], named: list[str], s: Settings) -> list[Block]:
    """Blocks of the content region, in order."""
    if not blocks:
        return []
    scores = path_scores(blocks, s)
    best = max(scores.values())
    # where all text is links, every path ties at 0
    chosen = {p for p, v in scores.items() if v >= s.threshold * best}
    held = [0] * len(parents)
    for b in blocks:
        held[b.element] += len(b.text) if b.path in chosen else 0
    for e in range(len(parents) - 1, 0, -1):
        held[parents[e]] += held[e]
    # elements that hold so much lie on one line from the root, the deepest has the highest number
    region = max(e for e in range(len(parents)) if held[e] >= s.hold * held[0])
    # a paragraph, list or table is part of an article, not its frame; a cell frames if it holds elements
    while named[region] in PARTS or (named[region] == "td" and region not in parents[region + 1 :]):
        region = parents[region]
    up = region
    while up and named[up] != "article":
        up = parents[up]
    region = up or region
    inside = [e == region for e in range(len(parents))]
    for e in range(region + 1, len(parents)):
        inside[e] = inside[e] or inside[parents[e]]
    linked: dict[int, list[int]] = {}
    for b in blocks:
        sums = linked.setdefault(b.path, [0, 0])
        sums[0] += b.linked
        sums[1] += len(b.text)
    menu = {p for p, (a, t) in linked.items() if p not in chosen and a >= s.links * t}
    at = [i for i, b in enumerate(blocks) if inside[b.element] and b.path not in menu]
    # a title may stand right before the region
    while at and at[0] and blocks[at[0] - 1].tag in HEADINGS:
        at.insert(0, at[0] - 1)
    return [blocks[i] for i in at]


def main_text(page: str, settings: Settings = Settings()) -> str:
    """Main text of one page, blocks in order joined by a blank."""
    return " ".join(b.text for b in content_blocks(*blocks_of(page), settings))


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).

    A null or empty page, or one without candidates, has an empty text. Each row is read on its own,
    so repeated rows and null ids stay as they are; other columns are ignored.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h or "", settings) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts}

    table = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = table.mapInArrow(arrow_batches(run, schema), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
