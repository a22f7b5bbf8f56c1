"""Main text of web pages: flat blocks, word counts and link densities of neighbours, a decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesift.llm.common import strings

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

#: Elements that begin or end a block (fixed values of the HTML standard).
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th
thead title tr ul""".split())
#: Elements without content (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math canvas iframe object audio video head title textarea select button datalist".split())
#: Silent elements whose content is raw up to the end tag.
RAW = frozenset("script style noscript template iframe textarea title".split())
#: What a container's element or its class, id or role says about the blocks in it.
KINDS = ("nav", "header", "footer", "aside", "advert", "notice", "comment", "form", "share")
_NAMES = {
    "nav": r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toc|topbar|tabs|skip|skiplink",
    "header": r"header|masthead|banner|branding|logo",
    "footer": r"footer|copyright|colophon",
    "aside": r"aside|sidebar|rail|widget|related|recommended|recommendations|trending|popular|complementary|teasers?",
    "advert": r"ads?|advert|advertisement|adverts|advertising|adbox|sponsor|sponsored|promo|promoted|promotion|outbrain|taboola|affiliate|dfp|gpt",
    "notice": r"notice|cookie|cookies|consent|gdpr|privacy|alert|popup|modal|overlay|paywall|disclaimer|dialog|toast|warning|banner-text|announcement",
    "comment": r"comments?|commentlist|replies|reply|respond|discussion|disqus|reviews?|responses",
    "form": r"form|login|signup|signin|subscribe|subscription|newsletter|search|searchbox|contact",
    "share": r"share|social|sharing|tags|meta|byline|follow|likes|toolbar|rating",
}
_ELEMENTS = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "notice"}
_MAIN = r"article|main|content|post|entry|story|articlebody|body|text"
_WORD = re.compile(r"[a-z]+")


@cache
def _names() -> dict[str, int]:
    """Each class word's bit: of a kind, or the bit after those for main content."""
    out: dict[str, int] = {}
    for k, kind in enumerate(KINDS):
        for name in _NAMES[kind].replace("?", "").split("|"):
            out[name] = out.get(name, 0) | 1 << k
    for name in ("comments", "comment", "breadcrumbs", "breadcrumb", "ad", "ads", "teaser", "teasers", "review", "reviews"):
        out[name] = out.get(name, out.get(name + "s", 0))
    for name in _MAIN.split("|"):
        out[name] = out.get(name, 0) | 1 << len(KINDS)
    return out


def _hints(tag: str, attributes: str) -> int:
    bits = 1 << KINDS.index(_ELEMENTS[tag]) if tag in _ELEMENTS else 0
    if tag in ("article", "main"):
        bits |= 1 << len(KINDS)
    if attributes and tag not in ("body", "html"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "style" and "display" in value and "none" in value):
                bits |= 1 << KINDS.index("notice")
            elif name != "style":
                for word in _WORD.findall(value.replace("articlebody", "main")):
                    bits |= _names().get(word, 0)
    return bits


@dataclass
class Block:
    text: str
    words: int
    links: float
    hints: int
    heading: bool


def blocks(page: str) -> list[Block]:
    """The page's flat text blocks in order: what stands between two block elements, with its link density and containers' hints."""
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link, heading = 0, 0, False
    stack: list[tuple[str, int]] = []
    hints = 0
    silent = 0

    def close() -> None:
        nonlocal linked, heading
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            n = len(text.split())
            out.append(Block(text, n, min(linked / n, 1.0), hints, heading))
        linked, heading = 0, False

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not silent:
            parts.append(piece)
            if in_link:
                linked += len(html.unescape(piece).split())

    at, size = 0, len(page)
    while at < size:
        found = _MARKUP.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        if found["cdata"] is not None:
            text(html.escape(found["cdata"]))
        if found["tag"] is None:
            continue
        tag, ends = found["tag"].lower(), bool(found["end"])
        if tag in RAW and not ends:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else (size if tag in ("script", "style") else at)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = 0 if ends else 1
            continue
        if tag in BLOCK:
            close()
            in_link = 0
            heading = not ends and tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag in VOID:
            continue
        if not ends:
            if tag == "body":
                stack.clear()
            if tag == "p":  # a paragraph ends the one before
                _pop(stack, "p", ("div", "section", "article", "td", "li", "blockquote", "body"))
            if tag in BLOCK or tag in SILENT:
                stack.append((tag, _hints(tag, found["attrs"])))
        elif tag in BLOCK or tag in SILENT:
            _pop(stack, tag, ())
        hints = 0
        inside = 1 << len(KINDS)
        for name, bits in stack:
            hints |= bits & ~(_HEADER if hints & inside and name != "footer" else 0)
        silent = sum(name in SILENT for name, _ in stack)
    close()
    return out


_HEADER = 1 << KINDS.index("header")


def _pop(stack: list[tuple[str, int]], tag: str, until: tuple[str, ...]) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == tag:
            del stack[k:]
            return
        if stack[k][0] in until:
            return


def features(all_blocks: list[Block]) -> np.ndarray:
    """Per block: words and link density of the one before, itself and the one after; hinted kinds; main container; heading."""
    n = len(all_blocks)
    words = np.array([0] + [b.words for b in all_blocks] + [0], float)
    links = np.array([0] + [b.links for b in all_blocks] + [0], float)
    kinds = np.array([(b.hints & ((1 << len(KINDS)) - 1)).bit_count() for b in all_blocks], float)
    main = np.array([b.hints >> len(KINDS) & 1 for b in all_blocks], float)
    heading = np.array([b.heading for b in all_blocks], float)
    return np.column_stack([words[:n], words[1 : n + 1], words[2:], links[:n], links[1 : n + 1], links[2:], kinds, main, heading])


#: Labelled blocks: words before, own, after; link density before, own, after; kinds hinted; main container; heading; 1 for main text.
LABELLED = """
0 6 6 0 1 1 1 0 0 0|6 6 6 1 1 1 1 0 0 0|6 1 12 1 1 0 0 0 0 0|1 1 1 1 1 1 0 0 0 0|4 2 20 1 0.5 0 0 0 0 0|0 3 1 0 1 1 0 0 0 0
1 8 60 1 0 0 0 1 1 1|0 9 45 0 0 0 0 1 1 1|0 5 80 0 0 0 0 0 1 1|12 7 30 0 0 0 0 0 1 1|40 4 50 0 0 0 0 1 1 1|6 10 3 0 0 0 0 1 1 1
8 60 40 0 0 0 0 1 0 1|60 3 55 0 0 0 0 1 0 1|55 120 10 0 0.1 0 0 1 0 1|30 1 40 0 0 0 0 1 0 1|20 2 8 0 0 0 0 1 0 1|9 4 0 0 0 0 0 1 0 1
70 15 6 0 0 0.2 0 1 0 1|3 2 5 0 0 0 0 1 0 1|5 25 30 0 0.3 0 0 1 0 1|10 12 9 0 0 1 0 1 0 1|0 4 0 0 0 0 0 1 0 1|40 6 4 0 1 1 0 1 0 0
50 80 60 0 0 0 0 0 0 1|20 45 70 0 0.05 0 0 0 0 1|10 30 25 0 0 0.1 0 0 0 1|0 60 0 0 0 0 0 0 0 1|1 35 90 1 0.1 0 0 0 0 1|45 18 40 0 0 0 0 0 0 1
80 11 60 0 0 0 0 0 0 1|60 16 2 0 0 1 0 0 0 1|30 5 40 0 0 0 0 0 0 1|70 3 3 0 0 1 0 0 0 0|2 4 3 0 0 0 0 0 0 0|3 5 2 1 0 1 0 0 0 0
4 3 4 1 0.3 1 0 0 0 0|60 9 8 0 0.9 1 0 0 0 0|30 14 12 0 0.7 0.8 0 0 0 0|2 30 3 1 0.8 1 0 0 0 0|1 12 50 1 0 0 1 0 0 0|50 12 1 0 0 1 1 0 0 0
0 20 9 0 0 0 1 0 0 0|60 40 35 0 0 0 1 0 0 0|70 12 0 0 0 0 1 0 0 0|30 6 0 0 0.2 0 1 0 0 0|6 18 60 1 0 0 1 0 0 0|40 25 30 0 0 0 2 0 0 0
30 50 20 0 0 0 1 1 0 0|25 8 40 0 0 0 1 1 0 0|9 30 5 0 0 0 2 1 0 0|80 60 70 0 0 0 1 1 0 0|12 4 30 0 0 0 1 1 1 0|5 6 9 0 0 0 1 0 1 0
30 3 8 0 0 0.5 2 0 1 0|0 4 6 0 0 1 1 0 1 0|60 5 4 0 0 1 1 0 0 0|8 90 70 0 0 0 1 0 0 0|2 3 0 0 0 0 1 0 0 0|40 7 0 0 0.6 0 1 0 0 0
"""


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    share: float = 0.0

    def keep(self, rows: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(rows), self.share >= 0.5)
        below = rows[:, self.feature] <= self.cut
        out = np.empty(len(rows), bool)
        out[below], out[~below] = self.low.keep(rows[below]), self.high.keep(rows[~below])
        return out


def grown(rows: np.ndarray, labels: np.ndarray, depth: int = 5) -> Tree:
    """A tree by the Gini index; of equal splits the first feature's smallest cut."""
    share = float(labels.mean()) if len(labels) else 0.0
    best = (2 * share * (1 - share) * len(labels) - 1e-9, -1, 0.0)
    if depth and 0 < share < 1:
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                below = rows[:, f] <= cut
                cost = sum(2 * s.mean() * (1 - s.mean()) * len(s) for s in (labels[below], labels[~below]))
                if cost < best[0] - 1e-9:
                    best = (cost, f, float(cut))
    if best[1] < 0:
        return Tree(share=share)
    below = rows[:, best[1]] <= best[2]
    return Tree(best[1], best[2], grown(rows[below], labels[below], depth - 1), grown(rows[~below], labels[~below], depth - 1), share)


def trained(table: str = LABELLED) -> Tree:
    rows = np.array([[float(x) for x in row.split()] for row in table.strip().replace("\n", "|").split("|")])
    return grown(rows[:, :-1], rows[:, -1])


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(b.text for b, keep in zip(found, tree.keep(features(found)), strict=True) if keep)


def extracted(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every row: the page's main text, whole.

    Blocks are what stands between block elements; character references are
    decoded, white space in a block becomes one space, kept blocks are joined in
    page order by an empty line. Null or empty pages, and pages without main
    text, give an empty text. Broken or truncated markup is read as far as it
    goes. Repeated rows give equal rows; further columns are ignored; an empty
    table gives no rows.
    """
    model = tree or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, model) for p in strings(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
