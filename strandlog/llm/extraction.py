"""Main text of HTML pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks. Each has its word count, its link
density, those of its two neighbours, whether it ends a sentence or is a
heading, and the zone that it lies in (page furniture, named like furniture,
neither, or article). A decision tree says which blocks are main text. It is
trained when the module is first used, on blocks of pages that a rule composes
from the small table of labelled kinds of blocks below.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select button canvas audio video datalist noframes noembed xmp".split())
CONTAINERS = frozenset("html body div section article main nav aside header footer form fieldset dialog menu ul ol dl table figure details blockquote center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav aside footer dialog menu".split())
# Words in class, id and role that tell page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs complementary contentinfo cookie cookies consent disclaimer footer menu modal "
    "nav navbar navigation newsletter notice notices notification paywall popup promo promoted related search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies".split())
MAIN_WORDS = frozenset("article articlebody main maincontent".split())
# Words that beside one of those in a name leave its meaning as it is ("site-footer", "share-buttons").
NEUTRAL_WORDS = frozenset(
    "area bar body bottom box button buttons container content entry footer form global group header inner item items left link links list menu meta outer page panel post posts primary "
    "right row secondary section sections site slot sticky text thread title top unit wrap wrapper".split()
)

# Possessive, and without "<" outside quotes, so that a page of unclosed tags takes linear time.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\"><])*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"[ \t\n\f\r\v]+")
_WORD_CUT = re.compile(r"[\s_-]+")
_ANCHOR = re.compile(r"<(/?)a(?=[\s>/])", re.IGNORECASE)
# What a sentence ends with.
ENDINGS = (".", "!", "?", ":", ";", "…", '."', ".'", '!"', '?"', ".”", "!”", "?”", ".»", ".)", "。", "！", "？")
# Only elements, roles, hiding and comments make furniture for sure; a class or id may be wrong.
FURNITURE_ZONE, NAMED_ZONE, PLAIN_ZONE, MAIN_ZONE = -1, -0.5, 0, 1

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "ended", "heading", "zone")
# Kinds of blocks, labelled by hand: whether they are main text, their words (least and most), the share of
# words in links (least and most), how often they end a sentence, and whether they are headings.
KINDS = {
    "title": (1, 1, 14, 0.0, 0.0, 0.1, 1), "subtitle": (1, 1, 9, 0.0, 0.0, 0.1, 1), "byline": (1, 1, 6, 0.0, 0.4, 0.0, 0),
    "text": (1, 15, 160, 0.0, 0.35, 0.9, 0), "line": (1, 1, 14, 0.0, 0.2, 1.0, 0), "unended": (1, 20, 120, 0.0, 0.1, 0.0, 0),
    "item": (1, 1, 9, 0.0, 0.0, 0.1, 0), "linked line": (1, 2, 7, 1.0, 1.0, 0.0, 0), "linked text": (1, 3, 60, 0.3, 0.8, 0.8, 0),
    "link": (0, 1, 4, 1.0, 1.0, 0.0, 0), "teaser": (0, 4, 40, 0.6, 1.0, 0.5, 0), "related": (0, 1, 4, 0.0, 0.0, 0.0, 1),
    "slogan": (0, 1, 6, 0.0, 0.0, 0.0, 0), "share": (0, 1, 3, 0.0, 0.0, 0.0, 0), "imprint": (0, 3, 14, 0.0, 0.5, 0.4, 0),
    "notice": (0, 3, 40, 0.0, 0.3, 0.8, 0), "comment": (0, 1, 160, 0.0, 0.1, 0.9, 0), "control": (0, 1, 6, 0.0, 0.6, 0.1, 0),
}
#: Pages composed of them for the table that the tree is trained on, and rows of a leaf, at least.
PAGES, LEAF = 800, 6


def composed(rng: np.random.Generator) -> list[tuple[str, float]]:
    """(kind, zone) of the blocks of a made-up page, from its menu to its imprint."""
    chance, some = (lambda p: rng.random() < p), (lambda low, high: range(int(rng.integers(low, high + 1))))
    pick = lambda *zones: float(rng.choice(zones))
    out: list[tuple[str, float]] = []
    body = pick(PLAIN_ZONE, MAIN_ZONE)
    if chance(0.8):
        zone = pick(FURNITURE_ZONE, NAMED_ZONE, PLAIN_ZONE)
        out += [("link", zone) for _ in some(1, 8)]
        if chance(0.3):
            out += [("slogan", zone)]
    if chance(0.3):
        out += [("notice", pick(FURNITURE_ZONE, NAMED_ZONE)) for _ in some(1, 2)]
    if chance(0.15):  # one short text, and nothing behind it
        return [*out, *[("title", body)] * chance(0.3), *[(str(rng.choice(["text", "line", "unended"])), body) for _ in some(1, 3)]]
    if chance(0.7):
        out += [("title", body)]
        if chance(0.3):
            out += [("byline", body)]
    for part in some(1, 5):
        out += [(str(rng.choice(["text", "text", "text", "line", "unended"])), body) for _ in some(1, 4)]
        if chance(0.15):
            out += [("item", body) for _ in some(2, 6)]
        if chance(0.1):
            out += [("link", pick(NAMED_ZONE, PLAIN_ZONE)), ("text", body)]
        elif chance(0.1):
            out += [("notice", NAMED_ZONE), ("text", body)]
        elif chance(0.4) and body == MAIN_ZONE:
            out += [("item", body)] * chance(0.5) + [(str(rng.choice(["linked line", "linked text", "linked text"])), body)] + [("text", body)] * chance(0.8)
        if chance(0.3):
            out += [("subtitle", body), ("text", body)]
        if chance(0.1):  # named like furniture, but text
            out += [("text long", NAMED_ZONE) for _ in some(1, 3)]
    if chance(0.5):
        zone = pick(FURNITURE_ZONE, NAMED_ZONE, PLAIN_ZONE, body, body)
        out += [("related", zone)] * chance(0.5) + [(str(rng.choice(["link", "teaser"])), zone) for _ in some(2, 5)]
    if chance(0.3):
        zone = pick(FURNITURE_ZONE, NAMED_ZONE, PLAIN_ZONE)
        out += [("share", zone)] + [("link", zone) for _ in some(1, 4)]
    if chance(0.3):
        out += [(str(rng.choice(["comment", "comment", "control"])), FURNITURE_ZONE) for _ in some(1, 5)]
    if chance(0.2):
        out += [("control", NAMED_ZONE) for _ in some(1, 3)]
    if chance(0.6):
        zone = pick(FURNITURE_ZONE, NAMED_ZONE, PLAIN_ZONE)
        out += [("link", zone) for _ in some(1, 4)] + [("imprint", zone)] * chance(0.6)
    return out


def training_table(pages: int = PAGES) -> np.ndarray:
    """Rows of FEATURES and the label of the blocks of composed pages; the same ones each time."""
    rows, rng = [], np.random.default_rng(8)
    for _ in range(pages):
        blocks = [(0, 0.0, 0, 0, 0, 0)]
        for name, zone in composed(rng):
            label, low, high, least, most, ended, heading = KINDS[name.removesuffix(" long")]
            low = 48 if name.endswith(" long") else low
            n = int(round(np.exp(rng.uniform(np.log(low), np.log(high)))))
            share = round(rng.uniform(least, most) * n) / n if rng.random() < 0.5 or least else 0.0
            blocks.append((n, share, rng.random() < ended, heading, zone, label))
        blocks.append(blocks[0])
        rows += [(*here[:2], *before[:2], *after[:2], *here[2:]) for before, here, after in zip(blocks, blocks[1:], blocks[2:], strict=False)]
    return np.array(rows, float)


def _grow(x: np.ndarray, y: np.ndarray, depth: int) -> tuple:
    """A tree by least Gini impurity: (share of 1,) or (feature, cut, low side, high side)."""
    share = float(y.mean())
    if depth == 0 or share in (0, 1):
        return (share,)
    best = (len(y) * share * (1 - share) - 1e-9, None, None)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        values, ones = x[order, k], np.cumsum(y[order])
        low = np.arange(1, len(y))
        able = (values[1:] > values[:-1]) & (low >= LEAF) & (len(y) - low >= LEAF)
        a, b = ones[:-1], ones[-1] - ones[:-1]
        left = np.where(able, a * (1 - a / low) + b * (1 - b / (len(y) - low)), np.inf)
        at = int(np.argmin(left)) if len(left) else 0
        if len(left) and left[at] < best[0] - 1e-12:
            best = (left[at], k, float(values[at] + values[at + 1]) / 2)
    if best[1] is None:
        return (share,)
    side = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[side], y[side], depth - 1), _grow(x[~side], y[~side], depth - 1))


@lru_cache(maxsize=1)
def tree(depth: int = 12) -> tuple:
    table = training_table()
    return _grow(table[:, :-1], table[:, -1], depth)


def is_main(node: tuple, row: tuple) -> bool:
    while len(node) > 1:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node[0] >= 0.5


def _named(tokens: set[str], words: frozenset[str]) -> bool:
    """Whether a whole token is one of words, or is made of them and neutral ones."""
    for token in tokens:
        parts = set(_WORD_CUT.split(token)) - {""}
        if token in words or parts & words and parts <= words | NEUTRAL_WORDS | MAIN_WORDS:
            return True
    return False


def _named_main(tokens: set[str]) -> bool:
    for token in tokens:
        parts = set(_WORD_CUT.split(token)) - {""}
        if _WORD_CUT.sub("", token) in MAIN_WORDS or parts & MAIN_WORDS and not parts & (FURNITURE_WORDS | COMMENT_WORDS):
            return True
    return False


def _zone(name: str, attributes: str, above: float, comments: bool) -> tuple[float, bool]:
    """(zone, inside reader comments) of a container below the zone ``above``."""
    tokens: set[str] = set()
    roles: set[str] = set()
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id", "itemprop"):
                tokens.update(value.split())
            elif key == "role":
                roles.update(value.split())
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                return FURNITURE_ZONE, comments
    main = name in ("article", "main") or bool(roles & MAIN_WORDS) or _named_main(tokens)
    if comments or name not in ("html", "body") and _named(tokens | roles, COMMENT_WORDS):
        return FURNITURE_ZONE, True
    if name in FURNITURE or roles & FURNITURE_WORDS and name not in ("html", "body", "main", "article"):
        return FURNITURE_ZONE, False
    if main:
        return MAIN_ZONE, False
    if name == "header" and above != MAIN_ZONE:
        return FURNITURE_ZONE, False
    if name == "form" or name not in ("html", "body") and _named(tokens, FURNITURE_WORDS):
        return min(above, NAMED_ZONE), False  # some sites put a whole page into one form
    return above, False


def text_blocks(page: str) -> list[tuple]:
    """(text, words, words in links, ends a sentence, heading, zone) of each block with text, in page order."""
    out: list[tuple] = []
    stack: list[tuple[str, float, bool]] = [("", PLAIN_ZONE, False)]
    parts: list[tuple[str, bool]] = []
    heading = link = across = False
    own: float | None = None  # the zone of a block that is no container

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip(" ")
            if text:
                linked = sum(len(html.unescape(p).split()) for p, inside in parts if inside)
                zone = stack[-1][1] if own is None else own
                out.append((text, len(text.split()), linked, text.endswith(ENDINGS), heading, zone))
            parts.clear()

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        if found is None:
            parts.append((page[at:], link))
            break
        if found.start() > at:
            parts.append((page[at : found.start()], link))
        at = found.end()
        if not found[2]:
            continue  # a comment or a declaration
        name, ends = found[2].lower(), bool(found[1])
        if name in RAW:
            if not ends and not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            if name not in ("button", "select", "noscript", "svg", "math"):
                close()
            continue
        if name in INLINE:
            if name == "a":
                link = not ends
                following = _ANCHOR.search(page, at) if link else None
                across = following is not None and bool(following[1])  # one that is never closed ends with its block
            elif name == "br":
                parts.append((" ", link))
            continue
        close()
        link, own = link and across, None
        if name in CONTAINERS:
            if not ends:
                if not found[3].endswith("/"):
                    stack.append((name, *_zone(name, found[3], stack[-1][1], stack[-1][2])))
            elif any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
        elif found[3] and not ends:
            own = _zone(name, found[3], stack[-1][1], stack[-1][2])[0]
        heading = name in HEADINGS and not ends
    close()
    return out


def main_text(page: str, root: tuple | None = None) -> str:
    """The blocks of the page that the tree takes for main text, joined by line feeds."""
    found, root = text_blocks(page), root or tree()
    sizes = [(0, 0.0), *((words, min(linked / words, 1.0)) for _, words, linked, *_ in found), (0, 0.0)]
    return "\n".join(b[0] for k, b in enumerate(found) if is_main(root, (*sizes[k + 1], *sizes[k], *sizes[k + 2], *b[3:])))


def extracted(pages: DataFrame) -> DataFrame:
    """Main text of every row of pages (page_id, url, html).

    Returns a row per input row: page_id, url, text (blocks joined by one line
    feed, white space inside a block one space; empty if there is none),
    n_chars (its code points).

    A null html is empty. Repeated rows are read each, null ids and urls stay
    null. An empty table gives an empty result. Other columns are ignored. No
    row is shuffled; memory is bounded by the longest page.
    """
    root = tree()  # trained once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x or "", root) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
