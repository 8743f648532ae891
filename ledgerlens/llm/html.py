"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass labels each block by itself:
inside a container of page furniture (navigation, footer, adverts, comments, forms ...) or
dense with links it is bad; long with many stop words it is good; what is short or neither is
left open. The second pass gives open blocks the label of the nearest decided neighbours: good
between good ones, bad between bad ones, and in between good only if they read like prose
or are headings before a good block.

Where a page marks its article, that mark is the stronger evidence: blocks outside it are bad,
and open blocks inside it look only at neighbours inside it, with the article's own edges
counting as good. Pages without such a mark rest on the block rules alone.

Words in class, id or role are weaker evidence of furniture than tags, as layouts wear them too
(``layout has-sidebar``). Words behind "has", "no" and the like do not count. A marked article
below such a word counts where it holds more text than the page has otherwise, and its wrappers'
words are then void; without any text elsewhere, good blocks below the fewest such words are.

Cases: a null or empty page, or one without main text, gives an empty text; broken markup is
read as far as it goes; a tag cut off at the end of the page is dropped; repeated rows give
repeated results; other columns of the input are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_batches, texts_of

#: Thresholds of the first pass: lengths in characters, densities as shares.
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
LINKS = 0.4
#: Inside a marked article only list items that are nearly all links are taken for menus.
ARTICLE_LINKS = 0.8

# Tags by their part in a page.
RAW_TAGS = frozenset("script style noscript template svg math iframe object textarea title".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog select button".split())
ARTICLE_TAGS = frozenset("article main".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main "
    "menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())

# Words in class, id or role that mark page furniture or the article.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside "
    "widget related recommended share sharing social comment comments comentarios kommentare "
    "commentaires reply replies disqus respond discussion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login search "
    "pagination pager toolbar complementary contentinfo skip legal disclaimer".split())
ARTICLE_WORDS = frozenset("article articlebody main".split())
# Words before a furniture word that make it a trait of a layout.
TRAIT_WORDS = frozenset("has have no not with without show hide is".split())

# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was be with as by this are at an from or not have he "
    "they which but his her has had were been will would can all there their "
    "der die das und in zu den von mit ist im des ein eine auf für dem nicht sich auch es an als "
    "bei aus nach wie war sind oder wird um "
    "le la les de des et à en un une du que qui est dans pour par sur au avec pas ce il elle plus "
    "son sa ses ne se ou sont "
    "el los las y del al con por para una su lo no se es como más o pero sus le ha si sobre este "
    "entre cuando".split())

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)"
    r"(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[=\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(
    r"(?i)(?:^|[\s/\"'])(class|id|role|itemprop|hidden|aria-hidden)\b"
    r"(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Za-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, OPEN, NEAR = "good", "bad", "open", "near good"
#: Outside all elements.
NOWHERE = ("", False, 0, False, 0)


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    furniture: bool
    article: int
    listed: bool
    heading: bool
    #: Elements around the block that only words mark as furniture.
    worded: int = 0
    label: str = OPEN


def _names_furniture(value: str) -> bool:
    """Whether an attribute's value holds a furniture word that is not a layout's trait."""
    for token in value.split():
        before = ""
        for word in [w.lower() for w in _PART.findall(_HUMP.sub(" ", token))]:
            if word in FURNITURE_WORDS and before not in TRAIT_WORDS:
                return True
            before = word
    return False


def _part_of(name: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether a tag opens page furniture, by itself or by words, and whether it opens the
    article."""
    furniture, worded, article = name in FURNITURE_TAGS, False, name in ARTICLE_TAGS
    for key, *values in _ATTR.findall(attrs) if attrs else ():
        value, key = "".join(values), key.lower()
        if key in ("hidden", "aria-hidden"):
            furniture |= value.lower() in (("true",) if key == "aria-hidden" else ("", "hidden"))
            continue
        parts = {w.lower() for w in _PART.findall(_HUMP.sub(" ", value))} | {value.lower()}
        worded |= _names_furniture(value)
        article |= bool(parts & ARTICLE_WORDS) if key in ("role", "itemprop") else False
    if name in ("html", "body"):
        furniture = worded = False
    return furniture, worded, article and not furniture


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order, furniture and articles settled."""
    found: list[Block] = []
    # Open elements that matter: (name, furniture, article number, listed, worded).
    stack: list[tuple[str, bool, int, bool, int]] = []
    # By article number: words around it and on it, and whether some are on it.
    articles: list[tuple[int, bool]] = [(0, False)]
    links = 0
    buffer: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(buffer)).strip()
        if text:
            _, furniture, article, listed, worded = stack[-1] if stack else NOWHERE
            heading = bool(stack) and stack[-1][0] in HEADING_TAGS
            found.append(Block(
                text, min(linked, len(text)), furniture, article, listed, heading, worded))
        buffer.clear()
        linked = 0

    def data(a: int, b: int) -> None:
        nonlocal linked
        if a < b:
            text = unescape(page[a:b])
            buffer.append(text)
            if links:
                linked += len(text.strip())

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            data(at, len(page))
            break
        data(at, m.start())
        at = m.end()
        name = m["name"]
        if name is None:
            if page.startswith("<![CDATA[", m.start()):
                buffer.append(page[m.start() + 9:m.end()].removesuffix("]]>"))
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK_TAGS:
                close()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            continue
        if name in RAW_TAGS:
            if not m["attrs"].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                close_at = page.find(">", end.end()) if end else -1
                at = close_at + 1 if close_at >= 0 else len(page)
            continue
        if name == "br":
            buffer.append(" ")
        elif name == "a":
            links = 1
        if name not in BLOCK_TAGS:
            continue
        close()
        links = 0
        if name in VOID_TAGS:
            continue
        if name in ("p", "li", "dd", "dt", "td", "th", "tr") and stack and stack[-1][0] == name:
            stack.pop()
        _, furniture, article, listed, worded = stack[-1] if stack else NOWHERE
        new_furniture, new_worded, new_article = _part_of(name, m["attrs"])
        # A header inside the article holds its title, not the page's.
        if not (name == "header" and article):
            furniture |= new_furniture
            worded += new_worded
        # Words around an article do not hide one marked below them.
        if new_article and not furniture and (not article or worded > articles[article][0]):
            articles.append((worded, new_worded))
            article = len(articles) - 1
        stack.append((name, furniture, article, listed or name in ("li", "menu"), worded))
    close()
    _settle(found, articles)
    return found


def _settle(found: list[Block], articles: list[tuple[int, bool]]) -> None:
    """Decide which words in class, id or role mark furniture, and which articles count."""
    if not any(b.worded for b in found):
        return
    sizes = [0] * len(articles)
    for b in found:
        if b.article and not b.furniture and b.worded == articles[b.article][0]:
            sizes[b.article] += len(b.text)
    free = {k for k, (worded, _) in enumerate(articles) if not worded and sizes[k]}
    # Text elsewhere counts by density: free of such words, else under the fewest of them.
    labels = [] if free else [(b, _alone(b)) for b in found if not b.furniture]
    good = [b for b, label in labels if label == GOOD and not b.article]
    prose = sum(len(b.text) for b, label in labels if label in (GOOD, NEAR) and not b.worded)
    level = 0 if prose else min((b.worded for b in good), default=0)
    other = sum(len(b.text) for b in good if b.worded == level)
    # Articles that wear no such word themselves come first, then those under the fewest.
    for own in (False, True):
        hidden = [k for k, (worded, on_it) in enumerate(articles)
                  if worded and sizes[k] and on_it == own]
        least = min((articles[k][0] for k in hidden), default=0)
        chosen = {k for k in hidden if articles[k][0] == least}
        rest = sum(sizes[k] for k in free) or (other if level <= least else 0)
        if own:
            rest = rest or prose
        if sum(sizes[k] for k in chosen) > rest and not (own and (free or (other and not level))):
            free |= chosen
            break
    for b in found:
        b.furniture |= b.worded > (articles[b.article][0] if b.article in free else level)
        if b.article not in free:
            b.article = 0


def _alone(block: Block) -> str:
    """A block's label by density, wherever it stands."""
    return first_pass(replace(block, furniture=False, article=0), False)


def first_pass(block: Block, marked: bool) -> str:
    """A block's label by itself."""
    links = block.linked / len(block.text)
    if block.furniture or (marked and not block.article):
        return BAD
    if block.article:
        if block.listed and links > ARTICLE_LINKS:
            return BAD
    elif links > LINKS:
        return BAD
    if len(block.text) < SHORT:
        return OPEN if block.article or not block.linked else BAD
    found = _WORD.findall(block.text.lower())
    stops = sum(map(STOP_WORDS.__contains__, found)) / max(1, len(found))
    if stops >= STOP_HIGH:
        return GOOD if len(block.text) > LONG else NEAR
    if stops >= STOP_LOW:
        return NEAR
    return OPEN if block.article else BAD


def second_pass(page_blocks: list[Block], marked: bool) -> None:
    """Settle open blocks by their nearest decided neighbours, in one sweep each way."""
    edge = GOOD if marked else BAD
    decided = [b for b in page_blocks if not (marked and (b.furniture or not b.article))]
    before, last = [], edge
    for b in decided:
        before.append(last)
        last = b.label if b.label in (GOOD, BAD) else last
    last = edge
    for k in range(len(decided) - 1, -1, -1):
        b, ahead = decided[k], last
        last = b.label if b.label in (GOOD, BAD) else last
        if b.label in (GOOD, BAD):
            continue
        if before[k] == ahead or (b.heading and ahead == GOOD):
            settled = ahead
        else:
            settled = GOOD if b.label == NEAR or marked else BAD
        b.label = GOOD if b.label == NEAR and GOOD in (before[k], ahead) else settled


def main_text(page: str) -> str:
    """The page's main text, blocks joined by an empty line."""
    if not page:
        return ""
    found = blocks(page)
    marked = any(b.article and not b.furniture for b in found)
    near = [False] * len(found)
    for k, b in enumerate(found):
        b.label = first_pass(b, marked)
        near[k] = b.label == NEAR
    if not marked and not any(b.label == GOOD for b in found):
        # No block is good by itself: prose of middling length takes its place.
        for b, n in zip(found, near):
            if n:
                b.label = GOOD
    second_pass(found, marked)
    return "\n\n".join(b.text for b in found if b.label == GOOD)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every page."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema}

    def make():
        def work(batch: pa.RecordBatch):
            texts = [main_text(p) for p in texts_of(batch, "__html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                [id_col, url_col, "text", "n_chars"])

        return work

    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"),
                        F.col(html_col).alias("__html"))
    return map_batches(rows, make, f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, "
                                   "text string, n_chars bigint")
