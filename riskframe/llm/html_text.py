"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass classifies each block from its own figures: length,
density of stop-words, density of links, and the containers it stands in (a menu, footer, form, advert and the like is
bad whatever it says). Blocks too short or too mixed to tell stay open. In the second pass open blocks inherit the
label of the nearest decided neighbours in their region; the edges of an article count as good, those of the page as
bad. If a page marks its article, only blocks inside are text; otherwise the whole body is one region. Stop-words decide
only on pages whose text shows one of their languages; on others long blocks with few links are good.

Nothing inside a good block is dropped; character references are decoded, white space becomes one space, blocks are
joined by a line break in page order.

Defined results: NULL, empty and text-less pages give an empty text; unclosed and stray tags are tolerated, so a skipped
element without its end, or closed in itself, is its own tag alone (as in HTML, script and style reach to the end of the
page); repeated rows are extracted each. Extra columns pass through; one named like an output is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.arrow import SLICE_BYTES, add_columns, as_texts

SHORT_CHARS, LONG_CHARS = 70, 200
LINK_SHARE = 0.33
STOP_LOW, STOP_HIGH = 0.20, 0.30

#: Frequent words of the languages at hand.
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are as with be by at this from or an not have "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de du des et à un une en est que qui dans pour pas sur au avec par il elle se "
    "el los las del y en un una que es se no por con su para como lo al más".split()
)

#: Elements by their part in a page.
SKIPPED = "script style noscript template svg iframe object textarea select button math canvas audio video title"
#: What is in these is no markup: their first end tag counts, and a slash in their tag does not close them.
RAW_TAGS = frozenset("script style textarea iframe title".split())
BOILER_TAGS = frozenset("nav footer aside form dialog menu".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of these closes an open paragraph; they hold text, not sections.
LEAF_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 hr".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "popup modal newsletter subscribe subscription sidebar nav navbar navigation menu breadcrumb breadcrumbs footer comment comments "
    "disqus reply replies share sharing social related recommended widget masthead login signup search pagination pager "
    "copyright toolbar skip hidden".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SKIPPED.replace(' ', '|')})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*+)>|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
BODY = re.compile(r"<body[\s>]", re.IGNORECASE)
#: Fixed value: scripts that write in one character what Latin letters write in about three.
WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    region: int
    boiler: bool
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is the article, by tag and attributes."""
    boiler, article = tag in BOILER_TAGS, tag in ("article", "main")
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "").lower()
            if name in ("class", "id") and tag not in ("body", "html", "main"):
                boiler |= not BOILER_WORDS.isdisjoint(re.split(r"[\s_-]+", value))
            elif name == "role":
                boiler |= value in BOILER_ROLES
                article |= value in ("main", "article")
            elif name == "itemprop":
                article |= value == "articlebody"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                boiler = True
    return boiler, article and not boiler


def closings(html: str, tag: str) -> dict[int, int]:
    """Where each skipped element `tag` ends, by the end of its opening tag; one pass over the page."""
    found, open_ends = {}, []
    for m in re.finditer(rf"<{tag}(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</{tag}\s*>", html, re.IGNORECASE):
        if m[0][1] != "/":
            if tag in RAW_TAGS or m[0][-2] != "/":
                open_ends.append(m.end())
        elif open_ends:
            if tag in RAW_TAGS:
                found |= dict.fromkeys(open_ends, m.end())
                open_ends.clear()
            else:
                found[open_ends.pop()] = m.end()
    if tag in ("script", "style"):
        found |= dict.fromkeys(open_ends, len(html))
    return found


def blocks_of(html: str) -> tuple[list[Block], bool]:
    """Blocks in page order, and whether any is inside an article (region above 0)."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open containers: tag, boilerplate, region
    regions, links, breaks = 0, 0, 0
    current = Block(0, False)

    def cut() -> None:
        nonlocal current
        if current.pieces:
            out.append(current)
        boiler, region = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        current = Block(region, boiler)

    def add(text: str) -> None:
        nonlocal breaks
        if text:
            plain = unescape(text) if "&" in text else text
            current.pieces.append(plain)
            if plain.strip():
                breaks = 0
                if links:
                    current.linked += len("".join(plain.split()))

    at, ends = 0, {}
    first_body = BODY.search(html)
    body = first_body.start() if first_body else -1
    while m := MARKUP.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if tag is None:
            if m[1]:
                current.pieces.append(" ")
                name = m[1].lower()
                if name not in ends:
                    ends[name] = closings(html, name)
                end = ends[name].get(at)
                if body >= at and (end is None or body < end) and html[at - 2] != "/":
                    end = body  # what is open before the body ends there
                at = end or at
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if close else 1
        elif tag == "br":
            breaks += 1
            current.pieces.append(" ")
            if breaks == 2:
                cut()
        elif tag in BLOCK_TAGS:
            links = 0
            if tag in LEAF_TAGS:
                # its own class can make a single paragraph boilerplate
                cut()
                if not close and attributes:
                    current.boiler |= marks(tag, attributes)[0]
            elif close:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                cut()
            elif tag not in VOID_TAGS:
                boiler, article = marks(tag, attributes)
                above, region = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                # a page's header is boilerplate, an article's own is not
                boiler |= tag == "header" and not region
                if article and not region and not (above or boiler):
                    regions += 1
                    region = regions
                stack.append((tag, above or boiler, region))
                cut()
    add(html[at:])
    cut()
    for b in out:
        b.text = " ".join("".join(b.pieces).split())
    found = [b for b in out if b.text]
    return found, any(b.region and not b.boiler for b in found)


def links_rule(b: Block) -> bool:
    return b.boiler or b.linked > LINK_SHARE * max(1, len(b.text) - b.text.count(" "))


def stop_words(text: str) -> tuple[int, int]:
    """Number of stop-words, and of words."""
    words = LETTERS.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)), len(words)


def shows_language(blocks: list[Block]) -> bool:
    """Whether the stop-words know the page's language: by one long block, or by its longer blocks together."""
    stops = words = 0
    for b in blocks:
        if len(b.text) >= SHORT_CHARS and not links_rule(b):
            found, n = stop_words(b.text)
            if len(b.text) > LONG_CHARS and found >= STOP_HIGH * max(1, n):
                return True
            stops, words = stops + found, words + n
    return words > 0 and stops >= STOP_LOW * words


def first_pass(b: Block, known: bool = True) -> str:
    """good, bad, or open; `known` tells whether stop-words are evidence here."""
    size = len(b.text)
    if links_rule(b):
        return "bad"
    if not known:
        return "good" if size + 2 * len(WIDE.findall(b.text)) > LONG_CHARS else "open"
    if size < SHORT_CHARS:
        return "open"
    stops, words = stop_words(b.text)
    density = stops / max(1, words)
    if density >= STOP_HIGH and size > LONG_CHARS or b.region and density >= STOP_LOW:
        return "good"
    if density < STOP_LOW and not b.region:
        return "bad"
    return "open"


def second_pass(labels: list[str], blocks: list[Block]) -> list[bool]:
    """Open blocks take the label of the nearest decided neighbour of their region; on a tie the region's edge's."""
    n = len(blocks)
    out = [x == "good" for x in labels]
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for found, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, tuple[int, bool]] = {}
        for k in order:
            # boilerplate inside an article says nothing about the article's text around it
            if labels[k] != "open" and not (blocks[k].boiler and blocks[k].region):
                last[blocks[k].region] = k, out[k]
            found[k] = last.get(blocks[k].region)
    for k in range(n):
        if labels[k] == "open":
            edge = blocks[k].region > 0
            near = sorted((abs(k - at), good != edge, good) for at, good in filter(None, (before[k], after[k])))
            out[k] = near[0][2] if near else edge
    return out


def main_text(html: str) -> str:
    blocks, marked = blocks_of(html)
    if marked:
        blocks = [b for b in blocks if b.region]
    known = shows_language(blocks)
    labels = [first_pass(b, known) for b in blocks]
    good = second_pass(labels, blocks)
    if not marked and not any(good):
        # nothing is long enough to decide by: what is no boilerplate is the text
        good = [x != "bad" for x in labels]
    return "\n".join(b.text for b, g in zip(blocks, good) if g)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """`df` without the html, with text and n_chars (code points). A narrow pass."""

    def start():
        return lambda part: [[main_text(h) for h in as_texts(part, html_col)]]

    out = add_columns(df, html_col, [("text", T.StringType())], start, SLICE_BYTES, drop=(html_col, "n_chars"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op7_html(spark: SparkSession, sf: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html"))
