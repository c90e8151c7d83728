"""Main text of HTML pages by block rules in two passes.

Pass one looks at each block alone: link density, length and stop-word density make it good, bad or undecided.
Pass two gives undecided blocks the label of the nearest decided neighbours. Elements whose tag, role or class says
that they are page furniture (menus, footers, adverts, comments ...) are bad from the start. No block is bad for want of
stop words: a long one without them stays, a short one follows its neighbours. A class, an id or a form is not believed where the element holds the page's ``main``
element, most of the text of its articles or, without articles, most of its text: then it is a wrapper of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import col

# Limits of pass one.
MAX_LINK_DENSITY = 0.33
SHORT_CHARS = 70
LONG_CHARS = 200
HIGH_STOP_DENSITY = 0.32
# The lists fit a page whose blocks reach this density together; else the density says nothing about its blocks.
FITTING_DENSITY = 0.20
# A character of a script without spaces counts as so many.
UNSPACED_CHARS = 3

# Common function words of the languages at hand.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you",
    "de": "auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht sich sie sind und von vor war wie zu zum zur",
    "fr": "à au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous",
    "es": "a al como con de del el ella en entre es está este fue ha la las le lo los más no o para pero por que se sin sobre su sus un una y ya",
}
STOPS = frozenset(word for words in STOP_WORDS.values() for word in words.split())

# Elements without text of the page.
SILENT = frozenset("head script style noscript template svg math iframe object embed canvas audio video textarea select option title".split())
# Elements of page furniture, by tag, by role and by a part of the class or id.
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
WRAPPER_TAGS = frozenset(["form", "fieldset"])  # may also be around a whole page
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal "
    "nav navbar navigation newsletter notice pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe widget".split()
)
# Class names that begin or end so tell what a page has or allows ("has-sidebar", "comments-open"), not what the element is.
STATE_FIRST = frozenset("has have no not with without".split())
STATE_LAST = frozenset("allowed closed disabled enabled off on open".split())
# A named element is a wrapper if it holds more than this share of the text; inside of an article, more than the second.
WRAPPER_SHARE = 0.5
INNER_WRAPPER_SHARE = 0.9
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A new one of these ends an open one of the same set that lies directly around it.
# Their text need not be sentences.
NO_PROSE = frozenset("table caption tr td th pre dl dt dd ul ol li address figcaption h1 h2 h3 h4 h5 h6".split())
SELF_CLOSING = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|noscript|template|iframe|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z0-9]+")
# Thai, Lao, Burmese, Khmer, kana and ideographs.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")
_OTHER_LETTER = re.compile(r"[^\W\d_A-Za-z\u00c0-\u024f]")

GOOD, BAD, SHORT, NEAR = "good", "bad", "short", "near"

SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


@dataclass
class Wrapper:
    """An element that is furniture by its class or id, or a form, unless it turns out to hold the page."""

    above: Wrapper | None
    region: int
    main: bool = False  # holds a main element
    chars: int = 0  # of blocks that are not furniture by other signs nor full of links
    article_chars: int = 0  # of these, in articles that are not named as furniture themselves
    furniture: bool = False


@dataclass
class Block:
    text: str
    link_chars: int
    furniture: bool
    region: int  # the article or main element around it, by number; 0 for none
    label: str = ""
    wrapper: Wrapper | None = None
    prose: bool = True


@dataclass
class Element:
    tag: str
    silent: bool = False
    furniture: bool = False
    region: int = 0
    heading: bool = False  # in a page header
    wrapper: Wrapper | None = None


@dataclass
class _Reader:
    """Cuts a page into blocks."""

    open: list[Element] = field(default_factory=lambda: [Element("")])
    count: Counter[str] = field(default_factory=Counter)  # open elements by tag
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    links: int = 0
    regions: int = 0
    wrappers: list[Wrapper] = field(default_factory=list)
    named_regions: set[int] = field(default_factory=set)  # articles named as furniture inside of a named element

    def text(self, piece: str) -> None:
        top = self.open[-1]
        if piece and not top.silent:
            self.parts.append(piece)
            if self.links:
                self.link_parts.append(piece)

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                top = self.open[-1]
                link_chars = len(" ".join(html.unescape("".join(self.link_parts)).split()))
                self.blocks.append(Block(text, link_chars, top.furniture or top.heading, top.region, wrapper=top.wrapper, prose=top.tag not in NO_PROSE))
            self.parts, self.link_parts = [], []

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        if tag == "a":
            self.links = 1
        block = tag in BLOCKS
        if block:
            self.end_block()
            closes = SELF_CLOSING.get(tag)
            if closes and self.open[-1].tag in closes:
                self.pop()
            if tag != "p" and self.open[-1].tag == "p":
                self.pop()
        if tag in VOID or not (block or tag in SILENT or tag in FURNITURE_TAGS):
            return
        above = self.open[-1]
        region, wrapper = above.region, above.wrapper
        furniture, heading = above.furniture, above.heading
        silent, role, named = _signs(attrs)
        self.end_block()
        if tag in ("article", "main"):
            if not region:
                self.regions += 1
                region, heading = self.regions, False
                if tag == "main":
                    furniture = False
                    if wrapper:
                        wrapper.main = True
                elif named and wrapper:
                    self.named_regions.add(region)
        elif (named and tag not in ("html", "body")) or tag in WRAPPER_TAGS:
            wrapper = Wrapper(wrapper, region)
            self.wrappers.append(wrapper)
        self.count[tag] += 1
        self.open.append(
            Element(
                tag,
                silent=above.silent or silent or tag in SILENT,
                furniture=furniture or (role and tag not in ("html", "body", "article", "main")) or (tag in FURNITURE_TAGS and tag not in WRAPPER_TAGS),
                region=region,
                heading=heading or (tag == "header" and not region),
                wrapper=wrapper,
            )
        )

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag not in BLOCKS and tag not in SILENT and tag not in FURNITURE_TAGS:
            return
        self.end_block()
        if self.count[tag]:
            while self.pop() != tag:
                pass
            self.links = 0

    def pop(self) -> str:
        """End the innermost element and return its tag."""
        tag = self.open.pop().tag
        self.count[tag] -= 1
        return tag

    def decide_wrappers(self) -> None:
        """Tell wrappers of the page from furniture; blocks inside of furniture are furniture."""
        chars, article_chars = [0] * (self.regions + 1), 0
        for b in self.blocks:
            if b.furniture or b.link_chars > MAX_LINK_DENSITY * len(b.text):
                continue
            size = len(b.text)
            plain = size if b.region and b.region not in self.named_regions else 0
            chars[b.region] += size
            article_chars += plain
            if b.wrapper:
                b.wrapper.chars += size
                b.wrapper.article_chars += plain
        for w in reversed(self.wrappers):  # inner ones first
            if w.above:
                w.above.main |= w.main
                w.above.chars += w.chars
                w.above.article_chars += w.article_chars
        for w in self.wrappers:  # outer ones first
            if w.region:
                holds = w.chars > INNER_WRAPPER_SHARE * chars[w.region]
            elif article_chars:
                holds = w.article_chars > WRAPPER_SHARE * article_chars
            else:
                holds = w.chars > WRAPPER_SHARE * sum(chars)
            w.furniture = (w.above is not None and w.above.furniture) or not (w.main or holds)
        for b in self.blocks:
            b.furniture |= b.wrapper is not None and b.wrapper.furniture


def _signs(attrs: str) -> tuple[bool, bool, bool]:
    """(hidden, furniture by role, furniture by class or id) of an element's attributes."""
    hidden = role = named = False
    if attrs and attrs != "/":
        for key, value in _ATTRIBUTE.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = True
            elif key == "role":
                roles = set(value.split())
                named |= "form" in roles
                role |= not FURNITURE_ROLES.isdisjoint(roles - {"form"})
            elif key in ("class", "id"):
                named |= any(_names_furniture(name) for name in value.split())
    return hidden, role, named


def _names_furniture(name: str) -> bool:
    parts = _NAME.findall(name)
    if FURNITURE_NAMES.isdisjoint(parts):
        return False
    return len(parts) == 1 or not (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST)


def _unended(m: re.Match) -> bool:
    """Whether a comment or a raw element goes on to the end of the page."""
    if m["raw"]:
        return not re.search(rf"</{m['raw']}\s*>\Z", m[0], re.I)
    return m[0].startswith("<!--") and not m[0].endswith("-->")


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in page order, not yet labelled."""
    reader, at = _Reader(), 0
    last = page.rfind(">") + 1  # no tag begins after it, so none is looked for
    for m in _MARKUP.finditer(page, 0, last):
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        if tag := m["tag"]:
            (reader.end if m["close"] else lambda t: reader.start(t, m["attrs"]))(tag.lower())
        elif at == last and _unended(m):
            at = len(page)
    rest = page[at:]
    comment = rest.find("<!--")
    reader.text(rest if comment < 0 else rest[:comment])
    reader.end_block()
    if reader.wrappers:
        reader.decide_wrappers()
    return reader.blocks


def _size(text: str) -> int:
    """Characters, those of scripts without spaces by their weight."""
    return len(text) if text.isascii() else len(text) + (UNSPACED_CHARS - 1) * len(_UNSPACED.findall(text))


def _stop_words(text: str) -> tuple[int, int]:
    """(stop words, words)"""
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOPS for w in words), len(words)


def _latin(text: str) -> bool:
    return text.isascii() or len(_LATIN.findall(text)) > len(_OTHER_LETTER.findall(text))


def page_density(found: list[Block]) -> float:
    """Stop words among the words of all blocks that may be text."""
    stops = words = 0
    for b in found:
        if not b.furniture and b.link_chars <= MAX_LINK_DENSITY * len(b.text) and _size(b.text) >= SHORT_CHARS:
            s, n = _stop_words(b.text)
            stops, words = stops + s, words + n
    return stops / words if words else 0.0


def first_pass(block: Block, density_of_page: float = 1.0) -> str:
    """Label of a block from what it holds.

    The stop words are those of a few languages. Where the page does not use them, or the block is in another script,
    its length alone decides.
    """
    if block.furniture or block.link_chars > MAX_LINK_DENSITY * len(block.text):
        return BAD
    size = _size(block.text)
    if size < SHORT_CHARS:
        return SHORT
    stops, words = _stop_words(block.text)
    if size >= LONG_CHARS and stops >= HIGH_STOP_DENSITY * words:
        return GOOD
    if block.region:
        return NEAR
    if density_of_page < FITTING_DENSITY or not _latin(block.text):
        return GOOD
    return NEAR


def second_pass(labels: list[str], regions: list[int]) -> list[bool]:
    """Good or not, for every block: undecided ones take the label of their nearest decided neighbours.

    Neighbours are looked for in the same region. Nearly good blocks, long and not full of links, are good: neighbours
    cannot make them furniture. Where both sides differ, a short block follows the nearer side (good at equal distance).
    A region without any decided block is good as a whole if it is an article; outside of articles short blocks are good
    only if the page decided nothing.
    """
    n = len(labels)
    before: list[tuple[str, int] | None] = [None] * n
    after: list[tuple[str, int] | None] = [None] * n
    for order, found in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            if regions[i] in last:
                j = last[regions[i]]
                found[i] = (labels[j], abs(i - j))
            if labels[i] in (GOOD, BAD):
                last[regions[i]] = i
    decided = any(x in (GOOD, BAD) for x in labels)
    good = []
    for label, region, a, b in zip(labels, regions, before, after):
        if label in (GOOD, BAD):
            good.append(label == GOOD)
        elif label == NEAR:
            good.append(True)
        elif not a and not b:
            good.append(bool(region) or not decided)
        elif not a or not b or a[0] == b[0]:
            good.append((a or b)[0] == GOOD)
        else:
            nearer = GOOD if a[1] == b[1] else (a if a[1] < b[1] else b)[0]
            good.append(nearer == GOOD)
    return good


def main_text(page: str) -> str:
    """Good blocks of a page, one per line, in page order."""
    found = blocks(page)
    density = page_density(found) if any(not b.region for b in found) else 1.0
    labels = [first_pass(b, density) for b in found]
    # Furniture and link lists inside an article say nothing about the article's own blocks.
    regions = [-1 if label == BAD and b.region else b.region for b, label in zip(found, labels)]
    keep = second_pass(labels, regions)
    return "\n".join(b.text for b, good in zip(found, keep) if good)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from the whole page.

    A null page is empty; a page without main text gives an empty text. Ids and urls may be null or repeat; columns
    besides these three are not read.
    """
    picked = df.select(
        col(id_col).cast("long").alias("page_id"),
        col(url_col).cast("string").alias("url"),
        F.coalesce(col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"),
    )

    def run(batches):
        for batch in batches:
            texts = [main_text(page.decode("utf-8", "replace")) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=SCHEMA
            )

    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
