"""Main text of web pages by tag-path ratios.

A page becomes its text blocks in order, each with its root-to-leaf path of tags and classes. Paths gather text length,
punctuation and link text. A path's text and punctuation per block are smoothed along the page by a Gaussian and fused
(with its share of text outside links, and a small factor where the path's names say that it is a menu, an advert, a
notice, comments and so on); a path whose mean reaches a share of the page's mean is a content path. A heading begins a
part of its own, across whose start nothing is smoothed, and counts as the block that follows it.

The blocks of content paths are the content nodes. The deepest element that holds them all bounds the article. In it stand
blocks that are too short for a ratio of their own (list items, cells, code, captions): they come out where they are
neighbours of content nodes, unless their path is one of links or of such names. Elements that can't be content (forms,
scripts, nav, footer, what is hidden, ...) are left out from the start; where a page has nothing but a form, the form is read.

Defined results: a null or empty html, or one without text, gives an empty text; a null url stays null; equal page_ids
keep a row each; broken markup (unclosed, crossed or cut tags) is read as far as it goes; elements nested deeper than
DEPTH stand beside each other, as browsers have it; an empty table gives no rows; other columns are left alone. The time
is linear in the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

# Element names of HTML by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg canvas select".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside form button menu dialog fieldset label input select head script style".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("p li ul ol dl dt dd pre blockquote table thead tbody tfoot tr td th caption figure figcaption details summary address hgroup".split())
# Whole class names, ids and roles of what is never an article's text. SURE ones hold inside article and main too.
SURE = frozenset(
    "ad ads adbox advert adverts advertisement advertising ad-banner ad-container ad-slot ad-unit sponsored navbar navigation breadcrumb breadcrumbs pagination pager sidebar complementary contentinfo search toolbar dialog "
    "share-bar share-buttons share-links social-share social-links sharing-buttons related-posts related-articles comments commentlist comment-list comment-form comment-respond disqus_thread "
    "cookie-banner cookie-consent cookie-notice popup modal newsletter newsletter-form newsletter-signup subscribe-form".split()
)
OUTSIDE = SURE | frozenset("header masthead topbar top-bar site-header banner footer site-footer bottom copyright menu nav widget widgets related share sharing social comment notice notices alert cookie cookies consent gdpr promo promotion sponsor sponsors subscribe signup login".split())
#: What an opening tag of the key closes, if it is the innermost block that is open.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
#: Width of the Gaussian in blocks; the share of the page's mean that a content path reaches; the factor of paths with names of what is never content.
WIDTH, SHARE, NAMED = 0.4, 0.35, 0.02
DEPTH = 512


class Element:
    __slots__ = ("tag", "up", "path", "never", "link", "named", "inside", "depth", "holds")

    def __init__(self, tag: str, up: Element | None, path: int, names: set[str] = frozenset(), hidden: bool = False, forms: bool = False) -> None:
        """path: the number of its tag path; names: class names, ids and roles."""
        self.tag, self.up, self.path, self.holds = tag, up, path, False
        above = up if up is not None else self
        self.depth = up.depth + 1 if up is not None else 0
        was = up is not None and up.inside
        self.inside = was or tag in ("article", "main")
        called = bool(names & (SURE if was else OUTSIDE)) and tag not in HEADINGS and tag not in ("html", "body", "main")
        self.named = called or up is not None and above.named
        never = tag in NEVER and not (forms and tag in ("form", "fieldset")) or tag == "header" and not was or hidden and tag not in ("html", "body")
        self.never = never or up is not None and above.never
        self.link = tag == "a" or up is not None and above.link


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element, text: str, linked: int) -> None:
        self.element, self.text, self.linked = element, text, linked


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str | None]]:
    """(start, end, closing, name) of the tags of a page, and of comments and declarations (without a name); linear."""
    at, last, hopeless = 0, page.rfind(">"), set()

    def end_of(place: int) -> int:
        """Behind the > of a tag; quoted values may hold one. Places from which no > follows outside quotes are remembered."""
        begin, seen = place, []
        while place not in hopeless:
            seen.append(place)
            place = PLAIN.match(page, place).end()
            if place >= len(page):
                break
            if page[place] == ">":
                return place + 1
            # only behind = does a quotation mark begin a value
            if page[begin:place][-16:].rstrip()[-1:] == "=":
                place = page.find(page[place], place + 1)
                if place < 0:
                    break
            place += 1
        hopeless.update(seen)
        return page.find(">", begin) + 1

    while 0 <= (start := page.find("<", at)) < last:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, False, None
            continue
        closing = page.startswith("/", start + 1)
        name = NAME.match(page, start + 1 + closing)
        if name:
            at = end_of(name.end())
            yield start, at, closing, name[0].lower()
        elif page[start + 1] in "!?":
            at = page.find(">", start) + 1
            yield start, at, False, None
        else:
            at = start + 1


def blocks_of(page: str, forms: bool = False) -> list[Block]:
    """Text blocks of a page in order, character references decoded, white space made single; without what is never content."""
    out: list[Block] = []
    paths: dict[tuple[int, str], int] = {}
    at = Element("", None, 0)
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = 0
    holder = at
    unclosed: set[str] = set()

    def end() -> None:
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(holder, text, linked))
            parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked, holder
        if text and not at.never:
            if not parts:
                holder = at
                while holder.tag not in BLOCK and holder.up is not None:
                    holder = holder.up
            parts.append(text)
            if at.link:
                linked += len(text)

    def leave(up: Element | None) -> None:
        """Closes what is open up to, and without, an element."""
        nonlocal at
        while at is not up:
            open_[at.tag] -= 1
            at = at.up

    place, skip = 0, 0
    for start, stop, closing, tag in tags_of(page):
        if start < skip:
            continue
        if start > place:
            say(page[place:start])
        place = stop
        if tag is None:
            continue
        if not closing:
            if tag in BLOCK:
                end()
            attributes = page[start + 1 + len(tag) : stop - 1]
            if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, place) if tag not in unclosed else None
                if close:
                    place = skip = close.end()
                    continue
                # what is never closed is read on, but for code
                unclosed.add(tag)
                if tag in ("script", "style"):
                    place = skip = len(page)
                    continue
            if closes := CLOSES.get(tag):
                inner: Element | None = at
                while inner is not None and inner.tag not in BLOCK:
                    inner = inner.up
                if inner is not None and inner.tag in closes and inner.up is not None:
                    leave(inner.up)
            names: set[str] = set()
            hidden = False
            classes = ""
            for name, a, b, c in ATTRIBUTE.findall(attributes) if len(attributes) > 2 else ():
                value, name = (a or b or c).lower(), name.lower()
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    hidden = True
                elif name != "aria-hidden":
                    names.update(value.split())
                    if name == "class":
                        classes = ".".join(sorted(value.split()))
            if at.depth >= DEPTH:
                leave(at.up)
            # a path's number stands for its tags and classes from the root, and for ids and roles where they count
            key = (at.path, f"{tag}.{classes} {names & OUTSIDE and 'named'}")
            at = Element(tag, at, paths.setdefault(key, len(paths) + 1), names, hidden, forms)
            open_[tag] = open_.get(tag, 0) + 1
        else:
            if tag in BLOCK:
                end()
            # A stray end tag closes nothing; one of a text style doesn't close blocks.
            if open_.get(tag):
                found: Element | None = at
                while found is not None and found.tag != tag and (tag in BLOCK or found.tag not in BLOCK):
                    found = found.up
                if found is not None and found.tag == tag and found.up is not None:
                    leave(found.up)
    if place < len(page):
        rest = page[place:]
        cut = re.search(r"<(?:/?[a-zA-Z]|!)[^<>]*\Z", rest)
        say(rest[: cut.start()] if cut else rest)
    end()
    return out


def smoothed(values: list[float], part: list[int], width: float = WIDTH) -> list[float]:
    """Values smoothed along the page, each among those of its own part."""
    reach = max(1, math.ceil(2 * width))
    weights = [math.exp(-k * k / (2 * width * width)) for k in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = mass = 0.0
        for k in range(max(0, i - reach), min(len(values), i + reach + 1)):
            if part[k] == part[i]:
                total += values[k] * weights[abs(i - k)]
                mass += weights[abs(i - k)]
        out.append(total / mass)
    return out


def content_paths(blocks: list[Block]) -> set[int]:
    """Paths whose smoothed, fused ratios reach the threshold."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.element.path, [0.0, 0.0, 0.0, 0.0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(PUNCTUATION.findall(b.text))
        s[3] += min(b.linked, len(b.text))
    # a heading begins a part, and stands for what follows it
    stands, following, part = [b.element.path for b in blocks], None, []
    for b in blocks:
        part.append((part[-1] if part else 0) + (b.element.tag in HEADINGS))
    for i in range(len(blocks) - 1, -1, -1):
        if blocks[i].element.tag not in HEADINGS:
            following = i
        elif following is not None:
            stands[i] = blocks[following].element.path
    text = smoothed([sums[p][1] / sums[p][0] for p in stands], part)
    marks = smoothed([sums[p][2] / sums[p][0] for p in stands], part)
    by_path: dict[int, list[float]] = {}
    for b, p, t, m in zip(blocks, stands, text, marks, strict=True):
        outside = 1 - sums[p][3] / sums[p][1]
        by_path.setdefault(b.element.path, []).append(math.sqrt(t * (0.1 + m)) * outside * (NAMED if b.element.named else 1.0))
    mean = sum(map(sum, by_path.values())) / len(blocks)
    return {p for p, xs in by_path.items() if sum(xs) / len(xs) >= SHARE * mean}


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    blocks = blocks_of(page) or blocks_of(page, forms=True)
    if not blocks:
        return ""
    chosen = content_paths(blocks)
    nodes = [i for i, b in enumerate(blocks) if b.element.path in chosen]
    if not nodes:
        return ""
    # The deepest element that holds all content nodes; those that hold one are marked on the way.
    root = blocks[nodes[0]].element
    for i in nodes:
        at: Element | None = blocks[i].element
        while at is not None and not at.holds:
            at.holds, at = True, at.up
        while root.depth > blocks[i].element.depth:
            root = root.up
        at = blocks[i].element
        while at.depth > root.depth:
            at = at.up
        while at is not root:
            at, root = at.up, root.up
    while root.tag in TEXTUAL and root.up is not None:
        root = root.up
    links: dict[int, list[int]] = {}
    for b in blocks:
        s = links.setdefault(b.element.path, [0, 0])
        s[0] += len(b.text)
        s[1] += min(b.linked, len(b.text))
    out = []
    for i, b in enumerate(blocks):
        if b.element.path in chosen:
            out.append(b.text)
            continue
        if b.element.named:
            continue
        # the highest element with this block and no content node: what stands beside content
        top = b.element
        while top.up is not None and not top.up.holds and top is not root:
            top = top.up
        if not below(b.element, root):
            continue
        length, linked = links[b.element.path]
        if 2 * linked > length and top.tag != "p":
            continue
        if b.element.holds or top.tag in TEXTUAL or top.tag not in BLOCK or nodes[0] < i < nodes[-1]:
            out.append(b.text)
    return "\n".join(out)


def below(at: Element | None, root: Element) -> bool:
    while at is not None and at.depth > root.depth:
        at = at.up
    return at is root


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
