"""Leaf blocks of a page: runs of text no block element divides, with what stands above.

Each block knows the marks of all elements above it, those of the nearest landmark (an element
that names a part of a page), those of elements that span nearly the whole page, and how much
of the page's text its container holds. A form or a division around everything is thereby told
from one that is a part. Marks of html and body describe the page and do not count.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

BLOCK_TAGS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe
    legend li main menu nav ol optgroup option p pre section select summary table tbody td
    textarea tfoot th thead tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style noscript template title desc metadata iframe noembed noframes".split())
LANDMARKS = frozenset("article main section nav header footer aside form button select fieldset figure details dialog".split())
CONTAINERS = LANDMARKS | frozenset("html body div center td th dialog".split())
SPANS = 0.8  # an element with this share of the page's text spans the page
FEATURE_TAGS = (
    "article main section div nav header footer aside form button select option label textarea fieldset ul ol li dl dd dt table"
    " td th tr p pre blockquote figure figcaption h1 h2 h3 h4 h5 h6 details address dialog"
).split()
# What the words of class, id, role and label attributes say about an element.
FAMILIES = {
    "nav": "nav navbar navi navigation menu submenu breadcrumb breadcrumbs crumbs pagination pager toc tabs skip sitemap topbar toolbar",
    "header": "header masthead logo brand branding tagline hero",
    "footer": "footer foot bottom copyright colophon legal imprint",
    "side": "sidebar side aside widget widgets rail secondary complementary",
    "related": "related recommended recommendations more popular trending tags tagcloud categories archive archives latest next previous teaser",
    "ad": "ad ads advert adverts advertising advertisement adsense adslot sponsor sponsored sponsors promo promotion dfp banner",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay privacy paywall announcement disclaimer warning",
    "comment": "comment comments commentlist commenter discussion respond reply replies disqus feedback reviews",
    "social": "share sharing social follow followers facebook twitter whatsapp",
    "form": "form search searchbox login signin signup register subscribe subscription newsletter contact field input",
    "content": "article content post entry story main body text prose longform",
}
_FAMILY_OF = {word: family for family, words in FAMILIES.items() for word in words.split()}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z) | <(/?)([a-zA-Z][^\s/>]*) | [^<]+ | <""", re.S | re.X)
_STOP = re.compile("[>\"']")
# Other attributes' quoted values are passed over whole.
_ATTRIBUTE = re.compile(
    r""""[^"]*"|'[^']*'|(class|id|role|aria-label|style|hidden|itemprop)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Such names say what an element holds or lacks, not what it is.
_ABOUT = re.compile(r"(?<![\w-])(?:has|no|with|without)[-_][\w-]*", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    tag: str
    above: frozenset[str]
    near: frozenset[str] = frozenset()
    wide: frozenset[str] = frozenset()
    share: float = 0.0


class _Elements:
    """Every element's parent, marks and place in the page's text, by number."""

    def __init__(self) -> None:
        self.tags, self.parents, self.marks = ["html"], [0], [frozenset()]
        self.starts, self.ends = [0], [0]
        self.above: list[frozenset[str]] = [frozenset()]
        self.landmark, self.container = [0], [0]

    def add(self, tag: str, parent: int, marks: frozenset[str], start: int) -> int:
        n = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        self.marks.append(marks)
        self.starts.append(start)
        self.ends.append(start)
        self.above.append(self.above[parent] | marks if marks else self.above[parent])
        tells = tag in LANDMARKS or any(m.startswith("is:") for m in marks)
        self.landmark.append(n if tells else self.landmark[parent])
        self.container.append(n if tag in CONTAINERS else self.container[parent])
        return n

    def complete(self, blocks: list[Block], owners: list[int], total: int) -> None:
        """What can only be told of blocks when the whole page has been read."""
        wide = [frozenset()]
        for n in range(1, len(self.tags)):
            over = wide[self.parents[n]]
            spans = self.marks[n] and self.ends[n] - self.starts[n] >= SPANS * total
            wide.append(over | self.marks[n] if spans else over)
        for block, n in zip(blocks, owners):
            block.near = self.marks[self.landmark[n]]
            block.wide = wide[n]
            c = self.container[n]
            block.share = (self.ends[c] - self.starts[c]) / total


def _marks(tag: str, attributes: str) -> frozenset[str]:
    """Names of the element's tag and of the families its attributes belong to."""
    marks = {f"in:{tag}"} if tag in _KNOWN else set()
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name == "hidden" or (name == "style" and _HIDES.search(value)):
                marks.add("is:hidden")
            elif name != "style":
                for word in _WORD.findall(_ABOUT.sub("", value)):
                    family = _FAMILY_OF.get(word.lower())
                    if family:
                        marks.add(f"is:{family}")
    return frozenset(marks)


_KNOWN = frozenset(FEATURE_TAGS)
# A start tag on the left closes open elements on the right, up to the barrier.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_SCOPE = frozenset("article aside section div body table td th blockquote form nav header footer main ul ol dl".split())


class _Ends:
    """Where the tags of a page end: at the first > outside quotes, whatever their length.

    Without one (a quote is never closed) a tag ends at its first >. Quotes from which no end
    was found are remembered, so the work is linear in the page.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = page.rfind(">")
        self.lost: set[int] = set()

    def after(self, at: int) -> int:
        """Place of the > that ends the tag whose name ends at `at`; -1 if there is none."""
        if at > self.last:
            return -1
        page, opened, pos = self.page, [], at
        while (stop := _STOP.search(page, pos)) and stop.start() not in self.lost:
            pos = stop.start()
            if page[pos] == ">":
                return pos
            opened.append(pos)
            pos = page.find(page[pos], pos + 1) + 1
            if not pos:
                break
        self.lost.update(opened)
        return page.find(">", at)


def leaf_blocks(page: str) -> list[Block]:
    """Blocks in page order, without scripts, styles, titles and markup comments.

    Character references are decoded, white space becomes one space, ends are trimmed.
    Unclosed, crossed and stray tags are taken as browsers do in the common cases.
    """
    elements = _Elements()
    stack: list[tuple[str, int]] = [("html", 0)]
    blocks: list[Block] = []
    owners: list[int] = []
    told = 0  # characters of text so far
    pieces: list[str] = []
    links = [0]
    open_links = 0
    at, size = 0, len(page)
    ends_of = _Ends(page)
    lower = page.lower() if "<" in page else ""
    if len(lower) != size:  # a character whose lower case is longer; tags are ASCII
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), page)

    def flush() -> None:
        nonlocal told
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tag = next((t for t, _ in reversed(stack) if t in BLOCK_TAGS), "html")
                blocks.append(Block(text, links[0], tag, elements.above[stack[-1][1]]))
                owners.append(stack[-1][1])
                told += len(text)
            pieces.clear()
            links[0] = 0

    def close(depth: int) -> None:
        nonlocal open_links
        if any(t in BLOCK_TAGS for t, _ in stack[depth:]):
            flush()
        open_links -= sum(t == "a" for t, _ in stack[depth:])
        for _, n in stack[depth:]:
            elements.ends[n] = told
        del stack[depth:]

    while at < size:
        found = _TOKEN.match(page, at)
        tag = found[2]
        stop = ends_of.after(found.end()) if tag else -1
        if stop < 0:
            text = "<" if tag else found[0]
            at += len(text)
            if text[0] != "<" or len(text) == 1:
                text = html.unescape(text) if "&" in text else text
                pieces.append(text)
                if open_links:
                    links[0] += len(text)
            continue
        attributes = page[found.end() : stop]
        at = stop + 1
        tag = tag.lower()
        if found[1]:
            barrier = BLOCK_TAGS if tag not in BLOCK_TAGS else ()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if stack[depth][0] in barrier:
                    break
            continue
        if tag in SKIPPED_TAGS and not attributes.endswith("/"):
            end = lower.find(f"</{tag}", at)
            end = size if end < 0 else lower.find(">", end)
            at = size if end < 0 else min(end + 1, size)
            continue
        if tag in ("br", "text"):  # text is a label of a drawing
            pieces.append(" ")
            if tag == "br":
                continue
        if tag in BLOCK_TAGS:
            if tag == "body":
                for depth, (name, _) in enumerate(stack):
                    if name == "head":
                        close(depth)
                        break
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p" and tag not in ("button", "select", "option", "textarea"):
                    close(depth)
                    break
                if stack[depth][0] in _SCOPE:
                    break
            if tag in _CLOSES:
                same, barrier = _CLOSES[tag]
                lowest = None
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in barrier:
                        break
                    if stack[depth][0] in same:
                        lowest = depth
                if lowest is not None:
                    close(lowest)
            flush()
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag == "a":
            for depth in range(len(stack) - 1, 0, -1):  # links do not nest
                if stack[depth][0] == "a":
                    close(depth)
                    break
                if stack[depth][0] in BLOCK_TAGS:
                    break
            open_links += 1
        marks = frozenset() if tag in ("html", "body") else _marks(tag, attributes)
        stack.append((tag, elements.add(tag, stack[-1][1], marks, told)))
    flush()
    close(0)
    elements.complete(blocks, owners, told)
    return blocks
