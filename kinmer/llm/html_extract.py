"""Main text of web pages: flat text blocks, classified with their neighbours by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its word count and link
density, the same of the blocks before and after it, and whether the markup around it is named an
article or furniture. The tree is grown once a worker from the small labelled table below, whose blocks
are those of web pages as they are and of the same pages without any such names: where a page names its
parts these decide, where it doesn't, the counts and densities of a block and its neighbours do.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements of HTML that end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
# Elements whose whole content is no text of the page and holds no tags but the end; unclosed, it runs on as in a browser.
SKIPPED = "script style title noscript template iframe textarea".split()
# Elements with tags inside whose whole content is no text of the page; unclosed, it ends at the next block.
EMBEDDED = frozenset("svg object canvas audio video select button".split())
# Elements around furniture of a page, and roles of the same meaning.
FURNITURE = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of class and id names around furniture.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disclaimer discussion disqus feedback footer gdpr hidden legal login "
    "masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted "
    "promotion rail related recommended replies reply respond responses search secondary share sharing side sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
# Words that end a name and only say that it is of some box; what stands before them tells what is in it.
BOXES = frozenset(
    "area articles bar block body bottom box btn button buttons center col column container content div form fields group head header "
    "heading icons inner inline item items label left link links list message module outer panel posts region right row section slot "
    "space stories tab tabs title top unit widget widgets wrap wrapper zone".split()
)
#: Ends of names written as one word, such as sitefooter or topnav.
NAME_ENDS = ("nav", "menu", "footer", "sidebar", "banner", "advert", "comments")
# Names of furniture only outside the article, whose own head they may mark inside it.
OUTER_NAMES = frozenset("header siteheader pageheader topbar brand logo bottom".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
# Names of the element around the article where a page has no article or main element.
CONTENT = frozenset("article content entry main post story".split())
#: Elements whose nesting is followed; others can't hold furniture.
FOLLOWED = frozenset("article aside body dialog div dl fieldset figure footer form header main menu nav ol section span table ul".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<skip>" + "|".join(SKIPPED) + r")(?=[\s/>]|\Z)(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=skip)\s*>|\Z)"
    r"|</(?P<end>[a-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<odd>[a-z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.I | re.S,
)
MARKS = re.compile(r"""\b(?P<name>class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Za-z]+?(?=[A-Z][a-z]|[^A-Za-z]|\Z)")


def _names_furniture(value: str) -> bool:
    """Whether a class or id names furniture inside an article: one of its names does by its last word, of boxes left aside.

    A cookie-notice or related-posts does, a notice-board, related-work or search-results-analysis doesn't.
    """
    for name in value.split():
        words = [w.lower() for w in WORD.findall(name)]
        while len(words) > 1 and words[-1] in BOXES:
            words.pop()
        if words and (words[-1] in NAMES or words[-1].endswith(NAME_ENDS)):
            return True
    return False


def _is_furniture(tag: str, attrs: str, inside: bool = False) -> tuple[bool, bool, bool]:
    """(whether a tag stands around furniture, around reader comments, around content).

    inside: whether it stands in an article itself.
    """
    furniture, comments, content = tag in FURNITURE or (tag == "header" and not inside), False, False
    for m in MARKS.finditer(attrs) if attrs else ():
        name, value = m["name"].lower(), m["a"] or m["b"] or m["c"] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            furniture = True
        elif name == "role":
            furniture |= value.lower() in ROLES
        elif name in ("class", "id") and tag not in ("body", "html", "main"):
            words = {w.lower() for w in WORD.findall(value)}
            comments |= not words.isdisjoint(COMMENTS)
            content |= not words.isdisjoint(CONTENT)
            if tag != "article" and inside:
                furniture |= _names_furniture(value)
            elif tag != "article":
                furniture |= not words.isdisjoint(NAMES | OUTER_NAMES) or any(w.endswith(NAME_ENDS) for w in words)
    return furniture or comments, comments, content and not furniture and not comments


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    in_article: bool
    in_content: bool
    in_furniture: bool
    heading: bool


EMBEDDED_START = re.compile("<(?:" + "|".join(sorted(EMBEDDED)) + r")(?=[\s/>])", re.I)


def _embedded_ends(page: str) -> dict[int, int]:
    """Where each closed embedded element starts and ends."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in TOKEN.finditer(page) if EMBEDDED_START.search(page) else ():
        tag = (m["end"] or m["start"] or m["odd"] or "").lower()
        if tag not in EMBEDDED:
            continue
        if not m["end"]:
            if not _is_empty(tag, m):
                opened.setdefault(tag, []).append(m.start())
        elif opened.get(tag):
            ends[opened[tag].pop()] = m.end()
    return ends


def _is_empty(tag: str, m: re.Match) -> bool:
    return tag == "svg" and m[0].endswith("/>")


OUTSIDE = ("", False, False, False)


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty text blocks in order, white space collapsed and references decoded."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # followed elements: name, in article, in content, in furniture
    open_: Counter[str] = Counter()  # how many of each name the stack holds
    parts: list[str] = []
    linked: list[str] = []
    in_link = heading = own = unclosed = False
    ends, until = _embedded_ends(page), 0

    def close() -> None:
        nonlocal heading, own
        text = " ".join("".join(parts).split())
        if text:
            _, article, content, furniture = stack[-1] if stack else OUTSIDE
            n_linked = len("".join(linked).split())
            found.append(Block(text, text.count(" ") + 1, n_linked, article, content, furniture or own, heading))
        parts.clear()
        linked.clear()
        heading = own = False

    for m in TOKEN.finditer(page):
        kind = m.lastgroup
        if m.start() < until:
            continue
        if unclosed:
            tag = (m["end"] or m["start"] or m["odd"] or "").lower()
            if tag not in BLOCK and not (m["end"] and open_[tag]):
                continue
            unclosed = False
        if kind == "text":
            piece = html.unescape(m["text"])
            parts.append(piece)
            if in_link:
                linked.append(piece)
            continue
        if kind in ("skip", None):
            if m["skip"]:
                parts.append(" ")
            continue
        tag = (m["end"] or m["start"] or m["odd"]).lower()
        if tag in EMBEDDED:
            parts.append(" ")
            if not m["end"] and not _is_empty(tag, m):
                until = ends.get(m.start(), 0)
                unclosed = not until
            continue
        if tag in BLOCK:
            close()
        elif tag in ("br", "img", "input", "wbr"):
            parts.append(" " if tag != "wbr" else "")
        if m["end"]:
            if tag == "a":
                in_link = False
            while open_[tag]:
                closed = stack.pop()[0]
                open_[closed] -= 1
                if closed == tag:
                    break
            continue
        attrs = m["attrs"] or ""
        if tag == "a":
            in_link = True
        if tag in FOLLOWED:
            if attrs.endswith("/"):
                continue
            _, article, content, outer = stack[-1] if stack else OUTSIDE
            furniture, comments, named = _is_furniture(tag, attrs, article)
            if tag in ("article", "main") and not comments:
                # A page's article inside a wrapper named after its side bar is no side bar.
                article, outer = True, outer and any(open_[name] for name in FURNITURE)
            open_[tag] += 1
            stack.append((tag, article, content or named, outer or furniture))
        elif tag in BLOCK:
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            own = bool(attrs) and _is_furniture(tag, attrs, bool(stack) and stack[-1][1])[0]
    close()
    return found


FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "article", "furniture", "heading", "has_article", "menu",
)

# The labelled table: the features above (link densities in hundredths), then 1 for main text.
LABELLED = [
    # blocks of pages as they are
    (4, 0, 4, 0, 13, 0, 1, 0, 0, 1, 1, 1), (4, 0, 6, 0, 4, 0, 1, 0, 1, 1, 1, 1), (4, 0, 44, 0, 7, 0, 1, 0, 0, 1, 1, 1),
    (13, 0, 4, 0, 55, 0, 1, 0, 0, 1, 1, 1), (14, 0, 8, 0, 35, 0, 1, 0, 1, 1, 1, 1), (17, 0, 35, 0, 49, 0, 1, 0, 0, 1, 1, 1),
    (17, 0, 55, 0, 21, 0, 1, 0, 0, 1, 1, 1), (21, 0, 17, 0, 44, 0, 1, 0, 0, 1, 1, 1), (35, 0, 14, 0, 17, 0, 1, 0, 0, 1, 1, 1),
    (44, 0, 21, 0, 4, 0, 1, 0, 0, 1, 1, 1), (49, 0, 17, 0, 143, 0, 1, 0, 0, 1, 1, 1), (55, 0, 13, 0, 17, 0, 1, 0, 0, 1, 1, 1),
    (143, 0, 49, 0, 11, 0, 1, 0, 0, 1, 1, 1), (1, 100, 0, 0, 1, 100, 0, 1, 0, 1, 1, 0), (1, 100, 1, 100, 1, 100, 0, 1, 0, 1, 1, 0),
    (1, 100, 1, 100, 6, 0, 0, 1, 0, 1, 1, 0), (1, 100, 1, 100, 8, 0, 0, 1, 0, 1, 1, 0), (6, 0, 1, 100, 4, 0, 0, 1, 0, 1, 1, 0),
    (7, 0, 4, 0, 0, 0, 0, 1, 0, 1, 1, 0), (8, 0, 1, 100, 14, 0, 0, 1, 0, 1, 1, 0), (11, 0, 143, 0, 0, 0, 0, 1, 0, 1, 1, 0),
    # blocks of such pages without their tags' names, classes, ids and roles: only words, links and neighbours tell
    (4, 0, 4, 0, 13, 0, 0, 0, 0, 0, 1, 1), (4, 0, 6, 0, 4, 0, 0, 0, 1, 0, 1, 1), (4, 0, 44, 0, 7, 0, 0, 0, 0, 0, 1, 1),
    (10, 0, 9, 0, 33, 0, 0, 0, 1, 0, 1, 1), (13, 0, 4, 0, 55, 0, 0, 0, 0, 0, 1, 1), (13, 0, 102, 0, 82, 0, 0, 0, 0, 0, 1, 1),
    (14, 0, 8, 0, 35, 0, 0, 0, 1, 0, 1, 1), (14, 0, 15, 0, 33, 0, 0, 0, 0, 0, 1, 1), (15, 0, 54, 0, 14, 0, 0, 0, 0, 0, 1, 1),
    (17, 0, 35, 0, 49, 0, 0, 0, 0, 0, 1, 1), (17, 0, 55, 0, 21, 0, 0, 0, 0, 0, 1, 1), (20, 0, 33, 0, 40, 0, 0, 0, 0, 0, 1, 1),
    (21, 0, 17, 0, 44, 0, 0, 0, 0, 0, 1, 1), (24, 0, 35, 0, 63, 0, 0, 0, 0, 0, 1, 1), (33, 0, 10, 0, 20, 0, 0, 0, 0, 0, 1, 1),
    (33, 0, 14, 0, 40, 0, 0, 0, 0, 0, 1, 1), (35, 0, 14, 0, 17, 0, 0, 0, 0, 0, 1, 1), (35, 0, 40, 0, 24, 0, 0, 0, 0, 0, 1, 1),
    (40, 0, 20, 0, 110, 0, 0, 0, 0, 0, 1, 1), (40, 0, 33, 0, 35, 0, 0, 0, 0, 0, 1, 1), (44, 0, 21, 0, 4, 0, 0, 0, 0, 0, 1, 1),
    (49, 0, 17, 0, 143, 0, 0, 0, 0, 0, 1, 1), (54, 0, 82, 0, 15, 0, 0, 0, 0, 0, 1, 1), (55, 0, 13, 0, 17, 0, 0, 0, 0, 0, 1, 1),
    (63, 0, 24, 0, 12, 0, 0, 0, 0, 0, 1, 1), (82, 0, 13, 0, 54, 0, 0, 0, 0, 0, 1, 1), (102, 0, 110, 0, 13, 0, 0, 0, 0, 0, 1, 1),
    (110, 0, 40, 0, 102, 0, 0, 0, 0, 0, 1, 1), (143, 0, 49, 0, 11, 0, 0, 0, 0, 0, 1, 1), (7, 0, 51, 0, 57, 0, 0, 0, 0, 0, 1, 1),
    (11, 0, 7, 0, 74, 0, 0, 0, 1, 0, 1, 1), (6, 0, 31, 0, 107, 0, 0, 0, 0, 0, 1, 1), (17, 0, 27, 0, 6, 0, 0, 0, 0, 0, 1, 1),
    (1, 0, 1, 0, 111, 0, 0, 0, 0, 0, 1, 1), (12, 0, 10, 0, 9, 0, 0, 0, 0, 0, 1, 1), (8, 0, 6, 0, 8, 0, 0, 0, 1, 0, 1, 1),
    (10, 0, 97, 0, 3, 0, 0, 0, 0, 0, 1, 1), (9, 0, 25, 0, 2, 0, 0, 0, 0, 0, 1, 1), (1, 100, 0, 0, 1, 100, 0, 0, 0, 0, 1, 0),
    (1, 100, 1, 100, 1, 100, 0, 0, 0, 0, 1, 0), (1, 100, 1, 100, 6, 0, 0, 0, 0, 0, 1, 0), (1, 100, 1, 100, 8, 0, 0, 0, 0, 0, 1, 0),
    (1, 100, 1, 100, 9, 0, 0, 0, 0, 0, 1, 0), (6, 0, 1, 100, 4, 0, 0, 0, 0, 0, 1, 0), (7, 0, 4, 0, 0, 0, 0, 0, 0, 0, 1, 0),
    (8, 0, 1, 100, 14, 0, 0, 0, 0, 0, 1, 0), (9, 0, 1, 100, 10, 0, 0, 0, 0, 0, 1, 0), (11, 0, 143, 0, 0, 0, 0, 0, 0, 0, 1, 0),
    (12, 0, 63, 0, 0, 0, 0, 0, 0, 0, 1, 0), (11, 0, 21, 0, 0, 0, 0, 0, 0, 0, 1, 0),
    # articles of pages that end or begin with them, and articles of links
    (1, 0, 0, 0, 1, 0, 1, 0, 1, 1, 0, 1), (2, 0, 15, 0, 0, 0, 1, 0, 0, 1, 0, 1), (2, 0, 87, 0, 0, 0, 1, 0, 0, 1, 0, 1),
    (4, 0, 0, 0, 4, 0, 1, 0, 1, 1, 0, 1), (5, 0, 9, 0, 0, 0, 1, 0, 0, 1, 1, 1), (8, 0, 26, 0, 0, 0, 1, 0, 0, 1, 0, 1),
    (8, 0, 86, 0, 0, 0, 1, 0, 0, 1, 0, 1), (9, 0, 0, 0, 12, 0, 1, 0, 1, 1, 0, 1), (9, 0, 6, 0, 0, 0, 1, 0, 0, 1, 0, 1),
    (9, 0, 28, 0, 0, 0, 1, 0, 0, 1, 0, 1), (9, 0, 30, 0, 0, 0, 1, 0, 0, 1, 0, 1), (10, 0, 0, 0, 13, 0, 1, 0, 1, 1, 0, 1),
    (11, 0, 0, 0, 21, 0, 1, 0, 1, 1, 0, 1), (11, 0, 0, 0, 83, 0, 1, 0, 1, 1, 0, 1), (4, 100, 8, 100, 8, 100, 1, 0, 0, 1, 1, 1),
    (7, 100, 5, 100, 74, 100, 1, 0, 0, 1, 1, 1), (8, 100, 2, 100, 4, 100, 1, 0, 0, 1, 1, 1), (8, 100, 14, 100, 35, 100, 1, 0, 0, 1, 1, 1),
    (10, 100, 20, 100, 20, 100, 1, 0, 0, 1, 1, 1), (14, 100, 83, 100, 9, 100, 1, 0, 0, 1, 1, 1), (17, 100, 8, 100, 33, 100, 1, 0, 0, 1, 1, 1),
    (17, 100, 88, 100, 34, 100, 1, 0, 0, 1, 1, 1), (20, 100, 25, 100, 10, 100, 1, 0, 0, 1, 1, 1), (22, 100, 40, 100, 7, 0, 1, 0, 0, 1, 1, 1),
    # what stands outside the article of a page where only that is named
    (1, 100, 0, 0, 1, 100, 0, 0, 0, 1, 1, 0), (4, 0, 1, 100, 10, 0, 0, 0, 0, 1, 1, 0), (6, 0, 1, 100, 4, 0, 0, 0, 0, 1, 1, 0),
    (7, 0, 1, 100, 11, 0, 0, 0, 0, 1, 1, 0), (7, 0, 27, 0, 0, 0, 0, 0, 0, 1, 1, 0), (8, 0, 1, 100, 12, 0, 0, 0, 0, 1, 1, 0),
    (9, 0, 1, 100, 9, 0, 0, 0, 0, 1, 1, 0), (10, 0, 1, 100, 7, 0, 0, 0, 0, 1, 1, 0), (11, 0, 1, 100, 12, 0, 0, 0, 0, 1, 1, 0),
    (11, 0, 9, 0, 0, 0, 0, 0, 0, 1, 1, 0), (12, 0, 1, 100, 2, 0, 0, 0, 0, 1, 1, 0), (13, 0, 1, 100, 11, 0, 0, 0, 0, 1, 1, 0),
    (13, 0, 17, 0, 0, 0, 0, 0, 0, 1, 1, 0), (15, 0, 5, 0, 0, 0, 0, 0, 0, 1, 1, 0),
    # pages of other layouts: furniture inside articles, bare text, menus without names
    (60, 0, 8, 0, 75, 0, 1, 0, 0, 1, 0, 1), (8, 0, 4, 100, 60, 0, 1, 0, 1, 1, 1, 1), (1, 0, 60, 0, 3, 0, 1, 0, 0, 1, 0, 1),
    (3, 0, 1, 0, 40, 0, 1, 0, 0, 1, 0, 1), (120, 5, 40, 0, 2, 0, 1, 0, 0, 1, 0, 1), (25, 12, 90, 0, 30, 8, 1, 0, 0, 1, 0, 1),
    (2, 0, 55, 0, 12, 30, 1, 0, 0, 1, 0, 1), (14, 50, 80, 0, 60, 0, 1, 0, 0, 1, 0, 1), (5, 100, 70, 0, 66, 0, 1, 0, 0, 1, 1, 1),
    (1, 100, 30, 0, 30, 0, 1, 0, 0, 1, 1, 1), (6, 0, 0, 0, 0, 0, 1, 0, 1, 1, 0, 1), (300, 1, 200, 0, 150, 2, 1, 0, 0, 1, 0, 1),
    (30, 0, 60, 0, 2, 100, 1, 0, 0, 1, 1, 1), (8, 0, 1, 100, 2, 100, 1, 0, 1, 1, 1, 1), (90, 0, 3, 100, 9, 90, 1, 0, 0, 1, 1, 1),
    (2, 0, 40, 90, 1, 100, 1, 0, 0, 1, 1, 1), (4, 100, 3, 100, 2, 100, 1, 0, 0, 1, 1, 1), (1, 0, 50, 0, 6, 80, 1, 0, 0, 1, 1, 1),
    (70, 0, 5, 100, 80, 0, 0, 0, 0, 0, 1, 1), (40, 5, 70, 0, 60, 0, 0, 0, 0, 0, 0, 1), (18, 0, 60, 0, 45, 0, 0, 0, 0, 0, 0, 1),
    (25, 20, 50, 5, 70, 0, 0, 0, 0, 0, 0, 1), (6, 0, 2, 100, 60, 0, 0, 0, 1, 0, 1, 1), (5, 0, 70, 0, 40, 0, 0, 0, 1, 0, 0, 1),
    (3, 0, 60, 0, 50, 0, 0, 0, 0, 0, 0, 1), (1, 0, 45, 0, 38, 0, 0, 0, 0, 0, 0, 1), (12, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1),
    (30, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1), (2, 0, 40, 5, 0, 0, 0, 0, 0, 0, 0, 1), (60, 0, 70, 0, 1, 100, 0, 0, 0, 0, 1, 1),
    (25, 0, 1, 100, 2, 100, 0, 0, 0, 0, 1, 1), (2, 0, 60, 0, 1, 100, 0, 0, 0, 0, 1, 1), (40, 0, 2, 100, 1, 100, 0, 0, 0, 0, 1, 1),
    (10, 0, 1, 100, 8, 0, 0, 1, 0, 1, 1, 0), (9, 0, 90, 0, 0, 0, 0, 1, 0, 1, 0, 0), (60, 0, 8, 0, 40, 0, 0, 1, 0, 1, 0, 0),
    (45, 2, 50, 0, 60, 0, 1, 1, 0, 1, 0, 0), (7, 0, 70, 0, 25, 0, 1, 1, 1, 1, 0, 0), (20, 100, 80, 0, 60, 0, 1, 1, 0, 1, 1, 0),
    (30, 0, 12, 0, 22, 0, 0, 1, 0, 0, 0, 0), (3, 0, 22, 0, 60, 0, 0, 1, 1, 0, 0, 0), (150, 3, 2, 0, 90, 0, 0, 1, 0, 0, 0, 0),
    (4, 100, 40, 0, 3, 100, 0, 1, 0, 0, 1, 0), (12, 0, 80, 0, 0, 0, 0, 0, 0, 1, 0, 0), (4, 0, 0, 0, 8, 0, 0, 0, 1, 1, 0, 0),
    (50, 0, 5, 100, 60, 0, 0, 0, 0, 1, 1, 0), (2, 100, 60, 0, 2, 100, 0, 0, 0, 1, 1, 0), (25, 10, 90, 0, 10, 0, 0, 0, 0, 1, 0, 0),
    (4, 100, 2, 100, 60, 0, 0, 0, 0, 0, 1, 0), (9, 90, 70, 0, 5, 100, 0, 0, 0, 0, 1, 0), (20, 80, 12, 100, 15, 90, 0, 0, 0, 0, 1, 0),
    (3, 0, 2, 100, 3, 100, 0, 0, 0, 0, 1, 0), (30, 70, 40, 0, 20, 100, 0, 0, 0, 0, 1, 0), (6, 60, 0, 0, 4, 100, 0, 0, 0, 0, 1, 0),
    (2, 100, 80, 0, 0, 0, 0, 0, 0, 0, 1, 0), (5, 0, 4, 100, 2, 100, 0, 0, 1, 0, 1, 0),
]


@dataclass
class Tree:
    """A binary decision tree as flat arrays; a leaf's feature is -1."""

    feature: np.ndarray
    at_most: np.ndarray
    below: np.ndarray
    above: np.ndarray
    answer: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := self.feature[node] >= 0).any():
            goes = np.where(x[rows, self.feature[node]] <= self.at_most[node], self.below[node], self.above[node])
            node = np.where(inner, goes, node)
        return self.answer[node]


def grow(x: np.ndarray, y: np.ndarray) -> Tree:
    """Least Gini impurity at each split, midway between values, until leaves are pure."""
    nodes: list[list[float]] = []

    def add(rows: np.ndarray) -> int:
        k, mean = len(nodes), float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, float(mean >= 0.5)])
        best = (2.0, -1, 0.0)
        if 0 < mean < 1:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[rows, f] <= cut
                    score = sum(part.mean() * (1 - part.mean()) * len(part) for part in (y[rows[low]], y[rows[~low]])) / len(rows)
                    best = min(best, (score, f, float(cut)))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[k][:4] = [best[1], best[2], add(rows[low]), add(rows[~low])]
        return k

    add(np.arange(len(x)))
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Tree(*[np.array(c, t) for c, t in zip(zip(*nodes), kinds)])


@functools.cache
def block_tree() -> Tree:
    table = np.array(LABELLED, np.float64)
    return grow(table[:, :-1], table[:, -1])


def features_of(blocks: list[Block]) -> np.ndarray:
    """The FEATURES of each block; `menu` tells whether any block of the page is mostly links."""
    words = np.array([b.words for b in blocks], np.float64)
    links = np.array([100 * b.link_words / b.words for b in blocks])
    tagged = any(b.in_article and not b.in_furniture for b in blocks)
    flags = np.array([(b.in_article if tagged else b.in_content, b.in_furniture, b.heading) for b in blocks], np.float64)
    before = [np.concatenate([[0], c[:-1]]) for c in (words, links)]
    after = [np.concatenate([c[1:], [0]]) for c in (words, links)]
    page = [np.full(len(blocks), float(x)) for x in ((flags[:, 0] > flags[:, 1]).any(), (links >= 80).any())]
    return np.column_stack([words, links, *before, *after, flags, *page])


def main_text(page: str | None) -> str:
    """The blocks classified as main text, joined by line feeds."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    kept = block_tree().predict(features_of(blocks)) > 0.5
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


def extract_pages(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: (page_id, url, text, n_chars).

    Null, empty and text-free pages give an empty text. White space is what Python's str.split takes
    for it, no-break spaces included; a line break element counts as white space. Pages cut off in
    the middle of a tag lose that tag only. Repeated rows each give a row; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            told = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told], [c.split()[0] for c in SCHEMA.split(", ")])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(run, SCHEMA)
