"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element.  Lines of menus, headers,
footers, sidebars, notices, adverts, forms and comments - by element name or
by what class, id and role name - have no text of their own and count as
length 0, as do link lists.  So do all lines outside of what the page marks as
main or article, if that holds the page's strongest surge (for main: any).

Over the line lengths a window of WINDOW lines is summed.  Text begins at a
surge, where a window's sum leaves 0 for at least SURGE characters, and ends
at a dive, where the sum is back at 0.  The lines between a surge and its dive
are kept whole, and all between the first surge and the last dive, from a
heading that leads to it on; other runs that never reach SURGE characters are
kept only if the page has nothing better.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2
SURGE = 40

# HTML element names and usual words of class, id and role.
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "select", "title", "head"}
_SIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "header"}
_MAIN = {"article", "main"}
_BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody",
          "tfoot", "tr", "td", "th", "caption", "section", "article", "main", "header", "footer", "nav", "aside", "form",
          "blockquote", "pre", "figure", "figcaption", "address", "hr", "fieldset", "details", "summary", "body", "html",
          "br", "menu", "dialog", "center"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_SIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
               "banner", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "widget",
               "footer", "foot", "header", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice",
               "notices", "alert", "popup", "modal", "overlay", "subscribe", "subscription", "newsletter", "signup", "login",
               "comment", "comments", "respond", "reply", "replies", "discussion", "disqus", "share", "sharing", "social",
               "related", "recommended", "recommendations", "pagination", "pager", "search", "copyright", "legal",
               "complementary", "contentinfo", "form", "hidden"}

# Of these, those whose containers hold articles of their own, those that also
# name parts or subjects of a text, and the words around them in a name.
_OWN_ARTICLES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
                 "sidebar", "aside", "widget", "comment", "comments", "respond", "reply", "replies", "discussion", "disqus",
                 "related", "recommended", "recommendations"}
_TEXT_WORDS = {"header", "legal", "discussion", "side"}
_MODIFIERS = {"has", "have", "with", "without", "no", "not", "non", "hide", "category", "cat", "tag", "topic", "type", "format"}
_CONTENT = {"post", "entry", "article", "story", "content", "text"}
_TAIL = {"list", "item", "items", "box", "container", "wrapper", "wrap", "area", "section", "block", "bar", "left", "right", "top",
         "bottom", "inner", "outer", "content", "body", "link", "links", "button", "buttons", "slot", "unit", "group", "row", "col",
         "column", "title", "text", "label", "icon", "icons", "primary", "secondary", "main", "site", "page", "small", "large",
         "thread", "panel", "message", "policy", "posts", "articles", "stories", "menu", "form", "field", "input", "toggle",
         "widgets", "desktop", "mobile", "sticky", "default", "dark", "light", "expand", "inline", "xs", "sm", "md", "lg", "xl"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[|\]\]>|<[!?][^>]*(?:>|$)"
                  r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)", re.S)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _side_word(token: str) -> str | None:
    """The side part that one name of a class, id or role stands for.

    It is the name's head word, before words for its pieces: 'user-comments',
    'sidebar-left', 'ad-slot-1'; not 'has-sidebar', 'side-effects', 'post-header'.
    """
    if token.lower() in _SIDE_WORDS:
        return token.lower()
    words = [w.lower() for w in _WORD.findall(token)]
    if not words or words[0] in _MODIFIERS:
        return None
    head = len(words) - 1
    while head and (words[head] in _TAIL or len(words[head]) == 1) and words[head] not in _SIDE_WORDS:
        head -= 1
    # 'search-form', 'menu-toggle': a side part by either word
    word = words[head]
    if word not in _SIDE_WORDS:
        return None
    if (word == "header" or head < len(words) - 1) and _CONTENT.intersection(words[:head]):
        return None                                    # 'post-header', 'content-sidebar-wrap'
    return word


def _is_side(name: str, attributes: str, in_main: bool) -> str | None:
    """What makes an element a side part: its name, 'hidden' or a side word."""
    if name in _SIDE and not (name == "header" and in_main):
        return "<" + name
    if name in ("html", "body", "main") or not attributes:
        return None
    if _HIDDEN.search(attributes):
        return "<hidden"
    for m in _MARKS.finditer(attributes):
        # Ids of headings and of an article's sections are anchors made of their titles.
        if m.group(1).lower() == "id" and (name in _HEADINGS or in_main and name == "section"):
            continue
        for token in (m.group(2) or m.group(3) or m.group(4) or "").split():
            word = _side_word(token)
            if word and not (in_main and word in _TEXT_WORDS) and (name != "article" or word in _OWN_ARTICLES):
                return word
    return None


class Line(NamedTuple):
    text: str
    aside: bool
    main: int               # 1 inside article, 2 inside main
    linked: int             # characters in links
    doubt: bool             # aside, but in an article of its own
    level: int              # of the heading, or 0


def lines(page: str) -> list[Line]:
    """The text of each block, in page order."""
    out: list[Line] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, str | None, int]] = []      # name, why aside, main, as of this element
    aside, main, level = None, 0, 0
    links = 0

    def close_line():
        nonlocal linked
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            out.append(Line(line, aside is not None, main, linked, aside == "~", level))
        text.clear()
        linked = 0

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        piece = page[at:m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        name = (m.group(2) or "").lower()
        if not name:
            continue
        closing = bool(m.group(1))
        if name in _RAW:
            if not closing and not m.group(3).rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>" if name != "head" else r"</head\s*>|<body\b", re.I).search(page, at)
                if end:
                    at = end.start() if page[end.start() + 1] != "/" else end.end()
                elif name not in ("head", "noscript", "title"):
                    at = len(page)
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name in _BLOCK:
            close_line()
            if name != "a":
                links = 0
        if name in _VOID or (m.group(3) or "").rstrip().endswith("/"):
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif name in _BLOCK or name in _MAIN or name == "span":
            if name in _MAIN:                          # ends a menu or the like left open
                outer = next((i for i, x in enumerate(stack) if x[1]), None)
                if outer is not None and stack[outer][0] in ("nav", "header", "menu", "form"):
                    del stack[outer:]
                aside = stack[-1][1] if stack else None
                # a container of the page's frame that holds the article does not make it a side part
                if aside and aside[0] not in "<~":
                    aside = "~" if name == "article" and aside in _OWN_ARTICLES else None
            side = aside if aside and aside != "~" else _is_side(name, m.group(3) or "", main) or aside
            if side != aside and name == "span":
                side = aside
            stack.append((name, side, 2 if name == "main" else main or int(name in _MAIN)))
        aside, main = (stack[-1][1], stack[-1][2]) if stack else (None, 0)
        level = int(stack[-1][0][1]) if stack and stack[-1][0] in _HEADINGS else 0
    close_line()
    return out


def _runs(lengths: list[int], window: int) -> list[tuple[int, int, int]]:
    """(begin, end, characters) of the lines between each surge and its dive."""
    sums = [sum(lengths[i:i + window]) for i in range(len(lengths))]
    runs, begin = [], None
    for i, s in enumerate([*sums, 0]):
        if s and begin is None:
            begin = i
        elif not s and begin is not None:
            runs.append((begin, i, sum(lengths[begin:i])))
            begin = None
    return runs


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's main text; '' if it has none."""
    found = lines(page or "")
    if sum(len(x.text) for x in found if not x.aside) < surge:         # the articles of side parts, if there is nothing else
        found = [x._replace(aside=x.aside and not x.doubt) for x in found]
    if any(x.main and not x.aside for x in found):     # what else an article holds does not part its text
        found = [x for x in found if not (x.aside and x.main)]
    lengths = [0 if x.aside or (x.linked and x.linked >= 0.8 * len(x.text) and not x.main) else len(x.text) for x in found]

    def strongest(which) -> int:
        return max((n for _, _, n in _runs([n if which(x) else 0 for x, n in zip(found, lengths)], window)), default=0)

    marked = strongest(lambda x: x.main)
    if marked and (marked >= strongest(lambda x: not x.main) or strongest(lambda x: x.main == 2) >= surge):
        lengths = [n if x.main else 0 for x, n in zip(found, lengths)]
    runs = _runs(lengths, window)
    strong = [r for r in runs if r[2] >= surge]
    if strong:
        begin = next(i for i in range(strong[0][0], strong[0][1]) if lengths[i])
        level = found[begin].level
        # A heading before the text leads to it, unless the text has one of its rank.
        begin = next((i for i in range(begin) if lengths[i] and found[i].level and not 0 < level <= found[i].level), begin)
        end = strong[-1][1]
    else:
        begin, end, _ = max(runs, key=lambda r: r[2], default=(0, 0, 0))
    return " ".join(found[i].text for i in range(begin, end) if lengths[i])


def main_text(pages: DataFrame, html_column: str = "html", window: int = WINDOW, surge: int = SURGE,
              name: str = "text") -> DataFrame:
    """``pages`` with the column ``name`` set to each page's main text.

    Null, empty and text-free pages give ''; all rows and other columns stay
    (a column called ``name`` is replaced); an empty table stays empty.
    """
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pd.Series([extract(p, window, surge) for p in pages_], dtype=object)

    return pages.withColumn(name, run(F.col(html_column)))
