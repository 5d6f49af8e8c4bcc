"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by where it stands (menus, notices,
adverts, forms, reader comments and the like are out, the article or main element is in) and by length, link density and
stop-word density; the second gives ambiguous short blocks the label of their nearest decided neighbours. Pages are
independent, so the operator is a narrow map of one page to one text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.quality import STOP_WORDS

LENGTH_LOW, LENGTH_HIGH = 70, 200
MAX_LINK_DENSITY, MAX_LINK_DENSITY_MAIN = 0.2, 0.5
#: Shares of stop words that fit short lists.
STOP_LOW, STOP_HIGH = 0.1, 0.2

# Further function words of the four languages, besides those of the quality rules.
MORE_STOP_WORDS = """
    he she they we you his her their its who which what when where while than more most some all one had has were been
    will would can could may but if so about into over after before between out up only other there then these those
    am vor war waren dass daß wie wenn noch nur oder aber aus bei nach um bis über unter durch gegen ohne zum zur vom
    einen einem einer eines sie wir ihr ihre sein seine hat haben wird werden wurde sind kann diese dieser dieses so
    ce cette ces son sa ses leur leurs nous vous ils elle elles on ou où mais donc ne plus aux avec sans sous entre
    comme tout tous était sont été ont avait être fait plus tandis si
    e o u un unos unas mi sus este esta estos estas ese esa como más pero sin sobre entre hasta desde cuando donde quien
    muy ya también fue era son han ha había ser está están le les mientras si
""".split()

# Fixed values of HTML: elements by how they cut text.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title",
           "textarea", "select", "button", "audio", "video", "map", "datalist", "dialog", "annotation",
           "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "math", "semantics", "mrow", "mi", "mn", "mo", "ms",
          "mtext", "mstyle", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover",
          "mtable", "mtr", "mtd"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")

# Words of class and id names that mark blocks outside the article.
OUTSIDE = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
           "consent", "cookie", "cookies", "disclaimer", "footer", "login", "masthead", "menu", "modal", "nav", "navbar",
           "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "recommended", "related",
           "reply", "replies", "respond", "share", "sharing", "sidebar", "sidenav", "social", "sponsor", "sponsored",
           "subscribe", "subscription", "toolbar", "topbar", "widget", "disqus"}
# Those of them whose elements may hold articles that are not the page's.
OTHERS = {"ad", "ads", "advert", "adverts", "advertisement", "comment", "comments", "disqus", "promo", "promoted",
          "recommended", "related", "replies", "reply", "respond", "sponsor", "sponsored"}
# Words that may stand beside them in a name of several words without changing its sense.
BESIDE = {"area", "bar", "block", "body", "bottom", "box", "container", "content", "footer", "form", "group", "header",
          "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "primary",
          "right", "row", "secondary", "section", "site", "slot", "text", "thread", "title", "top", "unit", "wrap",
          "wrapper"}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar",
                 "form"}

_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+(=)\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)|(?=>)))?)?")
_CLOSE_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden")
_PIECES = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W\d_]+")
_STOP = frozenset([*STOP_WORDS, *MORE_STOP_WORDS])


@dataclass
class Block:
    text: str
    link_chars: int
    outside: bool
    main: bool
    heading: bool
    label: str = ""


class Mark:
    """An element that stands outside the article, unless it turns out to hold it."""

    __slots__ = ("above", "lifted", "firm")

    def __init__(self, above: "Mark | None", firm: bool):
        self.above, self.firm, self.lifted = above, firm, False


def _standing(mark: Mark | None) -> Mark | None:
    """The nearest mark that was not lifted; the way there is shortened for the next one who asks."""
    top = mark
    while top and top.lifted:
        top = top.above
    while mark and mark.lifted and mark.above is not top:
        mark.above, mark = top, mark.above
    return top


def tags(page: str) -> Iterator[tuple[str, bool, dict[str, str], bool, str]]:
    """``(name, closing, attributes, closed at once, text before)`` of every tag in order, last one with no name.

    One pass: a tag or comment that never ends takes the rest of the page, as in browsers, and nothing is read again.
    """
    at = start = 0
    parts: list[str] = []
    while (at := page.find("<", at)) >= 0:
        plain = _PLAIN.match(page, at)
        closing, attributes, quick = False, {}, False
        if plain:
            closing, name, end = bool(plain[1]), plain[2].lower(), plain.end()
        elif page.startswith(("<!", "<?"), at):
            end = page.find("-->", at + 4) + 3 if page.startswith("<!--", at) else page.find(">", at) + 1
            parts.append(page[start:at])
            start = at = end if end > 2 else len(page)
            continue
        else:
            closing = page.startswith("/", at + 1)
            found = _NAME.match(page, at + 1 + closing)
            if not found:
                at += 1
                continue
            name, end = found[0].lower(), found.end()
            while end < len(page) and page[end] != ">":
                one = _ATTRIBUTE.match(page, end)
                if one[1] and not closing:
                    attributes.setdefault(one[1].lower(), one[3] or one[4] or one[5] or "")
                quick = page[one.end() - 1] == "/" and not one[5]
                if one.end() == end or one[1] and not one[2] and _open_value(page, one.end()):
                    end = len(page)  # a quoted value without an end
                end = max(end, one.end())
            if end >= len(page):
                parts.append(page[start:at])
                start = len(page)
                break
            end += 1
        parts.append(page[start:at])
        yield name, closing, attributes, quick, "".join(parts)
        parts.clear()
        if name in _CLOSE_RAW and not closing and not quick:
            close = _CLOSE_RAW[name].search(page, end)
            end = close.end() if close else len(page)
        start = at = end
    parts.append(page[start:])
    yield "", False, {}, False, "".join(parts)


def _open_value(page: str, at: int) -> bool:
    """Whether an equals sign follows, whose value the pattern could not read."""
    while at < len(page) and page[at].isspace():
        at += 1
    return page.startswith("=", at)


def _outside_name(token: str) -> set[str]:
    """The words of a class or id name that mark an element as outside; none if another word changes the sense."""
    pieces = _PIECES.findall(token)
    marks = OUTSIDE.intersection(pieces)
    return marks if all(p in OUTSIDE or p in BESIDE or p.isdigit() for p in pieces) else set()


def _marked(attributes: dict[str, str]) -> tuple[bool, set[str], bool]:
    """(hidden or of a role outside, marking words of class and id, main content)."""
    role = attributes.get("role", "").lower()
    gone = "hidden" in attributes or role in OUTSIDE_ROLES or bool(_HIDDEN.search(attributes.get("style", "").lower()))
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    return gone, set().union(*map(_outside_name, names)), role in ("main", "article")


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; markup, scripts, styles and other skipped elements are gone."""
    stack: list[tuple[str, bool, Mark | None, bool, bool]] = []  # name, skipped, mark, main, heading
    count: Counter = Counter()  # open elements by name
    state: tuple = (False, None, False, False)
    parts: list[str] = []
    linked: list[str] = []
    found: list[tuple[Block, Mark | None]] = []

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            links = len(" ".join(entities.unescape("".join(linked)).split()))
            found.append((Block(text, links, False, state[2], state[3]), state[1]))
        parts.clear()
        linked.clear()

    def close(i: int):
        count.subtract(entry[0] for entry in stack[i:])
        del stack[i:]

    for name, closing, attributes, quick, text in tags(page):
        if text and not state[0]:
            parts.append(text)
            if count["a"]:
                linked.append(text)
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
        if closing:
            if count[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
        elif name and name not in VOID and name not in RAW and not quick:
            if name not in INLINE and stack and "p" in (stack[-1][0], *(x[0] for x in stack[-4:-1])):
                for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
                state = stack[-1][1:] if stack else (False, None, False, False)
            gone, words, main = _marked(attributes) if attributes else (False, set(), False)
            main |= name in MAIN
            mark = state[1]
            if main:
                words &= OTHERS  # an article is no menu or notice, whatever its classes say
                above = mark
                while above and not above.firm and not above.lifted:
                    above.lifted, above = True, above.above
            elif name in ("html", "body"):
                words = set()
            if gone or words or name in BOILERPLATE or name == "header" and not state[2]:
                mark = Mark(mark, gone or name in BOILERPLATE or not words.isdisjoint(OTHERS))
            stack.append((name, state[0] or name in SKIPPED, mark, state[2] or main, state[3] or name in HEADINGS))
            count[name] += 1
        state = stack[-1][1:] if stack else (False, None, False, False)
    flush()
    for block, mark in found:
        block.outside = _standing(mark) is not None
    return [block for block, _ in found]


def _stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in _STOP for w in words) / max(1, len(words))


def _first_pass(block: Block) -> str:
    size = len(block.text)
    density = block.link_chars / size
    if block.outside:
        return "bad"
    if block.main:
        if block.heading or density <= MAX_LINK_DENSITY_MAIN:
            return "good"
        if size < LENGTH_LOW:
            return "short"
        return "good" if _stop_share(block.text) >= STOP_LOW else "bad"  # linked prose, or a list of links
    if density > MAX_LINK_DENSITY or "©" in block.text:
        return "bad"
    if size < LENGTH_LOW:
        return "bad" if block.link_chars else "short"
    stops = _stop_share(block.text)
    if stops >= STOP_HIGH:
        return "good" if size > LENGTH_HIGH else "near"
    return "near" if stops >= STOP_LOW else "bad"


def classify(page: str) -> list[Block]:
    """All blocks with their label, good or bad.

    If an article or main element holds a paragraph, blocks outside it are bad. Otherwise a short block is good if its
    nearest decided neighbours on both sides are (a near-good one on either side counts), and a near-good block if one is
    or if the page has no good block; a short heading takes the label of what follows. If there is no near-good block
    either, short sentences stand.
    """
    found = blocks(page)
    for block in found:
        block.label = _first_pass(block)
    if any(b.main and b.label == "good" and not b.heading and len(b.text) >= LENGTH_LOW for b in found):
        for block in found:
            if not block.main:
                block.label = "bad"
    if all(b.label != "good" for b in found):
        stand = [b for b in found if b.label == "near"] or [
            b for b in found if b.label == "short" and not b.heading and _stop_share(b.text) >= STOP_HIGH]
        for block in stand:
            block.label = "good"
    first = [b.label for b in found]

    def nearest(decided: set[str], order) -> list[str]:
        out, last = [""] * len(found), "bad"
        for i in order:
            out[i] = last
            if first[i] in decided:
                last = first[i]
        return out

    forward, back = range(len(found)), range(len(found) - 1, -1, -1)
    before, after = nearest({"good", "bad"}, forward), nearest({"good", "bad"}, back)
    near_before, near_after = nearest({"good", "bad", "near"}, forward), nearest({"good", "bad", "near"}, back)
    for i, block in enumerate(found):
        sides = {before[i], after[i]}
        if first[i] == "near":
            block.label = "good" if "good" in sides else "bad"
        elif first[i] == "short":
            if block.heading:
                block.label = "good" if near_after[i] != "bad" and after[i] == "good" else "bad"
            elif len(sides) == 1:
                block.label = sides.pop()
            else:
                nearer = near_before[i] if before[i] == "bad" else near_after[i]
                block.label = "good" if nearer == "near" else "bad"
    return found


def main_text(page: str) -> str:
    """Good blocks of a page joined by one space."""
    return " ".join(b.text for b in classify(page) if b.label == "good")


@F.pandas_udf(T.StringType())
def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pages.fillna("").map(main_text)


def extract(df: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """``df`` with ``out``, the main text of the page; null or empty html gives the empty text.

    Rows are independent, so repeated rows and empty tables need no care. A very long page is read whole, in time
    proportional to its length whatever its markup. A column already named ``out`` is replaced.
    """
    return df.withColumn(out, _extract(F.col(column)))


def report(pages: DataFrame) -> DataFrame:
    """The digest of the query."""
    made = extract(pages.select("page_id", "url", "html"), "html", "text")
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
