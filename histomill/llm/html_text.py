"""Main text of web pages by tag-path ratios.

A page is cut into text nodes, each under the path of block tags that leads to it, without the
paths through menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments. Text length outside links and punctuation are added up for every path and divided by
the number of its nodes; both ratios are fused with the nodes' own, smoothed along the page, and
nodes below a share of the page's spread are not selected. The innermost element with most of
what is selected is the container; text in an article or main element weighs more. Headings and
short nodes stay in the container, but neither lists of links nor parts without a node that
measures up to the selected ones; outside it only nodes that measure up stay.

Defined results: null or blank html gives empty text; markup that never ends is read up to the
page's end, and time and memory are linear in the page, however deep or broken; repeated rows
are read each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomill.llm.common import clashless

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")

# Fixed values of HTML: elements without content, with raw text, and that run inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
#: Blocks that an opening tag of the value's group closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What no article's own text stands in.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe button select textarea title head menu dialog svg math".split())
#: Words of class names and ids that speak against an element, unless they are denied
#: (``no-sidebar``). Those of readers' comments hold whatever the element contains.
DROPPED_WORDS = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|banner|breadcrumbs?|cookies?|consent|footer|header|masthead|menu|modal|nav|navbar|navigation"
    r"|newsletter|notices?|popup|promo|promoted|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[_-])",
    re.I,
)
COMMENT_WORDS = re.compile(r"(?:^|[_-])(?:comments?|comment-?list|disqus|replies|respond)(?:$|[_-])", re.I)
DENIED = re.compile(r"(?:^|[_-])(?:no|non|not|without|has|with|hide|hidden)[_-]", re.I)
#: Share of the page's weight from which an element is text whatever its class name says, if
#: no article or main element stands outside it.
MOST = 0.9
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")
#: Share of the spread of the page's fused ratios that a node must reach.
THRESHOLD = 0.5
#: Weight of text in an article or main element, share of the selected weight that the container
#: holds at least, and share of the selected nodes' mean weight that a part's best node reaches.
BONUS, HELD, STRONG = 1.5, 0.7, 0.5
#: Elements that are parts of a text rather than containers of it, and elements that hold texts.
PARTS = frozenset("p li ul ol dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr".split()) | HEADINGS
HOLDERS = frozenset("html body main article section".split())
_LINK = re.compile(r"<(/?)a(?=[\s>/])", re.I)


KEPT, SOFT, HARD = 0, 1, 2


def _dropped(tag: str, attributes: str) -> int:
    """``HARD`` for an element that holds no text of an article, ``SOFT`` for one that by its
    class name may not, else ``KEPT``."""
    if tag in DROPPED:
        return HARD
    if not attributes.strip():
        return KEPT
    found = KEPT
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name in ("class", "id") and tag not in ("html", "body"):
            words = [w for w in value.split() if not DENIED.search(w)]
            if any(map(COMMENT_WORDS.search, words)):
                return HARD
            if any(map(DROPPED_WORDS.search, words)):
                found = SOFT
        if name == "role" and value.lower() in DROPPED_ROLES or name == "aria-hidden" and value == "true":
            return HARD
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        return HARD
    return found


class Node(NamedTuple):
    element: int  # number of the innermost block around the text
    text: str
    linked: int  # characters in links
    links: int


class Page:
    """Blocks of a page as a tree, numbered in page order from 1 (0 is the page), and its texts.
    Paths of tags are a trie: a number for each step ``(path so far, tag)``."""

    def __init__(self) -> None:
        self.parent, self.tag, self.drop, self.path = [0], [""], [KEPT], [0]
        self.steps: dict[tuple[int, str], int] = {}
        self.texts: list[Node] = []

    def open(self, parent: int, tag: str, drop: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.drop.append(drop)
        self.path.append(self.steps.setdefault((self.path[parent], tag), len(self.steps) + 1))
        return len(self.parent) - 1

    def down(self, at_top, step) -> list:
        """A value for every element, the top's first: ``step(element, its parent's value)``."""
        out = [at_top]
        for e in range(1, len(self.parent)):
            out.append(step(e, out[self.parent[e]]))
        return out

    def up(self, sums: list[float]) -> list[float]:
        """Sums of every element with all in it."""
        for e in range(len(sums) - 1, 0, -1):
            sums[self.parent[e]] += sums[e]
        return sums


class Tokens:
    """Texts and tags of a page, in time linear in its length."""

    def __init__(self, html: str):
        self.html, self.loose = html, False

    def _tag_end(self, at: int) -> int:
        """Place behind the ``>`` that ends a tag; quoted values may hold others. Once quotes turn
        out to be unbalanced they are ignored. A tag that never ends is read up to the end."""
        html, n = self.html, len(self.html)
        i = at
        while not self.loose:
            m = _STOP.search(html, i)
            if m and m[0] == ">":
                return m.end()
            end = html.find(m[0], m.end()) if m else -1
            if end < 0:
                self.loose = True
            i = end + 1
        end = html.find(">", at)
        return end + 1 if end >= 0 else n

    def __iter__(self) -> Iterator[tuple[str, str, int]]:
        """``(tag or "", text or attributes, place behind)``; closing tags begin with ``/``. The
        receiver may set ``at`` to go on elsewhere."""
        html, n = self.html, len(self.html)
        self.at = held = 0  # what is read; where text begins
        while self.at < n:
            start = html.find("<", self.at)
            if start < 0:
                break
            mark = html[start + 1 : start + 2]
            name = _NAME.match(html, start)
            if not name and mark not in ("!", "?"):
                self.at = start + 1  # a bare sign
                continue
            if start > held:
                yield "", unescape(html[held:start]), start
            if name:
                end = self._tag_end(name.end())
                self.at = end
                closing = "/" if mark == "/" else ""
                yield closing + name[1].lower(), html[name.end() : end].removesuffix(">"), end
            else:
                opening, closing = next(((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if html.startswith(o, start)), ("<", ">"))
                end = html.find(closing, start + len(opening))
                self.at = end + len(closing) if end >= 0 else n
                if closing == "]]>":
                    yield "", html[start + len(opening) : end if end >= 0 else n], self.at
            held = self.at
        if held < n:
            yield "", unescape(html[held:]), n


def read(html: str) -> Page:
    """The page's blocks and texts."""
    page = Page()
    stack = [0]  # blocks that are open
    open_tags: Counter[str] = Counter()
    held: list[str] = []
    linked = links = 0
    in_link = False
    raw_ends = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
    tokens = Tokens(html)

    def flush() -> None:
        nonlocal linked, links
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text:
                page.texts.append(Node(stack[-1], text, min(linked, len(text)), max(links, linked > 0)))
            held.clear()
        linked = links = 0

    def close(tag: str) -> None:
        """Close the innermost open block of that name and all in it."""
        while open_tags[tag]:
            last = page.tag[stack.pop()]
            open_tags[last] -= 1
            if last == tag:
                return

    for tag, rest, behind in tokens:
        if not tag:
            held.append(rest)
            if in_link:
                linked += len(_SPACE.sub(" ", rest).strip())
            continue
        ends = tag[0] == "/"
        tag = tag.lstrip("/")
        if tag in RAW and not ends:
            end = raw_ends[tag].search(html, behind)
            tokens.at = end.end() if end else len(html)
            if tag not in ("script", "style", "svg", "math"):
                flush()
            continue
        if tag == "a":
            end = None if ends or not re.search(r"(?:^|\s)href\s*=", rest, re.I) else _LINK.search(html, behind)
            in_link = bool(end and end[1])  # a link that is never closed is none
        if tag in INLINE and not open_tags[tag] and (ends or _dropped(tag, rest) == KEPT):
            links += tag == "a" and in_link
            continue
        flush()
        if tag in VOID:
            continue
        if ends:
            close(tag)
            continue
        if tag not in INLINE and open_tags["p"]:  # a block ends an open paragraph
            around = next(page.tag[e] for e in reversed(stack) if page.tag[e] in ("p", "table", "object", "button"))
            if around == "p":
                close("p")
        if tag in CLOSES and page.tag[stack[-1]] in CLOSES[tag]:
            close(page.tag[stack[-1]])
        if not rest.rstrip().endswith("/"):
            stack.append(page.open(stack[-1], tag, _dropped(tag, rest)))
            open_tags[tag] += 1
    flush()
    return page


def weight(chars: float, marks: float, n: int = 1) -> float:
    """Text length and punctuation of ``n`` texts, fused into one ratio."""
    return math.sqrt((chars / n) * (1 + marks / n)) * math.log1p(chars)


def _kept(page: Page) -> list[Node]:
    """Texts outside dropped elements. An element that is dropped by its class name only is kept
    if it holds nearly all of the page's weight."""
    hard = page.down(False, lambda e, above: above or page.drop[e] == HARD)
    found = [x for x in page.texts if not hard[x.element]]
    if SOFT not in page.drop:
        return found
    sums = [0.0] * len(page.parent)
    for x in found:
        sums[x.element] += weight(len(x.text) - x.linked, len(PUNCTUATION.findall(x.text)))
    soft = page.down(False, lambda e, above: above or page.drop[e] == SOFT)
    if any(tag in ("article", "main") and not inside for tag, inside in zip(page.tag, soft, strict=True)):
        return [x for x in found if not soft[x.element]]
    sums = page.up(sums)
    lost = page.down(False, lambda e, above: above or page.drop[e] == SOFT and sums[e] < MOST * sums[0])
    return [x for x in found if not lost[x.element]]


def _link_lists(page: Page, found: list[Node]) -> set[int]:
    """Places of the texts that are rows of links or belong to lists of links."""
    groups: dict[int, list[int]] = {}
    for x in found:
        at = groups.setdefault(page.parent[x.element], [0, 0, 0])
        at[0] += x.linked
        at[1] += len(x.text)
        at[2] += x.links > 0
    mostly = lambda linked, chars: 2 * linked > chars
    return {
        i
        for i, x in enumerate(found)
        if mostly(x.linked, len(x.text)) and (x.links > 2 or mostly(*groups[page.parent[x.element]][:2]) and groups[page.parent[x.element]][2] > 1)
    }


def path_ratios(page: Page, found: list[Node], bonus: list[float]) -> dict[int, float]:
    """Fused ratio of every tag path: text outside links and punctuation of all its texts."""
    sums: dict[int, list[float]] = {}
    for x, b in zip(found, bonus, strict=True):
        at = sums.setdefault(page.path[x.element], [0, 0, 0, b])
        at[0] += len(x.text) - x.linked
        at[1] += len(PUNCTUATION.findall(x.text))
        at[2] += 1
    return {p: b * weight(c, m, n) for p, (c, m, n, b) in sums.items()}


def smoothed(values: list[float], reach: int = 2) -> list[float]:
    """Means of the values around each, by a bell of one text's width."""
    bell = [math.exp(-d * d / 2) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        near = range(max(0, i - reach), min(len(values), i + reach + 1))
        out.append(sum(bell[abs(i - j)] * values[j] for j in near) / sum(bell[abs(i - j)] for j in near))
    return out


def _container(page: Page, found: list[Node], weights: dict[int, float]) -> int:
    """The innermost element that holds most of the weight, or the article (or else main
    element) around it."""
    outside = page.down(0, lambda e, above: e if above == page.parent[e] and page.tag[e] not in PARTS else above)  # the innermost that is in no part
    sums = [0.0] * len(page.parent)
    for i, w in weights.items():
        e = found[i].element
        sums[page.parent[e] if outside[e] == e and page.tag[e] not in HOLDERS else outside[e]] += w
    total = sum(weights.values())
    sums = page.up(sums)
    at = max((e for e, w in enumerate(sums) if w >= HELD * total), default=0)  # over half: they are nested, inner ones later
    for name in ("article", "main"):
        e = at
        while e and page.tag[e] != name:
            e = page.parent[e]
        if e:
            return e
    return at


def select(page: Page, threshold: float = THRESHOLD) -> list[str]:
    """The texts that belong to the article."""
    kept = _kept(page)
    listed = _link_lists(page, kept)
    if len(listed) < len(kept):  # a page of nothing but links keeps them
        kept = [x for i, x in enumerate(kept) if i not in listed]
    if not kept:
        return []
    main = page.down(False, lambda e, above: above or page.tag[e] in ("article", "main"))
    bonus = [BONUS if main[x.element] else 1.0 for x in kept]
    own = [b * weight(len(x.text) - x.linked, len(PUNCTUATION.findall(x.text))) for b, x in zip(bonus, kept, strict=True)]
    ratio = path_ratios(page, kept, bonus)
    fused = [0.5 * ratio[page.path[x.element]] + 0.5 * v for x, v in zip(kept, smoothed(own), strict=True)]
    of_path: dict[int, list[float]] = {}
    for x, v in zip(kept, fused, strict=True):
        of_path.setdefault(page.path[x.element], []).append(v)
    means = [sum(v) / len(v) for v in of_path.values()]
    mean = sum(means) / len(means)
    spread = math.sqrt(sum((v - mean) ** 2 for v in means) / len(means))
    heading = [page.tag[x.element] in HEADINGS for x in kept]
    chosen = {i for i, v in enumerate(fused) if v >= threshold * spread and not heading[i]} or set(range(len(kept)))
    container = _container(page, kept, {i: own[i] for i in chosen})
    inside = page.down(container == 0, lambda e, above: above or e == container)
    # the container's child around each element, 0 outside and for the container itself
    part = page.down(0, lambda e, above: e if inside[e] and page.parent[e] == container and e != container else above)
    within = [own[i] for i in chosen if inside[kept[i].element]]
    measure = STRONG * sum(within) / max(len(within), 1)
    strong = {i for i in chosen if own[i] >= measure}
    parts = {part[kept[i].element] for i in strong if inside[kept[i].element]} - {0}

    def stays(i: int) -> bool:
        at = kept[i].element
        if not inside[at]:
            return i in strong
        if part[at] in parts:
            return True
        if part[at] not in (0, at) and page.tag[part[at]] not in PARTS or part[at] and page.tag[part[at]] in ("article", "section"):
            return False  # in a part of its own that has no strong text
        return i in chosen or heading[i] or page.tag[container] not in ("", "html", "body")

    return [x.text for i, x in enumerate(kept) if stays(i)]


def extract(html: str | None) -> str:
    """The article's text: blocks in page order, joined by one space."""
    return " ".join(select(read(html))) if html else ""


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [extract(h if isinstance(h, str) else None) for h in b["html"].array]
            yield b[["page_id", "url", "text"]]

    rows = clashless(pages, "page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    read = rows.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(run, "page_id string, url string, text string")
    return read.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
