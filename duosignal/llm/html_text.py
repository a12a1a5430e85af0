"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of the page. A line weighs what it has of text
outside links and outside of what is marked as menu, footer, notice, advert and the like. The sums
of weights over windows of a few lines surge where the article begins and dive to nothing after it;
text between is kept. A name doesn't mark the element that holds most of the page's text.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from duosignal.llm.shared import per_row, table

# Elements that break a line, that hold no article text, and names that mark such parts.
BLOCKS = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("aside button dialog fieldset footer form head header iframe label menu nav noscript object select svg template textarea".split())
MARKS = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs consent cookie cookies footer menu modal nav navbar navigation newsletter notice popup promo promoted related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
COMMENTS = set("comment comments commentary disqus replies respond responses".split())
# Words that a name of such a part may have beside one of these.
PLACES = set("area bar body bottom box button buttons col column container content desktop extra fixed form global group header icons inner item items left link links list main message mobile module page panel policy post posts primary right row secondary section site slot sticky thread top unit wrap wrapper".split())
ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
HOLDERS = {"article", "main"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|xmp|noembed)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[a-z]+")
_RIGHTS = re.compile(r"©|\(c\)|copyright\b", re.I)

# What the standard closes when an element begins without an end tag before it, and what keeps it open.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)), "body": (("head",), ("html",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)),
}
#: End tags that only close what began inside the innermost of these.
WITHIN = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
LISTS = set("ul ol menu dl li dd dt table tbody thead tfoot tr p h1 h2 h3 h4 h5 h6 pre hr br center".split())


def _kind(name: str) -> str:
    """What a class or id says: "comments", "named" for other parts that are no article, or nothing.

    All of its words have to be such names or places of a page, so that what merely begins with one
    (related-work, share-prices) says nothing.
    """
    words = set(_PARTS.findall(name))
    if not words or not words <= MARKS | COMMENTS | PLACES:
        return ""
    return "comments" if words & COMMENTS else "named" if words & MARKS else ""


def _aside(tag: str, attributes: str, in_article: bool) -> str:
    """If the element is no part of the article: "sure", "comments", or "named" if only a class or id says so.

    A header inside an article holds its heading; the names of headings are their topics.
    """
    if tag in SKIPPED and not (tag == "header" and in_article):
        return "sure"
    if not attributes or tag in ("html", "body"):
        return ""
    found = ""
    for name, *values in _NAMED.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "hidden" or name.lower() == "role" and value in ROLES:
            return "sure"
        if name.lower() in ("class", "id") and not re.fullmatch("h[1-6]", tag):
            kinds = {_kind(n) for n in value.split()}
            found = "comments" if "comments" in kinds else found or ("named" if "named" in kinds else "")
    return found


class Line(NamedTuple):
    text: str
    weight: int
    #: The innermost element around it that is marked as no part of the article, -1 for none.
    mark: int
    #: Numbers of the outermost holder and of the outermost article element around it, 0 for none.
    holder: int
    article: int
    #: The element around it that is no list, table row or paragraph.
    parent: int


class Mark(NamedTuple):
    kind: str
    #: The marked element around it, -1 for none.
    parent: int


class _Open(NamedTuple):
    tag: str
    mark: int
    holder: int
    article: int
    parent: int


def lines(html: str) -> tuple[list[Line], list[Mark]]:
    """The blocks of the page, and its marked elements. End tags may be left out as the standard allows."""
    out: list[Line] = []
    marks: list[Mark] = []
    text: list[str] = []
    stack = [_Open("", -1, 0, 0, 0)]
    at_tag: dict[str, list[int]] = {}  # where open elements of a tag stand in the stack
    blocks = [0]  # where open blocks do
    linked, in_link, holders, articles, elements = 0, False, 0, 0, 0

    def close() -> None:
        nonlocal linked
        line = " ".join(unescape("".join(text)).split())
        if line:
            top = stack[-1]
            out.append(Line(line, max(0, len(line) - linked), top.mark, top.holder, top.article, top.parent))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if in_link:
            linked += len(" ".join(unescape(piece).split()))

    def last(*tags: str) -> int:
        return max((at_tag[t][-1] for t in tags if at_tag.get(t)), default=0)

    def pop(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            at_tag[tag].pop()
            if blocks[-1] == len(stack):
                blocks.pop()

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        block = tag in BLOCKS or tag in SKIPPED
        if block:
            close()
        if m[2]:
            in_link = in_link and tag != "a"
            found = last(tag)
            if found and (found > last(*WITHIN.get(tag, ())) if block else found > blocks[-1]):
                close()  # a marked inline element ends a line too
                pop(found)
        elif tag not in VOID and not m[4].endswith("/"):
            if block and stack[blocks[-1]].tag == "p":
                pop(blocks[-1])
            closed, kept = IMPLIED.get(tag, ((), ()))
            if closed and (found := last(*closed)) > last(*kept):
                pop(found)
            top = stack[-1]
            aside = _aside(tag, m[4], top.holder > 0 or tag in HOLDERS)
            mark, holder, article, parent = top.mark, top.holder, top.article, top.parent
            if aside:
                close()
                marks.append(Mark(aside, mark))
                mark = len(marks) - 1
            elif tag in HOLDERS and (mark < 0 or marks[mark].kind == "named"):
                holders += not holder
                holder = holder or holders
                if tag == "article" and not article:
                    articles += 1
                    article = articles
            if block and tag not in LISTS:
                elements += 1
                parent = elements
            if block or aside or at_tag.get(tag) or tag not in ("b", "i", "em", "strong", "br"):
                at_tag.setdefault(tag, []).append(len(stack))
                if block:
                    blocks.append(len(stack))
                stack.append(_Open(tag, mark, holder, article, parent))
            in_link = in_link or tag == "a"
    add(html[at:])
    close()
    return out, marks


def _lifted(found: list[Line], marks: list[Mark], window: int, least: int) -> list[bool]:
    """Which marks hold: all but names on elements that have most of the text.

    Such an element has over half of the text outside links and of what is marked by more than a name,
    and a window of over ``least`` characters, while no article or main element outside of names has
    one. If no text outside of names has, an article or main element inside them goes before. The names
    of comments always hold.
    """
    holds = [True] * len(marks)
    firm = [m.kind != "named" for m in marks]
    for i, m in enumerate(marks):
        firm[i] = firm[i] or (m.parent >= 0 and firm[m.parent])
    open_ = [x.weight if x.mark < 0 or not firm[x.mark] else 0 for x in found]
    sums = _sums(open_, window)
    if any(s > least for s, x in zip(sums, found, strict=True) if x.holder and x.mark < 0):
        return holds
    plain = _sums([x.weight if x.mark < 0 else 0 for x in found], window)
    held = {x.mark for s, x in zip(sums, found, strict=True) if s > least and x.holder and x.mark >= 0 and not firm[x.mark]}
    if held and max(plain) <= least:
        for i in held:
            while i >= 0:
                holds[i], i = False, marks[i].parent
        return holds
    weight, first, end = [0] * len(marks), [len(found)] * len(marks), [0] * len(marks)
    for j, x in enumerate(found):
        if x.mark >= 0:
            weight[x.mark] += open_[j]
            first[x.mark], end[x.mark] = min(first[x.mark], j), j + 1
    for i in range(len(marks) - 1, -1, -1):
        if (up := marks[i].parent) >= 0:
            weight[up] += weight[i]
            first[up], end[up] = min(first[up], first[i]), max(end[up], end[i])
    # Elements with over half of the text stand in each other, so their windows are looked at from the innermost on.
    fullest, seen = 0, (0, 0)
    for i in range(len(marks) - 1, -1, -1):
        if not firm[i] and 2 * weight[i] > sum(open_):
            new = [*range(first[i], seen[0]), *range(seen[1], end[i])] if seen[1] else range(first[i], end[i])
            fullest, seen = max([fullest, *(sums[j] for j in new)]), (first[i], end[i])
            holds[i] = fullest <= least
    return holds


def _sums(weights: list[int], window: int) -> list[int]:
    return [sum(weights[i : i + window]) for i in range(len(weights))]


def main_text(html: str, window: int = 3, least: int = 80) -> str:
    """The blocks between a surge and the next dive of the windowed weights, joined by newlines.

    A surge is a window of over ``least`` characters, or over a quarter of the page's fullest
    window if that is less; it reaches back to where the sums left zero, the dive is where they
    return to it. If the page has article or main elements with text, only theirs weighs; weights
    only find the borders there. An article with a surge keeps all of its blocks, a main element
    those from its first surge to its last dive, linked and short ones too, but what is marked.
    Elsewhere each surge and its dive bound the text, linked blocks stay between others, and lines of the
    element that holds the text stay up to its last line that is not a link or a notice of rights.
    """
    found, marks = lines(html)
    holds = _lifted(found, marks, window, least)
    for i, m in enumerate(marks):  # what is in a marked element is marked
        holds[i] = holds[i] or (m.parent >= 0 and holds[m.parent])
    shown = [x.mark < 0 or not holds[x.mark] for x in found]
    marked = any(x.weight and x.holder for x, s in zip(found, shown, strict=True) if s)
    weights = [x.weight if s and (x.holder or not marked) else 0 for x, s in zip(found, shown, strict=True)]
    sums = _sums(weights, window)
    bound = min(least, max(sums, default=0) / 4)
    kept: set[int] = set()
    ends: dict[int, tuple[int, int]] = {}
    start = 0
    for i in range(len(sums) + 1):
        if i == len(sums) or not sums[i]:
            if max(sums[start:i], default=0) > bound:
                heavy = [j for j in range(start, i) if weights[j]]
                kept.update(j for j in range(heavy[0], heavy[-1] + 1) if shown[j] and (found[j].holder or not marked))
                for j in range(start, i):
                    if found[j].holder:
                        ends[found[j].holder] = (ends.get(found[j].holder, (j, j))[0], j)
            start = i + 1
    articles: dict[int, list[int]] = {}
    for j, x in enumerate(found):
        if shown[j] and x.article:
            articles.setdefault(x.article, []).append(j)
        elif shown[j] and x.holder in ends and ends[x.holder][0] <= j <= ends[x.holder][1]:
            kept.add(j)
    if not marked and kept:
        # A short end of the text after linked lists: lines of the element that holds the text, up to the last with weight.
        parents = {found[j].parent for j in kept if weights[j]}
        own = [j for j in range(min(kept), len(found)) if shown[j] and found[j].parent in parents]
        last = max((j for j in own if weights[j] and not _RIGHTS.match(found[j].text)), default=-1)
        kept.update(j for j in own if j <= last)
    for rows in articles.values():
        if not kept.isdisjoint(rows) or max(_sums([weights[j] for j in rows], window)) > bound:
            kept.update(rows)
    return "\n".join(found[j].text for j in sorted(kept))


_OUT = pa.schema([("text", pa.string()), ("n_chars", pa.int64())])


def _extract(html: bytes) -> tuple[str, int]:
    text = main_text(html.decode(errors="replace"))
    return text, len(text)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    Null or empty html, or a page without text outside of menus and the like: empty text. Repeated
    rows: one result each. Of articles that weigh the same all are kept, in page order. No rows: no
    rows. Further columns are ignored. Whole pages are read, in time linear in their length.
    """
    return pages.select("page_id", "url", "html").mapInArrow(per_row(_extract, _OUT, ["page_id", "url"], "html"), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
