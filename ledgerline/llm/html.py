"""Main text of web pages by composite text density.

Every element gets, over its subtree: characters C, tags T, link characters
LC and link tags LT, and the link-adjusted characters per tag

    (C / T) * log(C/LC * T/LT) to the base ln(C * LC / nonLC + LCb / Cb * C + e)

with LCb and Cb those of the body and zero denominators taken as one.  An
element's density sum adds its children's densities; the element of largest
sum holds the text.  The least density on its path from the body is the
threshold at which further subtrees beside the path, the body's own children
included, belong to it as well.  Short blocks of an article (a lead, a list, a
table) lie below any average of it, so a subtree below the threshold belongs
too if most of its characters are unlinked and stand in paragraphs, headings, items or
cells.  An article or main element around the chosen one is taken whole, and
then neither the body nor short blocks beside it count; if the chosen
subtree has no first-rank heading, those beside it are taken too.

Menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts and styles are cut from the tree first, by element, role and the
words of class and id.  A form, or an element whose name mentions such a part
among other words, is a wrapper and stays if it holds most of the unlinked
text, or the article, main or h1 with paragraphs, and the page has no article
beside it; its flagged inner parts are judged in turn.  Pages are cut into tags by one regular expression
and nested with the usual implied ends, so broken markup has a tree too.

Cases: null or empty html gives an empty text, as does a page without text;
a page without body or with plain text only is its own body; any number of
open elements is closed at the end; repeated rows are read one by one.
"""

from __future__ import annotations

import heapq
import html as entities
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Fixed values of HTML: elements without content, with raw content, and those that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr "
    "ul".split())
#: An opening element of the key ends an open one of the value, up to the fence.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
        "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",))}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote caption figcaption".split())
CLOSES_P = BLOCK - frozenset("body br html li dd dt td th tr tbody thead tfoot caption option legend summary".split())

#: Never part of an article.
CUT_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea input iframe object embed "
                     "svg canvas menu dialog noembed noframes xmp".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors alert alerts promo promotion banner sidebar sidebars menu "
    "nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "commentlist disqus reply replies respond search toolbar widget".split())
#: Words before these say that a part is absent or present elsewhere, not that this is it.
ABOUT_OTHERS = frozenset("no has with without".split())
#: A header of these is the article's own and holds its title; any other, outside an article, is the page's.
OWN_HEADER = frozenset("article post entry content story".split())
_WORD = re.compile(r"[A-Za-z][a-z]*")
#: Why an element is cut: its name mentions a part (it may wrap one), is that part's name, or it is one by element or role.
MENTIONS, NAMED, SURE = 1, 2, 3


class _Node:
    __slots__ = ("tag", "parent", "children", "cut", "chars", "tags", "link_chars", "link_tags", "density",
                 "flag", "plain", "marks")

    def __init__(self, tag: str, parent: _Node | None, flag: int) -> None:
        self.tag, self.parent, self.flag, self.cut = tag, parent, flag, flag > 0
        self.children: list[_Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0
        self.plain = self.marks = 0


def _name_flag(value: str, inside_article: bool) -> int:
    """What the words of a class or id say of an element."""
    flag = 0
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        if words and words[0] not in ABOUT_OTHERS and (
                CUT_WORDS.intersection(words)
                or "header" in words and not inside_article and not OWN_HEADER.intersection(words)):
            flag = max(flag, NAMED if CUT_WORDS.issuperset(words) else MENTIONS)
    return flag


def _flag(tag: str, attributes: str, inside_article: bool) -> int:
    if tag in CUT_TAGS and tag != "form" or tag == "header" and not inside_article:
        return SURE
    flag = MENTIONS if tag == "form" else 0
    if tag in ("html", "body", "article", "main") or not attributes:
        return flag
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            flag = max(flag, _name_flag(value, inside_article))
        elif name == "role" and value.lower() in CUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return SURE
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return SURE
    return flag


_ARTICLE, _TITLE, _PARAGRAPH = 1, 2, 4


def _has_article(marks: int) -> bool:
    return bool(marks & _ARTICLE) or marks & (_TITLE | _PARAGRAPH) == _TITLE | _PARAGRAPH


def _keep_wrappers(root: _Node) -> None:
    """Take back the cut of wrappers that hold the page's text; largest first, then the flagged parts inside them."""
    order, todo, flagged = [], [(root, False)], False
    while todo:
        n, linked = todo.pop()
        order.append((n, linked := linked or n.tag == "a"))
        flagged |= n.flag > 0
        todo += [(c, linked) for c in n.children if isinstance(c, _Node) and c.flag != SURE]
    if not flagged:
        return
    own = {id(n): 0 if linked else sum(len("".join(c.split())) for c in n.children if isinstance(c, str)) for n, linked in order}
    for strict in (True, False):  # parts named outright are wrappers only where nothing else has text
        limit = MENTIONS if strict else NAMED
        mark = {id(n): n.marks for n, _ in order}
        for n, _ in reversed(order):  # children first
            kids = [c for c in n.children if isinstance(c, _Node) and c.flag <= limit]
            n.plain = own[id(n)] + sum(c.plain for c in kids)
            for c in kids:
                mark[id(n)] |= mark[id(c)]
            mark[id(n)] = mark[id(n)] if n.plain else 0
        outside, seen, heap = 0, 0, []

        def look(start: _Node) -> None:
            """Count what stands uncut in ``start`` and list the wrappers there."""
            nonlocal outside, seen
            todo = [start]
            while todo:
                n = todo.pop()
                outside += own[id(n)]
                seen |= n.marks if n.plain else 0
                for c in n.children:
                    if isinstance(c, _Node) and c.flag <= limit:
                        if c.cut:
                            heapq.heappush(heap, (-c.plain, len(heap), id(c), c))
                        else:
                            todo.append(c)

        look(root)
        while heap:
            n = heapq.heappop(heap)[-1]
            beside = _has_article(seen) and (seen & _ARTICLE or 10 * outside >= root.plain)
            if n.plain and not beside and (2 * n.plain > root.plain or _has_article(mark[id(n)])):
                n.cut = False
                look(n)
        if outside:
            return


def parse(page: str) -> _Node:
    """The tree of a page; text children are decoded strings."""
    root = _Node("#page", None, 0)
    at, node, end = 0, root, len(page)
    articles = 0

    def text(upto: int) -> None:
        if upto > at:
            node.children.append(entities.unescape(page[at:upto]))

    def close(upto: _Node) -> None:
        nonlocal node, articles
        while True:
            articles -= node.tag in ("article", "main")
            done = node is upto
            node = node.parent
            if done:
                return

    def open_one(names, fence=()) -> _Node | None:
        n = node
        while n is not root and n.tag not in fence:
            if n.tag in names:
                return n
            n = n.parent
        return None

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text(end)
            break
        text(m.start())
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                node.children.append(m[0][9:-3])
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag == "br":
                node.children.append(_Node("br", node, 0))
            elif n := open_one((tag,), ("table",) if tag in ("p", "li") else ()):
                close(n)
            continue
        if tag in CLOSES_P and (n := open_one(("p",), ("table", "button", "object"))):
            close(n)
        if tag in ENDS:
            while n := open_one(*ENDS[tag]):
                close(n)
        child = _Node(tag, node, _flag(tag, m[3] or m[6] or "", articles > 0))
        if tag in ("article", "main"):
            named = [v[2] or v[3] or v[4] or "" for v in _ATTRIBUTE.finditer(m[3] or m[6] or "") if v[1].lower() in ("class", "id")]
            child.marks = _ARTICLE * (not any(_name_flag(v, True) for v in named))
        elif tag in ("h1", "p"):
            child.marks = _TITLE if tag == "h1" else _PARAGRAPH
        node.children.append(child)
        if tag in VOID or (m[3] or m[6] or "").endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            child.children.append(page[at:stop.start() if stop else end])
            child.flag, child.cut = SURE, True
            at = stop.end() if stop else end
            continue
        node = child
        articles += tag in ("article", "main")
    _keep_wrappers(root)
    return root


def _walk(root: _Node) -> list[_Node]:
    """Elements that are not cut, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, _Node) and not c.cut]
    return out


def measure(root: _Node) -> list[_Node]:
    """Fill in the counts and densities of every node; returns them, parents first."""
    nodes = _walk(root)
    for n in nodes:
        n.chars = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
    for n in reversed(nodes):
        kids = [c for c in n.children if isinstance(c, _Node) and not c.cut]
        n.chars += sum(c.chars for c in kids)
        n.tags = sum(c.tags + 1 for c in kids)
        n.link_chars, n.link_tags = sum(c.link_chars for c in kids), sum(c.link_tags + (c.tag == "a") for c in kids)
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = body.link_chars / max(body.chars, 1)
    for n in nodes:
        if n.chars:
            plain = max(n.chars - n.link_chars, 1)
            base = math.log(n.chars / plain * n.link_chars + ratio * n.chars + math.e)
            inner = n.chars / max(n.link_chars, 1) * max(n.tags, 1) / max(n.link_tags, 1)
            # the logarithm's base is 1 without links: the density is then characters per tag alone
            scale = math.log(max(inner, 1.0)) / math.log(base) if base > 1.0 + 1e-12 else 1.0
            n.density = n.chars / max(n.tags, 1) * scale
    return nodes


def _is_prose(node: _Node) -> bool:
    """Whether most characters of a subtree are unlinked and stand in elements of running text."""
    prose, todo = 0, [(node, False)]
    while todo:
        n, inside = todo.pop()
        if n.tag != "a":
            inside = inside or n.tag in PROSE
            prose += sum(len("".join(c.split())) for c in n.children if isinstance(c, str)) if inside else 0
            todo += [(c, inside) for c in n.children if isinstance(c, _Node) and not c.cut]
    return 2 * prose > node.chars


def content(root: _Node) -> list[_Node]:
    """The subtrees that hold the main text, in page order."""
    nodes = measure(root)
    blocks = [n for n in nodes if n.tag in BLOCK and n.tag != "br" or n is root]
    total = {id(n): sum(c.density for c in n.children if isinstance(c, _Node) and not c.cut) for n in blocks}
    # ties go to the inner one, which comes later
    best = max(reversed(blocks), key=lambda n: total[id(n)])
    n = best
    while n is not None and n.tag not in ("article", "main"):
        n = n.parent
    if n is not None:
        best = n
        while (n := n.parent) is not None:
            if n.tag in ("article", "main"):
                best = n
    path, n = [], best
    while n is not None and n.tag not in ("body", "html", "#page"):
        path.append(n)
        n = n.parent
    chosen = {id(best)}
    if not any(x.tag == "h1" for x in _walk(best)):  # the article's title may stand beside its text
        chosen |= {id(x) for x in nodes if x.tag == "h1"}
    whole = best.tag in ("article", "main")
    inside = {id(x) for x in path}
    # beside the path, the children of the body (or of what stands for it) included
    parents = path[1:] + ([n] if path else [])
    threshold = min((x.density for x in (path if whole else [best, *parents])), default=0.0)
    for p in parents:
        chosen |= {id(c) for c in p.children if isinstance(c, _Node) and not c.cut and id(c) not in inside
                   and c.chars and (c.density >= threshold or not whole and _is_prose(c))}
    out, below = [], set()  # parents come first: what lies in a chosen subtree is not taken again
    for x in nodes:
        if x.parent is not None and (id(x.parent) in below or id(x.parent) in chosen):
            below.add(id(x))
        elif id(x) in chosen:
            out.append(x)
    return out


def text_of(node: _Node) -> str:
    """Text of a subtree; blocks and line breaks end a word, inline elements don't."""
    parts: list[str] = []
    todo: list[_Node | str] = [node]
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
        elif not c.cut:
            if c.tag in BLOCK:
                parts.append(" ")
                todo.append(" ")
            todo += reversed(c.children)
    return " ".join("".join(parts).split())


def extract(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    return " ".join(t for t in map(text_of, content(parse(page))) if t)


def main_text(html: Column | str) -> Column:
    """The main text of a column of pages; Arrow batches, whole pages, nothing shuffled."""
    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(extract, na_action=None)

    return read(html)
