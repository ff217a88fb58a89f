"""Main text of HTML pages by tree scoring.

Paragraphs earn points for their length and commas and pass them to their ancestors, less with
each step up; a container's points are discounted by its link density.  The best container is
kept with those of its siblings that score near it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.blocks import sliced

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|</\s*([a-zA-Z][^\s/>]*)[^>]*(?:>|$)"
    # attributes up to the ">" outside quotes; where a quote is never closed, up to the next ">"
    r"|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+(?:>|\Z)|[^>]*+(?:>|\Z))",
    re.S,
)
#: Elements nested deeper than this become siblings, as in browsers.
_DEEPEST = 500
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_RAW_END = {x: re.compile(rf"</{x}[\s/>]", re.I) for x in _RAW}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: What an opening tag closes, if it is open within the nearest of the stops.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_STOPS = {"article", "section", "div", "body", "td", "th", "li", "blockquote", "table", "main", "aside", "button"}
_NEVER = {"nav", "footer", "aside", "form", "button", "select", "input", "svg", "canvas", "object", "menu", "dialog", "head"}
#: Words of class, id and role that mark what isn't the article.
_UNWANTED = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios kommentare "
    "cookie cookies consent disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond "
    "share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription teaser toolbar widget "
    "complementary contentinfo search alert alertdialog".split()
)
#: Those of them that are never around an article: readers' words and consent.
_NEVER_AROUND = set("comment comments comentarios kommentare discussion disqus reply replies respond cookie cookies consent gdpr sidebar nav navbar".split())
_WANTED = set("article body content entry hentry main page post story text blog".split())
_WORD = re.compile(r"[a-z]+")


class Node:
    """An element; sizes are those of its whole text: characters, commas, characters inside links."""

    __slots__ = ("tag", "words", "children", "parent", "depth", "score", "chars", "linked", "commas", "holds")

    def __init__(self, tag: str, words: frozenset, parent: Node | None):
        self.tag, self.words, self.parent = tag, words, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list = []
        self.score = self.chars = self.linked = 0.0
        self.commas, self.holds = 0, False


def _marks(attributes: str) -> tuple[frozenset, bool]:
    """Words of class, id and role, and whether the element is hidden."""
    words, hidden = set(), False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            words.update(_WORD.findall("".join(values).lower()))
        hidden |= name == "hidden" or name == "aria-hidden" and "true" in values or name == "style" and "display:none" in "".join(values).replace(" ", "")
    return frozenset(words), hidden


def parse(page: str) -> Node:
    """A light tree of the page; texts are still escaped strings among the children."""
    root = node = Node("#root", frozenset(), None)
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        if close := m[1]:
            close, up = close.lower(), node
            while up.parent and up.tag != close:
                up = up.parent
            if up.parent:
                node = up.parent
            elif close == "br":
                node.children.append(" ")
        elif tag := m[2]:
            tag = tag.lower()
            if tag in _RAW:
                end = _RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)
                close = page.find(">", at)
                at = close + 1 if end and close >= 0 else len(page)
                continue
            if tag in _BLOCK:  # a block closes an open paragraph
                up = node
                while up.parent and up.tag != "p" and up.tag not in _P_STOPS:
                    up = up.parent
                if up.tag == "p":
                    node = up.parent
            if tag in _CLOSES:
                closes, stops = _CLOSES[tag]
                up, found = node, None
                while up.parent and up.tag not in stops:
                    found = up if up.tag in closes else found
                    up = up.parent
                node = found.parent if found else node
            attributes = m[3].removesuffix(">")
            words, hidden = _marks(attributes) if attributes else (frozenset(), False)
            if hidden:
                words |= {"ad"}
            child = Node(tag, words, node)
            node.children.append(child)
            if tag not in _VOID and not attributes.endswith("/") and child.depth < _DEEPEST:
                node = child
    return root


_COMMAS = re.compile("[,\u060c\uff0c]")


def sizes(node: Node, linked: bool = False) -> None:
    """Sets the sizes of all nodes and whether they hold an article's elements; linear, from the leaves up."""
    linked = linked or node.tag == "a"
    node.chars = node.linked = 0.0
    node.commas, node.holds = 0, False
    for x in node.children:
        if isinstance(x, str):
            text = html.unescape(x) if "&" in x else x
            n = len(text.strip())
            node.chars += n
            node.linked += n * linked
            node.commas += len(_COMMAS.findall(text))
        else:
            sizes(x, linked)
            node.chars += x.chars
            node.linked += x.linked
            node.commas += x.commas
            node.holds |= x.holds or x.tag in ("article", "main", "h1")


def candidate_chars(node: Node) -> float:
    """Characters outside elements that are never part of an article or around one."""
    if node.tag in _NEVER or node.words & _NEVER_AROUND:
        return 0.0
    return node.chars - sum(x.chars - candidate_chars(x) for x in node.children if not isinstance(x, str))


def _dropped(node: Node, inside: bool, page_chars: float) -> bool:
    """Whether a node isn't part of any article; ``inside``: of an article or main element.

    What only its marks speak against stays if it holds an article's elements and most of the
    page's text, as far as that can be an article's, with few links: then it is the page's frame,
    whatever it is called.
    """
    if node.tag in _NEVER or node.tag == "header" and not inside:
        return True
    if node.tag == "article":
        return bool(node.words & {"comment", "comments", "reply"})
    if node.tag in ("html", "body", "main") or not node.words & _UNWANTED:
        return False
    frame = node.holds and not node.words & _NEVER_AROUND and node.chars > 0.5 * page_chars and node.linked < 0.3 * node.chars
    return not frame


def prune(node: Node, page_chars: float, inside: bool = False) -> None:
    inside = inside or node.tag in ("article", "main")
    node.children = [x for x in node.children if isinstance(x, str) or not _dropped(x, inside, page_chars)]
    for x in node.children:
        if not isinstance(x, str):
            prune(x, page_chars, inside)


def measure(node: Node, containers: list[Node]) -> None:
    """The points that paragraphs pass up, from the sizes of what is left of the tree."""
    for x in node.children:
        if not isinstance(x, str):
            measure(x, containers)
    whole = node.tag in ("p", "pre", "td", "blockquote")
    own = [x for x in node.children if isinstance(x, str)]
    paragraph = whole or node.tag == "h1" or node.tag in ("div", "section", "article", "main", "li", "dd", "body", "#root") and any(map(str.strip, own))
    if paragraph and node.chars:
        chars, commas = (node.chars, node.commas) if whole else (sum(map(len, own)), sum(len(_COMMAS.findall(x)) for x in own))
        points = min(1.0, node.chars / 25) + commas + min(3.0, chars / 100)
        points *= 1 - node.linked / node.chars
        up, share = (node.parent if whole or node.tag in ("h1", "li", "dd") else node), 1.0
        for step in (1, 2, 3, 4):
            if up is None:
                break
            up.score += points * share
            up, share = up.parent, 0.5 if step == 1 else 1 / (3 * step)
    if node.tag in ("div", "section", "article", "main", "td", "body", "#root", "blockquote", "center"):
        containers.append(node)


def _final(node: Node) -> float:
    """Points of a container, with what its tag and marks tell, discounted by its link density."""
    base = {"article": 30.0, "main": 25.0, "section": 2.0, "div": 1.0}.get(node.tag, 0.0)
    base += 10.0 * bool(node.words & _WANTED) - 15.0 * bool(node.words & _UNWANTED)
    return (node.score + base) * (1 - node.linked / node.chars) if node.chars else -1.0


def _blocks(node: Node, out: list[list[str]]) -> None:
    for x in node.children:
        if isinstance(x, str):
            out[-1].append(x)
        elif x.tag in _BLOCK:
            out.append([])
            _blocks(x, out)
            out.append([])
        elif x.tag == "br":
            out[-1].append(" ")
        else:
            _blocks(x, out)


def main_text(page: str) -> str:
    """The article's blocks, one a line; '' if the page has none."""
    root = parse(page)
    sizes(root)
    prune(root, candidate_chars(root))
    sizes(root)
    containers: list[Node] = []
    measure(root, containers)
    found = [(s, x) for x in containers if (s := _final(x)) > 0]
    if not found:
        return ""
    best_score, best = max(found, key=lambda x: x[0])
    kept = [best]
    if best.parent is not None and best.tag not in ("article", "main", "body"):
        near = max(10.0, 0.2 * best_score)
        alike = lambda x: best.words and (x.tag, x.words) == (best.tag, best.words)
        wanted = lambda x: x is best or x.chars and (_final(x) >= (0.2 * best_score if alike(x) else near) or x.tag == "p" and x.chars > 80 and x.linked < 0.25 * x.chars)
        kept = [x for x in best.parent.children if not isinstance(x, str) and wanted(x)]
    elif best.tag == "article" and best.parent is not None:
        kept = [x for x in best.parent.children if x is best or not isinstance(x, str) and x.tag == "article" and _final(x) >= 0.2 * best_score]
    out: list[list[str]] = []
    for x in kept:
        out.append([])
        _blocks(x, out)
    lines = (" ".join(html.unescape("".join(x)).split()) for x in out)
    return "\n".join(x for x in lines if x)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * _DEEPEST))
    for batch in sliced(batches, "html", 1 << 22):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page; narrow, without a shuffle.

    Null and empty pages, and pages without an article, have the empty text.  Of containers with
    equal points the first in the page wins.  Ids and URLs are passed on as they are, also null or
    repeated ones; other columns are ignored; an empty table gives no rows.  The work grows with
    the length of a page, however deep its elements are nested.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
