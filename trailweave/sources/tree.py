"""Element tree of captured pages: each element as an interval of its page's text, ancestors as intervals around it.

One scan of a page pairs opening and closing tags; what follows is columns.  An element lies in
another if it opens within the other's interval, so whether any ancestor matches a selector
is a running maximum of the ends of the matching ones, over one sort of a page's elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.functions import actions
from trailweave.functions.text import accessible_label, squeeze
from trailweave.functions.urls import resolve
from trailweave.sources.pages import attributes, plain_text

#: Elements without content, those whose content is no markup, and what an opening tag ends (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")} | {x: ("p",) for x in _BLOCKS}
SCOPES = frozenset("ul ol dl table select button article section div nav aside header footer main form td th body html".split())
#: Regions of navigation, elements that are acted on, and regions whose content isn't shown (fixed values).
NAV = "nav, header, footer, aside, [role=navigation], [role=banner], [role=contentinfo], [role=complementary]"
ACTED = "a[href], button, summary, input[type=submit], input[type=button], input[type=image], input[type=reset], [role=button], [role=link], [role=tab], [role=menuitem], [role=option], [role=checkbox], [role=switch]"
UNSEEN = "[hidden], template, noscript, head"
#: Elements whose content is carried along.
_NAMED = re.compile(r"(?:a|button|summary|h[1-6]|title)$")
_ROLE = re.compile(r"(?i)\srole\s*=\s*[\"']?(?:button|link|tab|menuitem|option|checkbox|switch)\b")
_NEXT = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^>"']+|["'])*+)>""")
_OUT = ["open", "close", "depth", "tag", "opening", "inner"]


def intervals(html: str) -> list[list]:
    """[open, close, depth, tag, opening tag, inner text or None] of a page's elements in order.

    ``close`` is where the element's end tag ends.  An end tag closes the innermost open element of its
    name and all in it; one without such an element is ignored.  What is open at the end closes there.
    """
    found: list[list] = []
    stack: list[list] = []
    places: dict[str, list[int]] = {}

    def close(level: int, at: int, own_end: int) -> None:
        while len(stack) > level:
            element = stack.pop()
            places[element[3]].pop()
            element[1] = own_end if len(stack) == level else at
            if _NAMED.match(element[3]) or _ROLE.search(element[4]):
                element[5] = html[element[0] + len(element[4]) : at]

    def last(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    at = 0
    while m := _NEXT.search(html, at):
        at = m.start()
        if html.startswith("<!--", at):
            at = html.find("-->", at + 4) + 3
            if at == 2:
                break
            continue
        tag = _TAG.match(html, at)
        if not tag:
            # a declaration, or a tag that never ends: then the rest is no markup
            end = html.find(">", at)
            if end < 0 or html[at + 1] not in "!?/":
                break
            at = end + 1
            continue
        name, at = tag[2].lower(), tag.end()
        if tag[1]:
            if places.get(name):
                close(places[name][-1], tag.start(), at)
            continue
        if name in ENDS and (level := last(ENDS[name])) > last(SCOPES.difference(ENDS[name])):
            if name == "tr" and places.get("tr"):
                level = max(places["tr"][-1], last(("table",)) + 1)
            close(level, tag.start(), tag.start())
        element = [tag.start(), at, len(stack), name, tag[0], None]
        found.append(element)
        if name in RAW:
            end = re.compile(f"(?i)</{name}\\s*>").search(html, at)
            stop, at = (end.start(), end.end()) if end else (len(html), len(html))
            element[1] = at
            if name == "title":
                element[5] = html[tag.end() : stop]
        elif name not in VOID and not tag[3].endswith("/"):
            places.setdefault(name, []).append(len(stack))
            stack.append(element)
    close(0, len(html), len(html))
    return found


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 32):
            part = batch.slice(at, 32)
            trees = [intervals(x or "") for x in part.column("html").to_pylist()]
            who = pa.array([k for k, tree in enumerate(trees) for _ in tree], pa.int64())
            rows = [x for tree in trees for x in tree]
            columns = [pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.record_batch([part.column("page_id").take(who), part.column("url").take(who), *columns], ["page_id", "url", *_OUT])


def elements(pages: DataFrame) -> DataFrame:
    """(page_id, url, open, close, depth, tag, opening, inner) of the elements of each page (page_id, url, html).

    ``open`` and ``close``: the interval in code points; ``inner``: content of links, buttons, summaries,
    headings, titles and elements that have the role of an action.  Comments, and what scripts and styles hold, are no elements.
    A null page has none.  ``page_id`` names a page.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_scanned, f"page_id {kind}, url string, open int, close int, depth int, tag string, opening string, inner string")


def selected(selector: str, tag: Column, at: Column) -> Column:
    """Whether an element with the name ``tag`` and the map ``at`` of attributes matches a list of simple selectors.

    Name, ``.class``, ``#id``, ``[attribute]`` and ``[attribute=value]``, alone or joined; others are an error.
    """
    found = F.lit(False)
    for one in filter(None, (x.strip() for x in selector.split(","))):
        parts = re.findall(r"""([.#]?)([\w-]+|\*)|\[([\w-]+)(?:=["']?([^"'\]]*)["']?)?\]""", one)
        if "".join(re.split(r"""[.#]?(?:[\w-]+|\*)|\[[\w-]+(?:=["']?[^"'\]]*["']?)?\]""", one)):
            raise ValueError(f"no simple selector: {one}")
        fits = F.lit(True)
        for mark, name, attribute, value in parts:
            if attribute:
                own = at[attribute.lower()]
                fits &= own.isNotNull() & ((F.lower(own) == value.lower()) if value else F.lit(True))
            elif mark == ".":
                fits &= F.array_contains(F.split(F.coalesce(at["class"], F.lit("")), r"\s+"), name)
            elif mark == "#":
                fits &= F.coalesce(at["id"] == name, F.lit(False))
            elif name != "*":
                fits &= tag == name.lower()
        found |= fits
    return found


def closest(tree: DataFrame, **selectors: str) -> DataFrame:
    """``tree`` with a column of each selector's name: whether an element or any ancestor of it matches; and ``at``, its attributes."""
    above = Window.partitionBy("page_id").orderBy("open").rowsBetween(Window.unboundedPreceding, 0)
    rows = tree.withColumn("at", attributes(F.col("opening")))
    ends = [F.coalesce(F.max(F.when(selected(s, F.col("tag"), F.col("at")), F.col("close"))).over(above) > F.col("open"), F.lit(False)).alias(name) for name, s in selectors.items()]
    return rows.select("*", *ends)


def tree_actions(pages: DataFrame, deny: str = "", volatile: str = "") -> DataFrame:
    """(page_id, url, pos, role, kind, label, href, target, toggle, test_id, in_nav, volatile, nth) of what can be acted on.

    Left out: what lies in an element that ``deny`` selects, in hidden or unseen elements, in a disabled
    one, and what has neither label nor address.  ``volatile``: lies in an element that this selects.
    ``nth``: which of the page's actions with this role and label it is, from 0.  Actions are in page order.
    """
    tree = closest(elements(pages), denied=deny, volatile=volatile, in_nav=NAV, in_form="form", off=UNSEEN)
    at, tag = F.col("at"), F.col("tag")
    kept = selected(ACTED, tag, at) & ~F.col("denied") & ~F.col("off") & at["disabled"].isNull()
    type_ = F.lower(F.coalesce(at["type"], F.lit("")))
    said = [F.coalesce(at["aria-label"], F.lit("")), plain_text(F.coalesce("inner", F.lit(""))), *(F.coalesce(at[x], F.lit("")) for x in ("value", "title", "alt"))]
    rows = tree.where(kept).select(
        "page_id", "url", "open", actions.role(tag, F.coalesce(at["role"], F.lit(""))).alias("role"), actions.kind(tag, type_, F.col("in_form")).alias("kind"), squeeze(accessible_label(*said)).alias("label"),
        F.when(tag == "a", at["href"]).alias("href"), actions.is_toggle(tag, at).alias("toggle"), actions.test_id(at).alias("test_id"), "in_nav", "volatile",
    )
    script = F.coalesce(F.col("href").rlike("(?i)^javascript:"), F.lit(False))
    rows = rows.where(~script & ((F.col("label") != "") | F.col("href").isNotNull()))
    page, same = Window.partitionBy("page_id").orderBy("open"), Window.partitionBy("page_id", "role", "label").orderBy("open")
    return rows.select(
        "page_id", "url", (F.row_number().over(page) - 1).alias("pos"), "role", "kind", "label", "href", resolve(F.col("href"), F.col("url")).alias("target"), "toggle", "test_id", "in_nav", "volatile",
        (F.row_number().over(same) - 1).alias("nth"),
    )


def tree_headings(pages: DataFrame, volatile: str = "") -> DataFrame:
    """(page_id, pos, tag, text) of the headings that are shown and don't lie in an element that ``volatile`` selects."""
    tree = closest(elements(pages), volatile=volatile, off=UNSEEN).where(F.col("tag").rlike("^h[1-6]$") & ~F.col("volatile") & ~F.col("off"))
    return tree.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("open")) - 1).alias("pos"), "tag", plain_text(F.coalesce("inner", F.lit(""))).alias("text"))
