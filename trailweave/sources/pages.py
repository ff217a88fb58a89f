"""Captured pages: titles, headings, links and fields from static HTML, as columns.

The HTML of captures isn't well-formed XML, so elements are found by patterns.  What needs a
layout (visibility, covered elements) isn't in a capture; ``hidden`` and ``disabled`` are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.functions.text import accessible_label, squeeze
from trailweave.functions.urls import resolve

_ATTRIBUTE = r"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in an opening tag; null if it has none."""
    pattern = _ATTRIBUTE.replace("{name}", name)
    values = [F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]
    return F.when(tag.rlike(pattern), F.concat(*values))


def unescape(text: Column) -> Column:
    """The five references every page may have, and the no-break blank."""
    for written, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def plain_text(html: Column) -> Column:
    """Text without tags, references resolved, white space squeezed."""
    return squeeze(unescape(F.regexp_replace(html, "(?s)<[^>]*>", " ")))


def body_text(html: Column) -> Column:
    """Text of the page without comments, scripts and styles."""
    bare = F.regexp_replace(html, "(?is)<!--.*?-->|<(script|style|head|template)\\b.*?</\\1\\s*>", " ")
    return plain_text(bare)


def headings(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, tag, text) of titles and headings in page order."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(?:title|h[1-6])\b[^>]*>.*?</(?:title|h[1-6])\s*>"), F.lit(0))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "element"))
    return rows.select(
        "page_id", "url", F.col("pos").cast("int").alias("pos"), F.lower(F.regexp_extract("element", r"^<(\w+)", 1)).alias("tag"), plain_text(F.col("element")).alias("text")
    )


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, target, label, in_nav, nth) of the links of each page.

    ``nth``: which of the page's links with this label it is; ``target``: its absolute URL.
    """
    parts = F.split("html", r"(?i)(?=<nav\b)|(?<=</nav>)", -1)
    rows = pages.select("page_id", "url", F.posexplode(parts).alias("part", "chunk"))
    rows = rows.withColumn("in_nav", F.col("chunk").rlike(r"(?i)^<nav\b"))
    found = rows.select("page_id", "url", "part", "in_nav", F.posexplode(F.regexp_extract_all("chunk", F.lit(r"(?is)<a\s[^>]*>.*?</a\s*>"), F.lit(0))).alias("k", "a"))
    opening = F.regexp_extract("a", r"(?s)^(<[^>]*>)", 1)
    label = F.coalesce(F.when(squeeze(attribute(opening, "aria-label")) != "", squeeze(attribute(opening, "aria-label"))), plain_text(F.col("a")))
    named = found.select("page_id", "url", "part", "k", "in_nav", unescape(attribute(opening, "href")).alias("href"), F.substring(label, 1, 60).alias("label")).where("href is not null")
    order = Window.partitionBy("page_id").orderBy("part", "k")
    same = Window.partitionBy("page_id", "label").orderBy("part", "k")
    return named.select(
        "page_id", "url", (F.row_number().over(order) - 1).alias("pos"), "href", resolve(F.col("href"), F.col("url")).alias("target"), "label", "in_nav",
        (F.row_number().over(same) - 1).alias("nth"),
    )


def attributes(tag: Column) -> Column:
    """Map of an opening tag's attributes, names in lower case; the first of equal names counts, one without a value is ''."""
    pattern = r"(?s)\s([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"
    inner = F.regexp_replace(tag, r"(?s)^<[^\s>/]+|/?>$", "")
    found = [F.regexp_extract_all(inner, F.lit(pattern), F.lit(k)) for k in range(1, 5)]
    rows = F.transform(F.arrays_zip(*(x.alias(f"g{k}") for k, x in enumerate(found))), lambda x: F.struct(F.lower(x["g0"]).alias("k"), unescape(F.concat(x["g1"], x["g2"], x["g3"])).alias("v")))
    names = F.transform(rows, lambda x: x["k"])
    firsts = F.filter(rows, lambda x, i: F.array_position(names, x["k"]) == i + 1)
    return F.map_from_entries(firsts)


def controls(pages: DataFrame, volatile: str | None = None) -> DataFrame:
    """(page_id, pos, role, kind, label, toggle, test_id, nth) of buttons, tabs, summaries and other elements with a role.

    Links are those of ``links``.  Disabled and hidden elements, and those without a label, are left
    out; ``volatile``: pattern of opening tags that aren't actions.
    """
    from trailweave.functions import actions

    wanted = r"(?is)<(button|summary)\b[^>]*>.*?</\1\s*>|<input\s[^>]*>|<(div|span|li)\b[^>]*\srole\s*=[^>]*>.*?</\2\s*>"
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(wanted), F.lit(0))).alias("pos", "element"))
    found = found.withColumn("tag", F.regexp_extract("element", r"(?s)^(<[^>]*>)", 1)).withColumn("name", F.lower(F.regexp_extract("element", r"^<(\w+)", 1)))
    rows = found.withColumn("at", attributes(F.col("tag")))
    type_ = F.lower(F.coalesce(F.col("at")["type"], F.lit("")))
    shown = F.col("at")["disabled"].isNull() & F.col("at")["hidden"].isNull() & ((F.col("name") != "input") | type_.isin("submit", "button", "image", "reset"))
    rows = rows.where(shown if volatile is None else shown & ~F.col("tag").rlike(volatile))
    said = [F.coalesce(F.col("at")[x], F.lit("")) for x in ("aria-label",)] + [plain_text(F.col("element"))] + [F.coalesce(F.col("at")[x], F.lit("")) for x in ("value", "title", "alt")]
    rows = rows.select(
        "page_id", F.col("pos").cast("int").alias("pos"), actions.role(F.col("name"), F.coalesce(F.col("at")["role"], F.lit(""))).alias("role"), actions.kind(F.col("name"), type_, F.lit(False)).alias("kind"),
        accessible_label(*said).alias("label"), actions.is_toggle(F.col("name"), F.col("at")).alias("toggle"), actions.test_id(F.col("at")).alias("test_id"),
    )
    same = Window.partitionBy("page_id", "role", "label").orderBy("pos")
    return rows.where("label <> ''").withColumn("nth", F.row_number().over(same) - 1)


def fields(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, kind, name) of the form fields that aren't hidden."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(?:input|select|textarea)\b[^>]*>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "tag_text"))
    rows = rows.select(
        "page_id", "pos", F.lower(F.regexp_extract("tag_text", r"^<(\w+)", 1)).alias("tag"), F.coalesce(F.lower(attribute(F.col("tag_text"), "type")), F.lit("")).alias("kind"),
        F.coalesce(attribute(F.col("tag_text"), "name"), F.lit("")).alias("name"), F.col("tag_text").rlike(r"(?i)\s(disabled|hidden)\b").alias("off"),
    )
    return rows.where("kind <> 'hidden' and not off").drop("off")


def allowed(actions: DataFrame, deny_text: tuple[str, ...] = (), deny_url: tuple[str, ...] = (), volatile: str | None = None) -> DataFrame:
    """Links that may be followed: none whose label has a denied text or whose address matches a denied pattern."""
    kept = F.lit(True)
    for text in deny_text:
        kept &= ~F.contains(F.lower("label"), F.lit(text.lower()))
    for pattern in deny_url:
        kept &= ~F.col("href").rlike(f"(?i){pattern}")
    if volatile:
        kept &= ~F.col(volatile)
    script = F.col("href").rlike("(?i)^javascript:")
    return actions.where(kept & ~script & ~((F.col("label") == "") & (F.col("href") == "")))
