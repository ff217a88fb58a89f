"""Element trees of captured pages against a plain parser, and what hangs on ancestors."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from trailweave.operators import skeleton
from trailweave.sources import pages as captured
from trailweave.sources import tree

PAGES = "page_id int, url string, html string"


class Plain(HTMLParser):
    """(tag, names of the ancestors) of each element of well-formed text."""

    def __init__(self):
        super().__init__()
        self.path, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, tuple(self.path)))
        if tag not in tree.VOID:
            self.path.append(tag)

    def handle_endtag(self, tag):
        assert self.path.pop() == tag


def made(rng: random.Random, depth: int = 0) -> str:
    out = ""
    for _ in range(rng.randrange(1, 4)):
        name = rng.choice(["div", "nav", "section", "span", "em", "br", "img", "#", "!", "script"])
        if name == "#":
            out += "a < b &amp; c"
        elif name == "!":
            out += "<!-- <nav> -->"
        elif name == "script":
            out += "<script>if (a<b) '</nav>'</script>"
        elif name in tree.VOID:
            out += f'<{name} title="1 > 0">'
        else:
            out += f"<{name} class='x {name}'>{made(rng, depth + 1) if depth < 6 else 't'}</{name}>"
    return out


def above(rows: list[list]) -> list[tuple]:
    return [(r[3], tuple(o[3] for o in rows if o[0] < r[0] < o[1])) for r in rows]


def test_intervals_equal_a_plain_parser():
    rng = random.Random(3)
    for _ in range(200):
        html, plain = made(rng), Plain()
        plain.feed(html)
        rows = tree.intervals(html)
        assert above(rows) == plain.found
        assert [r[2] for r in rows] == [len(x) for _, x in plain.found]
        assert all(html[r[0] : r[1]].endswith(f"</{r[3]}>") for r in rows if r[3] not in tree.VOID)


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("ul", 0), ("li", 1), ("li", 1), ("ul", 2), ("li", 3), ("li", 1)]),
        ("<p>a<b>b<p>c<div>d", [("p", 0), ("b", 1), ("p", 0), ("div", 0)]),
        ("<table><tr><td>a<td>b<tr><td><table><tr><td>c</table>", [("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("td", 2), ("table", 3), ("tr", 4), ("td", 5)]),
        ("</div><nav>a</section><a href=x>b</nav><i>", [("nav", 0), ("a", 1), ("i", 0)]),
        ("<div <!-- ", []),
        ("<script>x", [("script", 0)]),
        ("", []),
    ],
)
def test_ends_that_are_left_out(html, expected):
    assert [(r[3], r[2]) for r in tree.intervals(html)] == expected


def test_long_pages_are_scanned_once():
    deep = "<div>" * 50_000 + "<a href=x>y" + "<li>" * 50_000
    rows = tree.intervals(deep)
    assert len(rows) == 100_001 and rows[0][1] == len(deep)
    assert tree.intervals("<a b=\"" * 100_000)[1:] == [] and tree.intervals("<!--" * 100_000) == []


HTML = """<html><head><title>T</title></head><body>
<nav><nav><a href="/in">in</a></nav><a href="/still">still in</a></nav>
<div class="menu danger"><p><button id=del>Delete 5</button></p></div>
<main><h1>Head</h1><form><button>Send</button><button type=button aria-expanded=false data-qa=open>More</button><input type=submit value=Go disabled></form>
<div hidden><a href="/secret">secret</a></div><div class="live"><span><a href="/tick">12:01</a><h2>Now</h2></span></div>
<a href="javascript:x()">js</a><a href="/none"></a><div role="tab"><b>Tab 7</b></div><a href="/in">in</a></main></body></html>"""


def test_actions_by_their_ancestors(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", HTML), (2, "http://a.example/y", None), (3, "http://a.example/z", "")], PAGES)
    found = tree.tree_actions(pages, deny=".danger, #none", volatile="div.live").orderBy("pos").collect()
    said = [(r.role, r.label, r.kind, r.in_nav, r.volatile, r.nth) for r in found]
    assert said == [
        ("link", "in", "click", True, False, 0), ("link", "still in", "click", True, False, 0), ("button", "Send", "submit", False, False, 0), ("button", "More", "click", False, False, 0),
        ("link", "12:01", "click", False, True, 0), ("link", "", "click", False, False, 0), ("tab", "Tab 7", "click", False, False, 0), ("link", "in", "click", False, False, 1),
    ]
    more = found[3]
    assert more.toggle and more.test_id == "data-qa=open" and found[0].target == "http://a.example/in"
    assert {r.label for r in tree.tree_actions(pages).where("role = 'button'").collect()} == {"Delete 5", "Send", "More"}
    assert [(r.tag, r.text) for r in tree.tree_headings(pages, ".live").collect()] == [("h1", "Head")]


def test_structures_have_the_shapes_of_controls(spark):
    pages = spark.createDataFrame([(k, f"http://a.example/x{k}", HTML.replace("Tab 7", f"Tab {k}")) for k in (1, 2)], PAGES)
    acts = tree.tree_actions(pages, deny=".danger", volatile=".live").where("not volatile")
    heads = tree.tree_headings(pages, ".live")
    rows = skeleton.skeletons(pages, heads, captured.links(pages), controls=acts.where("role <> 'link'")).collect()
    assert all({"a:button|Send", "a:button|~", "a:tab|Tab #", "h:h1:Head"} <= set(r.lines) for r in rows)


def test_selectors_are_simple():
    with pytest.raises(ValueError, match="no simple selector"):
        tree.selected("div p", F.col("tag"), F.col("at"))


def test_empty_table(spark):
    none = spark.createDataFrame([], PAGES)
    assert tree.tree_actions(none).count() == 0 and tree.elements(none).count() == 0
