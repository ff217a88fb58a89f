"""Actions, what a run records of them, and settings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trailweave.functions import actions
from trailweave.operators import recording, skeleton
from trailweave.sources import pages, runs, settings

OWN = "http://a.test"


def test_shape_keys(spark):
    kind = "role string, label string, target string, toggle boolean, kind string, search boolean, values array<string>"
    rows = [
        ("link", "Item 7", "http://a.test/items/7?x=1", False, "click", False, []), ("link", "Away", "https://b.test/q/9", False, "click", False, []), ("button", "Show: 12 \u25be", None, True, "click", False, []),
        ("button", "Compare Acme 3", None, False, "click", False, ["Acme"]), ("button", "Send", None, False, "submit", False, []), ("button", "Find", None, False, "submit", True, []),
    ]
    c = F.col
    df = spark.createDataFrame(rows, kind)
    fold = F.create_map(F.lit("button|Compare * #"), F.lit("Compare *"))
    out = df.select(
        actions.action_key(c("role"), c("label"), c("target"), c("toggle"), F.lit(OWN), c("values"), fold).alias("key"),
        actions.family_key(c("role"), c("label"), c("kind"), c("target"), c("values")).alias("family"),
        actions.common_key(c("role"), c("label"), c("kind"), c("search"), c("toggle"), c("target"), F.lit(OWN), c("values")).alias("common"),
        actions.is_clean(c("role"), c("kind"), c("search"), c("target"), c("toggle")).alias("clean"),
    ).collect()
    assert [r.key for r in out] == ["link|/items/*", "link|//b.test", "button|~", "button|Compare *", "button|Send", "button|Find"]
    assert [r.family for r in out] == [None, None, "button|Show: # \u25be", "button|Compare * #", "button|Send|submit", "button|Find|submit"]
    assert [r.common for r in out] == ["L|link|/items/*", "L|link|//b.test", "C|button|Show: # \u25be", "C|button|Compare * #", None, "C|button|Find|submit"]
    assert [r.clean for r in out] == [True, True, True, False, False, True]


HTML = """<form><button>Save <b>all</b></button><button type=button data-qa="m" aria-haspopup="menu">More</button><input type="submit" value="Go"><input type="text" value="no">
<button disabled>Off</button></form><details><summary>Facts 3</summary></details><div role="tab" title="x">Tab &amp; two</div><button aria-label="  ">Save all</button><div role=combobox data-testid='c'>Pick</div>"""


def test_controls_of_a_page(spark):
    found = pages.controls(spark.createDataFrame([(1, HTML), (2, ""), (3, None)], "page_id int, html string")).orderBy("pos").collect()
    assert [(r.role, r.kind, r.label, r.toggle, r.test_id, r.nth) for r in found] == [
        ("button", "click", "Save all", False, None, 0), ("button", "click", "More", True, "data-qa=m", 0), ("button", "submit", "Go", False, None, 0), ("summary", "click", "Facts 3", True, None, 0),
        ("tab", "click", "Tab & two", False, None, 0), ("button", "click", "Save all", False, None, 1), ("combobox", "click", "Pick", True, "data-testid=c", 0),
    ]


def test_pages_that_differ_in_buttons_differ(spark):
    two = spark.createDataFrame([(k, "http://a.test/x", f"<h1>T</h1><button>{label}</button>") for k, label in enumerate(["Buy 1", "Buy 2", "Sell"])], "page_id int, url string, html string")
    out = skeleton.skeletons(two, pages.headings(two), pages.links(two), controls=pages.controls(two)).orderBy("page_id").collect()
    assert [list(r.lines) for r in out] == [["h:h1:T", "a:button|Buy #"], ["h:h1:T", "a:button|Buy #"], ["h:h1:T", "a:button|Sell"]]
    assert out[0].signature == out[1].signature != out[2].signature


def test_failures_leave_out_what_was_broken_off(spark):
    log = [
        (1, 0, "console", "error", "x" * 400, None, None, None), (1, 1, "console", "warning", "w", None, None, None), (1, 2, "pageerror", None, "boom", None, None, None), (1, 3, "requestfailed", None, "net::ERR_ABORTED", "GET", "/a", None),
        (1, 4, "requestfailed", None, None, "GET", "/b", None), (1, 5, "response", None, None, "POST", "/c", 500), (1, 6, "response", None, None, "GET", "/d", 304),
    ]
    found = recording.failures(spark.createDataFrame(log, "node int, pos int, kind string, level string, text string, method string, url string, status int")).orderBy("pos").collect()
    assert [(r.pos, r["list"], r.text) for r in found] == [(0, "console", "x" * 300), (2, "console", "boom"), (4, "request", "GET /b (failed)"), (5, "request", "500 POST /c")]


def test_viewer_helpers(spark):
    df = spark.createDataFrame([("s1", "Home Page", True, False, 0), ("s2", "List", False, False, 2)], "id string, title string, added boolean, changed boolean, errors int")
    ask = lambda status, text: [r.id for r in df.where(recording.passes(status, text, F.col("added"), F.col("changed"), F.col("errors"), F.col("id"), F.col("title"))).collect()]
    assert (ask("all", ""), ask("added", ""), ask("error", ""), ask("all", "PAGE"), ask("changed", "")) == (["s1", "s2"], ["s1"], ["s2"], ["s1"], [])
    name = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    assert {(r.name, tuple(r.sources)) for r in recording.known_names(name("Acme", " Acme ", "12"), name("Acme", "Beta"), name("-", None)).collect()} == {("Acme", ("row", "title")), ("Beta", ("row",))}
    via = spark.createDataFrame([(1, 0, "a", "button", "Add X"), (1, 1, "a", "link", "Go")], "edge_pos int, k int, src string, role string, label string")
    local = spark.createDataFrame([("a", 2, "button", "Add X", "late"), ("a", 1, "button", "Add X", "Add *")], "node string, pos int, role string, label string, pattern string")
    assert [r["name"] for r in recording.via_names(via, local).orderBy("k").collect()] == ["Add *", "Go"]
    shots = recording.previous_shots(spark.createDataFrame([("n", "p"), ("m", "q")], "id string, prev_id string"), spark.createDataFrame([("p", "s1.png"), ("q", None)], "id string, screenshot string"), "../old")
    assert dict(map(tuple, shots.collect())) == {"n": "../old/s1.png", "m": ""}
    known = recording.known_signatures(spark.createDataFrame([("x",), ("y",)], "signature string"), spark.createDataFrame([("y",)], "signature string"))
    assert [r.signature for r in known.collect()] == ["x"]
    views = [("/a", "/a", ["h:h1:T", "a:link|/x"], ["h:h1:T", "a:link|/x", "a:button|New"]), ("/a", "/b", ["h:h1:T"], ["h:h1:T"]), (None, None, ["h:h1:T"], ["h:h1:T"])]
    found = recording.absorbed(spark.createDataFrame(views, "src_route string, dst_route string, before array<string>, after array<string>"))
    assert [r.absorb for r in found.collect()] == [True, False, False]


def test_settings_are_merged_and_checked():
    found = settings.merged({"maxDepth": 3, "viewport": {"width": 800}, "outDir": "out", "storageState": "a.json"}, {"maxStates": 9, "outDir": None, "baseline": "b"}, "/conf", "/work")
    assert (found.maxDepth, found.maxStates, found.viewport, found.outDir, found.storageState, found.baseline) == (3, 9, {"width": 800, "height": 800}, "/conf/out", "/conf/a.json", "/work/b")
    kept = settings.recorded(found)
    assert kept["authenticated"] is True and kept["maxStates"] == 9 and not {"outDir", "storageState", "denyUrl"} & set(kept)
    assert settings.problems({"maxDepth": "3", "queryParams": "some", "maxStates": 0, "nope": 1, "denyUrl": ["ok", "("], "baseline": None, "pathRules": [{"pattern": "["}]}) != []
    with pytest.raises(ValueError, match="maxDepth: number is wanted, not text; queryParams: one of ignore, names, values"):
        settings.merged({"maxDepth": "3", "queryParams": "some"}, {})
    assert settings.problems({"absorbLocalChanges": 1}) == ["absorbLocalChanges: true or false is wanted, not number"]


def test_runs_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("r1", 1, "s2", "B", "http://x/?token=a&p=1", "/b", "T", 1, "h", ["at http://x/?sid=9"], [], []), ("r1", 0, "s1", "A", "http://x/", "/", None, 0, None, [], [], ["old"])],
        "run string, pos int, id string, signature string, url string, route string, title string, depth int, text_hash string, console_errors array<string>, failed_requests array<string>, alias_signatures array<string>",
    )
    edges = spark.createDataFrame([("r1", 0, "s1", "s2", "link", "B", "/b?key=1", None, False)], "run string, edge_pos int, src string, dst string, role string, label string, href string, error string, inferred boolean")
    meta = spark.createDataFrame([("r1", "s1", "http://x/", None, {"a": "b"}), ("r2", "s1", "http://x/", "error", None)], "run string, root string, base_url string, stop_kind string, config map<string,string>")
    folder = str(tmp_path / "runs")
    made = runs.run_documents(nodes, edges, meta)
    assert runs.write_runs(made, folder) == ["r1", "r2"]
    found = runs.read_runs(spark, folder)
    assert {r.run: r.broken for r in found.select("run", "broken").collect()} == {"r1": False, "r2": True}
    own = runs.nodes(found).orderBy("pos").collect()
    assert [(r.id, r.url, list(r.console_errors), list(r.alias_signatures)) for r in own] == [("s1", "http://x/", [], ["old"]), ("s2", "http://x/?token=***&p=1", ["at http://x/?sid=***"], [])]
    assert [(r.src, r.dst, r.href) for r in runs.edges(found).collect()] == [("s1", "s2", "/b?key=***")]


def test_long_runs_are_written_in_parts(spark, tmp_path):
    node = "run string, pos int, id string, signature string, url string, route string, title string, depth int, text_hash string, console_errors array<string>, failed_requests array<string>, alias_signatures array<string>"
    nodes = spark.createDataFrame([(r, k, f"s{k}", "A", "http://x/", "/", "T", 0, None, [], [], []) for r, n in (("long", 5), ("short", 2)) for k in reversed(range(n))], node)
    edges = spark.createDataFrame(
        [(r, k, f"s{k % 5}", f"s{k % 3}", "link", f"L{k}", "/", None, False) for r, n in (("long", 27), ("short", 4)) for k in reversed(range(n))],
        "run string, edge_pos int, src string, dst string, role string, label string, href string, error string, inferred boolean",
    )
    meta = spark.createDataFrame([(r, "s0", "http://x/", None, {}) for r in ("long", "short")], "run string, root string, base_url string, stop_kind string, config map<string,string>")
    folder = str(tmp_path / "runs")
    made = runs.run_documents(nodes, edges, meta, part_size=4)
    assert {(r.run, len(r.nodes), len(r.edges)) for r in made.collect()} == {("long", 4, 4), ("long", 1, 4), ("long", 0, 4), ("long", 0, 3), ("short", 2, 4)}
    assert runs.write_runs(made, folder) == ["long", "short"]
    found = runs.read_runs(spark, folder)
    assert sorted((r.run, r.meta.totalStates, r.meta.totalEdges) for r in runs.heads(found).where("not broken").collect()) == [("long", 5, 27), ("short", 2, 4)]
    assert sorted((r.run, r.edge_pos, r.label) for r in runs.edges(found).collect()) == sorted((r, k, f"L{k}") for r, n in (("long", 27), ("short", 4)) for k in range(n))
    assert sorted((r.run, r.pos, r.id) for r in runs.nodes(found).collect()) == sorted((r, k, f"s{k}") for r, n in (("long", 5), ("short", 2)) for k in range(n))
    assert [r.run for r in runs.baseline(found, "short").collect()] == ["long"]
    next((tmp_path / "runs" / "long" / "graph.json").glob("part-*.json")).unlink()  # a run without one of its parts is broken
    assert {(r.run, r.broken) for r in runs.read_runs(spark, folder).collect()} == {("long", True), ("short", False)}


def test_runs_are_kept_beside_earlier_ones(spark, tmp_path):
    folder = str(tmp_path / "runs")
    node = "pos int, id string, signature string, url string, route string, title string, depth int, text_hash string, console_errors array<string>, failed_requests array<string>, alias_signatures array<string>"
    edge = "edge_pos int, src string, dst string, role string, label string, href string, error string, inferred boolean"

    def document(run, title, n=1):
        nodes = spark.createDataFrame([(run, k, f"s{k}", "A", "http://x/", "/", title, 0, None, [], [], []) for k in range(n)], f"run string, {node}")
        edges = spark.createDataFrame([(run, k, "s0", "s0", "link", "B", "/", None, False) for k in range(n)], f"run string, {edge}")
        return runs.run_documents(nodes, edges, spark.createDataFrame([(run, "s0", "http://x/", None, {})], "run string, root string, base_url string, stop_kind string, config map<string,string>"), most_edges=3)

    for run, title in [("2024-01-01", "one"), ("2024-01-02", "two"), ("of day 3: 10%/a", "three"), ("2024-01-02", "two again")]:
        assert runs.write_runs(document(run, title), folder) == [run]
    found = runs.read_runs(spark, folder)
    assert {(r.run, r.title) for r in runs.nodes(found).collect()} == {("2024-01-01", "one"), ("2024-01-02", "two again"), ("of day 3: 10%/a", "three")}
    assert [r.run for r in runs.baseline(found, "2024-01-02", "2024-01-01").collect()] == ["2024-01-01"]
    with pytest.raises(ValueError, match="4 edges"):
        document("big", "x", 4)
