"""Graph, diff, planning, learning and judging operators on small cases, with brute force where it is short."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.operators import compare, graph, judging, learning, naming, planning, rundiff
from trailweave.session import checkpoint
from trailweave.sources import runs

EDGES = "edge_pos int, src string, dst string, label string, error boolean"


def edges(spark):
    rows = [
        (0, "a", "b", "B", False), (1, "a", "c", "C", False), (2, "b", "d", "D", False), (3, "c", "d", "D", False), (4, "b", "b", "x", True), (5, "d", "a", "home", False), (6, "a", "b", "B", False),
        (7, "z", "y", "q", False),
    ]
    return spark.createDataFrame(rows, EDGES)


def test_tree_chapters_and_scenarios(spark):
    tree = graph.discovery_tree(edges(spark), "a")
    assert {(r.node, r.parent, r.depth, "".join(r.path)) for r in tree.collect()} == {("a", None, 0, "a"), ("b", "a", 1, "ab"), ("c", "a", 1, "ac"), ("d", "b", 2, "abd")}
    nodes = spark.createDataFrame([(x,) for x in "abcdy"], "node string")
    assert {(r.node, r.chapter) for r in graph.chapters(nodes, tree, "a").collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "b"), ("y", "a")}
    assert sorted("".join(r.path) for r in graph.scenarios(tree, "a").collect()) == ["abd", "ac"]


def test_merged_edges_leave_failures_out(spark):
    found = {(r.src, r.dst, r.label): (r.n, r.first_pos) for r in graph.merged_edges(edges(spark)).collect()}
    assert found[("a", "b", "B")] == (2, 0) and ("b", "b", "x") not in found


def test_common_navigation(spark):
    rows = [(k, f"p{k}", "home", "Home", False) for k in range(4)] + [(9, "p0", "x", "X", False)]
    found = graph.common_navigation(graph.merged_edges(spark.createDataFrame(rows, EDGES)))
    assert [(r.label, r.dst, r.sources) for r in found.collect()] == [("Home", "home", 4)]


def test_redirects_follow_chains(spark):
    rows = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8)], "node int, into int")
    assert dict(graph.resolve_redirects(rows).collect()) == {5: 1, 4: 1, 3: 1, 9: 8}
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 130)], "node int, into int")
    assert set(r.final for r in graph.resolve_redirects(chain).collect()) == {0}
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (6, 5)], "node int, into int")
    with pytest.raises(ValueError, match="never end"):
        graph.resolve_redirects(cycle)


def test_trees_of_any_depth(spark):
    rows = [(k, f"n{k}", f"n{k + 1}", "go", False) for k in range(200)] + [(900, "x", "y", "go", False), (901, "y", "x", "go", False)]
    tree = {r.node: r for r in graph.discovery_tree(spark.createDataFrame(rows, EDGES), "n0").collect()}
    assert len(tree) == 201 and tree["n200"].depth == 200 and tree["n200"].chapter == "n1" and tree["n200"].order == list(range(200))
    assert tree["n3"].path == ["n0", "n1", "n2", "n3"] and tree["n3"].parent == "n2"


def test_rekey_merges_within_a_depth(spark):
    rows = spark.createDataFrame([(1, "s", 1, 1), (2, "s", 1, 2), (3, "s", 2, 3), (4, "t", 1, 4)], "node int, signature string, depth int, pos int")
    assert {(r.node, r.final, r.new_signature) for r in graph.rekeyed(rows).collect()} == {(1, 1, "s"), (2, 1, "s"), (3, 3, "s~2"), (4, 4, "t")}


NODE = "id string, pos int, signature string, alias_signatures array<string>, route string, schema_version int, text_hash string, console_errors array<string>, failed_requests array<string>"


def node(k, sig, errors=(), alias=(), text="t", route="/r"):
    return (k, int(k[1:]), sig, list(alias), route, 3, text, list(errors), [])


def test_diff_of_runs(spark):
    before = spark.createDataFrame([node("p1", "A", ["e"]), node("p2", "B"), node("p3", "C"), node("p4", "X", route=None)], NODE)
    after = spark.createDataFrame([node("n1", "A", ["e", "f"]), node("n2", "Z", alias=["B"]), node("n3", "N", ["g"]), node("n4", "A2", text="u", alias=["A"])], NODE)
    found = {r.id: (r.status, r.prev_id, r.new_errors) for r in rundiff.diff_nodes(after, before).collect()}
    assert found == {"n1": ("same", "p1", True), "n2": ("same", "p2", False), "n3": ("added", None, True), "n4": ("same", "p1", False)}
    assert [r.id for r in rundiff.removed_nodes(after, before).collect()] == ["p3"]
    none = spark.createDataFrame([], EDGES)
    counts = rundiff.gate_counts(after, none, rundiff.diff_nodes(after, before), rundiff.removed_nodes(after, before))
    g = rundiff.gate(counts, ("removed", "new-errors")).first()
    assert g.failed and g.reasons == ["removed: 1", "new-errors: 2"]
    assert not rundiff.gate(counts, ("removed",), unreliable=True).first().failed
    with pytest.raises(ValueError):
        rundiff.gate(counts, ("nothing",))


def test_local_change_and_variants(spark):
    a, b = ["h:h1:A", "a:link|/x", "a:link|/y"], ["h:h1:A", "a:link|/x", "a:link|/y", "a:button|More 1"]
    row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    found = row.select(compare.is_local_change(F.col("a"), F.col("b")).alias("x"), compare.is_local_change(F.col("b"), F.array(F.lit("h:h1:B"))).alias("y")).first()
    assert (found.x, found.y) == (True, False)
    widgets = compare.widget_patterns(spark.createDataFrame([("a:button|More *",), ("h:h2:Plain",), ("a:button|*",), (None,)], "line string"))
    pairs = spark.createDataFrame([(1, a, b), (2, a, [*a, "a:button|Less 1"]), (3, a, [*a, "h:h2:Plain", "a:button|More of (it)"]), (4, a, a), (5, a, ["h:h2:Plain"])], "pair int, base array<string>, variant array<string>")
    assert {r.pair: r.is_variant for r in compare.variants(pairs, widgets).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_actions_are_found_again_by_tiers(spark):
    kind = "page_id int, pos int, role string, label string, nth int, test_id string, toggle boolean, key string"
    present = [(1, 0, "button", "Save 3", 0, "t1", False, "k1"), (1, 1, "button", "Save 4", 0, None, False, None), (1, 2, "button", "Menu", 0, None, True, None), (1, 3, "link", "Other", 0, None, False, "/x"), (1, 4, "button", "Save 4", 0, None, False, None)]
    asked = [(1, 1, "button", "Save 4", 0, None, False, None), (2, 1, "button", "Gone", 0, "t1", False, None), (3, 1, "button", "Save 99", 0, None, False, None), (4, 1, "button", "Close", 0, None, True, None), (5, 1, "link", "New", 0, None, False, "/x"), (6, 1, "tab", "Save 4", 0, None, False, None)]
    wanted = spark.createDataFrame(asked, "want_id int, page_id int, role string, label string, nth int, test_id string, toggle boolean, key string")
    found = compare.relocate(wanted, spark.createDataFrame(present, kind)).collect()
    assert {r.want_id: (r.pos, r.tier) for r in found} == {1: (1, 1), 2: (0, 2), 3: (0, 3), 4: (2, 4), 5: (3, 5)}


def test_round_robin(spark):
    rows = spark.createDataFrame([("g", k, p) for p, k in enumerate("aaabbc")], "g string, key string, pos int")
    plan = planning.round_robin(rows, "g", "key", "pos", 2).orderBy("plan_pos").collect()
    assert [(r.key, r.turn) for r in plan] == [("a", 1), ("b", 1), ("c", 1), ("a", 2), ("b", 2)]


def test_islands(spark):
    hits = [1, 1, 0, 1, 1, 1, 0]
    rows = spark.createDataFrame([("g", k, bool(h)) for k, h in enumerate(hits)], "g string, pos int, hit boolean")
    assert [r.streak for r in planning.islands(rows, "g", "pos", "hit").orderBy("pos").collect()] == [1, 2, 0, 1, 2, 3, 0]


def test_explore_numbers_screens_in_order(spark):
    links = {"A": ["B", "C"], "B": ["D", "A"], "C": ["D"], "D": []}
    table = spark.createDataFrame([(a, k, b) for a, bs in links.items() for k, b in enumerate(bs)], "signature string, pos int, to string")

    def expand(frontier):
        found = frontier.join(table, "signature")
        return found.select(F.col("node").alias("src"), "pos", F.col("to").alias("signature"), F.col("to").alias("label"), F.lit(False).alias("error"))

    nodes, steps = planning.explore(spark.createDataFrame([("s001", "A")], "node string, signature string"), expand)
    assert {(r.node, r.signature, r.depth) for r in nodes.collect()} == {("s001", "A", 0), ("s002", "B", 1), ("s003", "C", 1), ("s004", "D", 2)}
    assert {(r.src, r.dst) for r in steps.collect()} == {("s001", "s002"), ("s001", "s003"), ("s002", "s004"), ("s002", "s001"), ("s003", "s004")}


def test_segments_below_a_parent_are_data(spark):
    links = [(f"http://a.test/shop/{w}/info", False) for w in ("apple", "pear", "plum")] + [("http://a.test/about/us", False)]
    found = learning.segment_proposals(spark.createDataFrame(links, "target string, in_nav boolean")).collect()
    assert [(r.origin, r.prefix, r.n_values) for r in found] == [("http://a.test", "/shop", 3)]


def test_only_affixes_below_a_length_that_few_share_are_made(spark):
    rng = random.Random(2)
    ends = ["".join(rng.choices("abcdefghij", k=50)) for _ in range(40)]
    labels = [("p", f"Open {chr(0x4E00 + k)}{x}") for k, x in enumerate(ends)] + [("q", f"{x[:3]} of a long common ending") for x in ends[:5]]
    made = learning.shared_affixes(spark.createDataFrame(labels, "g string, label string"), "g").groupBy("g").count()
    found = {r.g: r["count"] for r in made.collect()}
    assert found["p"] == 40 * 3 and found["q"] <= 5 * 2 * 30  # of 40 x 102: lengths 3 to 5
    folded = {r.label: r.folded for r in learning.label_families(spark.createDataFrame(labels, "g string, label string"), "g").collect()}
    assert set(folded.values()) == {"Open *", "* of a long common ending"} and len(folded) == 45


def test_label_families(spark):
    labels = [("g", f"Delete {w}") for w in ("apples", "pears", "plums", "figs")] + [("g", "Help")]
    found = {r.label: r.folded for r in learning.label_families(spark.createDataFrame(labels, "page_id string, label string")).collect()}
    assert found["Delete apples"] == "Delete *" and "Help" not in found


def test_auc_against_all_pairs(spark):
    r = random.Random(3)
    data = [(float(r.randrange(9)) - 3, r.random() < 0.4) for _ in range(80)]
    found = judging.auc(spark.createDataFrame(data, "s double, y boolean"), "s", "y").first().auc
    pairs = [(a, b) for (a, x), (b, y) in itertools.product(data, data) if x and not y]
    assert found == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))


def test_upper_median(spark):
    rows = spark.createDataFrame([(x,) for x in (1, 2, 3, 4, None)], "v int")
    assert judging.upper_median(rows, "v").first().median == 3
    rng = random.Random(2)
    for n in (1, 2, 5, 40, 41):
        values = [rng.randrange(-50, 5000) for _ in range(n)]
        many = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
        assert judging.upper_median(many, "v").first().median == sorted(values)[n // 2]


def test_upper_median_refines_crowded_ranges(spark):
    rng = random.Random(5)
    many = [10**15 + rng.randrange(10**9) for _ in range(400)] + [-3, 0, 7, 10**15 + 10**12] + [10**15 + 5] * 60
    for n, most in ((len(many), 1), (len(many) - 1, 8), (len(many), 100_000), (3, 1)):
        rows = spark.createDataFrame([(x,) for x in many[:n]] + [(None,)], "v long")
        assert judging.upper_median(rows, "v", most).first().median == sorted(many[:n])[n // 2], (n, most)
    close = [0.1 + k * 1e-9 for k in range(301)]
    assert judging.upper_median(spark.createDataFrame([(x,) for x in close], "v double"), "v", 2).first().median == close[150]
    equal = [2**60 + k for k in range(40)]  # some are one as doubles
    assert judging.upper_median(spark.createDataFrame([(x,) for x in equal], "v long"), "v", 3).first().median == equal[20]
    none = rows.where("false")
    assert judging.upper_median(none, "v").count() == 0 and tuple(judging.size_figures(none, "v").first()) == (0, 0, None, None)
    assert tuple(judging.size_figures(spark.createDataFrame([(4,), (None,), (1,)], "v long"), "v").first()) == (2, 5, 4, 2.5)


def test_chapter_links_keep_their_most_frequent_label(spark):
    merged = spark.createDataFrame(
        [("a1", "b1", "go", 2), ("a2", "b1", "go", 1), ("a1", "b2", "ask", 3), ("a1", "b2", "zap", 3), ("a1", "a2", "in", 9), ("b1", "a1", None, 1), ("a1", "b1", "menu", 9)], "src string, dst string, label string, n long"
    )
    chapters = spark.createDataFrame([(x, x[0].upper()) for x in ("a1", "a2", "b1", "b2")], "node string, chapter string")
    nav = spark.createDataFrame([("menu", "b1")], "label string, dst string")
    found = graph.chapter_links(graph.chapter_link_labels(merged, chapters, nav))
    assert {tuple(r) for r in found.collect()} == {("A", "B", False, 9, 3, "ask", 3), ("A", "B", True, 9, 1, "menu", 9), ("B", "A", False, 1, 1, None, 1)}

def test_complete_linkage(spark):
    v = {1: [1.0, 0.0], 2: [0.99, 0.1], 3: [0.0, 1.0], 4: [0.7, 0.7]}
    rows = spark.createDataFrame([("g", k, x) for k, x in v.items()], "g string, id int, v array<double>")
    assert {r.id: r.cluster for r in judging.complete_linkage(rows, "g", "id", "v", 0.9).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    with pytest.raises(Exception, match="complete linkage"):
        judging.complete_linkage(rows, "g", "id", "v", 0.9, most=3).collect()


def plain_linkage(scores: np.ndarray, threshold: float) -> list[int]:
    """Merges one pair after another, the best first; of equals that of the least rows."""
    worst = scores.copy()
    np.fill_diagonal(worst, -np.inf)
    cluster = list(range(len(worst)))
    while True:
        a, b = sorted(divmod(int(np.argmax(worst)), len(worst)))
        if worst[a, b] < threshold:
            return cluster
        joined = np.minimum(worst[a], worst[b])
        worst[a], worst[:, a], worst[a, a] = joined, joined, -np.inf
        worst[b] = worst[:, b] = -np.inf
        cluster = [a if c == b else c for c in cluster]


def test_complete_linkage_of_large_groups_equals_one_merge_after_another(spark, monkeypatch):
    monkeypatch.setattr(judging, "_BLOCK", 50)
    rng = np.random.default_rng(3)
    groups = {"a": rng.integers(0, 4, (90, 3)), "b": np.round(rng.normal(1, 0.6, (130, 3)), 2), None: rng.integers(1, 5, (7, 2))}
    rows, expected = [], {}
    for shift, (name, v) in enumerate(groups.items()):
        ids = rng.permutation(len(v)) + 1000 * shift
        v = v[np.argsort(np.argsort(ids))].astype(float)
        unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        order = sorted(ids.tolist())
        expected |= {order[k]: order[c] for k, c in enumerate(plain_linkage(np.round(unit @ unit.T, 9), 0.95))}
        rows += [(name, order[k], x) for k, x in enumerate(v.tolist())]
    rows += [("c", 5000 + k, [1.0, 2.0]) for k in range(1100)] + [("c", 9000, None), ("c", 9001, [0.0, 0.0]), ("c", 9002, [float("nan"), 1.0])]
    expected |= {5000 + k: 5000 for k in range(1100)} | {k: k for k in (9000, 9001, 9002)}
    rng.shuffle(rows)
    found = judging.complete_linkage(spark.createDataFrame(rows, "g string, id int, v array<double>"), "g", "id", "v", 0.95).collect()
    assert len(found) == len(rows) and {r.id: r.cluster for r in found} == expected


def plain_template(titles: list[str]) -> str:
    """By trying every beginning and end."""
    texts = sorted({" ".join(t.split()) for t in titles})
    if len(texts) < 2:
        return texts[0]
    fits = lambda ts, n: all(t[:n] == ts[0][:n] for t in ts) and (all(len(t) == n or t[n] == " " for t in ts) or n == 0 or ts[0][n - 1] == " ")
    front = max(n for n in range(min(map(len, texts)) + 1) if fits(texts, n))
    rest = [t[front:][::-1] for t in texts]
    back = max(n for n in range(min(map(len, rest)) + 1) if fits(rest, n))
    back = 0 if back >= min(map(len, rest)) else back
    return texts[0][:front] + naming.PLACEHOLDER + (texts[0][len(texts[0]) - back :] if back else "")


def test_templates_of_all_titles(spark):
    rng = random.Random(3)
    groups = {k: [" ".join(["Item", *rng.choices(["Alpha", "Alphabet", "Beta", "of"], k=rng.randint(0, 2)), rng.choice(["", "—  Shop", "Workshop"])]) for _ in range(rng.choice([1, 2, 3]))] for k in range(25)}
    groups[99] = [f"Item {k} — Shop" for k in range(60)] + ["Thing — Shop"]
    groups[100] = ["Item Alpha — Shop", "Item Beta — Shop"]
    rows = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "g int, title string")
    found = {r.g: (r.n, r.template) for r in naming.templates(rows, ["g"]).collect()}
    assert found == {g: (len(ts), plain_template(ts)) for g, ts in groups.items()}
    assert found[100][1] == f"Item {naming.PLACEHOLDER} — Shop" and found[99][1] == f"{naming.PLACEHOLDER} — Shop"


def test_labels_lose_their_values(spark):
    rows = [("Ｅｄｉｔ Alpha", ["Edit"]), ("Open Alpha Beta now", ["Alpha", "Beta"]), ("Alphabeta", ["Alpha", "phab"]), ("Room 12", ["12", "R"]), (None, ["x y"]), ("a  b\tc", ["a b"]), ("keep", None)]
    df = spark.createDataFrame(rows, "t string, v array<string>").withColumn("x", naming.scrub_to_placeholder(F.col("t"), F.col("v")))
    o = naming.PLACEHOLDER
    found = {r.t: (r.x["text"], list(r.x["removed"])) for r in df.collect()}
    assert found == {"Ｅｄｉｔ Alpha": (f"{o} Alpha", ["Ｅｄｉｔ"]), "Open Alpha Beta now": (f"Open {o} now", ["Alpha", "Beta"]), "Alphabeta": (f"{o}eta", ["Alphab"]), "Room 12": ("Room 12", []), None: ("", []), "a  b\tc": (f"{o}\tc", ["a  b"]), "keep": ("keep", [])}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from trailweave import session

    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master, fails in (("spark://host:7077", True), ("yarn", True), ("local-cluster[3,2,1024]", True), ("local[4]", False), ("local", False)):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        if fails:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))
        else:
            session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_names_and_suggestions(spark):
    found = naming.suggestions(spark.createDataFrame([("maxStats",), ("zzz",)], "key string"), ["maxStates", "maxDepth"]).collect()
    assert [r.suggestion for r in found] == ["maxStates", None]


def test_runs_are_read_and_broken_ones_skipped(spark, tmp_path):
    def write(name, stop=None, bad=False):
        (tmp_path / name).mkdir()
        doc = {"meta": {"schemaVersion": 3, "stopKind": stop}, "root": "s1", "nodes": [{"id": "s1", "signature": "A", "consoleErrors": ["e"]}], "edges": [{"from": "s1", "to": "s1", "action": {"label": "x", "role": "link"}, "error": "no"}]}
        (tmp_path / name / "graph.json").write_text("{broken" if bad else json.dumps(doc))

    write("2024-01-01"), write("2024-01-02", "interrupted"), write("2024-01-03", bad=True), write("2024-01-04")
    found = runs.read_runs(spark, str(tmp_path))
    assert {r.run: r.broken for r in found.select("run", "broken").collect()} == {"2024-01-01": False, "2024-01-02": False, "2024-01-03": True, "2024-01-04": False}
    assert [r.run for r in runs.baseline(found, "2024-01-04").collect()] == ["2024-01-01"]
    assert runs.nodes(found).count() == 3 and runs.edges(found).where("error = 'no'").count() == 3


def test_tree_numbers_equal_a_walk(spark):
    rng = random.Random(5)
    rows = [(k, f"n{rng.randrange(k // 4 + 1)}", f"n{rng.randrange(60)}", "go", rng.random() < 0.1) for k in range(200)] + [(900, "x", "y", "go", False), (901, "y", "x", "go", False)]
    below, seen = {}, set()
    for _, src, dst, _, error in rows:
        if not error and src != dst and dst not in seen and dst != "n0":
            seen.add(dst)
            below.setdefault(src, []).append(dst)
    expected = {}

    def walk(node, parent, depth, chapter):
        pre = len(expected)
        expected[node] = None
        for child in below.get(node, []):
            walk(child, node, depth + 1, chapter if depth else child)
        expected[node] = (parent, depth, chapter, pre, len(expected) - pre)

    walk("n0", None, 0, "n0")
    found = graph.discovery_numbers(spark.createDataFrame(rows, EDGES), "n0").collect()
    assert {r.node: (r.parent, r.depth, r.chapter, r.pre, r.size) for r in found} == expected and len(expected) > 10
    assert [tuple(r) for r in graph.discovery_numbers(spark.createDataFrame([], EDGES), "a").collect()] == [("a", None, 0, "a", 0, 1)]


def test_followed_sums_weights_and_leaves_cycles_out(spark):
    rows = [(k, k - 1) for k in range(1, 70)] + [(100, 101), (101, 102), (102, 100), (103, 102)] + [(k, 69) for k in range(200, 220)]
    found = {r.node: (r.end, r.total, r.last) for r in graph.followed(spark.createDataFrame(rows, "node int, next int"), F.col("node").cast("long")).collect()}
    one = {k: (0, k * (k + 1) // 2, 1) for k in range(1, 70)}
    assert found == one | {k: (0, k + 69 * 70 // 2, 1) for k in range(200, 220)}
    assert graph.followed(spark.createDataFrame([], "node int, next int")).count() == 0


def test_config_comments():
    assert runs.read_config('{"a": "http://x", // c\n "b": [1, 2,], /* d */ "c": ",]",}') == {"a": "http://x", "b": [1, 2], "c": ",]"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], EDGES)
    assert graph.merged_edges(none).count() == 0 and graph.discovery_tree(none, "a").count() == 1
    assert judging.auc(spark.createDataFrame([], "s double, y boolean"), "s", "y").first().auc is None
    assert learning.segment_proposals(spark.createDataFrame([], "target string, in_nav boolean")).count() == 0


def test_estimates_of_checkpoints_stay_small_in_rounds_of_joins(spark):
    rows = spark.range(8).select("id", F.lit(1).alias("n"))
    for _ in range(9):
        rows = checkpoint(rows.join(rows.select("id", F.col("n").alias("m")), "id").select("id", (F.col("n") + F.col("m")).alias("n")))
        assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63
    assert {tuple(r) for r in rows.collect()} == {(k, 512) for k in range(8)}
