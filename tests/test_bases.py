"""Widget lines by grams, bases by set similarity and ordered merging, against plain loops."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from trailweave.operators import bases, compare, merging


def pattern_of(line: str) -> re.Pattern | None:
    head = re.match(r"a:[^|]*\||h:[^:]*:|[dtf]:", line)
    body = line[head.end() :] if head else ""
    if not head or "*" not in body or len(body.replace("*", "").strip()) < 2:
        return None
    return re.compile(re.escape(head[0]) + ".+".join(map(re.escape, body.split("*"))))


def knows(widgets, line: str) -> bool:
    return any(w == line or ((p := pattern_of(w)) and p.fullmatch(line)) for w in widgets)


def strings(spark, rows):
    return spark.createDataFrame([(x,) for x in rows], "line string")


def test_lines_by_grams_same_as_trying_all(spark):
    rng = random.Random(2)
    heads = ["a:link|", "a:button|", "h:h2:", "f:", "d:", ""]
    word = lambda n: "".join(rng.choice("ab.c(é*") for _ in range(rng.randrange(n)))
    found = [rng.choice(heads) + word(9).replace("*", "x") for _ in range(600)] + ["", "a:link|ab", "a:link|aab"]
    widgets = [rng.choice(heads) + word(6) for _ in range(120)] + ["a:link|*ab", "a:link|a*b", "f:*a*b*", "h:h2:**", "h:h2:a**b"]
    got = {r.line for r in compare.known_lines(strings(spark, found), compare.widget_patterns(strings(spark, widgets))).collect()}
    assert got == {x for x in found if knows(widgets, x)}
    assert len(got) > 30
    nothing = compare.widget_patterns(strings(spark, []))
    assert compare.known_lines(strings(spark, found), nothing).isEmpty() and compare.known_lines(strings(spark, []), nothing).isEmpty()


def test_a_pattern_is_tried_only_on_lines_with_its_rarest_gram(spark):
    grams = {(r.pattern, r.gram) for r in compare.pattern_grams(compare.widget_patterns(strings(spark, ["f:ab*cde", "f:*a*b", "f:x*", "f:*long"]))).collect()}
    assert {g for p, g in grams if p.startswith("^ab")} == {"\x02ab", "cde", "de\x03"}
    assert {g for p, g in grams if p.endswith("long$")} == {"lon", "ong", "ng\x03"}
    assert {g for p, g in grams if p.startswith("^.+a")} == {"b\x03"}


def test_lines_are_staged_by_no_gram_that_isnt_looked_for(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(40)]
    found = [f"f:{a} {b} and so on" for a in words for b in words]
    widgets = [f"f:{a} *" for a in words[:4]] + ["f:*mn*"]
    staged = []
    monkeypatch.setattr(compare, "checkpoint", lambda df: staged.append(df.count()) or df)
    got = {r.line for r in compare.known_lines(strings(spark, found), compare.widget_patterns(strings(spark, widgets))).collect()}
    assert got == {x for x in found if knows(widgets, x)} and len(got) >= 160
    assert max(staged) < len(found)  # not one row for each gram that a line shares with some pattern


def test_ends_of_patterns_of_any_length(spark):
    widgets = ["f:abc*", "f:*" + "x" * 70, "f:" + "y" * 200 + "*z", "f:a*bcd*efgh"]
    ends = {r.pattern[-4:]: (r.side, r["size"], r.gram) for r in compare.pattern_ends(compare.widget_patterns(strings(spark, widgets))).collect()}
    assert sorted(x[:2] for x in ends.values()) == [("P", 3), ("P", 128), ("S", 4), ("S", 64)]
    found = ["f:abcd", "f:abc", "f:1" + "x" * 70, "f:1" + "x" * 69, "f:" + "y" * 200 + "1z", "f:" + "y" * 199 + "1z", "f:a1bcd1efgh", "f:abcdefgh"]
    got = {r.line for r in compare.known_lines(strings(spark, found), compare.widget_patterns(strings(spark, widgets))).collect()}
    assert got == {x for x in found if knows(widgets, x)} and "f:abc" not in got and len(got) == 5


def test_widgets_are_learned_from_changes(spark):
    pairs = spark.createDataFrame([(2, "a", "b"), (1, "a", "c")], "pair int, before string, after string")
    lines = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "new"), ("c", "new"), ("c", "")], "view string, line string")
    acts = spark.createDataFrame([("a", "go", "a:go"), ("b", "go", "a:go"), ("b", "go", "a:go"), ("c", "go", "a:go")], "view string, instance string, line string")
    assert {tuple(r) for r in compare.learned_widgets(pairs, lines, acts).collect()} == {("new", 1), ("a:go", 2)}


def is_local(a: list[str], b: list[str], retain: float) -> bool:
    kind = lambda x, k: [y for y in x if y.startswith(k)]
    rest = [x for x in a if x and not re.match("[dth]:", x)]
    if not kind(a, "h:") and not rest:
        return False
    if set(kind(a, "d:")) != set(kind(b, "d:")) or set(kind(a, "t:")) != set(kind(b, "t:")) or not set(kind(a, "h:")) <= set(kind(b, "h:")):
        return False
    return not rest or sum(x in b for x in rest) >= len(rest) * retain


def is_variant(a: list[str], b: list[str], widgets: set, retain: float) -> bool:
    extra = [x for x in b if x and x not in a]
    return bool(extra) and is_local(a, b, retain) and all(knows(widgets, x) for x in extra)


LINES = ["h:h1:a", "h:h2:b", "d:x", "t:y"] + [f"a:link|/{k}" for k in range(8)] + [f"f:in:{k}" for k in range(4)]
WIDGETS = ["a:link|/w*", "f:in:w1", "h:h3:w", "a:link|/1"]


def some_lines(rng: random.Random) -> list[str]:
    base = rng.sample(LINES, rng.randrange(0, 6))
    return base + rng.sample(["a:link|/w1", "a:link|/wé", "f:in:w1", "h:h3:w", "f:in:other"], rng.choice([0, 0, 1, 2]))


@pytest.mark.parametrize("retain", [0.9, 0.5])
def test_bases_same_as_all_pairs(spark, retain):
    rng = random.Random(int(retain * 10))
    views = [(k, rng.choice(["/a", "/b", None]), some_lines(rng)) for k in range(160)]
    known = views[:80]
    schema = "view int, route string, lines array<string>"
    screens = spark.createDataFrame(known, schema).select(F.col("view").alias("screen"), (-F.col("view")).alias("pos"), "route", "lines")
    found = spark.createDataFrame(views, schema)
    got = {r.view: r.screen for r in bases.variant_bases(found, screens, compare.widget_patterns(strings(spark, WIDGETS)), retain).collect()}
    want = {}
    for k, route, lines in views:
        fit = [(-j, j) for j, r, ls in known if r == route and r is not None and is_variant(ls, lines, WIDGETS, retain)]
        if fit:
            want[k] = min(fit)[1]
    assert got == want and len(want) > 3
    # no pair below the bound is made
    s = bases.structures(found).select("id", "route", "lines").dropDuplicates(["id"])
    of = {r.id: r for r in s.collect()}
    for r in bases.candidate_pairs(s, s, retain).collect():
        a, b = of[r.base], of[r.variant]
        rest = [x for x in a.lines if not re.match("[dth]:", x)]
        assert a.route == b.route and len([x for x in b.lines if not re.match("[dth]:", x)]) >= len(rest) * retain and set(a.lines) & set(b.lines)


def fold(outcomes, screens, aliases, widgets, most):
    """Taking in one by one."""
    nodes = [(s, route, lines) for s, _, _, route, lines in sorted(screens, key=lambda x: x[1])]
    by, index, lines_known = {s: (r, ls) for s, r, ls in nodes}, {sig: s for s, _, sig, _, _ in screens} | dict(aliases), set(widgets)
    out, full = [], False
    for pos, node, error, sig, route, lines in sorted(outcomes, key=lambda x: x[0]):
        if full:
            break
        if error:
            out.append((pos, "error", None))
            continue
        if sig in index:
            old = sig in {x[2] for x in screens} or sig in dict(aliases)
            out.append((pos, "known" if old else "joined", index[sig]))
            continue
        fate = None
        if route is not None:
            if by[node][0] == route and is_local(by[node][1], lines, 0.8):
                fate, index[sig] = "absorbed", node
                lines_known |= {x for x in lines if x and x not in by[node][1]}
            else:
                base = next((s for s, r, ls in nodes if r == route and is_variant(ls, lines, lines_known, 0.9)), None)
                if base:
                    fate, index[sig] = "variant", base
        if not fate:
            name = f"s{len(nodes) + 1:03d}"
            nodes.append((name, route, lines))
            by[name], index[sig], fate = (route, lines), name, "new"
            full = most is not None and len(nodes) >= most
        out.append((pos, fate, index[sig]))
    return out, [n[0] for n in nodes], full


@pytest.mark.parametrize("seed,most", [(1, None), (2, None), (3, 9), (4, 30)])
def test_merging_same_as_one_by_one(spark, seed, most):
    rng = random.Random(seed)
    chain = ["h:h1:a", *[f"a:link|/{k}" for k in range(10)]]

    def lines():
        if rng.random() < 0.5:  # chains of variants: each has one more widget line than the one before
            return chain + [f"a:link|/w{k}" for k in range(rng.randrange(6))]
        return list(dict.fromkeys(some_lines(rng)))

    def view():
        route, ls = rng.choice(["/a", "/a", "/b", None]), lines()
        return f"{route}|{'|'.join(ls)}", route, ls

    screens, seen = [], set()
    while len(screens) < 4:
        sig, route, ls = view()
        if sig not in seen:
            seen.add(sig)
            screens.append((f"s{len(screens) + 1:03d}", len(screens) - 10, sig, route, ls))
    aliases = [("old alias", "s002")]
    outcomes = []
    for pos in rng.sample(range(1000), 120):
        sig, route, ls = view()
        bad = rng.random() < 0.1
        outcomes.append((pos, f"s{rng.randrange(1, 5):03d}", bad, None if bad else "old alias" if rng.random() < 0.05 else sig, route, ls))
    # one structure has one signature
    outcomes = [(p, n, e, s, None if s == "old alias" else r, ls) for p, n, e, s, r, ls in outcomes]
    start = ["f:in:w1"] + (["a:link|/w*"] if seed % 2 else [])
    got = merging.merge_outcomes(
        spark.createDataFrame(outcomes, "pos long, node string, error boolean, signature string, route string, lines array<string>").repartition(4),
        spark.createDataFrame(screens, "screen string, pos long, signature string, route string, lines array<string>"),
        spark.createDataFrame(aliases, "signature string, screen string"), spark.createDataFrame([(x, -1) for x in start], "line string, since long"), most_screens=most,
    )
    want, nodes, full = fold(outcomes, screens, aliases, start, most)
    assert sorted((r.pos, r.fate, r.dst) for r in got.outcomes.collect()) == want
    assert sorted(r.screen for r in got.screens.collect()) == nodes[4:] and got.full == full
    assert {"new", "joined", "known", "error"} <= {f for _, f, _ in want} or most == 9


def test_rounds_settle_chains_and_stars(spark):
    firsts = spark.createDataFrame([(f"n{k}", k) for k in range(9)], "signature string, pos long")
    depends = spark.createDataFrame([(f"n{k}", f"n{k - 1}") for k in range(1, 6)] + [("n7", "n6"), ("n8", "n6"), ("n8", "n7")], "variant string, base string")
    got = {r.signature: r.base for r in merging.settled(firsts, depends).collect()}
    assert got == {"n0": None, "n1": "n0", "n2": None, "n3": "n2", "n4": None, "n5": "n4", "n6": None, "n7": "n6", "n8": "n6"}
