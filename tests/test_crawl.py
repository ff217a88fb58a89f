"""Exploration in three phases of a made-up site, against doing it action by action."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.test_bases import is_local, is_variant
from trailweave.operators import crawl
from trailweave.operators.crawl import Limits, Site


def made_up_site(seed: int):
    """Views {signature: (route, lines, actions)}; an action is (shape, key, fam, where it leads or None for an error)."""
    rng = random.Random(seed)
    pages = [f"/p{k}" for k in range(9)]
    views: dict[str, tuple] = {}
    for p in pages:
        lines = [f"h:h1:{p}", *(f"a:link|{q}" for q in rng.sample(pages, 5))]
        views[p] = (p, lines, [])
        for w in ("menu", "panel"):  # the page with something opened in place
            views[f"{p}+{w}"] = (p, [*lines, f"a:button|{w} one", f"a:button|{w} two"], [])
        views[f"{p}+menu+panel"] = (p, [*lines, "a:button|menu one", "a:button|menu two", "a:button|panel one", "a:button|panel two"], [])
    for sig, (p, lines, acts) in views.items():
        for x in lines[1:]:
            if x.startswith("a:link|"):
                to = x.removeprefix("a:link|")
                acts.append((x, f"L{to}" if rng.random() < 0.7 else None, None, to if rng.random() < 0.9 else None))
        for k in range(3):  # rows of one kind
            acts.append((f"row{k}", None, "rows", rng.choice([f"{p}+panel", f"{p}+panel", rng.choice(pages)])))
        acts.append(("open menu", "Cmenu", None, f"{p}+menu" if "panel" not in sig else f"{p}+menu+panel"))
        if "+menu" in sig:
            acts += [("menu one", None, None, rng.choice(pages)), ("menu two", None, None, f"{p}+menu+panel")]
        if "+panel" in sig:
            acts += [("panel one", None, None, rng.choice(pages)), ("panel two", None, None, None)]
    return views


def as_tables(spark, views):
    a = [(s, k, shape, key, fam, to) for s, (_, _, acts) in views.items() for k, (shape, key, fam, to) in enumerate(acts)]
    acts = spark.createDataFrame(a, "signature string, pos int, shape string, key string, fam string, to string")
    where = spark.createDataFrame([(s, r, ls) for s, (r, ls, _) in views.items()], "to string, route string, lines array<string>")

    def perform(tasks):
        led = tasks.join(acts.select("signature", "pos", "to"), ["signature", "pos"])
        return led.join(where, "to", "left").select("task", F.col("to").isNull().alias("error"), "to", "route", "lines")

    return Site(lambda seen: acts.drop("to").join(seen, "signature"), perform)


def one_by_one(views, root, limits: Limits):
    """The same exploration, an action at a time."""
    screens, index, widgets = [("s001", root)], {root: "s001"}, set()
    sources: dict = {}
    outcomes: dict = {}
    log, inferred, untried = [], set(), {}
    stop = None
    level_of = {"s001": 0}

    def merge(node, via, sig, pos, phase, level):
        nonlocal stop
        shape, key, fam, to = views[sig][2][pos]
        own = dict(screens)[node]
        if to is None:
            fate, dst = "error", None
        elif to in index:
            fate, dst = "known", index[to]
        else:
            route, lines, _ = views[to]
            if views[own][0] == route and is_local(views[own][1], lines, 0.8):
                fate, dst = "absorbed", node
                index[to] = node
                widgets.update(x for x in lines if x not in views[own][1])
            else:
                base = next((s for s, g in screens if views[g][0] == route and is_variant(views[g][1], lines, widgets, 0.9)), None)
                if base:
                    fate, dst = "variant", base
                    index[to] = base
                else:
                    fate, dst = "new", f"s{len(screens) + 1:03d}"
                    screens.append((dst, to))
                    index[to], level_of[dst] = dst, level
                    if len(screens) >= limits.max_states:
                        stop = "maxStates"
        log.append((phase, node, sig, pos, via, "known" if fate == "known" else fate, dst))
        if via == 0 and key:
            outcomes.setdefault(key, []).append("error" if fate == "error" else "local" if dst == node else dst)
        return fate, dst

    level, frontier = 1, [("s001", root)]
    while True:
        plan, later = [], []
        for node, sig in frontier:
            families, budget = set(), limits.max_actions
            for pos, (shape, key, fam, to) in enumerate(views[sig][2]):
                if fam and fam in families:
                    later.append((node, sig, pos, "dup"))
                    continue
                if fam:
                    families.add(fam)
                if key:
                    s = sources.setdefault(key, set())
                    if node not in s and len(s) >= limits.repeats:
                        later.append((node, sig, pos, "later"))
                        continue
                    if budget <= 0:
                        untried[level, node] = untried.get((level, node), 0) + 1
                        continue
                    s.add(node)
                elif budget <= 0:
                    untried[level, node] = untried.get((level, node), 0) + 1
                    continue
                plan.append((node, sig, pos))
                budget -= 1
        family: dict = {}
        compounds = []
        for node, sig, pos in plan:
            if stop:
                break
            fate, dst = merge(node, 0, sig, pos, "A", level)
            shape, key, fam, to = views[sig][2][pos]
            if fam:
                family[node, fam] = "local" if dst == node else "other"
            if fate == "absorbed":
                compounds.append((node, to, set()))
        run = []
        if not stop:
            used = {n: sum(x[0] == n for x in plan) for n, _ in frontier}
            for node, sig, pos, why in later:
                shape, key, fam, to = views[sig][2][pos]
                f = family.get((node, fam)) if why == "dup" else None
                if f == "local":
                    continue
                if not (why == "dup" and (f or not key)):
                    got = outcomes.get(key, [])
                    if got and all(x == "local" for x in got):
                        continue
                    if got and len(set(got)) == 1 and got[0] not in ("local", "error"):
                        if got[0] != node:
                            inferred.add((level, node, key, got[0]))
                        continue
                if used[node] >= limits.max_actions:
                    untried[level, node] = untried.get((level, node), 0) + 1
                    continue
                used[node] += 1
                run.append((node, sig, pos))
        for node, sig, pos in run:
            if stop:
                break
            fate, dst = merge(node, 0, sig, pos, "B", level)
            if fate == "absorbed":
                compounds.append((node, views[sig][2][pos][3], set()))
        shown, count = {}, {}
        for via in range(1, limits.max_via):
            tasks = []
            for node, view, seen in compounds:
                own = {a[0] for a in views[dict(screens)[node]][2]}
                done = shown.setdefault(node, set())
                here = {a[0] for a in views[view][2]}
                fresh = [(k, a[0]) for k, a in enumerate(views[view][2]) if a[0] not in own | seen | done]
                for k, shape in fresh[: limits.max_revealed]:
                    tasks.append((node, view, k, seen | here))
                done.update(shape for _, shape in fresh)
            if stop or not tasks:
                break
            order = {n: k for k, (n, _) in enumerate(frontier)}
            tasks.sort(key=lambda t: order[t[0]])
            compounds = []
            for node, view, k, seen in tasks:
                count[node] = count.get(node, 0) + 1
                if count[node] > limits.max_actions:
                    untried[level, node] = untried.get((level, node), 0) + 1
                    continue
                if stop:
                    continue
                fate, dst = merge(node, via, view, k, "C", level)
                if fate == "absorbed":
                    compounds.append((node, views[view][2][k][3], seen))
        new = [(s, g) for s, g in screens if level_of[s] == level]
        stop = stop or ("done" if not new else "maxDepth" if level >= limits.max_depth else None)
        if stop:
            return screens, log, inferred, untried, stop
        level, frontier = level + 1, new


@pytest.mark.parametrize(
    "seed,limits,phases",
    [(1, Limits(max_actions=5, repeats=2, max_depth=2), "AC"), (2, Limits(max_actions=30, repeats=1, max_depth=1), "AC"), (3, Limits(max_states=5), "A"), (8, Limits(max_actions=30, repeats=1, max_depth=1), "ABC")],
)
def test_three_phases_same_as_one_by_one(spark, tmp_path, seed, limits, phases):
    views = made_up_site(seed)
    site = as_tables(spark, views)
    root = spark.createDataFrame([("/p0", "/p0", views["/p0"][1])], "signature string, route string, lines array<string>")
    folder = str(tmp_path / "crawl")
    if seed == 1:  # stopped after its first level, then taken up again
        crawl.crawl(root, site, folder, limits, levels=1)
        assert len(crawl._meta(spark, folder)) == 2
        (tmp_path / "crawl" / "level-0002" / "screens").mkdir(parents=True)  # what an attempt left that was stopped within a level
    got = crawl.crawl(root, site, folder, limits)
    screens, log, inferred, untried, stop = one_by_one(views, "/p0", limits)
    assert [(r.screen, r.signature) for r in got["screens"].orderBy("screen").collect()] == screens
    mine = [(r.phase, r.node, r.signature, r.pos, r.via, "known" if r.fate == "joined" else r.fate, r.dst) for r in got["attempts"].orderBy("task").collect()]
    assert mine == log
    if stop != "maxStates":
        assert {tuple(r) for r in got["inferred"].collect()} == inferred
        assert {(r.level, r.node): r.n for r in got["untried"].collect()} == untried
    assert crawl._meta(spark, folder)[-1]["stop"] == stop
    assert {x[0] for x in log} == set(phases)
    before = got["attempts"].count()
    assert crawl.crawl(root, site, folder, limits)["attempts"].count() == before  # done stays done
