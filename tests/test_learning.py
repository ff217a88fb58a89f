"""Learning until nothing changes, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trailweave.operators import learning


def norm(segs, learned):
    out = []
    for s in segs:
        out.append("*" if s.isdigit() or (out and "/" + "/".join(out) in learned) else s)
    return out


def proposed(links, learned, least):
    """{prefix: number of values} of one origin's links (segments, in_nav)."""
    groups = {}
    for segs, nav in links:
        n = norm(segs, learned)
        for i in range(1, len(segs)):
            prefix = "/" + "/".join(n[:i])
            if n[i] != "*" and prefix not in learned:
                values = groups.setdefault((prefix, i, *n[:i], "*", *n[i + 1 :]), {})
                values[segs[i]] = values.get(segs[i], True) and nav
    found = {}
    for (prefix, *_), values in groups.items():
        if len(values) >= least and not (all(values.values()) and len(values) <= 12):
            found[prefix] = found.get(prefix, 0) + len(values)
    return found


def learned(links, least, refused=()):
    known, asked, found, k = set(), set(), [], 0
    while True:
        k += 1
        new = {p: n for p, n in proposed(links, known, least).items() if p not in asked}
        asked |= set(new)
        taken = {p: n for p, n in new.items() if p not in refused}
        found += [(p, k, n) for p, n in taken.items()]
        if not taken:
            return sorted(found)
        known |= set(taken)


def site(rng, n):
    # values of a first data segment, then a fixed one, then values below it: known only once the first are
    first, last = "pqrstuvw", "abcdefgh"
    out = []
    for _ in range(n):
        segs = ["shop", rng.choice(first) * 3, "item", rng.choice(last) * 2] if rng.random() < 0.7 else ["docs", rng.choice(["intro", "api", "7"])]
        out.append((segs[: rng.randrange(2, 5)] + (["more", rng.choice(last)] if rng.random() < 0.2 else []), rng.random() < 0.3))
    return out


@pytest.mark.parametrize("refused", [(), ("/shop/*/item", "/docs")])
def test_learning_to_a_fixpoint(spark, refused):
    rng = random.Random(11)
    sites = {f"http://s{k}.example": site(rng, n) for k, n in enumerate((6, 15, 40))}
    rows = [(f"{o}/{'/'.join(segs)}", nav) for o, links in sites.items() for segs, nav in links] + [("mailto:x", False), (None, False)]
    rng.shuffle(rows)
    judge = (lambda df: df.where(~F.col("prefix").isin(*refused))) if refused else None
    found = learning.learned_to_fixpoint(spark.createDataFrame(rows, "target string, in_nav boolean"), 3, accepted=judge)
    expected = {(o, *x) for o, links in sites.items() for x in learned(links, 3, refused)}
    assert {(r.origin, r.prefix, r.round, r.n_values) for r in found.collect()} == expected
    assert refused or max(x[2] for x in expected) >= 2
    if not refused:
        urls = spark.createDataFrame([("http://s2.example/shop/zzz/item/qq",), ("http://other.example/shop/zzz",)], "url string")
        by_url = {r.url: (r.route, r.data_driven) for r in learning.learned_routes(urls, found).collect()}
        assert by_url["http://s2.example/shop/zzz/item/qq"] == ("/shop/*/item/*", True) and by_url["http://other.example/shop/zzz"] == ("/shop/zzz", False)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "target string, in_nav boolean")
    assert learning.learned_to_fixpoint(none).count() == 0
