"""Paths of actions walked again over a run's edges."""

from __future__ import annotations

import pytest

from trailweave.operators.paths import replay

ACTION = "role string, label string, nth int, test_id string, toggle boolean, key string"


def test_paths_are_walked_by_tiers_and_end_early(spark):
    link = lambda label, key=None, nth=0, test_id=None: ("link", label, nth, test_id, False, key or f"link|{label}")
    edges = [
        ("a", 0, *link("Item 7", "link|/item/*"), "b", False), ("a", 1, *link("Help", test_id="help"), "c", False), ("a", 2, *link("Bad"), None, True),
        ("b", 0, *link("Back"), "a", False), ("c", 0, *link("Item 9", "link|/item/*"), "b", False),
    ]
    edges = spark.createDataFrame(edges, f"node string, pos int, {ACTION}, dst string, error boolean")
    steps = {
        1: [link("Item 7", "link|/item/*"), link("Back"), link("Help", test_id="help")], 2: [link("Item 3", "x"), link("Back")], 3: [link("Hilfe", "y", test_id="help"), link("Other", "link|/item/*")],
        4: [link("Gone"), link("Back")], 5: [link("Bad"), link("Back")],
    }
    rows = [(p, k, *a) for p, s in steps.items() for k, a in enumerate(s)]
    steps = spark.createDataFrame(rows, f"path_id int, step int, {ACTION}")
    paths = spark.createDataFrame([(p, "a") for p in (1, 2, 3, 4, 5, 6)], "path_id int, node string")
    got = sorted((r.path_id, r.step, r.node, r.tier, r.dst, r.stopped) for r in replay(paths, steps, edges).collect())
    assert got == [
        (1, 0, "a", 1, "b", None), (1, 1, "b", 1, "a", None), (1, 2, "a", 1, "c", None), (2, 0, "a", 3, "b", None), (2, 1, "b", 1, "a", None),
        (3, 0, "a", 2, "c", None), (3, 1, "c", 5, "b", None), (4, 0, "a", None, None, "missing"), (5, 0, "a", 1, None, "error"),
    ]
    assert replay(paths.where("false"), steps, edges).isEmpty()
    with pytest.raises(RuntimeError):
        replay(paths, steps, edges, most_steps=1)
