"""Paths of actions walked again over the edges of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.operators.compare import relocate
from trailweave.session import checkpoint

_ACTION = ["role", "label", "nth", "test_id", "toggle", "key"]


def replay(paths: DataFrame, steps: DataFrame, edges: DataFrame, most_steps: int = 32) -> DataFrame:
    """(path_id, step, node, pos, tier, dst, stopped) of each step walked.

    ``paths``: (path_id, node: where it starts); ``steps``: (path_id, step from 0, role, label, nth, test_id, toggle, key), which
    is what was done; ``edges``: (node, pos, role, label, nth, test_id, toggle, key, dst, error), which is what a run has.  On
    each screen the action is looked for as ``relocate`` does, and ``tier`` says how it was found.  A path
    ends early where its action isn't there (stopped: missing) or failed in the run (stopped: error).  All paths go one step a
    round, so there are as many rounds as the longest path has steps; more than ``most_steps`` are an error.
    """
    present = edges.select(F.col("node").alias("page_id"), "pos", *_ACTION)
    led = edges.select("node", "pos", "dst", "error")
    at, walked = checkpoint(paths.select("path_id", "node")), None
    for k in range(most_steps + 1):
        due = checkpoint(steps.where(F.col("step") == k).join(at, "path_id"))
        if due.isEmpty():
            break
        if k == most_steps:
            raise RuntimeError(f"a path has more than {most_steps} steps")
        wanted = due.select(F.col("path_id").alias("want_id"), F.col("node").alias("page_id"), *_ACTION)
        # only the actions of screens that a path is on
        here = present.join(due.select(F.col("node").alias("page_id")).distinct(), "page_id", "left_semi")
        found = relocate(wanted, here).withColumnRenamed("want_id", "path_id")
        rows = due.select("path_id", "step", "node").join(found, "path_id", "left").join(led, ["node", "pos"], "left")
        stopped = F.when(F.col("pos").isNull(), "missing").when(F.col("error") | F.col("dst").isNull(), "error")
        rows = checkpoint(rows.select("path_id", "step", "node", "pos", "tier", "dst", stopped.alias("stopped")))
        walked = rows if walked is None else walked.unionByName(rows)
        at = rows.where("stopped is null").select("path_id", F.col("dst").alias("node"))
    if walked is None:
        return at.select("path_id", F.lit(0).alias("step"), "node", F.lit(0).alias("pos"), F.lit(0).alias("tier"), F.col("node").alias("dst"), F.lit("").alias("stopped")).where("false")
    return walked
