"""What to try next: fair plans under budgets, repeats of common actions, and what can be inferred instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.session import checkpoint


def round_robin(actions: DataFrame, group: str, key: str, pos: str, per_key: int = 3) -> DataFrame:
    """``actions`` with ``plan_pos``: the first of each shape, then the second of each; ``per_key`` of a shape at most (0: all)."""
    own = Window.partitionBy(group, key).orderBy(pos)
    rows = actions.withColumn("turn", F.row_number().over(own)).withColumn("first", F.min(pos).over(Window.partitionBy(group, key)))
    rows = rows.where(F.col("turn") <= per_key) if per_key > 0 else rows
    return rows.withColumn("plan_pos", F.row_number().over(Window.partitionBy(group).orderBy("turn", "first"))).drop("first")


def budgeted(plan: DataFrame, group: str, order: str, budget: int, counts: str | None = None) -> DataFrame:
    """``plan`` with ``within``: whether an action is among the first ``budget`` of its group that count."""
    one = F.col(counts).cast("int") if counts else F.lit(1)
    so_far = F.sum(one).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return plan.withColumn("within", so_far <= budget)


def first_sources(actions: DataFrame, key: str, source: str, order: str, repeats: int = 3) -> DataFrame:
    """(key, source, first_order): the first ``repeats`` different screens from which a common action is tried."""
    per_source = actions.groupBy(key, source).agg(F.min(order).alias("first_order"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("first_order", source))
    return per_source.withColumn("k", rank).where(F.col("k") <= repeats).drop("k")


def first_of_family(actions: DataFrame, group: str, family: str, order: str) -> DataFrame:
    """``actions`` with ``deferred``: whether an earlier one of the group has the family."""
    w = Window.partitionBy(group, family).orderBy(order)
    return actions.withColumn("deferred", F.row_number().over(w) > 1)


def islands(rows: DataFrame, group: str, order: str, hit: str) -> DataFrame:
    """``rows`` with ``streak``: how many hits in a row end here (0 where there is none)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    block = F.sum(F.when(F.col(hit), 0).otherwise(1)).over(w)
    rows = rows.withColumn("_block", block)
    own = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("streak", F.sum(F.col(hit).cast("int")).over(own)).drop("_block")


def consistency(outcomes: DataFrame, key: str = "key") -> DataFrame:
    """(key, tries, verdict, nav): what a common action always did: local, nav to one place, or mixed.

    ``outcomes``: (key, kind: local or nav or error, nav).  Errors make it mixed.
    """
    g = outcomes.groupBy(key).agg(
        F.count("*").alias("tries"), F.bool_and(F.col("kind") == "local").alias("all_local"), F.bool_and(F.col("kind") == "nav").alias("all_nav"),
        F.count_distinct("nav").alias("places"), F.min("nav").alias("one"),
    )
    verdict = F.when(F.col("all_local"), "local").when(F.col("all_nav") & (F.col("places") == 1), "nav").otherwise("mixed")
    return g.select(key, "tries", verdict.alias("verdict"), F.when(verdict == "nav", F.col("one")).alias("nav"))


def resolve_deferred(deferred: DataFrame, known: DataFrame, enough: int = 2, key: str = "key") -> DataFrame:
    """``deferred`` (key, source) with what to do: skip (always local), infer (an edge to nav), or try."""
    rows = deferred.join(known, key, "left")
    sure = F.coalesce(F.col("tries") >= enough, F.lit(False))
    return rows.withColumn("decision", F.when(sure & (F.col("verdict") == "local"), "skip").when(sure & (F.col("verdict") == "nav"), "infer").otherwise("try"))


def local_actions(attempts: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """(node, key, count, tried, changed, first_pos): actions that stay on the screen, by shape."""
    return attempts.groupBy(node, key).agg(
        F.count("*").alias("count"), F.count_if("tried").alias("tried"), F.count_if(F.col("tried") & F.col("changed")).alias("changed"), F.min("pos").alias("first_pos")
    )


def explore(root: DataFrame, expand: Callable[[DataFrame], DataFrame], max_depth: int = 6, max_states: int = 60) -> tuple[DataFrame, DataFrame]:
    """Level by level from ``root`` (node, signature): (nodes, edges) of what ``expand`` finds.

    ``expand``: function of the frontier (node, signature, ...) giving (src, pos, signature, label,
    error).  A level's outcomes are merged in the order (src, pos) whatever order they come in:
    the first outcome with an unknown signature makes a node, numbered on, and every outcome an
    edge.  It ends without new nodes, at ``max_depth`` levels or ``max_states`` nodes.  Each level is
    written to the checkpoint folder.
    """
    nodes = checkpoint(root.select("node", "signature", F.lit(0).alias("depth")))
    frontier, edges, count = nodes, None, 1
    for depth in range(1, max_depth + 1):
        found = checkpoint(expand(frontier))
        good = found.where(~F.col("error"))
        first = good.groupBy("signature").agg(F.min(F.struct("src", "pos")).alias("at"))
        new = first.join(nodes.select("signature"), "signature", "left_anti")
        # numbering needs one order over a level's new screens, of which there are max_states at most
        kept = new.orderBy("at.src", "at.pos").limit(max(0, max_states - count))
        numbered = kept.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at.src", "at.pos")) + count)
        fresh = checkpoint(numbered.select(F.format_string("s%03d", F.col("k")).alias("node"), "signature", F.lit(depth).alias("depth")))
        nodes = checkpoint(nodes.unionByName(fresh))
        reached = found.join(nodes.select("signature", F.col("node").alias("dst")), "signature", "left")
        own = reached.select(F.lit(depth).alias("level"), "src", "pos", "label", "error", F.when(~F.col("error"), F.col("dst")).alias("dst")).where("dst is not null or error")
        edges = own if edges is None else edges.unionByName(own)
        count = nodes.count()
        if fresh.isEmpty() or count >= max_states:
            break
        frontier = fresh
    return nodes, checkpoint(edges) if edges is not None else edges


def truncation(nodes: DataFrame) -> DataFrame:
    """(node, note): screens whose actions were planned but not all tried."""
    cut = F.col("planned") - F.col("tried")
    return nodes.where(cut > 0).select("node", F.concat(cut.cast("string"), F.lit(" of "), F.col("planned").cast("string"), F.lit(" actions not tried")).alias("note"))
