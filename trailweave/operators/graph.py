"""The graph of screens: merged edges, discovery tree, paths, chapters, scenarios, common navigation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.session import checkpoint

NAV_SOURCES, NAV_SHARE = 3, 0.5


def merged_edges(edges: DataFrame, via: str | None = None) -> DataFrame:
    """(src, dst, label, n, inferred, first_pos): edges shown as one; failed ones are never merged.

    ``edges``: (edge_pos, src, dst, label, error, and inferred if known).
    """
    inferred = F.col("inferred") if "inferred" in edges.columns else F.lit(False)
    keys = ["src", "dst", "label"] + ([via] if via else [])
    return edges.where(~F.col("error")).groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(inferred).alias("inferred"), F.min("edge_pos").alias("first_pos"))


def discovery_edges(edges: DataFrame, root: Column) -> DataFrame:
    """(dst, src, edge_pos): the first good edge from elsewhere into each node but the root."""
    good = edges.where(~F.col("error") & (F.col("src") != F.col("dst")) & (F.col("dst") != root))
    return good.groupBy("dst").agg(F.min_by("src", "edge_pos").alias("src"), F.min("edge_pos").alias("edge_pos"))


def followed(links: DataFrame, weight: Column | None = None) -> DataFrame:
    """(node, end, total, last): where following ``links`` (node, next; each node once) ends, by pointer doubling.

    ``total``: sum of ``weight`` (1 if not given) over the links on the way; ``last``: the node whose link
    leads to the end.  Nodes on a cycle, or that lead into one, have no end and aren't there.  Only nodes
    without an end take part in a round, with what their pointer leads to: those that are done are
    written once, so that the many nodes of one end meet nowhere.  The rounds grow with the logarithm
    of the longest chain; all nodes at twice the distance before are done in each, so a round
    without a newly done node leaves only those of cycles.
    """
    rows = links.select("node", F.col("next").alias("at"), (F.lit(1) if weight is None else weight).cast("long").alias("total"))
    inner = rows.select(F.col("node").alias("at"), F.lit(True).alias("inner"))
    known = checkpoint(rows.join(inner, "at", "left").select("node", "at", "total", F.col("node").alias("last"), F.col("inner").isNull().alias("done")))
    ended, pending = [known.where("done")], known.where("not done")
    left, before = pending.count(), -1
    while left and left != before:
        before = left
        # a pointer leads to a node that is done, or to one that points on
        place = reduce(DataFrame.unionByName, [pending, *ended]).select(F.col("node").alias("at"), F.col("at").alias("on"), F.col("total").alias("more"), F.col("last").alias("on_last"), F.col("done").alias("on_done"))
        known = checkpoint(pending.join(place, "at").select("node", F.col("on").alias("at"), (F.col("total") + F.col("more")).alias("total"), F.col("on_last").alias("last"), F.col("on_done").alias("done")))
        ended.append(known.where("done"))
        pending = known.where("not done")
        left = pending.count()
    return reduce(DataFrame.unionByName, ended).select("node", F.col("at").alias("end"), "total", "last")


def discovery_numbers(edges: DataFrame, root: str) -> DataFrame:
    """(node, parent, depth, chapter, pre, size): the discovery tree in numbers, of bounded width for any depth.

    ``pre``: place in preorder, children by the edges that found them; ``size``: nodes of the subtree, so
    the nodes below one are those with ``pre`` in [pre, pre + size).  The tour that enters and leaves each
    node is a chain of arcs, two a node; how many entries lie ahead of each arc comes by doubling.
    """
    steps = checkpoint(discovery_edges(edges, F.lit(root)))
    ends = checkpoint(followed(steps.select(F.col("dst").alias("node"), F.col("src").alias("next"))).where(F.col("end") == root))
    tree = checkpoint(steps.join(ends.select(F.col("node").alias("dst"), F.col("total").alias("depth"), F.col("last").alias("chapter")), "dst"))
    # the chain of siblings by first found; edge positions differ, as one edge leads to one node
    sibling = tree.select(F.col("dst").alias("node"), "src", F.lead("dst").over(Window.partitionBy("src").orderBy("edge_pos")).alias("beside"))
    first = tree.groupBy(F.col("src").alias("node")).agg(F.min_by("dst", "edge_pos").alias("child"))
    arc = lambda name, leaves: F.struct(F.col(name).alias("node"), F.lit(leaves).alias("leaves"))
    enters = tree.select(F.col("dst").alias("node")).join(first, "node", "left").select(arc("node", False).alias("node"), F.when(F.col("child").isNotNull(), arc("child", False)).otherwise(arc("node", True)).alias("next"))
    leaves = sibling.select(arc("node", True).alias("node"), F.when(F.col("beside").isNotNull(), arc("beside", False)).otherwise(arc("src", True)).alias("next"))
    tour = followed(enters.unionByName(leaves), (~F.col("node.leaves")).cast("long")).select("node.node", "node.leaves", "total")
    ahead = tour.groupBy("node").agg(F.max(F.when(~F.col("leaves"), F.col("total"))).alias("entered"), F.max(F.when(F.col("leaves"), F.col("total"))).alias("left"))
    n = tree.agg(F.count("*").alias("n"))
    found = tree.select(F.col("dst").alias("node"), F.col("src").alias("parent"), "depth", "chapter").join(ahead, "node").join(F.broadcast(n))  # one row
    found = found.select("node", "parent", "depth", "chapter", (F.col("n") - F.col("entered") + 1).alias("pre"), (F.col("entered") - F.col("left")).alias("size"))
    top = n.select(F.lit(root).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(root).alias("chapter"), F.lit(0).cast("long").alias("pre"), (F.col("n") + 1).alias("size"))
    return top.unionByName(found)


def discovery_tree(edges: DataFrame, root: str) -> DataFrame:
    """(node, parent, depth, path, chapter, order): nodes that the root reaches over discovery edges.

    ``path``: nodes from the root; ``chapter``: the root's child above the node; ``order``: edge
    positions from the root, which sorts nodes in preorder.  Paths are as wide as nodes are deep: where none is
    asked for, ``discovery_numbers`` has the same tree.  First the nodes are found whose chain of
    parents ends at the root, then the chains of those that aren't whole double in length, round by round.
    """
    steps = checkpoint(discovery_edges(edges, F.lit(root)))
    reached = followed(steps.select(F.col("dst").alias("node"), F.col("src").alias("next"))).where(F.col("end") == root)
    steps = steps.join(reached.select(F.col("node").alias("dst")), "dst")
    own = F.array(F.struct(F.col("dst").alias("node"), F.col("edge_pos").cast("long").alias("edge_pos")))
    # top: the node above the chain's first one
    known = checkpoint(steps.select(F.col("dst").alias("node"), F.col("src").alias("parent"), F.col("src").alias("top"), own.alias("chain")))
    whole, part = [known.where(F.col("top") == root)], known.where(F.col("top") != root)
    while not part.isEmpty():
        above = reduce(DataFrame.unionByName, [part, *whole]).select(F.col("node").alias("top"), F.col("top").alias("above"), F.col("chain").alias("up"))
        known = checkpoint(part.join(above, "top").select("node", "parent", F.col("above").alias("top"), F.concat("up", "chain").alias("chain")))
        whole.append(known.where(F.col("top") == root))
        part = known.where(F.col("top") != root)
    known = reduce(DataFrame.unionByName, whole)
    names = F.transform("chain", lambda x: x["node"])
    found = known.select(
        "node", "parent", F.size("chain").alias("depth"), F.concat(F.array(F.lit(root)), names).alias("path"), names[0].alias("chapter"), F.transform("chain", lambda x: x["edge_pos"]).alias("order")
    )
    top = edges.sparkSession.range(1).select(
        F.lit(root).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.array(F.lit(root)).alias("path"), F.lit(root).alias("chapter"),
        F.array().cast("array<bigint>").alias("order"),
    )
    return top.unionByName(found)


def chapters(nodes: DataFrame, tree: DataFrame, root: str, route_of: Column | None = None) -> DataFrame:
    """(node, chapter): each node's child of the root; those with the root's route, and orphans, join the root.

    ``nodes``: (node); ``route_of``: column of the chapter's route, compared with the root's.
    """
    own = tree.select("node", "chapter")
    if route_of is not None:
        own = own.withColumn("chapter", F.when(route_of.eqNullSafe(F.lit(root)), root).otherwise(F.col("chapter")))
    return nodes.select("node").distinct().join(own, "node", "left").select("node", F.coalesce("chapter", F.lit(root)).alias("chapter"))


def scenarios(tree: DataFrame, root: str) -> DataFrame:
    """(leaf, path, steps, chapter, order): the way from the root to each node without children, in preorder."""
    parents = tree.select(F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = tree.where(F.col("node") != root).join(parents, "node", "left_anti")
    return leaves.select(F.col("node").alias("leaf"), "path", (F.size("path") - 1).alias("steps"), "chapter", "order")


def subtree(tree: DataFrame, node: str) -> DataFrame:
    return tree.where(F.array_contains("path", node))


def clicks(steps: Column, via: Column | None = None) -> Column:
    """Clicks of a path: each step and each action on the way counts."""
    return steps + (via if via is not None else F.lit(0))


def common_navigation(merged: DataFrame, least: int = NAV_SOURCES, share: float = NAV_SHARE) -> DataFrame:
    """(label, dst, sources): labels that lead to one place from many of the screens that have actions."""
    good = merged.where("src <> dst")
    with_out = good.agg(F.count_distinct("src").alias("with_out"))
    groups = good.groupBy("label", "dst").agg(F.count_distinct("src").alias("sources"))
    needed = F.greatest(F.lit(least), F.ceil(F.col("with_out") * share))
    return groups.join(F.broadcast(with_out)).where(F.col("sources") >= needed).drop("with_out")  # one row


def chapter_link_labels(merged: DataFrame, chapter_of: DataFrame, nav: DataFrame | None = None) -> DataFrame:
    """(chapter_from, chapter_to, nav, label, n): edges between chapters by label, a row each."""
    a = chapter_of.select(F.col("node").alias("src"), F.col("chapter").alias("chapter_from"))
    b = chapter_of.select(F.col("node").alias("dst"), F.col("chapter").alias("chapter_to"))
    rows = merged.where("src <> dst").join(a, "src").join(b, "dst").where("chapter_from <> chapter_to")
    if nav is not None:
        rows = rows.join(nav.select("label", "dst", F.lit(True).alias("nav")), ["label", "dst"], "left").withColumn("nav", F.coalesce("nav", F.lit(False)))
    else:
        rows = rows.withColumn("nav", F.lit(False))
    return rows.groupBy("chapter_from", "chapter_to", "nav", "label").agg(F.sum("n").alias("n"))


def chapter_links(labels: DataFrame) -> DataFrame:
    """(chapter_from, chapter_to, nav, n, n_labels, label, label_n) of ``chapter_link_labels``: each link with its most frequent label, the first in order among equals.

    A link keeps one label, however many it has.
    """
    best = F.min(F.struct((-F.col("n")).alias("less"), "label"))
    found = labels.groupBy("chapter_from", "chapter_to", "nav").agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("n_labels"), best.alias("best"))
    return found.select("chapter_from", "chapter_to", "nav", "n", "n_labels", "best.label", (-F.col("best.less")).alias("label_n"))


def adjacent_runs(rows: DataFrame, column: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``run``: number of the run of equal neighbouring values within a column."""
    w = Window.partitionBy(column).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(order).over(w).isNull()).cast("int")
    return rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def subtitles(clues: DataFrame) -> DataFrame:
    """(node, subtitle): of screens with one name, the clue that fewest of the others share; the first wins.

    ``clues``: (node, name, pos, clue).  A clue that all others share is none.
    """
    sizes = clues.groupBy("name").agg(F.count_distinct("node").alias("size")).where("size >= 2")
    shared = clues.select("name", "clue", "node").distinct().groupBy("name", "clue").agg((F.count("*") - 1).alias("shared"))
    rows = clues.where("clue <> ''").join(sizes, "name").join(shared, ["name", "clue"])
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("shared", "pos"))).where("k = 1 and shared < size - 1")
    return best.select("node", F.col("clue").alias("subtitle"))


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """(node, final): where each merged node ended, following (node, into); by pointer doubling.

    A cycle has no end, so one is an error.
    """
    links = checkpoint(redirects.select("node", F.col("into").alias("next")))
    found = checkpoint(followed(links).select("node", "end"))
    lost = links.join(found, "node", "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"redirects that never end: {', '.join(str(r.node) for r in lost)} and others on their way")
    return found.select("node", F.col("end").alias("final"))


def rekeyed(nodes: DataFrame) -> DataFrame:
    """(node, signature, depth, final, new_signature) after signatures were computed anew.

    ``nodes``: (node, signature, depth, pos).  Nodes of one depth that now have one signature
    merge into the first; those of further depths keep apart with the suffix ~2, ~3 by first place.
    """
    same = Window.partitionBy("signature", "depth")
    rows = nodes.withColumn("final", F.min_by("node", "pos").over(same)).withColumn("first", F.min("pos").over(same))
    rank = F.dense_rank().over(Window.partitionBy("signature").orderBy("first"))
    return rows.withColumn("rank", rank).select(
        "node", "signature", "depth", "final", F.when(F.col("rank") > 1, F.concat(F.col("signature"), F.lit("~"), F.col("rank").cast("string"))).otherwise(F.col("signature")).alias("new_signature")
    )


def rewired(edges: DataFrame, final: DataFrame) -> DataFrame:
    """Edges between the nodes that are left; those that became loops are dropped unless they failed."""
    a = final.select(F.col("node").alias("src"), F.col("final").alias("new_src"))
    b = final.select(F.col("node").alias("dst"), F.col("final").alias("new_dst"))
    rows = edges.join(a, "src", "left").join(b, "dst", "left")
    loop = F.coalesce("new_src", "src") == F.coalesce("new_dst", "dst")
    kept = rows.where(~loop | (F.col("src") == F.col("dst")) | F.col("error"))
    return kept.withColumn("src", F.coalesce("new_src", "src")).withColumn("dst", F.coalesce("new_dst", "dst")).select(*edges.columns)
