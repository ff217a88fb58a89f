"""What a run records: failures, bounded collections, counters, dirty marks, absorbed changes, names and filters of the viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.functions.text import is_data_text
from trailweave.operators.compare import is_local_change
from trailweave.operators.rundiff import SEVERITY

#: Loads that were only broken off, which are no failures (fixed values).
BENIGN_FAILURE = r"(?i)ERR_ABORTED|NS_BINDING_ABORTED|ERR_BLOCKED_BY_CLIENT|cancelled|canceled"
MESSAGE_CHARS = 300


def failures(log: DataFrame) -> DataFrame:
    """(node, pos, list, text): console errors and failed requests of a log, in order.

    ``log``: (node, pos, kind: console, pageerror, requestfailed or response, level, text, method,
    url, status).  Loads that were broken off and answers below 400 are none.
    """
    console = (F.col("kind") == "console") & (F.col("level") == "error") | (F.col("kind") == "pageerror")
    failed = (F.col("kind") == "requestfailed") & ~F.coalesce("text", F.lit("failed")).rlike(BENIGN_FAILURE)
    refused = (F.col("kind") == "response") & (F.col("status") >= 400)
    text = (
        F.when(console, F.left("text", F.lit(MESSAGE_CHARS)))
        .when(failed, F.concat("method", F.lit(" "), "url", F.lit(" ("), F.coalesce("text", F.lit("failed")), F.lit(")")))
        .otherwise(F.concat(F.col("status").cast("string"), F.lit(" "), "method", F.lit(" "), "url"))
    )
    return log.where(console | failed | refused).select("node", "pos", F.when(console, "console").otherwise("request").alias("list"), text.alias("text"))


def collected(rows: DataFrame, group: str, value: str, order: str, most: int | None = None) -> DataFrame:
    """(group, value, first, k): the distinct values of each group by their first place; at most ``most`` are recorded."""
    firsts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(order).alias("first"))
    ranked = firsts.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy("first", value)))
    return ranked.where(F.col("k") <= most) if most is not None else ranked


def counters(edges: DataFrame) -> DataFrame:
    """One row (attempts, failed, inferred, loops, screens): what a run did, in one pass."""
    inferred = F.col("inferred") if "inferred" in edges.columns else F.lit(False)
    return edges.agg(
        F.count_if(~inferred).alias("attempts"), F.count_if("error").alias("failed"), F.count_if(inferred).alias("inferred"), F.count_if(F.col("src") == F.col("dst")).alias("loops"),
        F.count_distinct("dst").alias("screens"),
    )


def dirty_nodes(tree: DataFrame, steps: DataFrame, root: str) -> DataFrame:
    """(node, dirty): whether the way from the root to a node had a step that may have changed data.

    ``tree``: (node, order: edge positions from the root); ``steps``: (edge_pos, clean, stored: whether
    the storage changed).
    """
    way = tree.select("node", F.explode("order").alias("edge_pos")).join(steps, "edge_pos", "left")
    marks = way.groupBy("node").agg(F.bool_or(~F.coalesce("clean", F.lit(False)) | F.coalesce("stored", F.lit(False))).alias("dirty"))
    return tree.select("node").join(marks, "node", "left").select("node", F.coalesce("dirty", F.lit(False)).alias("dirty"))


def compound_plan(revealed: DataFrame, used: DataFrame | None, budget: int, node: str = "node", order: str = "pos") -> DataFrame:
    """``revealed`` actions with ``within``: the first of each screen up to ``budget``, less those ``used`` (node, n) before."""
    rows = revealed if used is None else revealed.join(used.select(node, F.col("n").alias("_used")), node, "left")
    before = F.lit(0) if used is None else F.coalesce("_used", F.lit(0))
    out = rows.withColumn("within", F.row_number().over(Window.partitionBy(node).orderBy(order)) + before <= budget)
    return out if used is None else out.drop("_used")


def absorbed(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (src_route, dst_route, before, after: lines) with ``absorb``: whether the new view is the old screen changed in place."""
    return outcomes.withColumn("absorb", F.coalesce(F.col("src_route") == F.col("dst_route"), F.lit(False)) & is_local_change(F.col("before"), F.col("after")))


def chapter_stats(chapter_of: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chapter, screens, with_errors, any_added, any_changed, any_external) from (node, chapter) and (node, errors, added, changed, external)."""
    return chapter_of.join(nodes, "node").groupBy("chapter").agg(
        F.count("*").alias("screens"), F.count_if(F.col("errors") > 0).alias("with_errors"), F.bool_or("added").alias("any_added"), F.bool_or("changed").alias("any_changed"),
        F.bool_or("external").alias("any_external"),
    )


def known_names(titles: DataFrame, rows: DataFrame, families: DataFrame) -> DataFrame:
    """(name, sources): names that stand for data, from parts of titles, parts of row labels and varying parts of families.

    Each input has a column ``name``; a name of two characters or more that aren't digits or signs counts.
    """
    tagged = [df.select(F.trim("name").alias("name"), F.lit(tag).alias("tag")) for df, tag in ((titles, "title"), (rows, "row"), (families, "family"))]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).where(is_data_text(F.col("name")))
    return every.groupBy("name").agg(F.array_sort(F.collect_set("tag")).alias("sources"))  # three tags at most


def known_signatures(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``found`` whose signature no node has yet: only these are recorded anew."""
    return found.join(nodes.select("signature").distinct(), "signature", "left_anti")


def previous_shots(matches: DataFrame, previous: DataFrame, folder: str) -> DataFrame:
    """(id, screenshot): the earlier picture of each matched screen, its path seen from the current run; '' where there was none."""
    shots = previous.select(F.col("id").alias("prev_id"), F.coalesce("screenshot", F.lit("")).alias("shot"))
    return matches.join(shots, "prev_id").select("id", F.when(F.col("shot") != "", F.concat(F.lit(f"{folder}/"), "shot")).otherwise("").alias("screenshot"))


def edge_instances(edges: DataFrame, instances: DataFrame) -> DataFrame:
    """``edges`` (dst, key: instance key of the address) with the ``values`` of the instance of the destination that they lead to."""
    own = instances.groupBy("node", "key").agg(F.first("values").alias("values"))
    return edges.join(own.withColumnRenamed("node", "dst"), ["dst", "key"], "left")


def via_names(via: DataFrame, local: DataFrame) -> DataFrame:
    """``via`` (edge_pos, k, src, role, label) with ``name``: the pattern, else the label, of the first local action alike on the source."""
    firsts = local.groupBy("node", "role", "label").agg(F.min_by("pattern", "pos").alias("pattern"))
    joined = via.join(firsts.withColumnRenamed("node", "src"), ["src", "role", "label"], "left")
    return joined.withColumn("name", F.coalesce("pattern", "label")).drop("pattern")


def passes(status: str, text: str, added: Column, changed: Column, errors: Column, *searched: Column) -> Column:
    """The viewer's filter: all, added, changed or error; and a text that any of the columns has, case aside."""
    by_status = {"all": F.lit(True), "added": added, "changed": changed, "error": errors > 0}[status]
    said = F.contains(F.lower(F.concat_ws(" ", *searched)), F.lit(text.lower())) if text else F.lit(True)
    return by_status & said


def issue_items(items: DataFrame, only_kind: str | None = None, only_new: bool = False) -> DataFrame:
    """``items`` (key, pos, kind, is_new) with ``place``: the gravest of each screen first, for reading."""
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col("kind")]
    rows = items.where(F.lit(True) if only_kind is None else F.col("kind") == only_kind)
    rows = rows.where("is_new") if only_new else rows
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(rank), "pos")))


def screen_summary(actions: DataFrame, examples: int = 2) -> DataFrame:
    """(page_id, key, n, labels): actions of a screen by shape, with the first ``examples`` different labels of each."""
    firsts = actions.groupBy("page_id", "key", "label").agg(F.min("pos").alias("pos"), F.count("*").alias("c"))
    ranked = firsts.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "key").orderBy("pos", "label")))
    some = F.array_sort(F.collect_list(F.when(F.col("k") <= examples, F.struct("k", "label"))))
    return ranked.groupBy("page_id", "key").agg(F.sum("c").alias("n"), F.transform(some, lambda x: x["label"]).alias("labels"))
