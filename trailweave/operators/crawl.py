"""Exploration by levels in three phases, with a durable document of every level.

A level has the screens that the one before found.  Phase A tries their planned actions: of a family
of like actions on a screen the first only, of an action common to many screens those of the first few screens, and on
each screen no more than its budget.  Phase B decides on what was put off: a family whose first
action changed its screen in place, or a common action that always did, is skipped; a common action that always led to one screen
is an inferred step; the rest is tried within what is left of the budget.  Phase C tries the actions that changes in place
revealed, in further rounds as long as these reveal more.  Outcomes of each phase are merged in order.

The site is two functions on DataFrames, so a phase is one pass over all its actions:

* ``actions(views)``: of (signature) gives (signature, pos, shape, key, fam): the actions of a view in order, with their shape,
  the key if they are common to screens, and the family of like ones.
* ``perform(tasks)``: of (task, signature, pos) gives (task, error, to, route, lines): where each led.

Each level is written to a folder of its own, ``meta`` last.  A stopped exploration goes on after the last
level that has one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.operators.figures import Figures
from trailweave.operators.merging import merge_outcomes, numbered
from trailweave.session import checkpoint, drop_folder

TABLES = {
    "screens": "screen string, pos long, signature string, route string, lines array<string>, parent string, depth int",
    "aliases": "signature string, screen string",
    "widgets": "line string, since long",
    "attempts": "task long, level int, phase string, node string, signature string, pos int, shape string, key string, fam string, via int, fate string, dst string",
    "inferred": "level int, node string, key string, dst string",
    "untried": "level int, node string, n long",
}
META = "level int, tasks long, screens long, stop string"


@dataclass(frozen=True)
class Limits:
    max_depth: int = 6
    max_states: int = 60
    max_actions: int = 40
    repeats: int = 3
    max_via: int = 3
    max_revealed: int = 8


@dataclass(frozen=True)
class Site:
    actions: Callable[[DataFrame], DataFrame]
    perform: Callable[[DataFrame], DataFrame]


def plan_level(actions: DataFrame, prior: DataFrame, limits: Limits) -> DataFrame:
    """``actions`` (node, ord, pos, key, fam, ...) with ``status``: run, dup, later or cut, as if planned one by one.

    dup: an earlier one of the screen has the family.  later: the common action has ``repeats`` other screens
    before, of this level by (ord, pos) or of ``prior`` (key, node).  cut: beyond the screen's budget.  A cut action doesn't take
    a screen's place among the first ones, which frees later screens to be tried: so the plan is found in
    rounds, each of which settles at least the next screen in order.
    """
    like = F.row_number().over(Window.partitionBy("node", "fam").orderBy("pos")) > 1
    rows = checkpoint(actions.withColumn("dup", F.col("fam").isNotNull() & like))
    had = prior.select("key", "node").distinct()
    n_had = had.groupBy("key").agg(F.count("*").alias("n_had"))
    cut = rows.select("node", "pos").where("false")
    while True:
        taken = rows.where("key is not null and not dup").join(cut, ["node", "pos"], "left_anti").groupBy("key", "node").agg(F.min("ord").alias("ord"))
        new = taken.join(had, ["key", "node"], "left_anti").join(n_had, "key", "left").withColumn("n_had", F.coalesce("n_had", F.lit(0)))
        first = new.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("ord"))).where(F.col("k") + F.col("n_had") <= limits.repeats)
        sources = had.unionByName(first.select("key", "node")).withColumn("source", F.lit(True))
        full = first.groupBy("key").agg(F.count("*").alias("n"), F.max("ord").alias("last")).join(n_had, "key", "full")
        full = full.where(F.coalesce("n", F.lit(0)) + F.coalesce("n_had", F.lit(0)) >= limits.repeats).select("key", F.coalesce("last", F.lit(-1)).alias("last"))
        x = rows.join(sources, ["key", "node"], "left").join(full, "key", "left")
        later = F.coalesce(F.col("source").isNull() & (F.col("ord") > F.col("last")), F.lit(False)) if limits.repeats > 0 else F.lit(False)
        x = x.withColumn("later", ~F.col("dup") & later)
        place = F.sum((~F.col("dup") & ~F.col("later")).cast("int")).over(Window.partitionBy("node").orderBy("pos"))
        x = x.withColumn("place", place)
        status = F.when(F.col("dup"), "dup").when(F.col("later"), "later").when(F.col("place") > limits.max_actions, "cut").otherwise("run")
        x = checkpoint(x.withColumn("status", status).select(*actions.columns, "status"))
        now = x.where("status = 'cut'").select("node", "pos")
        if now.exceptAll(cut).isEmpty() and cut.exceptAll(now).isEmpty():
            return x
        cut = now


def resolve_later(plan: DataFrame, attempts: DataFrame, level_attempts: DataFrame, limits: Limits) -> DataFrame:
    """What was put off, with ``decision``: skip, infer (to ``nav``), try or cut."""
    kind = F.when(F.col("fate") == "error", "error").when(F.col("dst") == F.col("node"), "local").otherwise("nav")
    tried = attempts.where("key is not null and via = 0").withColumn("kind", kind)
    common = tried.groupBy("key").agg(
        F.bool_and(F.col("kind") == "local").alias("all_local"), F.bool_and(F.col("kind") == "nav").alias("all_nav"), F.count_distinct("dst").alias("places"), F.min("dst").alias("nav")
    )
    first = level_attempts.where("fam is not null and via = 0").groupBy("node", "fam").agg(F.min_by(kind, "task").alias("of_family"))
    rows = plan.where("status in ('dup', 'later')").join(common, "key", "left").join(first, ["node", "fam"], "left")
    dup = F.col("status") == "dup"
    by_key = F.when(F.col("all_local"), "skip").when(F.col("all_nav") & (F.col("places") == 1), "infer").otherwise("try")
    told = F.when(dup & (F.col("of_family") == "local"), "skip").when(dup & (F.col("of_family").isNotNull() | F.col("key").isNull()), "try").otherwise(by_key)
    used = plan.where("status = 'run'").groupBy("node").agg(F.count("*").alias("used"))
    rows = rows.withColumn("told", told).join(used, "node", "left")
    place = F.sum((F.col("told") == "try").cast("int")).over(Window.partitionBy("node").orderBy("pos"))
    over = (F.col("told") == "try") & (place + F.coalesce("used", F.lit(0)) > limits.max_actions)
    return rows.withColumn("decision", F.when(over, "cut").otherwise(F.col("told"))).select(*plan.columns, "decision", "nav")


def revealed_by(site: Site, done: DataFrame, own: DataFrame, before: DataFrame, limits: Limits) -> DataFrame:
    """(node, ord, from_task, signature, pos, shape, seen): what the changes in place of ``done`` revealed.

    ``done``: absorbed attempts (task, node, ord, to, seen), where ``seen`` are the shapes met on the way; ``own``: (node, shape) of the
    screens; ``before``: (node, shape) revealed earlier in the level.  One action of a shape, by the first outcome that
    reveals it, and of an outcome ``max_revealed``.
    """
    acts = site.actions(done.select(F.col("to").alias("signature")).distinct())
    one = acts.groupBy("signature", "shape").agg(F.min("pos").alias("pos"))
    every = acts.groupBy("signature").agg(F.collect_set("shape").alias("shapes"))
    rows = done.withColumnRenamed("to", "signature").join(one, "signature").join(every, "signature")
    known = own.unionByName(before).distinct()
    rows = rows.where(~F.array_contains("seen", F.col("shape"))).join(known, ["node", "shape"], "left_anti")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("node", "shape").orderBy("task"))).where("k = 1")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("task").orderBy("pos"))).where(F.col("k") <= limits.max_revealed)
    return rows.select("node", "ord", F.col("task").alias("from_task"), "signature", "pos", "shape", F.array_union("seen", "shapes").alias("seen"))


def _tables(spark: SparkSession, folder: str, levels: int) -> dict[str, DataFrame]:
    def read(name: str) -> DataFrame:
        paths = [f"{folder}/level-{k:04d}/{name}" for k in range(levels)]
        return spark.read.schema(TABLES[name]).parquet(*paths) if paths else spark.createDataFrame([], TABLES[name])

    return {name: read(name) for name in TABLES}


def _meta(spark: SparkSession, folder: str) -> list:
    """Meta of the levels that are whole, in order."""
    found = []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while files.exists(path(f"{folder}/level-{len(found):04d}/meta/_SUCCESS")):
        found.append(spark.read.schema(META).parquet(f"{folder}/level-{len(found):04d}/meta").first())
    return found


def crawl(root: DataFrame, site: Site, folder: str, limits: Limits = Limits(), levels: int | None = None, figures: Figures | None = None) -> dict[str, DataFrame]:
    """The ``TABLES`` of the exploration from ``root`` (signature, route, lines; one row), in ``folder``.

    ``levels``: how many of them to do in this call; the next call with the same folder goes on.  It ends
    without new screens (done), at ``max_states`` screens (maxStates) or below ``max_depth`` (maxDepth), which the last row of meta says.
    ``figures`` gathers the rows, failed steps and time of what each phase of this call performed.
    """
    figures = figures or Figures()
    spark = root.sparkSession
    meta = _meta(spark, folder)
    if not meta:
        _write(spark, folder, 0, {"screens": root.select(F.lit("s001").alias("screen"), F.lit(0).cast("long").alias("pos"), "signature", "route", "lines", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))}, 0, 1, None)
        meta = _meta(spark, folder)
    todo = levels
    while meta[-1]["stop"] is None and (todo is None or todo > 0):
        _level(spark, folder, site, limits, len(meta), meta[-1], figures)
        meta = _meta(spark, folder)
        todo = None if todo is None else todo - 1
    return _tables(spark, folder, len(meta))


def _write(spark: SparkSession, folder: str, level: int, tables: dict[str, DataFrame], tasks: int, screens: int, stop: str | None) -> None:
    place = f"{folder}/level-{level:04d}"
    drop_folder(spark, place)  # what a stopped attempt left
    for name, schema in TABLES.items():
        names = [x.split()[0] for x in schema.split(", ")]
        rows = tables[name].select(*names) if name in tables else spark.createDataFrame([], schema)
        rows.write.parquet(f"{place}/{name}")
    spark.createDataFrame([(level, tasks, screens, stop)], META).coalesce(1).write.parquet(f"{place}/meta")


def _level(spark: SparkSession, folder: str, site: Site, limits: Limits, level: int, last, figures: Figures) -> None:
    old = _tables(spark, folder, level)
    screens, aliases, widgets, attempts = old["screens"], old["aliases"], old["widgets"], old["attempts"]
    frontier = checkpoint(screens.where(F.col("depth") == level - 1).select(F.col("screen").alias("node"), F.col("pos").alias("ord"), "signature"))
    actions = checkpoint(frontier.join(site.actions(frontier.select("signature").distinct()), "signature"))
    prior = attempts.where("key is not null and via = 0").select("key", "node")
    plan = plan_level(actions, prior, limits)
    state = {"tasks": last["tasks"], "full": False, "new": [], "aliases": [], "widgets": widgets, "attempts": []}

    def run(todo: DataFrame, phase: str, via: int) -> DataFrame:
        """Tries (node, ord, signature, pos, shape, key, fam, ...) in order and merges the outcomes; gives them with ``to``."""
        todo = checkpoint(numbered(todo, ["ord", "order"], state["tasks"] + 1).withColumnRenamed("k", "task"))
        n = todo.count()
        if state["full"] or not n:
            return todo.withColumn("to", F.lit(None).cast("string")).withColumn("fate", F.lit(None).cast("string")).where("false")
        came = site.perform(todo.select("task", "signature", "pos"))
        outcomes = came.join(todo.select("task", "node"), "task").select(F.col("task").alias("pos"), "node", "error", F.col("to").alias("signature"), "route", "lines")
        all_screens = screens.drop("parent", "depth")
        all_aliases = aliases.select("signature", "screen")
        for x in state["new"]:
            all_screens = all_screens.unionByName(x.drop("parent", "depth"))
        for x in state["aliases"]:
            all_aliases = all_aliases.unionByName(x)
        outcomes = figures.run(f"perform {phase}", outcomes, checkpoint, F.col("error"))
        merged = merge_outcomes(outcomes, all_screens, all_aliases, state["widgets"], most_screens=limits.max_states)
        done = checkpoint(merged.outcomes.select(F.col("pos").alias("task"), F.col("signature").alias("to"), "fate", "dst"))
        state["new"].append(checkpoint(merged.screens.withColumn("depth", F.lit(level))))
        state["aliases"].append(checkpoint(merged.aliases))
        state["widgets"], state["full"] = checkpoint(merged.widgets), merged.full
        state["tasks"] += n
        rows = checkpoint(todo.join(done, "task"))
        own = rows.select("task", F.lit(level).alias("level"), F.lit(phase).alias("phase"), "node", "signature", F.col("pos").cast("int").alias("pos"), "shape", "key", "fam", F.lit(via).alias("via"), "fate", "dst")
        state["attempts"].append(own)
        return rows

    first = run(plan.where("status = 'run'").withColumn("order", F.col("pos").cast("long")), "A", 0)
    here = state["attempts"][0] if state["attempts"] else attempts.where("false")
    later = checkpoint(resolve_later(plan, attempts.unionByName(here), here, limits))
    if state["full"]:  # what was put off stays so
        later = later.where("false")
    second = run(later.where("decision = 'try'").drop("decision", "nav", "status").withColumn("order", F.col("pos").cast("long")), "B", 0)
    inferred = later.where((F.col("decision") == "infer") & (F.col("nav") != F.col("node"))).select(F.lit(level).alias("level"), "node", "key", F.col("nav").alias("dst"))
    own = actions.select("node", "shape").distinct()
    none = F.array().cast("array<string>")
    absorbed = [x.where("fate = 'absorbed'").select("task", "node", "ord", "to", none.alias("seen")) for x in (first, second)]
    changed, shown, used = absorbed[0].unionByName(absorbed[1]), own.where("false"), None
    left = []
    for via in range(1, limits.max_via):
        found = checkpoint(revealed_by(site, checkpoint(changed), own, shown, limits))
        if state["full"] or found.isEmpty():
            break
        shown = shown.unionByName(found.select("node", "shape"))
        place = F.row_number().over(Window.partitionBy("node").orderBy("from_task", "pos"))
        within = found.withColumn("order", place.cast("long"))
        if used is not None:
            within = within.join(used, "node", "left").withColumn("n_used", F.coalesce("n_used", F.lit(0)))
        else:
            within = within.withColumn("n_used", F.lit(0))
        within = checkpoint(within.withColumn("ok", F.col("order") + F.col("n_used") <= limits.max_actions))
        left.append(within.where("not ok").select("node"))
        count = within.where("ok").groupBy("node").agg(F.count("*").alias("more"))
        used = count if used is None else used.withColumnRenamed("n_used", "was").join(count, "node", "full").select("node", (F.coalesce("was", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("more"))
        used = checkpoint(used.withColumnRenamed("more", "n_used"))
        third = run(within.where("ok").drop("ok", "n_used").withColumn("key", F.lit(None).cast("string")).withColumn("fam", F.lit(None).cast("string")), "C", via)
        changed = third.where("fate = 'absorbed'").select("task", "node", "ord", "to", "seen")
    cut = plan.where("status = 'cut'").select("node").unionByName(later.where("decision = 'cut'").select("node"))
    for x in left:
        cut = cut.unionByName(x)
    untried = cut.groupBy("node").agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), "node", "n")
    tables = {"inferred": inferred, "untried": untried, "widgets": state["widgets"].join(widgets.select("line"), "line", "left_anti")}
    for name, parts in (("screens", state["new"]), ("aliases", state["aliases"]), ("attempts", state["attempts"])):
        for x in parts:
            tables[name] = tables[name].unionByName(x) if name in tables else x
    n_new = tables["screens"].count() if "screens" in tables else 0
    stop = "maxStates" if state["full"] else "done" if not n_new else "maxDepth" if level >= limits.max_depth else None
    _write(spark, folder, level, tables, state["tasks"], last["screens"] + n_new, stop)
