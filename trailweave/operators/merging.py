"""Outcomes of a level taken in as if one by one: what an earlier one makes decides what a later one meets.

Only the first outcome of each signature decides anything; the others go where it went.  A first one

* is absorbed, if it is a change in place of the screen that it was tried on.  That needs no other outcome, so all
  are found at once, and with them which widget lines are known from which place in the order on;
* joins the first screen that it is a variant of, by the widgets known at its place;
* else makes a new screen, which later ones may join as variants.

So the last two depend on earlier firsts that may turn out to be screens.  These dependencies are a table, made by the
set-similarity join, and are settled in rounds: a first is settled once the earliest candidate that is
still possible is a screen, or none is left.  The earliest of the unsettled always is, so every round settles some, and
there are as many rounds as the longest chain of variants, whatever the number of outcomes.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.operators.bases import variant_pairs
from trailweave.operators.compare import LOCAL_RETAIN, VARIANT_RETAIN, is_local_change, widget_patterns
from trailweave.session import checkpoint


@dataclass(frozen=True)
class Merged:
    """``outcomes`` with fate and dst; new ``screens`` (screen, pos, signature, route, lines, parent); new ``aliases`` (signature, screen); ``widgets`` (line, since)."""

    outcomes: DataFrame
    screens: DataFrame
    aliases: DataFrame
    widgets: DataFrame
    full: bool


def numbered(rows: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """``rows`` with ``k``: their place in the order of columns, from ``start`` on.

    Rows are sorted in ranges; the driver gets one count a range, so no task has all rows.
    """
    bits = 33  # of monotonically_increasing_id, for the row in its range
    placed = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    span = F.shiftright("at", bits)
    sizes = sorted((r["span"], r["count"]) for r in placed.groupBy(span.alias("span")).count().collect())
    before = list(itertools.accumulate((n for _, n in sizes), initial=start))
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "span long, before long")
    own = placed.withColumn("span", span).join(F.broadcast(starts), "span")
    return own.withColumn("k", F.col("before") + F.col("at").bitwiseAND((1 << bits) - 1)).drop("span", "before", "at")


def settled(firsts: DataFrame, depends: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(signature, pos, base): ``base`` is the earlier first that each joins, null for one that stands for itself.

    ``firsts``: (signature, pos); ``depends``: (variant, base) of which base is before variant.  Each joins the
    earliest of its bases that stands for itself.
    """
    by = depends.join(firsts.select(F.col("signature").alias("base"), F.col("pos").alias("base_pos")), "base")
    links, done = checkpoint(by.select("variant", "base", "base_pos")), None
    # what depends on nothing stands for itself
    waiting = checkpoint(firsts.join(links.select(F.col("variant").alias("signature")).distinct(), "signature", "left_semi"))
    alone = firsts.join(waiting, "signature", "left_anti").select("signature", "pos", F.lit(None).cast("string").alias("base"))
    done = checkpoint(alone)
    for _ in range(rounds):
        if waiting.isEmpty():
            return done
        state = done.select(F.col("signature").alias("base"), F.col("base").isNull().alias("stands"))
        open_links = links.join(waiting.select(F.col("signature").alias("variant")), "variant", "left_semi").join(state, "base", "left")
        open_links = checkpoint(open_links.where("stands is null or stands"))
        least = open_links.groupBy("variant").agg(F.min(F.struct("base_pos", "base", "stands")).alias("x"))
        now = waiting.join(least.withColumnRenamed("variant", "signature"), "signature", "left").where("x is null or x.stands")
        now = checkpoint(now.select("signature", "pos", F.col("x.base").alias("base")))
        done = checkpoint(done.unionByName(now))
        waiting = checkpoint(waiting.join(now.select("signature"), "signature", "left_anti"))
        links = open_links.drop("stands")
    raise RuntimeError(f"over {rounds} rounds: a dependency isn't on an earlier outcome")


def merge_outcomes(
    outcomes: DataFrame, screens: DataFrame, aliases: DataFrame, widgets: DataFrame, absorb: bool = True, most_screens: int | None = None,
    local_retain: float = LOCAL_RETAIN, variant_retain: float = VARIANT_RETAIN,
) -> Merged:
    """Takes in ``outcomes`` (pos, node, error, signature, route, lines), ``pos`` being their one order.

    ``screens``: (screen, pos, signature, route, lines) known before, with positions below all of ``outcomes``;
    ``aliases``: (signature, screen) of further signatures of these; ``widgets``: (line, since) learned before.
    Fates: error, known, absorbed, variant, joined (where an earlier outcome of this level went) and new.
    With ``most_screens`` in all reached, the outcome that reached it is the last one taken in.
    Null signatures are errors; views without a route are neither absorbed nor variants; repeated outcomes
    must differ in ``pos``.
    """
    outcomes = outcomes.withColumn("lines", F.array_distinct("lines"))
    good = outcomes.where(~F.col("error") & F.col("signature").isNotNull())
    known = screens.select("signature", "screen").unionByName(aliases.select("signature", "screen")).groupBy("signature").agg(F.min("screen").alias("screen"))
    at = F.min_by(F.struct("pos", "node", "route", "lines"), "pos").alias("x")
    firsts = checkpoint(good.join(known, "signature", "left_anti").groupBy("signature").agg(at).select("signature", "x.*"))
    on = screens.select(F.col("screen").alias("node"), F.col("route").alias("from_route"), F.array_distinct("lines").alias("from_lines"))
    local = firsts.join(on, "node").where((F.col("route") == F.col("from_route")) & is_local_change(F.col("from_lines"), F.col("lines"), local_retain))
    if not absorb:
        local = local.where("false")
    local = checkpoint(local)
    brought = local.select(F.explode(F.array_except(F.filter("lines", lambda x: x != ""), F.col("from_lines"))).alias("line"), F.col("pos").cast("long").alias("since"))
    lines = checkpoint(widgets.select("line", F.col("since").cast("long").alias("since")).unionByName(brought).groupBy("line").agg(F.min("since").alias("since")))
    rest = firsts.join(local.select("signature"), "signature", "left_anti")
    could = rest.where("route is not null") if absorb else rest.where("false")
    # bases are screens of before, and firsts that may become some; ids are signatures
    old = screens.where("route is not null").select(F.col("screen").alias("id"), F.col("pos").cast("long").alias("pos"), "route", F.array_distinct("lines").alias("lines"), F.lit(True).alias("old"))
    new = could.select(F.concat(F.lit("new:"), "signature").alias("id"), F.col("pos").cast("long").alias("pos"), "route", "lines", F.lit(False).alias("old"))
    bases = checkpoint(old.unionByName(new))
    patterned = widget_patterns(lines).join(lines, "line")
    pairs = variant_pairs(bases.drop("pos", "old"), bases.where("not old").drop("old"), patterned, variant_retain)
    place = bases.select(F.col("id").alias("base"), F.col("pos").alias("base_pos"), "old")
    dated = checkpoint(pairs.join(place, "base").join(bases.select(F.col("id").alias("variant"), "pos"), "variant").where("old or base_pos < pos"))
    to_old = checkpoint(dated.where("old").groupBy(F.substring("variant", 5, 1 << 20).alias("signature")).agg(F.min(F.struct("base_pos", "base"))["base"].alias("screen")))
    # one that joins a screen of before is none itself, so nothing depends on it
    stays = checkpoint(rest.join(to_old, "signature", "left_anti").select("signature", F.col("pos").cast("long").alias("pos")))
    bare = lambda c: F.substring(c, 5, 1 << 20)
    depends = dated.where("not old").select(bare("variant").alias("variant"), bare("base").alias("base"))
    depends = depends.join(stays.select(F.col("signature").alias("variant")), "variant", "left_semi").join(stays.select(F.col("signature").alias("base")), "base", "left_semi")
    found = settled(stays, depends)
    count = screens.count()
    made = found.where("base is null").select("signature", "pos")
    if most_screens is not None:
        made = made.orderBy("pos").limit(max(0, most_screens - count))
    made = checkpoint(numbered(made, ["pos"], count + 1).select("signature", F.format_string("s%03d", "k").alias("screen"), "pos"))
    n, last = made.agg(F.count("*"), F.max("pos")).first()
    full = most_screens is not None and count + n >= most_screens
    ids = made.select(F.col("signature").alias("base"), "screen")
    went = (
        local.select("signature", F.col("node").alias("screen"), F.lit("absorbed").alias("first_fate"))
        .unionByName(to_old.select("signature", "screen", F.lit("variant").alias("first_fate")))
        .unionByName(made.select("signature", "screen", F.lit("new").alias("first_fate")))
        .unionByName(found.where("base is not null").join(ids, "base").select("signature", "screen", F.lit("variant").alias("first_fate")))
    )
    went = checkpoint(went.join(firsts.select("signature", F.col("pos").alias("first_pos"), "node", "route", "lines"), "signature"))
    rows = outcomes.join(known.select("signature", F.col("screen").alias("was")), "signature", "left").join(went.select("signature", "screen", "first_fate", "first_pos"), "signature", "left")
    error = F.col("error") | F.col("signature").isNull()
    fate = F.when(error, "error").when(F.col("was").isNotNull(), "known").when(F.col("pos") == F.col("first_pos"), F.col("first_fate")).otherwise("joined")
    rows = rows.select(*outcomes.columns, fate.alias("fate"), F.when(~error, F.coalesce("was", "screen")).alias("dst"))
    if full:
        stop = last if n else -1
        rows, went, lines = rows.where(F.col("pos") <= stop), went.where(F.col("first_pos") <= stop), lines.where(F.col("since") <= stop)
    fresh = went.where("first_fate = 'new'").select("screen", F.col("first_pos").alias("pos"), "signature", "route", "lines", F.col("node").alias("parent"))
    return Merged(rows, fresh, went.where("first_fate <> 'new'").select("signature", "screen"), lines, full)
