"""Screens that differ from another only by widgets that stayed open: a set-similarity join of their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.operators.compare import VARIANT_RETAIN, is_local_change, matching, of_kind, rest_of
from trailweave.session import checkpoint


def _structure(route: Column, lines: Column) -> Column:
    return F.sha1(F.to_json(F.struct(route.alias("r"), lines.alias("l"))).cast("binary"))


def _needed(size: Column, retain: float) -> Column:
    """How many of ``size`` lines must be kept."""
    return F.ceil(size * retain).cast("int")


def candidate_pairs(bases: DataFrame, found: DataFrame, retain: float = VARIANT_RETAIN) -> DataFrame:
    """(base, variant) of structures (id, route, lines) that may pass, each pair once.

    A variant has all headings of its base and ``retain`` of its other lines.  Lines are ordered from the
    rarest.  So it has the base's rarest heading, or, of a base without headings, one of its n - needed + 1 rarest
    lines; pairs are made by these lines only.  Of such pairs go on those that are large enough, and whose first common
    line leaves enough lines behind it on both sides.
    """
    split = lambda x: x.select("id", "route", F.array_distinct(of_kind(F.col("lines"), "h:")).alias("h"), F.array_distinct(rest_of(F.col("lines"))).alias("rest"))
    own, other = split(bases), split(found)
    counts = own.select("route", F.explode(F.concat("h", "rest")).alias("line")).groupBy("route", "line").agg(F.count("*").alias("n"))

    def ranked(x: DataFrame, column: str) -> DataFrame:
        """Lines of one kind with their place, the rarest first."""
        rows = x.select("id", "route", F.size("h").alias("n_h"), F.size("rest").alias("n_rest"), F.explode(column).alias("line")).join(counts, ["route", "line"], "left")
        rows = rows.withColumn("n", F.coalesce("n", F.lit(0)))
        return rows.withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("n", "line")) - 1)

    headed = ranked(own, "h").where("at = 0")
    plain = ranked(own.where(F.size("h") == 0), "rest")
    prefix = plain.where(F.col("at") <= F.col("n_rest") - F.greatest(F.lit(1), _needed(F.col("n_rest"), retain)))
    keys = headed.withColumn("at", F.lit(None).cast("int")).unionByName(prefix)
    keys = keys.select("route", "line", F.col("id").alias("base"), F.col("n_h").alias("b_h"), F.col("n_rest").alias("b_rest"), F.col("at").alias("b_at"))
    sought = ranked(other, "h").withColumn("at", F.lit(None).cast("int")).unionByName(ranked(other, "rest")).withColumnRenamed("id", "variant")
    needed = _needed(F.col("b_rest"), retain)
    large = (F.col("base") != F.col("variant")) & (F.col("n_h") >= F.col("b_h")) & (F.col("n_rest") >= needed)
    pairs = keys.join(sought.drop("n"), ["route", "line"]).where(large)
    first = pairs.groupBy("base", "variant").agg(F.min(F.struct("b_at", "at", "b_rest", "n_rest")).alias("x"))
    left = F.least(F.col("x.b_rest") - F.col("x.b_at"), F.col("x.n_rest") - F.col("x.at"))
    return first.where(F.col("x.b_at").isNull() | (left >= _needed(F.col("x.b_rest"), retain))).select("base", "variant")


def unexplained(found: DataFrame, widgets: DataFrame) -> DataFrame:
    """(id, own): the lines of each structure (id, pos, lines) that no widget explains.

    ``widgets``: (line, head, pattern, since); a line is explained by a widget that was learned before, since < pos.
    """
    rows = found.select("id", "pos", F.explode(F.array_distinct("lines")).alias("line")).where("line <> ''")
    literal = widgets.groupBy("line").agg(F.min("since").alias("since"))
    of_pattern = widgets.where("pattern is not null").groupBy("pattern").agg(F.min("since").alias("since"))
    matched = matching(rows, widgets).join(of_pattern, "pattern").groupBy("line").agg(F.min("since").alias("since"))
    known = literal.unionByName(matched).groupBy("line").agg(F.min("since").alias("since"))
    alone = F.col("since").isNull() | (F.col("since") >= F.col("pos"))
    own = rows.join(known, "line", "left").groupBy("id").agg(F.collect_list(F.when(alone, F.col("line"))).alias("own"))
    return found.select("id").join(own, "id", "left").select("id", F.coalesce("own", F.array().cast("array<string>")).alias("own"))


def variant_pairs(bases: DataFrame, found: DataFrame, widgets: DataFrame, retain: float = VARIANT_RETAIN) -> DataFrame:
    """(base, variant): the variant (id, pos, route, lines) is the base (id, route, lines) with widgets' lines added, one at least."""
    pairs = checkpoint(candidate_pairs(bases, found, retain))
    own = unexplained(found, widgets)
    v = found.select("id", F.col("lines").alias("v")).join(own, "id").withColumnRenamed("id", "variant")
    b = bases.select(F.col("id").alias("base"), F.col("lines").alias("b"))
    both = pairs.join(b, "base").join(v, "variant")
    added = F.size(F.array_except(F.filter("v", lambda x: x != ""), F.col("b"))) > 0
    return both.where(added & (F.size(F.array_except("own", "b")) == 0) & is_local_change(F.col("b"), F.col("v"), retain)).select("base", "variant")


def structures(views: DataFrame) -> DataFrame:
    """``views`` (view, route, lines) with ``id``: equal for equal routes and lines; views without a route have none."""
    distinct = views.where("route is not null").withColumn("lines", F.array_distinct("lines"))
    return distinct.withColumn("id", _structure(F.col("route"), F.col("lines")))


def variant_bases(found: DataFrame, screens: DataFrame, widgets: DataFrame, retain: float = VARIANT_RETAIN) -> DataFrame:
    """(view, screen): for views (view, route, lines) that are a variant of a screen (screen, pos, route, lines), the first such by ``pos``.

    Equal structures are compared once, however many views have them.
    """
    views, known = checkpoint(structures(found)), checkpoint(structures(screens.withColumnRenamed("screen", "view")))
    once = lambda x: x.groupBy("id").agg(F.any_value("route").alias("route"), F.any_value("lines").alias("lines"))
    first = known.groupBy("id").agg(F.min(F.struct("pos", "view")).alias("first"))
    timeless = widgets.withColumn("since", F.lit(-1))
    pairs = variant_pairs(once(known), once(views).withColumn("pos", F.lit(0)), timeless, retain)
    best = pairs.join(first.withColumnRenamed("id", "base"), "base").groupBy("variant").agg(F.min("first").alias("first"))
    return views.select("view", F.col("id").alias("variant")).join(best, "variant").select("view", F.col("first.view").alias("screen"))
