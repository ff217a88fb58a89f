"""What in a set of pages is data: path segments below a parent, query variants, names, label families."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.functions.text import fold_digits, is_data_text, scrub, squeeze
from trailweave.functions.urls import RouteOptions, normalized, origin, query_pairs, route, ruled_segments, search, segments
from trailweave.session import checkpoint, join_checked

#: Smallest family, shortest common affix, shortest varying part, share of the largest family (fixed values).
MIN_FAMILY, MIN_AFFIX, MIN_VARYING, NEAR_LARGEST = 4, 3, 2, 0.8
NAV_WORDS, EXAMPLES = 12, 8
#: Origins whose prefixes are sent to all executors.
MOST_ORIGINS = 20_000


def segment_proposals(links: DataFrame, least: int = 3, options: RouteOptions = RouteOptions()) -> DataFrame:
    """(origin, prefix, n_values, examples): parents below which a segment looks like data.

    ``links``: (target, in_nav).  URLs of an origin that differ in one segment, not the first,
    make a group; it counts with ``least`` different values.  Few links of words only, all in the
    navigation, are separate pages.  Partial counts are combined before each shuffle.
    """
    learned = F.array(*map(F.lit, options.learned)) if options.learned else None
    return _proposed(_segmented(links, options), learned, least)


def _ruled(links: DataFrame, options: RouteOptions, *more: str) -> DataFrame:
    """(target, in_nav, origin, segs, ruled) of the links whose rules keep the number of segments."""
    rows = links.select("target", "in_nav", origin(F.col("target")).alias("origin"), segments(F.col("target")).alias("segs"), *more).where("origin is not null")
    return rows.withColumn("ruled", ruled_segments(F.col("segs"), options.path_rules)).where("size(ruled) = size(segs)")


def _segmented(links: DataFrame, options: RouteOptions) -> DataFrame:
    return _ruled(links, options).distinct()


def _places(rows: DataFrame, learned: Column | None, *more: str) -> DataFrame:
    """(origin, prefix, i, shape, value, in_nav, target): each segment of each link that can be data, and where it stands."""
    rows = rows.withColumn("norm", normalized(F.col("ruled"), learned)["norm"])
    at = rows.select("origin", "target", "in_nav", "segs", "norm", *more, *([learned.alias("learned")] if learned is not None else []), F.explode(F.when(F.size("segs") > 1, F.sequence(F.lit(1), F.size("segs") - 1))).alias("i"))
    at = at.withColumn("here", F.get("norm", F.col("i"))).withColumn("before", F.get("norm", F.col("i") - 1))
    at = at.where(~F.col("here").isin("*", "#") & (F.col("before") != "#"))
    at = at.withColumn("prefix", F.concat(F.lit("/"), F.array_join(F.slice("norm", 1, F.col("i")), "/")))
    if learned is not None:
        at = at.where(~F.array_contains("learned", F.col("prefix")))
    shape = F.array_join(F.transform("norm", lambda s, j: F.when(j == F.col("i"), "*").otherwise(s)), "/")
    return at.select("origin", "prefix", "i", shape.alias("shape"), F.get("segs", F.col("i")).alias("value"), "in_nav", "target", *more)


def _proposed(rows: DataFrame, learned: Column | None, least: int) -> DataFrame:
    values = _places(rows, learned)
    values = values.groupBy("origin", "prefix", "i", "shape", "value").agg(F.bool_and("in_nav").alias("in_nav"), F.min("target").alias("target"))
    # an example of each of some buckets of values: bounded, and combined before the shuffle
    picks = [F.min(F.when(F.crc32(F.col("value").cast("binary")) % EXAMPLES == b, F.col("target"))) for b in range(EXAMPLES)]
    groups = values.groupBy("origin", "prefix", "i", "shape").agg(
        F.count("*").alias("n"), F.bool_and("in_nav").alias("nav"), F.bool_or(F.col("value").rlike("[0-9]")).alias("digits"), F.array_compact(F.array(*picks)).alias("ex")
    )
    groups = groups.where((F.col("n") >= least) & ~(F.col("nav") & ~F.col("digits") & (F.col("n") <= NAV_WORDS)))
    merged = groups.groupBy("origin", "prefix").agg(F.sum("n").alias("n_values"), F.array_sort(F.flatten(F.collect_list("ex"))).alias("examples"))
    return merged.withColumn("examples", F.slice("examples", 1, EXAMPLES))


def signed_values(links: DataFrame, options: RouteOptions = RouteOptions()) -> DataFrame:
    """(origin, prefix, i, shape, value, n, outside): what links (target, in_nav, sign) that come and go add to each value's counts.

    ``sign`` is +1 where a link is seen and -1 where it is taken back; ``outside`` counts those out of
    navigation, null places among them.  Nothing is summed yet, so it works on a stream and on a table.
    """
    learned = F.array(*map(F.lit, options.learned)) if options.learned else None
    rows = _ruled(links.withColumn("sign", F.col("sign").cast("long")).where("sign is not null"), options, "sign")
    at = _places(rows, learned, "sign")
    return at.select("origin", "prefix", "i", "shape", "value", F.col("sign").alias("n"), F.when(F.coalesce("in_nav", F.lit(False)), 0).otherwise(F.col("sign")).cast("long").alias("outside"))


def learned_of_signed(links: DataFrame, least: int = 3, options: RouteOptions = RouteOptions()) -> DataFrame:
    """(origin, prefix, n_values) as ``segment_proposals`` gives of the links that remain of (target, in_nav, sign).

    A value counts while its links were seen more often than taken back.
    """
    values = signed_values(links, options).groupBy("origin", "prefix", "i", "shape", "value").agg(F.sum("n").alias("n"), F.sum("outside").alias("outside")).where("n > 0")
    groups = values.groupBy("origin", "prefix", "i", "shape").agg(
        F.count("*").alias("n"), F.count_if(F.col("outside") > 0).alias("outside"), F.count_if(F.col("value").rlike("[0-9]")).alias("digits")
    )
    found = groups.where((F.col("n") >= least) & ((F.col("outside") > 0) | (F.col("digits") > 0) | (F.col("n") > NAV_WORDS)))
    return found.groupBy("origin", "prefix").agg(F.sum("n").alias("n_values"))


def learned_to_fixpoint(links: DataFrame, least: int = 3, options: RouteOptions = RouteOptions(), accepted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(origin, prefix, round, n_values, examples): what is learned until nothing more is, as each prefix can uncover further ones.

    ``links``: (target, in_nav).  All proposals of a round are taken together, so the order of pages doesn't
    matter; the next round looks only at origins that learned something.  ``accepted``: those of
    the proposals (origin, prefix, n_values, examples) that a judge accepts; each is judged once.  A round takes
    at least one prefix, and in general there are as many rounds as a path has data segments.
    """
    rows = checkpoint(_segmented(links, options))
    given = F.array(*map(F.lit, options.learned)).cast("array<string>")
    pending, learned, judged, found = rows.withColumn("learned", given), None, None, []
    while True:
        proposed = _proposed(pending, F.col("learned"), least)
        if judged is not None:
            proposed = proposed.join(judged, ["origin", "prefix"], "left_anti")
        proposed = checkpoint(proposed)
        new = proposed if accepted is None else checkpoint(accepted(proposed))
        found.append(new.select("origin", "prefix", F.lit(len(found) + 1).alias("round"), "n_values", "examples"))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, found)
        keys = proposed.select("origin", "prefix")
        judged = keys if judged is None else judged.unionByName(keys)
        own = new.groupBy("origin").agg(F.collect_set("prefix").alias("more"))
        if learned is None:
            learned = own.select("origin", F.array_union(given, F.col("more")).alias("learned"))
        else:
            before = learned.join(own, "origin", "full")
            learned = before.select("origin", F.array_union(F.coalesce("learned", given), F.coalesce("more", F.array().cast("array<string>"))).alias("learned"))
        learned = checkpoint(learned)
        pending = join_checked(rows, learned.join(own.select("origin"), "origin", "left_semi"), "origin", "inner", MOST_ORIGINS)


def learned_routes(urls: DataFrame, prefixes: DataFrame, options: RouteOptions = RouteOptions()) -> DataFrame:
    """``urls`` (url, ...) with ``route``, ``data_values`` and ``data_driven`` by what its origin learned (origin, prefix)."""
    own = prefixes.groupBy("origin").agg(F.collect_set("prefix").alias("_learned"))
    rows = join_checked(urls.withColumn("_origin", origin(F.col("url"))), own.withColumnRenamed("origin", "_origin"), "_origin", "left", MOST_ORIGINS)
    given = F.array(*map(F.lit, options.learned)).cast("array<string>")
    rows = rows.withColumn("_route", route(F.col("url"), None, options, F.array_union(given, F.coalesce("_learned", F.array().cast("array<string>")))))
    return rows.select(*urls.columns, "_route.route", "_route.data_values", "_route.data_driven")


def learned_prefixes(links: DataFrame, least: int = 3) -> DataFrame:
    """(origin, learned): all proposals of an origin, as an array to join to its pages."""
    return segment_proposals(links, least).groupBy("origin").agg(F.array_sort(F.collect_set("prefix")).alias("learned"))


def query_variants(urls: DataFrame, options: RouteOptions = RouteOptions()) -> DataFrame:
    """(origin, route, n_queries): routes seen with two or more queries that don't count otherwise."""
    if options.query != "ignore":
        return urls.select(F.lit("").alias("origin"), F.lit("").alias("route"), F.lit(0).cast("long").alias("n_queries")).where("false")
    url, counted = F.col("url"), list(options.structural + options.data)
    pairs = query_pairs(search(url))
    rest = F.filter(pairs, lambda p: ~p["k"].isin(counted)) if counted else pairs
    text = F.array_join(F.array_sort(F.transform(rest, lambda p: F.concat(p["k"], F.lit("="), p["v"]))), "&")
    rows = urls.select(origin(url).alias("origin"), route(url, options=options)["route"].alias("route"), text.alias("rest")).where("route is not null and rest <> ''").distinct()
    return rows.groupBy("origin", "route").agg(F.count("*").alias("n_queries")).where("n_queries >= 2")


def names(actions: DataFrame) -> DataFrame:
    """(page_id, route, label): labels that name records.

    ``actions``: (page_id, label, target, route, data_driven).  On a page, the links to one
    data-driven route; a label names its target if no other target has it, or fewer than half of
    them; two such labels and two targets are needed.
    """
    rows = actions.where(F.col("data_driven") & is_data_text(F.trim("label"))).select("page_id", "route", F.trim("label").alias("label"), "target").distinct()
    per_label = rows.groupBy("page_id", "route", "label").agg(F.count("*").alias("n"), F.min("target").alias("one"))
    totals = rows.groupBy("page_id", "route").agg(F.count_distinct("target").alias("targets"))
    named = per_label.join(totals, ["page_id", "route"]).where("n = 1 or 2 * n < targets")
    reached = named.join(rows, ["page_id", "route", "label"]).groupBy("page_id", "route").agg(F.count_distinct("label").alias("labels"), F.count_distinct("target").alias("named_targets"))
    enough = reached.where("labels >= 2 and named_targets >= 2").select("page_id", "route")
    return named.join(enough, ["page_id", "route"], "left_semi").select("page_id", "route", "label")


def _affixes(label: Column, suffixes: Column, prefixes: Column) -> Column:
    """Suffixes (S) and prefixes (P) of the lengths given for each."""
    back = F.transform(suffixes, lambda k: F.concat(F.lit("S"), F.right(label, k)))
    front = F.transform(prefixes, lambda k: F.concat(F.lit("P"), F.left(label, k)))
    return F.array_distinct(F.concat(back, front))


def shared_affixes(labels: DataFrame, group: str) -> DataFrame:
    """(group, label, affix): all affixes of the labels that enough labels of a group share, and few others.

    An affix that so many share has only shorter ones that they share too: those of doubling lengths are
    counted first, and of each label only the affixes below the first such length that too few share are made.
    """
    rows = labels.select(group, "label").distinct()
    big = rows.groupBy(group).count().where(F.col("count") >= MIN_FAMILY).select(group)
    fitting = rows.join(big, group, "left_semi").where(F.length("label") >= MIN_AFFIX + MIN_VARYING)
    longest = F.length("label") - MIN_VARYING
    doubling = F.filter(F.array(*(F.lit(MIN_AFFIX << k) for k in range(24))), lambda k: k <= longest)
    coarse = fitting.select(group, "label", F.explode(_affixes(F.col("label"), doubling, doubling)).alias("affix"))
    shared = coarse.groupBy(group, "affix").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_FAMILY).select(group, "affix")
    top = [F.max(F.when(F.col("affix").startswith(side), F.length("affix") - 1)).alias(side) for side in "SP"]
    # in as many parts as a shuffle has, as few bytes here become many
    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tops = coarse.join(shared, [group, "affix"]).groupBy(group, "label").agg(*top).repartition(parts, group, "label")
    none = F.array().cast("array<int>")
    sizes = [F.when(F.col(side).isNull(), none).otherwise(F.sequence(F.lit(MIN_AFFIX), F.least(longest, 2 * F.col(side) - 1))) for side in "SP"]
    return tops.select(group, "label", F.explode(_affixes(F.col("label"), *sizes)).alias("affix"))


def label_families(labels: DataFrame, group: str = "page_id") -> DataFrame:
    """(group, label, folded): labels of a group that share a prefix or suffix, their varying part as *.

    Of a label's affixes that four labels or more share, those with nearly the largest family
    count, and of these the longest is taken, the first in order among equals.
    """
    each = shared_affixes(labels, group)
    counts = each.groupBy(group, "affix").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_FAMILY)
    found = each.join(counts, [group, "affix"])
    best = found.withColumn("most", F.max("n").over(Window.partitionBy(group, "label"))).where(F.col("n") >= F.col("most") * NEAR_LARGEST)
    order = Window.partitionBy(group, "label").orderBy(F.desc(F.length("affix")), "affix")
    chosen = best.withColumn("k", F.row_number().over(order)).where("k = 1")
    rest = F.substring("affix", 2, 1 << 30)
    return chosen.select(group, "label", F.when(F.col("affix").startswith("S"), F.concat(F.lit("*"), rest)).otherwise(F.concat(rest, F.lit("*"))).alias("folded"))


def adopted_shapes(leftover: DataFrame, shapes: DataFrame, group: str = "page_id") -> DataFrame:
    """(group, label, folded): labels that have the prefix and suffix of a shape that names were scrubbed to.

    ``shapes``: (group, shape, rows); the shape has one *, two rows or more, and with the adopted
    labels four or more.
    """
    parts = F.split("shape", r"\*", -1)
    known = shapes.where((F.size(parts) == 2) & (F.col("rows") >= 2)).withColumn("p", parts[0]).withColumn("q", parts[1])
    known = known.where(F.length("p") + F.length("q") >= MIN_AFFIX)
    fit = F.col("label").startswith(F.col("p")) & F.col("label").endswith(F.col("q")) & (F.length("label") - F.length("p") - F.length("q") >= MIN_VARYING)
    pairs = leftover.join(known, group).where(fit)
    counted = pairs.groupBy(group, "shape").agg(F.count_distinct("label").alias("more"))
    enough = pairs.join(counted, [group, "shape"]).where(F.col("rows") + F.col("more") >= MIN_FAMILY)
    order = Window.partitionBy(group, "label").orderBy("shape")
    return enough.withColumn("k", F.row_number().over(order)).where("k = 1").select(group, "label", F.col("shape").alias("folded"))


def scrubbed_labels(buttons: DataFrame, values: DataFrame, group: str = "page_id") -> DataFrame:
    """(group, label, raw, scrubbed): labels with digits folded and the group's data values (array) as *."""
    joined = buttons.join(values, group, "left")
    raw = squeeze(fold_digits(F.col("label")))
    return joined.select(group, "label", raw.alias("raw"), scrub(raw, F.coalesce("values", F.array().cast("array<string>"))).alias("scrubbed"))
