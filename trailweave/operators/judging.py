"""Scores of an external judge: thresholds, tallies, AUC, candidate pairs, clustering."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.operators.graph import followed
from trailweave.operators.merging import numbered
from trailweave.session import checkpoint

#: Ranges that a range of values is cut in, and values that one task puts in order.
RANGES, MOST_VALUES = 4096, 100_000
ACTION_THRESHOLD, LINK_THRESHOLD, MERGE_THRESHOLD = 0.5, 0.7, 0.7


def merge_score(same: Column, differs: Column, no_difference: Column) -> Column:
    """Whether two screens are one: sure without a difference, else the weaker of 'same' and not 'differs'."""
    return F.when(no_difference, F.lit(1.0)).otherwise(F.least(same, 1 - differs))


def accepted(score: Column, role: Column, toggle: Column) -> Column:
    """Whether an action may be tried: tabs, summaries and toggles always, links and buttons below their thresholds."""
    least = F.when(role == "link", LINK_THRESHOLD).otherwise(ACTION_THRESHOLD)
    return role.isin("tab", "summary") | toggle | score.isNull() | (score < least)


def cached_answers(asked: DataFrame, cache: DataFrame, *key: str) -> DataFrame:
    """``asked`` with ``answer`` from the cache, by the SHA-1 of the key columns; null: to be asked."""
    digest = F.sha1(F.to_json(F.struct(*key)).cast("binary"))
    return asked.withColumn("digest", digest).join(cache.select("digest", "answer"), "digest", "left")


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row ``auc``: share of (positive, negative) pairs in the right order, ties half; null without both.

    No pair is made: counts per distinct score are summed in order.  Scores are summed in two
    steps, within ranges of scores and over the ranges, so that no task has them all.
    """
    counts = rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n")
    )
    ranged = counts.withColumn("range", F.floor(F.log2(1 + F.abs("s")) * 64) * F.signum("s"))
    before = ranged.groupBy("range").agg(F.sum("n").alias("rn"))
    # a range of scores for each 1/64 of a doubling: some thousands at most
    before = before.withColumn("below", F.sum("rn").over(Window.orderBy("range")) - F.col("rn")).select("range", "below")
    within = Window.partitionBy("range").orderBy("s")
    placed = ranged.join(F.broadcast(before), "range").withColumn("less", F.col("below") + F.sum("n").over(within) - F.col("n"))
    right = F.sum(F.col("p") * (F.col("less") + 0.5 * F.col("n")))
    total = F.sum("p").cast("double") * F.sum("n")
    return placed.agg(F.when(total > 0, right / total).alias("auc"))


def tally(rows: DataFrame, score: str, positive: str, threshold: float) -> DataFrame:
    """One row (n, correct, false_negatives, false_positives)."""
    said = F.col(score) >= threshold
    return rows.agg(
        F.count("*").alias("n"), F.count_if(said == F.col(positive)).alias("correct"), F.count_if(~said & F.col(positive)).alias("false_negatives"), F.count_if(said & ~F.col(positive)).alias("false_positives")
    )


def upper_median(rows: DataFrame, value: str, most_values: int = MOST_VALUES) -> DataFrame:
    """One row ``median``: the element floor(n / 2) of the sorted values, the upper one of two; none of no values.

    It is the smallest value with more than half the rows at or below it.  Counts are summed by ranges
    of values, the first of equal width in the logarithm and further ones of equal width within the one that has it, until
    that one has no more than ``most_values`` values; only these are put in order.
    """
    v = F.col("v")
    counts = checkpoint(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")))
    inside, below, total = counts, 0, counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    number, step = v.cast("double"), F.floor(F.log2(1 + F.abs(v.cast("double"))) * 64) * F.signum(v.cast("double"))
    n = None
    while n is None or n > most_values:
        sizes = inside.groupBy(step.alias("range")).agg(F.sum("c").alias("rc"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
        # some thousands of ranges at most
        placed = sizes.withColumn("upto", F.sum("rc").over(Window.orderBy("range")) + below).where(2 * F.col("upto") > total)
        place = placed.agg(F.min(F.struct("range", (F.col("upto") - F.col("rc")).alias("below"), "low", "high", "n")).alias("x")).select("x.*").first()
        if place["range"] is None:
            return counts.select(v.alias("median")).where("false")
        n, below, low, high = place["n"], place["below"], place["low"], place["high"]
        inside = counts.where(v.between(F.lit(low), F.lit(high)))
        width = (float(high) - float(low)) / RANGES
        step = F.least(F.floor((number - float(low)) / width), F.lit(RANGES - 1)) if width else F.lit(0)
        if not width:  # values that are one as doubles: a few thousand whole numbers at most
            break
    so_far = F.lit(below) + F.sum("c").over(Window.orderBy("v"))
    return inside.withColumn("half", 2 * so_far > total).where("half").agg(F.min("v").alias("median"))


def size_figures(rows: DataFrame, value: str) -> DataFrame:
    """One row (n, total, largest, mean) of the values that aren't null."""
    return rows.agg(F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.max(value).alias("largest"), F.avg(value).alias("mean"))


def same_section_candidates(screens: DataFrame, most: int = 8) -> DataFrame:
    """(pos, other, same_route): for each screen, earlier screens of its section, same routes first, the nearest ``most``.

    ``screens``: (pos, section, route).  Only the ``most`` last of a section and route, and of a section,
    can be chosen, so each screen looks at the last ones before it and never at the whole section.
    """
    by_route = Window.partitionBy("section", "route").orderBy("pos").rowsBetween(-most, -1)
    by_section = Window.partitionBy("section").orderBy("pos").rowsBetween(-2 * most, -1)
    rows = screens.withColumn("near_route", F.collect_list("pos").over(by_route))
    rows = rows.withColumn("near_section", F.collect_list(F.struct("pos", "route")).over(by_section))
    others = F.transform(F.filter("near_section", lambda x: ~x["route"].eqNullSafe(F.col("route"))), lambda x: x["pos"])
    chosen = F.slice(F.concat(F.reverse("near_route"), F.reverse(others)), 1, most)
    each = rows.select("pos", F.posexplode(chosen).alias("k", "other"), F.size("near_route").alias("n_route"))
    return each.select("pos", "other", (F.col("k") < F.col("n_route")).alias("same_route"))


#: Rows of a block of vectors; two blocks are compared by one product of matrices.
_BLOCK = 1024


def _alike(rows: DataFrame, group: str, vector: str, threshold: float) -> DataFrame:
    """(a, b, worst): the pairs a < b of ``rows`` (k, group, vector) of a group whose cosine similarity reaches the threshold.

    ``k`` ascends by group.  Each block of a group meets each other one in a task of its own, so a
    group of any size fills many; vectors of different lengths aren't compared.
    """
    own = rows.select(F.col("k"), F.struct(group, F.size(vector)).alias("g"), F.col(vector).alias("v"), F.floor(F.col("k") / _BLOCK).alias("block"))
    spans = own.groupBy("g").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    met = own.join(spans, "g").withColumn("other", F.explode(F.sequence("low", "high")))
    met = met.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "k", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ignore_index=True)
        v = np.stack(pdf["v"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        k = pdf["k"].to_numpy()
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        n = len(v) if same else int((pdf["block"] == pdf["i"]).sum())
        scores = np.round(v[:n] @ (v if same else v[n:]).T, 9)
        a, b = np.nonzero(np.triu(scores >= threshold, 1) if same else scores >= threshold)
        return pd.DataFrame({"a": k[a], "b": k[b if same else b + n], "worst": scores[a, b]})

    return met.groupBy("g", "i", "j").applyInPandas(run, "a long, b long, worst double")


def linked_clusters(pairs: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(k, cluster): clusters of two and more by complete linkage over ``pairs`` (a < b, worst), named by their least k.

    ``pairs`` are all that may be in one cluster.  One after another, the two clusters whose worst
    pair is best would be merged, of equals those of the least names.  A merged cluster is no nearer to
    any other than its nearer part was, so clusters that are each other's nearest are merged in the
    end whatever comes before: all these are merged at once in each round, with the same result.
    The best of all pairs always is such a one, so every round merges some.
    """
    pairs = checkpoint(pairs)
    merged: list[DataFrame] = []
    for _ in range(rounds):
        ends = pairs.select(F.explode(F.array("a", "b")).alias("k"), F.struct("worst", (-F.col("a")).alias("a"), (-F.col("b")).alias("b")).alias("x"))
        best = ends.groupBy("k").agg(F.max("x").alias("x"))
        # a pair is there twice, if it is the best of both
        now = checkpoint(best.groupBy("x").count().where("count = 2").select((-F.col("x.b")).alias("k"), (-F.col("x.a")).alias("to")))
        if now.isEmpty():
            break
        merged.append(now)
        moved = now.unionByName(now.select(F.col("to").alias("k"), "to"))
        ends = pairs
        for end in ("a", "b"):
            to = moved.select(F.col("k").alias(end), F.col("to").alias(f"{end}_to"))
            ends = ends.join(to, end, "left")
        parts = lambda end: F.when(F.col(f"{end}_to").isNull(), 1).otherwise(2)
        ends = ends.select(F.coalesce("a_to", "a").alias("p"), F.coalesce("b_to", "b").alias("q"), "worst", (parts("a") * parts("b")).alias("needed")).where("p <> q")
        ends = ends.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.min("worst").alias("worst"), F.count("*").alias("n"), F.first("needed").alias("needed"))
        pairs = checkpoint(ends.where("n = needed").select("a", "b", "worst"))
    else:
        raise RuntimeError(f"over {rounds} rounds")
    if not merged:
        return pairs.select(F.col("a").alias("k"), F.col("b").alias("cluster"))  # none
    links = checkpoint(reduce(DataFrame.unionByName, merged))
    return followed(links.select(F.col("k").alias("node"), F.col("to").alias("next"))).select(F.col("node").alias("k"), F.col("end").alias("cluster"))


def complete_linkage(vectors: DataFrame, group: str, id_col: str, vector: str, threshold: float = MERGE_THRESHOLD, most: int | None = None) -> DataFrame:
    """(group, id, cluster): clusters of each group, named by their smallest id, by cosine similarity.

    A cluster's pairs all reach the threshold, so linkage needs only the pairs that do; groups may
    have any number of rows.  Equal vectors are one from the start.  A vector that is null, all zero
    or not finite is a cluster of its own.  With ``most``, a group of more rows is an error.
    """
    if most is not None and not vectors.groupBy(group).count().where(F.col("count") > most).isEmpty():
        raise ValueError(f"a group has more rows than the {most} that complete linkage takes here")
    rows = checkpoint(numbered(vectors.select(group, id_col, vector), [group, id_col]))
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(vector, lambda x: x != 0)
    units = checkpoint(rows.where(finite).groupBy(group, vector).agg(F.min("k").alias("unit"), F.count("*").alias("n")))
    copies = units.where("n > 1").select(F.col(group).alias("_g"), F.col(vector).alias("_v"), "unit")
    own = rows.join(copies, F.col(group).eqNullSafe(F.col("_g")) & (F.col(vector) == F.col("_v")), "left").select(group, id_col, "k", F.coalesce("unit", "k").alias("unit"))
    found = linked_clusters(_alike(units.select(F.col("unit").alias("k"), group, vector), group, vector, threshold))
    own = own.join(found.withColumnRenamed("k", "unit"), "unit", "left").select(group, id_col, F.coalesce("cluster", "unit").alias("cluster"))
    names = rows.select(F.col("k").alias("cluster"), F.col(id_col).alias("_name"))
    return own.join(names, "cluster").select(group, id_col, F.col("_name").alias("cluster"))
