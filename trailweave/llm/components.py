"""Connected components as a DataFrame loop of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.session import checkpoint


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component is its smallest node.

    Alternating large-star and small-star steps: each only groups by a node for the minimum and
    joins it back, so that no neighbourhood is ever gathered in a task, and the number of rounds
    grows with the logarithm of the longest path.  Each round is written to the shared
    checkpoint folder.  Self-links and repeated links are ignored, and so are links with a null
    end.  An empty table of links gives an empty result.  More than ``rounds`` rounds raise an error rather than return
    unfinished components.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs, before = checkpoint(pairs), None
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of a node are linked to the smallest of its neighbourhood
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = checkpoint(small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        # a fixpoint is a forest of stars: the pairs stay the same, as their number and two hashes of their set tell
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components need more than {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
