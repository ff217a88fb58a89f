"""Learning that takes back: signed links change counts, and only what crosses a threshold is learned, unlearned and keyed anew.

The counts are state in RocksDB of two operators of the stream, one of each value and one of each group of values.  Nothing is
summed over history again: a value that stays seen, or a group that stays on its side of the threshold, says nothing further.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trailweave.functions.urls import RouteOptions, origin
from trailweave.operators.learning import NAV_WORDS, learned_routes, signed_values

_GROUP = ["origin", "prefix", "i", "shape"]
_VALUE = [*_GROUP, "value"]
_GROUP_SCHEMA = "origin string, prefix string, i int, shape string"
CHANGES = "origin string, prefix string, sign long, epoch long"
#: The state store that operators with state of their own form need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of the pages by origin; those of origins that learned nothing aren't read.
BUCKETS = 256


def _summed(keys: list[str], counts: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of equal keys of an Arrow batch added up, so that a frequent key sends a row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(keys).aggregate([(c, "sum") for c in counts])
            yield from sums.select([*keys, *(f"{c}_sum" for c in counts)]).rename_columns([*keys, *counts]).to_batches()

    return run


class _Values(StatefulProcessor):
    """Says when a value, or its being outside navigation, begins or ends.  A value whose links are all taken back leaves no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._counts = handle.getValueState("counts", "n long, outside long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was_n, was_out = self._counts.get() or (0, 0)
        n, outside = was_n, was_out
        for part in rows:
            n, outside = n + int(part["n"].sum()), outside + int(part["outside"].sum())
        if n or outside:
            self._counts.update((n, outside))
        else:
            self._counts.clear()
        d_n = int(n > 0) - int(was_n > 0)
        d_out = int(n > 0 and outside > 0) - int(was_n > 0 and was_out > 0)
        if d_n or d_out:
            digits = d_n if any("0" <= c <= "9" for c in key[4]) else 0
            yield pd.DataFrame([(*key[:4], d_n, d_out, digits)], columns=[*_GROUP, "n", "outside", "digits"])

    def close(self) -> None:
        pass


class _Groups(StatefulProcessor):
    """Says when a group of values begins or ceases to be data."""

    def __init__(self, least: int) -> None:
        self._least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._counts = handle.getValueState("counts", "n long, outside long, digits long")

    def _is_data(self, n: int, outside: int, digits: int) -> bool:
        return n >= self._least and (outside > 0 or digits > 0 or n > NAV_WORDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self._counts.get() or (0, 0, 0)
        now = tuple(was)
        for part in rows:
            now = tuple(x + int(part[c].sum()) for x, c in zip(now, ("n", "outside", "digits")))
        if any(now):
            self._counts.update(now)
        else:
            self._counts.clear()
        sign = int(self._is_data(*now)) - int(self._is_data(*was))
        if sign:
            yield pd.DataFrame([(key[0], key[1], sign)], columns=["origin", "prefix", "sign"])

    def close(self) -> None:
        pass


def learned_changes(links: DataFrame, least: int = 3, options: RouteOptions = RouteOptions()) -> DataFrame:
    """(origin, prefix, sign) of a stream of links (target, in_nav, sign): +1 for each group of values below a prefix that becomes data, -1 where it ceases to be.

    A prefix is learned while its signs add up to more than 0: after each micro-batch these are the prefixes that
    ``learned_of_signed`` finds in all links so far.  Links of a micro-batch count together, in any order, and a
    link may be taken back before it is seen.  A value that half of the rows have is added up before its state sees it.
    """
    if "RocksDB" not in links.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        raise RuntimeError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}: these operators' state is kept there")
    values = signed_values(links, options).mapInArrow(_summed(_VALUE, ["n", "outside"]), f"{_GROUP_SCHEMA}, value string, n long, outside long")
    counts = values.groupBy(*_VALUE).transformWithStateInPandas(_Values(), f"{_GROUP_SCHEMA}, n long, outside long, digits long", "append", "none")
    counts = counts.mapInArrow(_summed(_GROUP, ["n", "outside", "digits"]), f"{_GROUP_SCHEMA}, n long, outside long, digits long")
    return counts.groupBy(*_GROUP).transformWithStateInPandas(_Groups(least), "origin string, prefix string, sign long", "append", "none")


def learned_now(changes: DataFrame) -> DataFrame:
    """(origin, prefix) that are learned after all ``changes`` (origin, prefix, sign)."""
    return changes.groupBy("origin", "prefix").agg(F.sum("sign").alias("sign")).where("sign > 0").select("origin", "prefix")


def _bucket(of: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(buckets)).cast("int")


def write_pages(pages: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Writes pages (page_id, url) in parts by origin, so that ``relearning`` reads those of the origins that changed.  A large origin is many files."""
    rows = pages.select("page_id", "url").withColumn("bucket", _bucket(F.coalesce(origin(F.col("url")), F.lit("")), buckets))
    rows.repartition("bucket", F.pmod(F.xxhash64("page_id"), F.lit(8))).write.partitionBy("bucket").parquet(folder)


def relearning(changes: DataFrame, pages_folder: str, target: str, checkpoint: str, buckets: int = BUCKETS, options: RouteOptions = RouteOptions()):
    """Starts a stream that keeps the changes of ``learned_changes`` and keys pages anew whose route they change.

    Each micro-batch writes its changes below ``target/changes`` and, below ``target/routes``, (page_id, route) of the
    pages whose route is another than before; a batch that is run again replaces its own.  Pages are read only from
    the parts (``write_pages``) of origins of which a prefix was learned or unlearned.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        own = batch.groupBy("origin", "prefix").agg(F.sum("sign").alias("sign")).where("sign <> 0")
        own.write.mode("overwrite").parquet(f"{target}/changes/epoch={epoch}")
        every = spark.read.schema(CHANGES).parquet(f"{target}/changes")
        own = every.where(F.col("epoch") == epoch)
        # of these origins only; the log has a row for each prefix that changed, however many links there were
        known = every.where(F.col("epoch") <= epoch).join(own.select("origin").distinct(), "origin", "left_semi")
        state = known.groupBy("origin", "prefix").agg(F.coalesce(F.sum(F.when(F.col("epoch") < epoch, F.col("sign"))), F.lit(0)).alias("was"), F.sum("sign").alias("now"))
        turned = state.where((F.col("was") > 0) != (F.col("now") > 0)).select("origin").distinct()
        touched = [r["b"] for r in turned.select(_bucket(F.col("origin"), buckets).alias("b")).distinct().collect()]  # as many as there are parts
        pages = spark.read.schema("page_id long, url string, bucket int").parquet(pages_folder).where(F.col("bucket").isin(touched)).select("page_id", "url")
        before = learned_routes(pages, state.where("was > 0"), options).select("page_id", "url", F.col("route").alias("old"))
        after = learned_routes(before, state.where("now > 0"), options)
        # an origin of these parts that changed nothing has no prefix on either side, so its pages are equal and stay
        after.where(~F.col("route").eqNullSafe(F.col("old"))).select("page_id", "route").write.mode("overwrite").parquet(f"{target}/routes/epoch={epoch}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def routes_now(spark: SparkSession, target: str, first: DataFrame) -> DataFrame:
    """(page_id, route): the newest route of each page; ``first`` (page_id, route) has those before anything was learned."""
    later = spark.read.schema("page_id long, route string, epoch long").parquet(f"{target}/routes")
    rows = first.select("page_id", "route", F.lit(-1).cast("long").alias("epoch")).unionByName(later)
    return rows.groupBy("page_id").agg(F.max(F.struct("epoch", "route")).alias("x")).select("page_id", "x.route")
