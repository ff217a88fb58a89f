"""Live logs with Structured Streaming: quiet gaps, late events, repeated errors, pages that settle, items seen first, ordered commits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def read_events(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """A stream of event files; a trigger takes ``files_per_trigger`` of them, so that a backlog is read in bounded steps."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def quiet_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes", by: str = "user_id") -> DataFrame:
    """(by, start, end, n, errors): events with no quiet period of ``gap`` between them.

    Works on a stream and on a table alike; events later than ``late`` are left out of a stream.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    sessions = rows.groupBy(by, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return sessions.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "errors")


def without_late(events: DataFrame, most: str = "3 seconds") -> DataFrame:
    """Answers that took longer than ``most`` are not waited for: (ts, done_ts) rows only within it."""
    return events.where(F.col("done_ts") <= F.col("ts") + F.expr(f"interval {most}"))


def first_errors(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each error of a user once within the watermark (drain and reset)."""
    errors = events.where(F.col("event_type") == "error")
    if not errors.isStreaming:
        return errors.groupBy("user_id", "props").agg(F.min("ts").alias("ts")).select("user_id", "props", "ts")
    return errors.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "props"]).select("user_id", "props", "ts")


def stabilized(observations: DataFrame, by: str = "page", order: str = "seq", fingerprint: str = "fp") -> DataFrame:
    """The first observation of each page that equals the one before it."""
    w = Window.partitionBy(by).orderBy(order)
    same = observations.withColumn("_same", F.col(fingerprint) == F.lag(fingerprint).over(w)).where("_same")
    return same.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_same", "_k")


def first_seen(observations: DataFrame, by: str = "page", order: str = "seq", items: str = "items", late: str | None = None) -> DataFrame:
    """(by, item, order): each item of a page's observations where it is seen first, over all levels.

    On a stream the state is one entry for each page and item, so no page's set is a row; with ``late``
    the column ``ts`` is the watermark's and an item is forgotten that long after it was seen.  A stream takes an item as it
    arrives, so observations come in order; of the items of one micro-batch any of several equal ones may count.
    """
    if not observations.isStreaming:
        rows = observations.select(by, order, F.explode(F.array_distinct(items)).alias("item")).where("item is not null")
        return rows.groupBy(by, "item").agg(F.min(order).alias(order))
    if late:
        rows = observations.withWatermark("ts", late).select("ts", by, order, F.explode(F.array_distinct(items)).alias("item")).where("item is not null")
        return rows.dropDuplicatesWithinWatermark([by, "item"]).select(by, "item", order)
    rows = observations.select(by, order, F.explode(F.array_distinct(items)).alias("item")).where("item is not null")
    return rows.dropDuplicates([by, "item"]).select(by, "item", order)


def settled(observations: DataFrame, failures: int = 3, forget_ms: int | None = None) -> DataFrame:
    """(page, seq, state) of each page once: ``stable`` where two observations in a row have one fingerprint, ``stopped`` at ``failures`` failed ones in a row.

    ``observations``: (page, seq, fp, failed).  What comes first settles the page; later ones are ignored.
    A failed observation, or one without a fingerprint, equals none.  A number that a page repeats counts once, with
    its least fingerprint.  On a stream a page has one small state (last number, fingerprint, failures in a row,
    whether it is settled), kept over restarts; observations of a page come in order over micro-batches, and
    earlier numbers than the last one are ignored.  ``forget_ms``: a page without news for so long starts anew.
    """
    kind = {f.name: f.dataType.simpleString() for f in observations.schema}
    rows = observations.select("page", "seq", "fp", F.coalesce("failed", F.lit(False)).alias("failed")).where("seq is not null")
    if observations.isStreaming:
        timeout = GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout
        return rows.groupBy("page").applyInPandasWithState(
            _settling(failures, forget_ms), f"page {kind['page']}, seq long, state string", "seq long, fp string, failures int, settled boolean", "append", timeout
        )
    once = rows.groupBy("page", "seq").agg(F.min(F.struct("failed", "fp")).alias("x")).select("page", "seq", "x.fp", "x.failed")
    w = Window.partitionBy("page").orderBy("seq")
    stable = ~F.col("failed") & ~F.lag("failed").over(w) & (F.col("fp") == F.lag("fp").over(w))
    # failed ones in a row: those since the last one that did not fail
    good = F.count_if(~F.col("failed")).over(w)
    marked = once.select("page", "seq", "failed", F.coalesce(stable, F.lit(False)).alias("stable"), good.alias("run"))
    row = F.count_if("failed").over(Window.partitionBy("page", "run").orderBy("seq"))
    states = marked.withColumn("state", F.when(F.col("stable"), "stable").when(F.col("failed") & (row == failures), "stopped")).where("state is not null")
    return states.groupBy("page").agg(F.min(F.struct("seq", "state")).alias("x")).select("page", F.col("x.seq").cast("long").alias("seq"), "x.state")


def _settling(failures: int, forget_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, fp, failed, done = state.get if state.exists else (None, None, 0, False)
        found = []
        # a settled page needs none of its rows; else they are those of one micro-batch
        news = pd.concat([x[["seq", "fp", "failed"]] for x in parts if not done] or [pd.DataFrame({"seq": [], "fp": [], "failed": []})])
        for seq, own, bad in news.sort_values(["seq", "failed", "fp"]).itertuples(index=False):
            if done or last is not None and seq <= last:
                continue
            own = None if bad or pd.isna(own) else own
            state_now = "stable" if own is not None and own == fp else "stopped" if bad and failed + 1 == failures else None
            last, fp, failed = int(seq), own, failed + 1 if bad else 0
            if state_now:
                found.append((*key, last, state_now))
                fp, done = None, True
        state.update((last, fp, failed, done))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(found, columns=["page", "seq", "state"])

    return step


def ordered_commits(results: DataFrame, target: str, checkpoint: str, seq: str = "seq", first: int = 0):
    """Starts a stream that commits results in the order of the plan, however late they come.

    ``seq`` numbers the planned results from ``first`` on without gaps.  A micro-batch commits what
    follows the last committed one without a gap, as ``target/committed/epoch=...``; what is beyond
    a gap is held back in ``target/held`` until the gap is filled.  Each batch reads what the one
    before it left and overwrites its own folders, so a batch that is run again commits nothing twice.
    """

    def commit(batch: DataFrame, epoch: int) -> None:
        spark, rows, due = batch.sparkSession, batch, first
        if epoch:
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/held/epoch={epoch - 1}"))
            due = spark.read.parquet(f"{target}/state/epoch={epoch - 1}").first()["due"]
        rows.where(F.col(seq) >= due).dropDuplicates([seq]).write.mode("overwrite").parquet(f"{target}/known/epoch={epoch}")
        known = spark.read.schema(batch.schema).parquet(f"{target}/known/epoch={epoch}")
        # the last one before a gap: the least number, from the one before the due one on, whose successor isn't there
        numbers = known.select(F.col(seq).cast("long").alias("n")).union(spark.range(due - 1, due).select("id"))
        last = numbers.join(known.select((F.col(seq).cast("long") - 1).alias("n")), "n", "left_anti").agg(F.min("n")).first()[0]
        known.where(F.col(seq) <= last).repartitionByRange(seq).sortWithinPartitions(seq).write.mode("overwrite").parquet(f"{target}/committed/epoch={epoch}")
        known.where(F.col(seq) > last).write.mode("overwrite").parquet(f"{target}/held/epoch={epoch}")
        spark.createDataFrame([(last + 1,)], "due long").write.mode("overwrite").parquet(f"{target}/state/epoch={epoch}")

    return results.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def relearned(events: DataFrame, recompute: Callable[[DataFrame], DataFrame], history: str, target: str, checkpoint: str):
    """Starts a stream whose result depends on all history: each batch is stored and the result is computed anew.

    Learning can take back what it said before, so each result is whole, in a folder of its own
    (``target/epoch=...``), and never replaces one that is being read; ``latest`` reads the last.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history}/epoch={epoch}")
        recompute(batch.sparkSession.read.parquet(history)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The last result that ``relearned`` wrote."""
    every = spark.read.parquet(target)
    return every.where(F.col("epoch") == every.agg(F.max("epoch")).first()[0]).drop("epoch")
