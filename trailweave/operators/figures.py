"""Figures of a run: how often each operation ran, its rows, failed calls and time, gathered without a further pass."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
FIGURES = "operation string, n long, rows long, failed long, broken long, ms double"


@dataclass
class _Total:
    n: int = 0
    rows: int = 0
    failed: int = 0
    broken: int = 0
    ms: float = 0.0


class Figures:
    """Totals by operation; one row of them each, however many rows the operations had.

    ``clock`` gives seconds.  An operation is what one action computes; the counts are made by the tasks of that
    action as the rows pass, so a task that is run again after a lost executor may count its rows twice.
    """

    def __init__(self, clock: Callable[[], float] = time.perf_counter) -> None:
        self._clock = clock
        self._totals: dict[str, _Total] = {}

    def run(self, operation: str, df: DataFrame, action: Callable[[DataFrame], T], failed: Column | None = None) -> T:
        """The result of ``action`` on ``df``, which reads all of it once (a write, a checkpoint); null or false ``failed`` is no failure.

        An action that raises is counted as ``broken`` with its time, and raises on.
        """
        total = self._totals.setdefault(operation, _Total())
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))).alias("failed")]
        total.n += 1
        started = self._clock()
        try:
            result = action(df.observe(seen, *counts))
        except BaseException:
            total.broken += 1
            raise
        finally:
            total.ms += 1000 * (self._clock() - started)
        found = seen.get
        total.rows += found["rows"]
        total.failed += found["failed"]
        return result

    def table(self, spark: SparkSession) -> DataFrame:
        """(operation, n, rows, failed, broken, ms)."""
        return spark.createDataFrame([(name, t.n, t.rows, t.failed, t.broken, round(t.ms, 3)) for name, t in sorted(self._totals.items())], FIGURES)


def merged_figures(figures: DataFrame, *by: str) -> DataFrame:
    """Figures of several runs or parts of a run added up by operation, and by the columns ``by``."""
    return figures.groupBy(*by, "operation").agg(*(F.sum(c).alias(c) for c in ("n", "rows", "failed", "broken", "ms")))
