"""Figures of a run: rows, failed calls and time by operation, and their place in a run's document."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.test_crawl import as_tables, made_up_site
from trailweave.operators import answers, crawl
from trailweave.operators.figures import FIGURES, Figures, merged_figures
from trailweave.session import checkpoint
from trailweave.sources import runs


def ticking():
    now = [0.0]

    def clock():
        now[0] += 0.25
        return now[0]

    return clock


def totals(gathered, spark):
    return {r.operation: (r.n, r.rows, r.failed, r.broken, r.ms) for r in gathered.table(spark).collect()}


def test_calls_that_fail_are_counted_as_they_pass(spark, tmp_path):
    gathered = Figures(ticking())
    asked = spark.createDataFrame([(k, f"q{k % 5}") for k in range(15)], "id int, q string").repartition(3)
    cached = asked.where("false").select(F.lit("").alias("digest"), F.lit(0.0).alias("answer"))

    def judge(row):
        if row["q"] in ("q1", "q2"):
            raise RuntimeError("no answer")
        return 0.5

    for k in range(2):
        got = answers.ask_all(asked, cached, judge, "q")
        gathered.run("ask", got, lambda df, k=k: df.write.parquet(str(tmp_path / f"out{k}")), F.col("answer").isNull())
    kept = gathered.run("keep", asked, checkpoint, F.lit(None).cast("boolean"))
    assert kept.count() == 15
    assert gathered.run("none", asked.where("id < 0"), lambda df: df.collect()) == []
    broken = asked.select(F.raise_error(F.lit("out of reach")).alias("x"))
    with pytest.raises(Exception, match="out of reach"):
        gathered.run("ask", broken, lambda df: df.collect())
    # the broken action's rows don't count, its time does
    assert totals(gathered, spark) == {"ask": (3, 30, 12, 1, 750.0), "keep": (1, 15, 0, 0, 250.0), "none": (1, 0, 0, 0, 250.0)}
    assert spark.read.parquet(str(tmp_path / "out1")).where("answer is null").count() == 6
    assert Figures().table(spark).count() == 0


def test_figures_are_part_of_a_run_and_read_again(spark, tmp_path):
    rows = [("r1", "ask", 2, 30, 12, 0, 1.5), ("r1", "ask", 1, 5, 0, 1, 2.0), ("r1", "plan", 1, 1, 0, 0, 0.25), ("r2", "ask", 1, 0, 0, 0, 3.0)]
    own = spark.createDataFrame(rows, f"run string, {FIGURES}")
    node = "run string, pos int, id string, signature string, url string, route string, title string, depth int, text_hash string, console_errors array<string>, failed_requests array<string>, alias_signatures array<string>"
    nodes = spark.createDataFrame([(r, 0, "s", "A", "http://x/", "/", None, 0, None, [], [], []) for r in ("r1", "r2", "r3")], node)
    edges = spark.createDataFrame([], "run string, edge_pos int, src string, dst string, role string, label string, href string, error string, inferred boolean")
    meta = spark.createDataFrame([(r, "s", "http://x/", None, {}) for r in ("r1", "r2", "r3")], "run string, root string, base_url string, stop_kind string, config map<string,string>")
    folder = str(tmp_path / "runs")
    runs.write_runs(runs.run_documents(nodes, edges, meta, figures=own), folder)
    found = runs.timings(runs.read_runs(spark, folder)).select("run", "operation", "n", "rows", "failed", "broken", "ms")
    want = {("r1", "ask", 3, 35, 12, 1, 3.5), ("r1", "plan", 1, 1, 0, 0, 0.25), ("r2", "ask", 1, 0, 0, 0, 3.0)}
    assert {tuple(r) for r in found.collect()} == want
    assert {tuple(r) for r in merged_figures(own, "run").select(*found.columns).collect()} == want


def test_an_exploration_counts_what_each_phase_performed(spark, tmp_path):
    views = made_up_site(3)
    random.seed(3)
    root = spark.createDataFrame([("/p0", "/p0", views["/p0"][1])], "signature string, route string, lines array<string>")
    gathered = Figures()
    found = crawl.crawl(root, as_tables(spark, views), str(tmp_path / "c"), crawl.Limits(max_depth=2), figures=gathered)
    per_phase = {r.phase: (r.n, r.bad) for r in found["attempts"].groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.col("fate") == "error").alias("bad")).collect()}
    got = totals(gathered, spark)
    assert {f"perform {p}": x for p, x in per_phase.items()} == {k: x[1:3] for k, x in got.items() if x[1]} and all(x[4] > 0 for x in got.values())
