"""Answers kept over writers and compactions, and calls that fail."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trailweave.operators import answers

DAY = dt.datetime(2024, 1, 1)


def rows_of(spark, rows):
    return spark.createDataFrame([(d, a, DAY + dt.timedelta(hours=h)) for d, a, h in rows], answers.ANSWERS)


def found(spark, folder):
    return {r.digest: r.answer for r in answers.read_answers(spark, folder).collect()}


def test_two_writers_lose_nothing_and_the_newest_counts(spark, tmp_path):
    folder = str(tmp_path / "cache")
    assert found(spark, folder) == {} and answers.compact_answers(spark, folder) is None
    answers.save_answers(rows_of(spark, [("a", 0.1, 1), ("b", 0.2, 5), ("n", None, 1), (None, 1.0, 1)]), folder)
    answers.save_answers(rows_of(spark, [("a", 0.9, 2), ("b", 0.8, 4), ("c", 0.5, 1), ("c", 0.6, 1)]), folder)
    want = {"a": 0.9, "b": 0.2, "c": 0.6}
    assert found(spark, folder) == want
    (tmp_path / "cache" / "_new-part-x" / "answers").mkdir(parents=True)  # what a stopped writer left
    name = answers.compact_answers(spark, folder)
    assert found(spark, folder) == want and answers._parts(spark, folder) == [name]
    answers.save_answers(rows_of(spark, [("d", 0.3, 1)]), folder)
    assert found(spark, folder) == want | {"d": 0.3}


def test_a_compaction_that_stops_after_its_rename_hides_what_it_replaced(spark, tmp_path):
    folder = str(tmp_path / "cache")
    old = [answers.save_answers(rows_of(spark, [("a", x, h)]), folder) for x, h in ((0.1, 1), (0.2, 2))]
    answers._add(rows_of(spark, [("a", 0.2, 2)]), folder, old)
    assert len(answers._parts(spark, folder)) == 1 and found(spark, folder) == {"a": 0.2}


def test_failed_calls_are_nulls_that_are_counted(spark):
    asked = spark.createDataFrame([(k, f"q{k % 4}") for k in range(12)], "id int, q string")
    cached = asked.where("q = 'q0'").select(F.sha1(F.to_json(F.struct("q")).cast("binary")).alias("digest"), F.lit(0.75).alias("answer")).distinct()

    def judge(row):
        if row["q"] == "q1":
            raise RuntimeError("no answer\nat all")
        return int(row["q"][1:]) / 10

    got = answers.ask_all(asked, cached, judge, "q").cache()
    assert {(r.q, r.answer, r.cached, r.error) for r in got.collect()} == {("q0", 0.75, True, None), ("q1", None, False, "no answer"), ("q2", 0.2, False, None), ("q3", 0.3, False, None)}
    assert got.count() == 12 and tuple(answers.call_figures(got).first()) == (12, 4, 1, 3, 1, "no answer")
    assert tuple(answers.call_figures(got.where("false")).first()) == (0, 0, 0, 0, 0, None)
