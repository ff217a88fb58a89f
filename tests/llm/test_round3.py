"""Results that must not hang on how large a table is or how often a row is repeated."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import toxicity
from trailweave.llm.pii import pii_report
from trailweave.llm.toxicity import fair_share, fit, spread, toxicity_score
from trailweave.session import table


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_texts_without_words_are_not_toxic_whatever_was_learned(spark, size):
    folder = f"/root/testdata/{size}"
    model = fit(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.3)
    bare = spark.createDataFrame([(None,), ("",), (" \n",), ("?! ...",)], "text string")
    assert [r.s for r in bare.select(toxicity_score(F.col("text"), model).alias("s")).collect()] == [0.0] * 4


def test_long_texts_are_learned_from_all_over():
    codes = np.arange(100_000)
    cut = spread(codes, 5000)
    assert len(cut) == 5000 and cut[0] == 0 and cut[-1] == 99_999 and (np.diff(cut) > 0).all()
    assert np.diff(cut).max() < 12_000
    assert (spread(codes[:4999], 5000) == codes[:4999]).all() and len(spread(codes, 3)) == 3


@pytest.mark.parametrize("lengths,most", [([], 10), ([5, 5, 5], 100), ([1, 2, 300], 100), ([7] * 30, 100), ([0, 0, 9], 4), ([3, 50, 50, 50], 60)])
def test_fair_share(lengths, most):
    share = fair_share(lengths, most)
    used = sum(min(n, share) for n in lengths)
    assert used <= max(most, len(lengths))
    assert share >= max(lengths, default=0) or sum(min(n, share + 1) for n in lengths) > most


@pytest.mark.parametrize("kwargs", [{}, {"part_bytes": 60_000}])
def test_rows_beyond_a_few_thousand_of_a_class_are_learned_from(spark, kwargs):
    ids = spark.range(8000).withColumnRenamed("id", "doc_id")
    labels = ids.withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    least = labels.where("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(2500).select("doc_id", F.lit("wretched").alias("word"))
    word = F.when(F.col("doc_id") % 2 == 0, "pleasant").otherwise(F.coalesce("word", F.lit("odious")))
    docs = ids.join(least, "doc_id", "left").select("doc_id", F.concat(F.lit("this is a "), word, F.lit(" one of "), F.col("doc_id") % 50).alias("text"))
    model = fit(docs, labels, **kwargs)
    said = spark.createDataFrame([(f"this is a {w} one of 7",) for w in ("wretched", "odious", "pleasant")], "text string")
    scores = [r.s for r in said.select(toxicity_score(F.col("text"), model).alias("s")).collect()]
    assert scores[0] > 0.5 and scores[1] > 0.5 and scores[2] < 0.1
    row = toxicity.buckets(toxicity.Encoder().of(b"odious"))[0][0]
    assert not np.array_equal(model.words[row], toxicity.Model.new(12, 8, 7).words[row])  # no row of the least hashes has it


def test_all_labelled_texts_are_whole_in_their_parts(spark):
    docs = spark.createDataFrame([(k, f"w{k} " * (k * 50)) for k in range(60)] + [(3, "again"), (None, "x"), (99, "no label"), (60, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(61)] + [(4, 1), (5, 7), (None, 1)], "doc_id int, toxic int")
    rows = toxicity.labelled_parts(docs, labels, F.lit(True), 4, "doc_id", "text", "toxic").collect()
    assert len(rows) == 61 and len({r.part for r in rows}) == 4 and sum(r.label for r in rows) == 31
    assert sorted(len(r.codes) // 4 for r in rows)[-50:] == [k * 50 for k in range(10, 60)]


def test_long_texts_are_learned_from_as_a_whole(monkeypatch):
    r = np.random.default_rng(1)
    m = toxicity.Model.new(4, 3, 5)
    codes, starts, stops = toxicity._joined([r.integers(1, 1 << 29, n) & 0xFFFF1FFF for n in (3, 0, 200, 41, 1)])
    y = np.array([0, 1, 1, 0, 1], np.float32)
    whole = toxicity.gradients(m, codes, starts, stops, y)
    for size in (1, 7, 64):
        monkeypatch.setattr(toxicity, "PIECE_WORDS", size)
        parts = toxicity.gradients(m, codes, starts, stops, y)
        assert (parts.rows == whole.rows).all() and np.allclose(parts.embedded, whole.embedded) and np.allclose(parts.out, whole.out)


def _terms(df) -> set[str]:
    return {r.spans for r in pii_report(df).collect() if r.doc_id == 100}


def test_repeated_rows_tell_as_much_as_copies_with_ids_of_their_own(documents):
    said = "Zebulonia wrote from qq@yy.example today"
    others = [(k, f"plain words of text {k} and more of them") for k in range(20)]
    same, own = ([_terms(documents(others + rows)) for rows in ([(100, said)] * n for n in (1, 2, 3, 50))], _terms(documents(others + [(100 + k, said) for k in range(3)])))
    assert own and "term" in next(iter(own))
    assert all(x == own for x in same)
