"""The pipeline's stages, each on what the one before it kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trailweave.session import table

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows after each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns_of_documents(spark, kept):
    columns = table(spark, SF, "documents").columns
    assert [sorted(x.columns) == sorted(columns) for x in kept] == [True] * 4 + [False]
    counts = [x.count() for x in kept]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0


def test_toxic_documents_go(spark):
    folder = "/root/testdata/sf0.1"  # smaller tables have too few toxic rows to learn from
    labels = table(spark, folder, "labels").where("toxic is not null")
    kept = pipeline.toxicity(spark, table(spark, folder, "documents"), folder)
    left = {r.toxic: r["count"] for r in labels.join(kept.select("doc_id"), "doc_id", "left_semi").groupBy("toxic").count().collect()}
    total = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    assert left.get(1, 0) <= 0.1 * total[1] and left[0] >= 0.97 * total[0]


def shingles(text: str) -> set:
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_near_copies_meet_in_one_document(kept):
    before = {r.doc_id: shingles(r.text) for r in kept[0].collect()}
    stay = {r.doc_id for r in kept[1].collect()}
    ids = sorted(before)
    alike = lambda a, b: len(before[a] & before[b]) >= 0.8 * len(before[a] | before[b])
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(before[a]) >= 20 and len(before[b]) >= 20 and alike(a, b)]
    missed = [p for p in pairs if set(p) <= stay]
    assert pairs and len(missed) <= 0.05 * len(pairs)
    gone = [x for x in ids if x not in stay and len(before[x]) >= 20]
    # what went had a near copy, at half of the shingles or more, that is older than itself
    alone = [x for x in gone if not any(len(before[x] & before[y]) >= 0.5 * len(before[x] | before[y]) for y in ids if y < x)]
    assert len(alone) <= 0.02 * len(gone)


def test_groups_are_those_of_all_pairs_of_similarity(spark):
    from trailweave.llm.near_copies import similar_groups
    from trailweave.llm.simhash import features, least_ids

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sets = {r.doc_id: frozenset(features((r.text or "").encode(), 5)) for r in docs.collect()}
    ids, up = sorted(sets), {}

    def root(x):
        while x in up:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, t = sets[a], sets[b]
            if 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) and 5 * len(s & t) >= 4 * len(s | t) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert len(up) > 20
    assert {r.doc_id: r.component_id for r in least_ids(similar_groups(docs)).collect()} == {x: root(x) for x in ids}
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == [x for x in ids if root(x) == x]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(3, long), (5, long + " end"), (5, "of its own"), (5, "of its own"), (None, long), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("x")).withColumn("group", F.lit("y"))
    kept = pipeline.near_dedup(spark, docs, "")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(3, long, "x", "y"), (5, "of its own", "x", "y"), (None, long, "x", "y"), (7, None, "x", "y")], key=str)


def test_stages_take_empty_tables_and_null_texts(spark):
    some = table(spark, SF, "documents").limit(3)
    nulls = some.withColumn("text", F.lit(None).cast("string"))
    for name, stage in pipeline.STAGES:
        assert stage(spark, some.where("false"), SF).count() == 0
        n = stage(spark, nulls, SF).count()
        assert n == 1 if name == "near_dedup" else n == 3, name


def test_no_benchmark_passage_is_left(spark, kept):
    from trailweave.llm.decontaminate import contamination

    found = contamination(kept[2], table(spark, SF, "benchmark"))
    assert found.where("size(hits) > 0").count() == 0 and kept[1].count() > kept[2].count()


def test_no_pattern_is_left_and_clean_texts_stay(kept):
    from trailweave.llm.pii import base_spans, keyed

    assert base_spans(keyed(kept[3], "doc_id", "text")).count() == 0
    same = kept[2].join(kept[3].withColumnRenamed("text", "t"), "doc_id").where("text <=> t").count()
    assert 0 < same < kept[2].count()
    assert kept[3].where("n_chars <> length(coalesce(text, ''))").count() == 0


def test_the_run_is_its_stages(spark, kept):
    order = ["doc_id", "piece"]
    assert [tuple(r)[:5] for r in pipeline.run(spark, SF).orderBy(*order).collect()] == [tuple(r)[:5] for r in kept[4].orderBy(*order).collect()]
