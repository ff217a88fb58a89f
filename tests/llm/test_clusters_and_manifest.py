"""Ball k-means and the Merkle manifest against plain loops."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import queries
from trailweave.llm.ball_kmeans import ball_kmeans, clustered, most_component, nearest, reassigned
from trailweave.llm.manifest import audited, folded, read_proofs, write_manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def plain_kmeans(rows: list[tuple], k: int, rounds: int, dims: int) -> list[tuple]:
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))
    c = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min(range(len(c)), key=lambda j: (dist(v, c[j]), j)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            m = [v for (_, v), o in zip(kept, own) if o == j]
            if m:
                c[j] = [sum(col) // len(m) for col in zip(*m)]
    own = assign()
    d = [dist(v, c[o]) for (_, v), o in zip(kept, own)]
    by = [sum(x for x, o in zip(d, own) if o == j) for j in range(len(c))]
    return sorted(((i, o, x, by[o], sum(d), sha(",".join(map(str, c[o])))) for (i, _), o, x in zip(kept, own, d)), key=repr)


@pytest.fixture(scope="module")
def embeddings(spark):
    def make(rows):
        full = [(i, v, 1, 2, 3) for i, v in rows]
        return spark.createDataFrame(full, "vec_id long, embedding array<float>, cluster int, distance int, label int").repartition(3)

    return make


def test_clusters_same_as_plain_loops(embeddings):
    rng = np.random.default_rng(3)
    grid = rng.integers(-3, 4, (150, 4)) / 4  # many ties and equal vectors
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(grid)]
    rows += rows[:10] + [(None, [0.5] * 4), (None, [0.25] * 4), (900, None), (901, []), (902, [1.0] * 3), (903, [None, 1.0, 1.0, 1.0]), (904, [math.nan] * 4), (905, [math.inf, 0.0, 0.0, 0.0])]
    got = sorted((tuple(r) for r in clustered(embeddings(rows), k=5, rounds=4, dims=4).collect()), key=repr)
    assert got == plain_kmeans(rows, 5, 4, 4)


def test_few_or_no_vectors(embeddings):
    assert clustered(embeddings([]), dims=4).collect() == []
    assert clustered(embeddings([(1, None)]), dims=4).collect() == []
    rows = [(1, [0.5] * 4), (2, [-0.5] * 4)]
    assert sorted((tuple(r) for r in clustered(embeddings(rows), dims=4).collect()), key=repr) == plain_kmeans(rows, 8, 10, 4)


def test_an_empty_cluster_keeps_its_centroid(spark):
    v = spark.createDataFrame([(k, [k % 3, 0]) for k in range(30)], "id long, v array<long>")
    got = ball_kmeans(v, [[0, 0], [1, 0], [500, 500]], 3)
    assert got.centroids[2] == [500, 500] and got.inertia[2] == 0


def test_balls_skip_only_what_is_farther():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-1000, 1000, (12, 8))
    x = np.concatenate([c + rng.integers(-60, 60, (300, 8)) for c in centroids])
    x = np.concatenate([x, (centroids[:-1] + centroids[1:]) // 2])  # between two centroids
    own = rng.integers(0, 12, len(x))
    own[: 12 * 300] = np.where(rng.random(3600) < 0.9, np.repeat(np.arange(12), 300), own[:3600])
    best, least, compared = reassigned(x, own, centroids)
    want, far = nearest(x, centroids)
    assert (best == want).all() and (least == far).all()
    assert compared < len(x) * 11 / 4


def test_exact_up_to_the_limit_and_an_error_beyond(spark):
    big = most_component(2) - 1
    v = spark.createDataFrame([(0, [big, big]), (1, [-big, -big])], "id long, v array<long>")
    got = ball_kmeans(v, [[-big, -big]], 1).members.collect()
    assert all(r["distance"] == 2 * big**2 for r in got) or {r["distance"] for r in got} <= {2 * big**2, 2 * (big + 1) ** 2}
    with pytest.raises(ValueError):
        ball_kmeans(spark.createDataFrame([(0, [big + 1, 0])], "id long, v array<long>"), [[0, 0]], 1)


def plain_tree(leaves: list[str]) -> tuple[str, list[list[str]]]:
    """Root and, for each leaf, the digests beside its path."""
    nodes, at, beside = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for k, a in enumerate(at):
            beside[k] += [(x, y) for x, y in [(nodes[a // 3 * 3 : a], nodes[a + 1 : a // 3 * 3 + 3])]]
            at[k] = a // 3
        nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], beside


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((members, *plain_tree([leaf(r) for r in members])))
    root, above = plain_tree([t[1] for t in trees])
    out = []
    for (members, subroot, beside), up in zip(trees, above):
        for r, path in zip(members, beside):
            full = path + up
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            at = leaf((*r[:4], r[4].replace("\n", ""))) if cut else leaf(r)
            for a, b in full:
                at = sha("".join([*a, at, *b]))
            out.append((r[0], leaf(r), subroot, root, sha("".join("".join(a + b) for a, b in full)), at, at == root))
    return sorted(out, key=repr)


def table_of(spark, rows):
    full = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(full, "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int").repartition(3)


def test_manifest_same_as_plain_loops(spark, tmp_path):
    rows = [(k, f"s{k % 3}" if k % 7 else "one", "en", k, f"text {k}\n{k}") for k in range(100)]
    rows += [(200, None, None, None, None), (None, "s1", "en", 1, "a\nb"), (None, "s1", "de", 1, ""), (201, "", "é", 2, "ü\n"), (5, "s1", "en", 1, "twice\n"), (5, "s1", "en", 1, "twice\n"), (202, "lone", "en", 9, "x" * 3_000_000 + "\n")]
    folder = str(tmp_path / "m")
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = sorted((tuple(r) for r in audited(table_of(spark, rows), folder, COLUMNS, {"text": cut}).collect()), key=repr)
    assert got == plain_manifest(rows)
    # the store stays and can be asked again
    proofs = read_proofs(spark, folder)
    assert proofs.count() == len(rows) and proofs.where(folded(F.col("leaf"), F.col("path")) != F.lower(F.hex("root"))).isEmpty()


@pytest.mark.parametrize("n", [1, 4, 10])
def test_trees_of_all_shapes(spark, tmp_path, n):
    rows = [(k, "s" if k % 4 else f"t{k}", "en", k, "a\nb") for k in range(n)]
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = sorted((tuple(r) for r in audited(table_of(spark, rows), str(tmp_path / "m"), COLUMNS, {"text": cut}).collect()), key=repr)
    assert got == plain_manifest(rows)


def test_an_empty_table_has_no_root(spark, tmp_path):
    none = table_of(spark, [(1, "s", "en", 1, "t")]).where("false")
    assert write_manifest(none, str(tmp_path / "a"), COLUMNS) is None
    assert audited(none, str(tmp_path / "b"), COLUMNS, {}).collect() == []


def test_many_files_of_a_level_in_any_order(spark, tmp_path):
    """Levels whose runs are a few nodes each: rows are completed from fragments."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = [(k, "s", "en", k, "a\nb") for k in range(60)]
        got = sorted((tuple(r) for r in audited(table_of(spark, rows), str(tmp_path / "m"), COLUMNS, {}).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert [r[:5] for r in got] == [r[:5] for r in plain_manifest(rows)] and all(r[6] for r in got)


def test_queries_are_registered():
    assert {"op11_substring_dedup", "op12_centroid_clustering", "op13_merkle_manifest"} <= set(queries.queries()) & set(queries.oracle_sql())
