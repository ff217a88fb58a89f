"""Exact k-means by balls: only the centroids that can be nearer to a vector are compared with it.

A cluster is a ball: its centroid and the distance of its farthest member.  Another centroid is a
neighbour if half its distance reaches into the ball.  A member nearer to its centroid than half the way to
the nearest neighbour is in the stable core and stays.  The rest of the ball is cut into rings by the
half distances of the neighbours; a member of the m-th ring is compared with the m nearest neighbours.

All is done on integers, so that every skipped comparison is proven: with squared distance d to its
own centroid and D between the centroids, 4 d < D means that the other one is farther.  Results
are those of comparing every vector with every centroid.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.blocks import staged


@dataclass(frozen=True)
class Clustering:
    """Members (id, cluster, distance), and by cluster the final centroid and the sum of its distances."""

    members: DataFrame
    centroids: list[list[int]]
    inertia: list[int]

    @property
    def sha256(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def grid(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component; null unless there are ``dims``, none null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when((F.size(vector) == dims) & fine, F.transform(x, lambda v: F.floor(v * scale)))


def most_component(dims: int) -> int:
    """Components below this in size have squared distances that stay exact, four times over, in 64 bits."""
    return math.isqrt((1 << 62) // (4 * dims)) // 2


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, the smaller number if there are several, and its squared distance."""
    best, least = np.zeros(len(x), np.int64), _squared(x, centroids[0])
    for j in range(1, len(centroids)):
        d = _squared(x, centroids[j])
        better = d < least
        best[better], least[better] = j, d[better]
    return best, least


def reassigned(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``nearest``, knowing each row's former cluster; also how many distances to other centroids were computed.

    A ball is that of the rows given, which is within the ball of the whole cluster: its neighbours are enough for them.
    """
    between = np.stack([_squared(centroids, c) for c in centroids])
    least = _squared(x, centroids[own])
    best, compared = own.copy(), 0
    for c in np.unique(own):
        members = np.flatnonzero(own == c)
        reach = 4 * least[members]
        near = np.flatnonzero(between[c] <= reach.max())
        near = near[near != c]
        near = near[np.argsort(between[c][near], kind="stable")]
        # how many neighbours a member's ring is compared with: none in the stable core
        ring = np.searchsorted(between[c][near], reach, side="right")
        for m, j in enumerate(near):
            outer = members[ring > m]
            d = _squared(x[outer], centroids[j])
            compared += len(outer)
            better = (d < least[outer]) | ((d == least[outer]) & (j < best[outer]))
            best[outer[better]], least[outer[better]] = j, d[better]
    return best, least, compared


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _matrix(batch.column("v"), centroids.shape[1]), batch.column("cluster").to_numpy().astype(np.int64)
            best, least = nearest(x, centroids) if own[0] < 0 else reassigned(x, own, centroids)[:2]
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array(best.astype(np.int32)), pa.array(least)], ["id", "v", "cluster", "distance"])

    return run


def _sums(k: int, dims: int):
    """One row (cluster, n, sums) for each cluster and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            own, x = batch.column("cluster").to_numpy(), _matrix(batch.column("v"), dims)
            n += np.bincount(own, minlength=k)
            for c in np.unique(own):
                total[c] += x[own == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def ball_kmeans(vectors: DataFrame, first: list[list[int]], rounds: int) -> Clustering:
    """Clusters of ``vectors`` (id, v: array of integers, none null) after ``rounds`` rounds from the centroids ``first``.

    In a round each vector goes to its nearest centroid (the smaller number of several); then each
    centroid with members becomes the exact floor of their mean, and one without stays.  At the end vectors are
    assigned once more.  Rounds that would change nothing are left out.  The driver holds k centroids and,
    each round, k sums.  A round is one pass: what it assigns is kept on the executors' disks
    for the next, and a lost executor's share is computed again from the vectors, which are a written table.
    """
    dims, spark = len(first[0]) if first else 0, vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()
    if not first:
        none = spark.createDataFrame([], f"id {kind}, cluster int, distance long")
        return Clustering(none, [], [])
    table, _ = staged(vectors.select("id", F.col("v").cast("array<long>").alias("v")))
    limit = most_component(dims)
    worst = table.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0]
    if worst is not None and worst >= limit:
        raise ValueError(f"components of {dims} dimensions must be below {limit} in size, for exact distances; one is {worst}")
    schema = f"id {kind}, v array<long>, cluster int, distance long"
    state = table.withColumn("cluster", F.lit(-1)).withColumn("distance", F.lit(0).cast("long"))
    centroids, kept = [list(c) for c in first], []
    for step in range(rounds + 1):
        state = state.mapInArrow(_assigned(np.array(centroids, np.int64)), schema).persist(StorageLevel.DISK_ONLY)
        kept.append(state)
        if step == rounds:
            break
        part = state.mapInArrow(_sums(len(centroids), dims), "cluster int, n long, sums array<long>")
        part = part.select("cluster", "n", F.posexplode("sums").alias("p", "s"))
        found = part.groupBy("cluster", "p").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        new = [list(c) for c in centroids]
        for r in found:
            new[r["cluster"]][r["p"]] = int(r["s"]) // int(r["n"])
        for old in kept[:-1]:
            old.unpersist()
        kept = kept[-1:]
        if new == centroids:
            break
        centroids = new
    members, _ = staged(state.select("id", "cluster", "distance"))
    for old in kept:
        old.unpersist()
    sums = {r["cluster"]: int(r["s"]) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    return Clustering(members, centroids, [sums.get(c, 0) for c in range(len(centroids))])


def first_by_hash(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors (id, v) with the smallest sha256 of ``seed``:id, in this order; equal hashes by components, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()]


def clustered(
    embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that can be clustered.

    Vectors that are null, of another length than ``dims``, or have a null or not finite component have no
    row; all others have one, also repeated rows and those with a null id.  With fewer than ``k``
    vectors there are as many clusters; with none, no rows.  Other columns are ignored.
    Components must be below ``most_component`` in size, or it is an error.
    """
    kept = embeddings.select(F.col(id_col).alias("id"), grid(F.col(vector_col), dims, scale).alias("v")).where("v is not null")
    kept, _ = staged(kept)
    result = ball_kmeans(kept, first_by_hash(kept, k, seed), rounds)
    rows = [(c, result.inertia[c], result.sha256[c]) for c in range(len(result.centroids))]
    by = embeddings.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    found = result.members.join(F.broadcast(by), "cluster")
    total = F.lit(sum(result.inertia)).cast("long")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")
