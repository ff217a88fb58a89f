"""A Merkle manifest of a dataset, kept as a node store in Parquet.

Every row is a leaf.  Leaves are sorted into runs; a level of the store is written by one sequential
scan of the level below: three consecutive nodes are one row of ``level=k``, with their digests, and
the digest of these is a node of the next level.  A scan only sees its own run, so the first
and last nodes of a run may be part of a row that another run completes.  Such fragments, a few
per run whatever its length, are the only rows that are grouped by key.  Whether a row is whole is
read from coordinates and counts, so nothing depends on how files are dealt to tasks.

Proofs go down the levels again: each level is merged, by coordinate, with the proofs of the nodes
above it.  A proof is shuffled once for three leaves, and no group of rows is ever gathered.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm.blocks import staged
from trailweave.session import checkpoint, drop_folder, join_checked

FANOUT = 3
#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
_ROW_BITS = 33


def canonical(*values: Column) -> Column:
    """Values as text: ``-`` for null, else UTF-8 byte count, ``:`` and value, one after the other."""
    parts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in parts))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def _join_hex(digests: Column) -> Column:
    return F.array_join(F.transform(digests, hex_text), "")


def in_order(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its place ``name`` (from 0) in the order of ``keys``, and the folders it is read from.

    It is written in sorted runs.  A place is that in the run and the rows of the runs before, of
    which the driver gets one number a run.
    """
    first, unsorted = staged(df)  # so that drawing the borders of the runs doesn't compute df again
    runs, path = staged(first.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    drop_folder(df.sparkSession, unsorted)
    run = F.shiftright("at", _ROW_BITS)
    sizes = sorted((r["run"], r["count"]) for r in runs.groupBy(run.alias("run")).count().collect())
    before = itertools.accumulate((n for _, n in sizes), initial=0)
    starts = df.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(sizes, before)], "run long, before long")
    placed = runs.withColumn("run", run).join(F.broadcast(starts), "run")
    return placed.withColumn(name, F.col("before") + F.col("at").bitwiseAND((1 << _ROW_BITS) - 1)).drop("run", "before", "at"), [path]


def _rows_of(kids: list[str]):
    """Consecutive nodes (tree, i, n, and the columns ``kids``) as rows of up to three."""

    def grouped(batch: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        tree, i = (batch.column(c).to_numpy() for c in ("tree", "i"))
        j = i // FANOUT
        new = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (j[1:] != j[:-1]) | (i[1:] != i[:-1] + 1)])
        if not last:  # the last row may go on in the next batch
            new, stop = new[:-1], int(new[-1])
        else:
            stop = len(i)
        rest = batch.slice(stop)
        if not len(new):
            return None, rest
        size = np.diff(np.r_[new, stop])
        n = batch.column("n").to_numpy()[new]
        whole = size == np.minimum(FANOUT, n - FANOUT * j[new])
        columns = [batch.column(c).slice(0, stop).combine_chunks() for c in kids]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[new, stop].astype(np.int32)), pa.StructArray.from_arrays(columns, kids))
        arrays = [pa.array(x) for x in (tree[new], j[new], n, i[new], whole)]
        return pa.record_batch([*arrays, lists], ["tree", "j", "n", "first", "whole", "kids"]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, rows]) if rest is not None and len(rest) else rows
            if len(rest):
                out, rest = grouped(rest, last=False)
                if out is not None:
                    yield out
        if rest is not None and len(rest):
            yield grouped(rest, last=True)[0]

    return run


def _level(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """(tree, j, n, kids) of level ``k`` of a store: each row has the nodes 3j, 3j + 1, ... of that level."""
    scan, border = (spark.read.parquet(f"{folder}/level={k}/part={part}") for part in ("scan", "border"))
    columns = ["tree", "j", "n", "kids"]
    return scan.where("whole").select(*columns).unionByName(border.select(*columns))


def _parents(rows: DataFrame) -> DataFrame:
    """The nodes (tree, i, n, digest) of the next level; ``n`` is how many the tree has there."""
    above = F.ceil(F.col("n") / FANOUT).cast("long")
    return rows.where("n > 1").select("tree", F.col("j").alias("i"), above.alias("n"), digest(_join_hex(F.col("kids.digest"))).alias("digest"))


def _write_levels(leaves: DataFrame, folder: str) -> int:
    """Writes the levels over ``leaves`` (tree, i, n, digest, ...) and gives their number; each reads the one below."""
    spark, nodes, k = leaves.sparkSession, leaves, 0
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        kids = [c for c in nodes.columns if c not in ("tree", "i", "n")]
        fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in nodes.schema if f.name in kids)
        scan = nodes.mapInArrow(_rows_of(kids), f"tree long, j long, n long, first long, whole boolean, kids array<struct<{fields}>>")
        scan.write.parquet(f"{folder}/level={k}/part=scan")
        found = spark.read.parquet(f"{folder}/level={k}/part=scan").where("not whole")
        parts = F.array_sort(F.collect_list(F.struct("first", "kids")))  # of three nodes at most
        border = found.groupBy("tree", "j", "n").agg(F.flatten(F.transform(parts, lambda x: x["kids"])).alias("kids"))
        border.write.parquet(f"{folder}/level={k}/part=border")
        k, most = k + 1, -(-most // FANOUT)
        if most <= 1:
            return k
        nodes = _parents(_level(spark, folder, k - 1)).where("n > 1")


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves: the powers of three, from 1, that are less than ``n``."""
    return reduce(lambda a, b: a + b, ((n > FANOUT**h).cast("int") for h in range(40)))


def _proofs(spark: SparkSession, folder: str, levels: int, tops: DataFrame) -> DataFrame:
    """(tree, i, kid, path, top) of all leaves of a store.

    ``tops`` (tree, height, path, top) has each tree's root; ``path`` lists, from the leaf on, the
    digests to the left and right of it in its row, and then what ``tops`` has.
    """
    known = tops.where(F.col("height") == levels).select("tree", F.lit(0).cast("long").alias("j"), "path", "top")
    for k in range(levels - 1, -1, -1):
        if k == 0:  # a lone leaf is a row of its own, without a node above it
            known = known.unionByName(tops.where("height = 0").select("tree", F.lit(0).cast("long").alias("j"), "path", "top"))
        rows = _level(spark, folder, k).join(known, ["tree", "j"])
        each = rows.select("tree", "j", "n", "kids", "path", "top", F.posexplode("kids").alias("p", "kid"))
        beside = F.struct(
            F.array_join(F.transform(F.slice("kids.digest", 1, F.col("p")), hex_text), "").alias("left"),
            F.array_join(F.transform(F.slice("kids.digest", F.col("p") + 2, FANOUT), hex_text), "").alias("right"),
        )
        packed = F.struct(F.unhex(beside["left"]).alias("left"), F.unhex(beside["right"]).alias("right"))
        path = F.when(F.col("n") > 1, F.concat(F.array(packed), "path")).otherwise(F.col("path"))
        here = each.select("tree", (F.col("j") * FANOUT + F.col("p")).alias("i"), "kid", path.alias("path"), "top")
        if k == 0:
            return here
        known = here.select("tree", F.col("i").alias("j"), "path", "top").unionByName(
            tops.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("j"), "path", "top")
        )


_PATH = "array<struct<left: binary, right: binary>>"


def write_manifest(
    documents: DataFrame, folder: str, columns: list[str], group_col: str = "source", id_col: str = "doc_id", beside: dict[str, Column] | None = None
) -> str | None:
    """Writes the node store of ``documents`` to ``folder`` and gives the root's digest, null for an empty table.

    A leaf is the digest of ``columns``.  Leaves of a group ascend by id, those without an id first,
    and those that share one by digest; so repeated rows have leaves of their own, with equal digests.  Groups ascend
    bytewise, null first.  ``beside`` are further values that are kept with each leaf.
    """
    spark, beside = documents.sparkSession, beside or {}
    group = F.coalesce(F.concat(F.lit(":"), F.col(group_col).cast("string")), F.lit(""))  # null first, no null key
    extra = [v.alias(f"x_{c}") for c, v in beside.items()]
    leaves = documents.select(group.alias("group"), F.col(id_col).alias("id"), digest(canonical(*(F.col(c) for c in columns))).alias("digest"), *extra)
    leaves, used = in_order(leaves, ["group", "id", "digest"], "g")
    groups = leaves.groupBy("group").agg(F.min("g").alias("start"), F.count("*").alias("n"))
    groups, more = in_order(groups, ["start"], "tree")
    leaves = join_checked(leaves, groups, "group", "inner").select("tree", (F.col("g") - F.col("start")).alias("i"), "n", "digest", "id", *(f"x_{c}" for c in beside))
    levels = _write_levels(leaves, f"{folder}/groups")
    # a tree's root is the only node of its last level
    roots = _level(spark, f"{folder}/groups", 0).where("n = 1").select("tree", F.col("kids")[0]["digest"].alias("digest"))
    for k in range(levels):
        roots = roots.unionByName(_parents(_level(spark, f"{folder}/groups", k)).where("n = 1").select("tree", "digest"))
    tops = join_checked(roots, groups.select("tree", F.col("n").alias("size")), "tree", "inner")
    count = groups.count()
    tops = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(count).cast("long").alias("n"), "digest", "size")
    tops, last_used = in_order(tops, ["i"], "place")
    above = _write_levels(tops.drop("place"), f"{folder}/top")
    last = _level(spark, f"{folder}/top", above - 1)
    row = (last.select("kids") if count == 1 else _parents(last).where("n = 1")).first()
    root = None if row is None else bytes(row[0][0]["digest"] if count == 1 else row["digest"]).hex()
    meta = spark.createDataFrame([(root, levels, above, count)], "root string, levels int, above int, groups long")
    meta.coalesce(1).write.parquet(f"{folder}/meta")
    for path in used + more + last_used:
        drop_folder(spark, path)
    return root


def read_proofs(spark: SparkSession, folder: str) -> DataFrame:
    """(id, leaf, subroot, root, path, and what was kept beside) of every leaf of a store; digests are binary."""
    meta = spark.read.parquet(f"{folder}/meta").first()
    one = spark.range(1).select(F.col("id").alias("tree"), _height(F.lit(meta["groups"])).alias("height"), F.array().cast(_PATH).alias("path"), F.lit(None).cast("binary").alias("top"))
    tops = _proofs(spark, f"{folder}/top", meta["above"], one)
    tops = tops.select(F.col("i").alias("tree"), _height(F.col("kid.size")).alias("height"), "path", F.col("kid.digest").alias("top"))
    found = _proofs(spark, f"{folder}/groups", meta["levels"], checkpoint(tops))
    kept = [c for c in found.schema["kid"].dataType.names if c.startswith("x_")]
    root = F.unhex(F.lit(meta["root"]))
    return found.select(F.col("kid.id").alias("id"), F.col("kid.digest").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), "path", *(F.col(f"kid.{c}").alias(c[2:]) for c in kept))


def folded(leaf: Column, path: Column) -> Column:
    """Hex digest of the root that ``leaf`` (binary) and the digests beside its ``path`` give."""
    return F.aggregate(path, hex_text(leaf), lambda at, x: F.sha2(F.concat(hex_text(x["left"]), at, hex_text(x["right"])), 256))


def proof_digest(path: Column) -> Column:
    """Hex digest of all digests of a ``path``, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: hex_text(F.concat(x["left"], x["right"]))), ""), 256)


def audited(documents: DataFrame, folder: str, columns: list[str], changed: dict[str, Column], group_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each document, digests in hex.

    The manifest of ``documents`` is written to ``folder``.  Then each row is looked at with the
    columns ``changed`` in place of its own: its leaf is computed anew and folded with the digests
    beside its path; only an unchanged row gives the root again.  Null ids and groups are values of
    their own, empty and very long texts are like any, repeated rows have proofs each, other
    columns are ignored, and an empty table gives no rows.
    """
    spark = documents.sparkSession
    now = digest(canonical(*(changed.get(c, F.col(c)) for c in columns)))
    write_manifest(documents, folder, columns, group_col, id_col, {"now": now})
    found = read_proofs(spark, folder)
    out = found.select(
        F.col("id").alias("doc_id"), hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("now"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
