"""Links that come and go: after each micro-batch what is learned, and each page's route, equals learning from all that remains."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trailweave.functions.urls import route
from trailweave.operators import learning
from trailweave.streaming import retraction

LINKS = "target string, in_nav boolean, sign int"
LEAST = 3


def plain(rows, least=LEAST):
    """Prefixes of the links that remain; addresses here have a host and two or three plain segments."""
    n, out = Counter(), Counter()
    for target, nav, sign in rows:
        host, *segs = target.removeprefix("http://").split("/")
        for i in range(1, len(segs)):
            key = (f"http://{host}", "/" + "/".join(segs[:i]), tuple(segs[:i] + ["*"] + segs[i + 1 :]), segs[i])
            n[key] += sign
            out[key] += 0 if nav else sign
    groups = {}
    for key, count in n.items():
        if count > 0:
            groups.setdefault(key[:3], []).append((key[3], out[key] > 0))
    data = lambda v: len(v) >= least and (any(x for _, x in v) or any(c.isdigit() for x, _ in v for c in x) or len(v) > 12)
    return {k[:2] for k, v in groups.items() if data(v)}


def batches(rng):
    """Ten batches: links seen, some taken back later, one back before it is seen, and a third below one prefix."""
    seen, all_of = [], []
    for b in range(10):
        rows = []
        for _ in range(25):
            host = rng.choice(["a.test", "b.test", "c.test"])
            target = "http://a.test/shop/" + rng.choice("pqrstuvw") * 3 if rng.random() < 0.33 else f"http://{host}/{rng.choice(['x', 'y'])}/{rng.choice('klmno') * 4}" + rng.choice(["", "/end", "/more"])
            rows.append((target, rng.random() < 0.5, 1))
        for target, nav, _ in rng.sample(seen, min(len(seen), 5 + 4 * b)):
            rows.append((target, nav, -1))
            seen.remove((target, nav, 1))
        if b in (2, 4):
            rows.append(("http://early.test/z/one", False, -1 if b == 2 else 1))
        if b == 3:
            rows += [(f"http://nav.test/menu/{w}", True, 1) for w in ("news", "help", "about")] + [(None, False, 1), ("no address", False, 1), ("http://a.test/shop/ppp", False, None)]
        if b == 6:
            rows += [("http://nav.test/menu/about", False, 1)]
        seen += [r for r in rows if r[2] == 1 and r[0] and "nav.test" not in r[0] and "early" not in r[0] and "no address" != r[0]]
        rng.shuffle(rows)
        all_of.append(rows)
    return all_of


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield spark.conf.set
    spark.conf.set(name, before)


def test_learned_and_routes_after_each_batch_equal_the_recompute(spark, tmp_path, rocks):
    parts = batches(random.Random(7))
    urls = sorted({t for rows in parts for t, _, _ in rows if t and t.startswith("http")}) + ["http://quiet.test/x/kkkk", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    folder, source, target = (str(tmp_path / x) for x in ("pages", "in", "out"))
    retraction.write_pages(pages, folder, 64)
    # parts of origins that learn nothing aren't read: what is in them does no harm
    known = {r.bucket for r in pages.where(F.col("url").rlike("//(a|b|c|nav).test")).select(retraction._bucket(F.substring_index("url", "/", 3), 64).alias("bucket")).collect()}
    quiet = [p for p in Path(folder).glob("bucket=*") if int(p.name.split("=")[1]) not in known]
    assert quiet
    for p in quiet:
        for f in p.glob("*.parquet"):
            (p / f".{f.name}.crc").unlink(missing_ok=True)
            f.write_bytes(b"not a table")
    with pytest.raises(RuntimeError, match="RocksDB"):
        retraction.learned_changes(spark.readStream.schema(LINKS).parquet(folder))
    rocks("spark.sql.streaming.stateStore.providerClass", retraction.ROCKS)
    first = pages.select("page_id", route(F.col("url"))["route"].alias("route"))
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, LINKS).coalesce(1).write.mode("append").parquet(source)
        if k in (3, 9):  # two starts, the second goes on from the first one's state
            stream = spark.readStream.schema(LINKS).option("maxFilesPerTrigger", 1).parquet(source)
            changes = retraction.learned_changes(stream, LEAST)
            retraction.relearning(changes, folder, target, str(tmp_path / "c"), 64).awaitTermination()
    log = spark.read.schema(retraction.CHANGES).parquet(f"{target}/changes").cache()
    # files of one second may come in any order, so the batches are those that the source's log names
    order = sorted(Path(source).glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(order) == 10 and log.where("sign < 0").count() > 0
    for epoch in range(10):
        rows = [r for part in parts[: epoch + 1] for r in part if r[2] is not None and r[0] and r[0].startswith("http")]
        want = plain(rows)
        assert {tuple(r) for r in retraction.learned_now(log.where(F.col("epoch") <= epoch)).collect()} == want, epoch
    assert {(r.origin, r.prefix) for r in learning.learned_of_signed(spark.createDataFrame([r for p in parts for r in p], LINKS), LEAST).collect()} == want
    got = {r.page_id: r.route for r in retraction.routes_now(spark, target, first).collect()}
    wanted = learning.learned_routes(pages, spark.createDataFrame(sorted(want), "origin string, prefix string"))
    assert got == {r.page_id: r.route for r in wanted.collect()} and any(r and "*" in r for r in got.values())


def test_signed_links_that_are_only_seen_are_the_proposals(spark, sf):
    links = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("url").alias("target"), F.lit(None).cast("boolean").alias("in_nav"))
    seen = learning.learned_of_signed(links.withColumn("sign", F.lit(1)), 2)
    plain_ones = learning.segment_proposals(links.withColumn("in_nav", F.lit(False)), 2).select("origin", "prefix", "n_values")
    assert {tuple(r) for r in seen.collect()} == {tuple(r) for r in plain_ones.collect()}
    twice = links.withColumn("sign", F.lit(1)).unionByName(links.withColumn("sign", F.lit(-1)))
    assert learning.learned_of_signed(twice, 1).count() == 0 and learning.learned_of_signed(twice.where("false")).count() == 0
