"""Streams give what the same operators give on tables."""

from __future__ import annotations

import random

from trailweave.session import table
from trailweave.streaming import live

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def copied(spark, sf, tmp_path) -> str:
    folder = str(tmp_path / "in")
    table(spark, sf, "events").orderBy("ts").coalesce(1).write.parquet(folder)
    return folder


def test_quiet_sessions_of_a_stream(spark, sf, tmp_path):
    stream = live.read_events(spark, copied(spark, sf, tmp_path), EVENTS)
    q = live.quiet_sessions(stream, "6 hours", "0 seconds").writeStream.format("memory").queryName("quiet").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    found = {tuple(r) for r in spark.table("quiet").collect()}
    assert found == {tuple(r) for r in live.quiet_sessions(table(spark, sf, "events"), "6 hours").collect()}


def test_late_results_are_committed_in_order(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    commits = []
    for part in ([3, 0, 1], [5, 2], [6], [4, 4, 1]):
        spark.createDataFrame([(k, f"r{k}") for k in part], "seq int, text string").coalesce(1).write.mode("append").parquet(source)
        live.ordered_commits(spark.readStream.schema("seq int, text string").parquet(source), target, str(tmp_path / "c")).awaitTermination()
        rows = spark.read.parquet(f"{target}/committed")
        commits.append(sorted(r.seq for r in rows.collect()))
    assert commits == [[0, 1], [0, 1, 2, 3], [0, 1, 2, 3], [0, 1, 2, 3, 4, 5, 6]]
    live.ordered_commits(spark.readStream.schema("seq int, text string").parquet(source), target, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(f"{target}/committed").count() == 7


def test_relearned_results_are_whole(spark, sf, tmp_path):
    folder = copied(spark, sf, tmp_path)
    for _ in range(2):
        stream = live.read_events(spark, folder, EVENTS)
        live.relearned(stream, lambda h: h.groupBy("event_type").count(), str(tmp_path / "h"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        expected = spark.read.parquet(folder).groupBy("event_type").count()
        assert {tuple(r) for r in live.latest(spark, str(tmp_path / "t")).collect()} == {tuple(r) for r in expected.collect()}
        table(spark, sf, "events").limit(50).coalesce(1).write.mode("append").parquet(folder)


SEEN = "page string, seq long, fp string, failed boolean, items array<string>"


def test_pages_settle_over_restarts_as_on_a_table(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for p in range(30):
        for seq in range(rng.randrange(1, 15)):
            bad = rng.random() < 0.35
            row = (f"p{p}", seq, None if rng.random() < 0.05 else rng.choice("abcd"), bad, rng.sample("uvwxyz", rng.randrange(4)))
            rows += [row] * rng.choice([1, 1, 2])
    expected = {}
    for p in {r[0] for r in rows}:
        before, run = None, 0
        for _, seq, fp, bad, _ in sorted({(r[0], r[1], r[2] or "", r[3], ()) for r in rows if r[0] == p}):
            own, run = None if bad or not fp else fp, run + 1 if bad else 0
            if own and own == before or run == 3:
                expected[p] = (seq, "stopped" if run == 3 else "stable")
                break
            before = own
    seen = {}
    for page, seq, _, _, items in rows:
        for x in items:
            seen[page, x] = min(seq, seen.get((page, x), seq))
    whole = spark.createDataFrame(rows, SEEN)
    assert {r.page: (r.seq, r.state) for r in live.settled(whole).collect()} == expected and {x for _, x in expected.values()} == {"stable", "stopped"}
    assert {(r.page, r.item): r.seq for r in live.first_seen(whole).collect()} == seen
    source = str(tmp_path / "in")
    for low, high in ((0, 3), (3, 4), (4, 20)):
        # later parts bring earlier numbers again; each start goes on from the checkpoint
        part = [r for r in rows if low <= r[1] < high or r[1] == low - 1]
        rng.shuffle(part)
        spark.createDataFrame(part, SEEN).coalesce(1).write.mode("append").parquet(source)
        for name, run in (("settled", live.settled), ("seen", live.first_seen)):
            stream = run(spark.readStream.schema(SEEN).parquet(source))
            stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "settled")).collect()
    assert len(got) == len(expected) and {r.page: (r.seq, r.state) for r in got} == expected
    got = spark.read.parquet(str(tmp_path / "seen")).collect()
    assert len(got) == len(seen) and {(r.page, r.item) for r in got} == set(seen)


def test_settled_of_an_empty_table(spark):
    none = spark.createDataFrame([], SEEN)
    assert live.settled(none).count() == 0 and live.first_seen(none).count() == 0
