"""Toxicity, repeats, packing, archives and near-duplicates against brute force; the pipeline's stages."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trailweave.llm import packing, queries, simhash, suffix_dedup, warc
from trailweave.llm.components import connected_components
from trailweave.llm.toxicity import fit, fold, toxicity_score
from trailweave.session import table

ODD = [(1, None), (2, ""), (None, "no id"), (3, "same text"), (3, "same text"), (4, "same text"), (5, "word " * 30_000), (6, "x" * 50_000), (7, "\n\n \t"), (8, "b é 😀 漢字")]
SF_01 = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out and toxic is not null").collect()
    hits = sum(r.predicted == r.toxic == 1 for r in rows)
    recall, precision = hits / max(1, sum(r.toxic for r in rows)), hits / max(1, sum(r.predicted for r in rows))
    assert len(rows) > 500 and recall >= 0.85 and precision >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_rows_are_crc32_folds(spark):
    rows = queries.op3_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_held_out_labels_are_never_seen(spark):
    docs, labels = (table(spark, SF_01, x) for x in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (fit(docs, x, fold(F.col("doc_id")) != 2) for x in (labels, flipped))
    assert np.array_equal(a.words, b.words) and np.array_equal(a.shift, b.shift)


def test_toxicity_of_odd_and_no_rows(spark, documents):
    docs, labels = (table(spark, SF_01, x) for x in ("documents", "labels"))
    model = fit(docs, labels)
    scores = [r.s for r in documents(ODD).select(toxicity_score(F.col("text"), model).alias("s")).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert documents([]).select(toxicity_score(F.col("text"), model)).count() == 0
    assert fit(docs, labels.where("toxic = 0")) is None
    assert {r.s for r in documents(ODD).select(toxicity_score(F.col("text"), None).alias("s")).collect()} == {0.0}


def brute_repeats(texts: list[bytes], least: int) -> list[np.ndarray]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - least + 1):
            seen[t[k : k + least]] = seen.get(t[k : k + least], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - least + 1):
            if seen[t[k : k + least]] > 1:
                gone[k : k + least] = True
        out.append(gone)
    return out


def repeat_texts() -> list[str]:
    rng = random.Random(4)
    base = lambda n, letters="abcdefghij é": "".join(rng.choices(letters, k=n))
    long, texts = base(900), []
    for _ in range(40):
        a = rng.randrange(0, 600)
        texts.append(base(rng.randrange(0, 400)) + (long[a : a + rng.choice([150, 199, 200, 201, 260])] if rng.random() < 0.6 else "") + base(rng.randrange(0, 300)))
    texts += ["z" * 450, "z" * 199, "ab" * 210, "", long, long[3:], base(230) * 2, base(500, "ab"), base(500, "ab")]
    return texts


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(documents, monkeypatch, hot):
    if hot:  # every anchor with two stretches or more takes the way of the hot ones
        monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", 1)
        monkeypatch.setattr(suffix_dedup, "FREQUENT_COPIES", 1)
    texts = repeat_texts()
    gone = brute_repeats([t.encode() for t in texts], 200)
    for r in suffix_dedup.without_repeats(documents(list(enumerate(texts)))).collect():
        data, g = texts[r.doc_id].encode(), gone[r.doc_id]
        kept = bytes(np.frombuffer(data, np.uint8)[~g])
        runs = int((np.diff(np.r_[0, g.astype(int)]) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), int(g.sum()), runs, hashlib.sha256(kept).hexdigest())
        assert bytes(r.kept) == kept


def test_repeats_on_the_documents(spark, sf):
    docs = [(r.doc_id, (r.text or "").encode()) for r in table(spark, sf, "documents").collect()]
    gone = {k: g for (k, _), g in zip(docs, brute_repeats([t for _, t in docs], 200))}
    found = queries.op4_suffix_dedup(spark, sf).collect()
    assert {r.doc_id: r.n_removed for r in found} == {k: int(g.sum()) for k, g in gone.items()} and sum(r.n_removed for r in found) > 0


def test_repeats_of_crowded_slices(documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", 1)
    monkeypatch.setattr(suffix_dedup, "CROWDED_PARTS", 1)
    compared = []
    single = suffix_dedup._single_strings
    monkeypatch.setattr(suffix_dedup, "_single_strings", lambda parts, least: compared.append(parts.count()) or single(parts, least))
    texts = repeat_texts()
    gone = brute_repeats([t.encode() for t in texts], 200)
    found = {r.doc_id: bytes(r.kept) for r in suffix_dedup.without_repeats(documents(list(enumerate(texts)))).collect()}
    assert found == {k: bytes(np.frombuffer(t.encode(), np.uint8)[~gone[k]]) for k, t in enumerate(texts)} and compared[0] > 0


def test_interval_expansion_of_many_parts():
    rng = np.random.default_rng(6)
    parts = [rng.choice(np.frombuffer(b"abcdefgh", np.uint8), 12).tobytes() for _ in range(70_000)]
    own, at = suffix_dedup.repeated_prefixes(parts, 8)
    strings = [p[i : i + 8] for p in parts for i in range(5)]
    seen = Counter(strings)
    assert sorted(zip(own.tolist(), at.tolist())) == [(k // 5, k % 5) for k, s in enumerate(strings) if seen[s] > 1]


def test_a_long_text_after_a_short_one():
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 123, 300, np.uint8).tobytes()
    long = rng.integers(97, 123, 17 << 20, np.uint8).tobytes()
    at = len(long) - 5000
    long = long[:at] + passage + long[at + len(passage) :]
    rows = [(1, b"small " + passage), (2, long)]
    batch = pa.record_batch([pa.array([r for r, _ in rows]), pa.array([t.decode() for _, t in rows])], ["rid", "text"])
    found = {}
    for b in suffix_dedup._anchored(200)(iter([batch])):
        for anchor, rid, packed in zip(b.column("anchor").to_pylist(), b.column("rid").to_pylist(), b.column("at").to_pylist()):
            start, length, place = packed >> 24, packed >> 12 & 4095, packed & 4095
            assert 0 <= start and start + length <= len(rows[rid - 1][1]) and place + suffix_dedup.GRAM <= length
            found.setdefault(anchor, set()).add((rid, start + place))
    # the anchor of the passage is found in both
    assert any({(1, 6 + k), (2, at + k)} <= places for places in found.values() for k in range(300))


def test_lengths_that_do_not_fit_are_refused(documents):
    for least in (31, 2001):
        with pytest.raises(ValueError, match="32 to 2000"):
            suffix_dedup.without_repeats(documents([(1, "x")]), least)


@pytest.mark.parametrize("least", [1, 3, 8, 20])
def test_interval_expansion(least):
    rng = random.Random(least)
    for _ in range(30):
        parts = ["".join(rng.choices("ab", k=rng.randrange(1, 40))).encode() for _ in range(rng.randrange(1, 8))]
        own, at = suffix_dedup.repeated_prefixes(parts, least)
        everything = [(k, i, p[i : i + least]) for k, p in enumerate(parts) for i in range(len(p) - least + 1)]
        strings = [s for _, _, s in everything]
        assert sorted(zip(own.tolist(), at.tolist())) == [(k, i) for k, i, s in everything if strings.count(s) > 1]


def test_repeats_of_odd_and_no_rows(documents):
    found = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.without_repeats(documents([*ODD, (9, "q" * 199), (10, "copy " * 41 + "end"), (10, "copy " * 41 + "end")])).collect()}
    assert found[(10, 208)] == 208 and found[(9, 199)] == 0 and found[(6, 50_000)] == 50_000 and found[(1, 0)] == 0
    assert suffix_dedup.without_repeats(documents([])).count() == 0


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(queries.WORD_BPE))


def test_packing(spark, documents, words, sf):
    texts = [t or "" for _, t in ODD] + ["it's <|endoftext|> A-B 12ab3 ΑΣ café", "x\x1cy　z a\x85b"] + [r.text or "" for r in table(spark, sf, "documents").collect()]
    rows = packing.packed_documents(documents(list(enumerate(texts))), queries.tokenizer_path(queries.WORD_BPE)).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for k, t in enumerate(texts):
        ids = np.array([*words.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        cuts = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(by_doc[k], key=lambda r: r.piece)] == [(i, 2048 * i, len(c), zlib.crc32(c.tobytes())) for i, c in enumerate(cuts)]
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1] and sum(r.length for r in own) <= 2048
    assert len(by_sequence) <= 1.01 * total / 2048 + 1


def optimum(items: list[int], size: int) -> int:
    """Fewest sequences, by branch and bound."""
    items, best = sorted(items, reverse=True), [len(items)]

    def put(k: int, rooms: list[int]) -> None:
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= items[k]}):
            rest = list(rooms)
            rest.remove(room)
            put(k + 1, [*rest, room - items[k]])
        put(k + 1, [*rooms, size - items[k]])

    put(0, [])
    return best[0]


def test_reduction_keeps_an_optimal_packing():
    rng = random.Random(8)
    worse = 0
    for _ in range(300):
        items = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))]
        counts = {x: items.count(x) for x in items}
        found = packing.patterns(counts, 20)
        placed = sorted(x for pattern, times in found for x in pattern * times)
        assert placed == sorted(items) and all(sum(p) <= 20 for p, _ in found)
        extra = sum(times for _, times in found) - optimum(items, 20)
        assert 0 <= extra <= 1
        worse += extra
    assert worse <= 6


def test_packing_of_no_rows(documents):
    assert packing.packed_documents(documents([]), queries.tokenizer_path(queries.WORD_BPE)).count() == 0
    assert packing.patterns({2048: 3}, 2048) == [((2048,), 3)]


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8, 13):
        runs = [sorted((rng.randrange(20), i) for i in range(rng.randrange(0, 30))) for _ in range(k)]
        assert [x for x in warc.LoserTree([iter(r) for r in runs])] == sorted(itertools.chain(*runs), key=lambda x: x[0]) or [x[0] for x in warc.LoserTree([iter(r) for r in runs])] == sorted(x[0] for r in runs for x in r)


def test_archive_round_trip(spark):
    rows = [(5, "http://b.test/x?b=2&a=1", "<p>one</p>\r\n\r\nWARC/1.1 no"), (2, "http://www.a.test/", "<p>one</p>\r\n\r\nWARC/1.1 no"), (9, None, None), (7, "u", ""), (1, "http://a.test/", "é漢😀"), (8, "http://a.test/", "é漢😀"), (3, "http://a.test:8080/p", "x" * 100_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, captured string").repartition(1)
    found = warc.archived(pages, archive_bytes=700).collect()
    assert len({r.archive for r in found}) >= 3
    assert all(r.offset >= 0 and r.length > r.payload_bytes * (r.record_type == "response") for r in found)
    first: dict[str, int] = {}
    for k, _, h in sorted(rows):
        first.setdefault(h or "", k)
    by = {r.page_id: r for r in found}
    for k, url, h in rows:
        data, r = (h or "").encode(), by[k]
        again = first[h or ""] != k
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to, r.url, r.intact) == ("revisit" if again else "response", first[h or ""] if again else None, url, True)
    order = [r.page_id for r in sorted(found, key=lambda r: r.index_order)]
    assert order == [r.page_id for r in sorted(found, key=lambda r: (r.url_key, r.captured, r.page_id))]
    assert by[5].url_key == "test,b)/x?a=1&b=2" and by[2].url_key == "test,a)/"


def record_bytes(k: int, payload: bytes, said: str | None = None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    digest = said or base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def test_archives_are_read_as_streams():
    import gzip
    import tracemalloc

    content = b"".join(gzip.compress(record_bytes(k, bytes(random.Random(k).randrange(97, 101) for _ in range(1000)) * 200)) for k in range(150))
    plain = gzip.decompress(content)
    assert len(plain) > 25 << 20
    tracemalloc.start()
    for n, (fields, block, at, length) in enumerate(warc.parsed(warc.unzipped(memoryview(content)))):
        assert warc.capture(fields, block)[0] == n and warc.capture(fields, block)[-1]
        assert hashlib.sha1(plain[at : at + length]).digest() != b"" and plain[at : at + 5] == b"WARC/" and plain[at + length : at + length + 4] == b"\r\n\r\n"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 149 and peak < 8 << 20


def test_a_damaged_record_is_an_error(spark, tmp_path):
    import gzip

    for k, data in enumerate((record_bytes(1, b"whole"), record_bytes(2, b"other", said="A" * 32), record_bytes(3, b"broken off")[:-12])):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / "part-0.gz").write_bytes(gzip.compress(record_bytes(0, b"first") + data))
        found = warc.captures(spark, f"file://{folder}")
        assert [r.intact for r in found.orderBy("page_id").collect()] == [True, k == 0]
        if k == 0:
            assert warc.capture_index(warc.checked(found)).count() == 2
        else:
            with pytest.raises(Exception, match="damaged record"):
                warc.capture_index(warc.checked(found)).collect()


@pytest.mark.parametrize("held", [1, 5_000, 1 << 20])
def test_runs_beyond_memory_are_merged_from_files(held, tmp_path):
    rng, schema = random.Random(4), pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64())])
    runs, every = warc.SortedRuns(schema, held, str(tmp_path)), []
    for _ in range(150):
        rows = sorted((rng.choice("abc"), str(rng.randrange(30)), rng.randrange(99)) for _ in range(rng.randrange(1, 60)))
        every += rows
        runs.begin()
        for at in range(0, len(rows), 7):
            runs.add(pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows[at : at + 7]), schema)], schema=schema))
    found = [tuple(r.values()) for b in runs.merged() for r in b.to_pylist()]
    assert found == sorted(every)


def test_archive_of_odd_and_no_rows(spark):
    kind = "page_id long, url string, html string"
    pages = spark.createDataFrame([(None, "u", "same"), (1, "u", "same"), (1, "u", "same"), (None, None, None)], kind)
    types = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.archived(pages).collect())
    assert types == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0)]
    assert warc.archived(spark.createDataFrame([], kind)).count() == 0


def brute_print(text: str) -> int:
    words = [w for w in text.encode().lower().split()]
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes: list, linked) -> dict:
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("hot", [4096, 2])
def test_near_duplicates(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ANCHOR", hot)
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    prints = {k: brute_print(t) for k, t in docs.items()}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = roots(list(prints), near)
    found = queries.op10_simhash_near_dedup(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {r.doc_id: r.component_id for r in found} == expected and near


@pytest.mark.parametrize("hot", [4096, 2])
def test_every_link_of_planted_fingerprints_is_found(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ANCHOR", hot)
    rng = random.Random(6)
    values = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        values.add(p)
        for _ in range(rng.randrange(0, 6)):
            q = p
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                q ^= 1 << b
            values.add(q)
    values = sorted(values)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v),) for v in values], "f0 long").repartition(5)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.print_links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    assert roots(values, edges) == roots(values, [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3])


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(found.collect()) == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_odd_and_no_rows(documents):
    found = simhash.near_duplicates(documents(ODD)).collect()
    assert len(found) == len(ODD)
    by = {(r.doc_id, r.fp): r.component_id for r in found}
    assert {k: c for (k, fp), c in by.items() if fp == 0} == {1: 1, 2: 1, 7: 1}
    assert simhash.near_duplicates(documents([])).count() == 0
    kept = simhash.one_of_each(documents(ODD))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 8] and kept.columns == documents(ODD).columns
