"""Exact removal of long repeated byte strings.

Which strings can repeat is narrowed down first.  Every string of ``least`` bytes has one anchor,
its k-gram with the smallest hash, and equal strings have equal anchors at equal places.
Consecutive strings with one anchor make a stretch.  An anchor that occurs once can't lie in a
repeated string; one whose stretches are all equal needs no comparison.  The different stretches
of each other anchor are compared by a Burrows-Wheeler transform: breadth-first backward
extension turns the interval of each common prefix of length d into those of length d + 1, so
common prefixes come by increasing length, intervals of one occurrence are dropped, and at
``least`` bytes the expansion stops: what is left occurs again.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.blocks import as_bytes, sliced
from trailweave.session import checkpoint, ensure_checkpoint_dir, join_checked

#: The places and the length of a stretch, below 2 ``least``, are kept in 12 bits each.
GRAM, MOST_LEAST = 32, 2000
_PLACE = np.uint64((1 << 24) - 1)
#: Different stretches of an anchor from which on they are dealt in slices by what surrounds the anchor.
HOT_STRETCHES = 4000
SLICES = 8
#: Copies of a stretch beyond which it is looked up in a list that all executors have; so many times fewer than the rows.
FREQUENT_COPIES = 2000
#: Different parts of a slice from which on its strings are counted one by one, so that no task holds a larger group.
CROWDED_PARTS = 1 << 14
_CHUNK_BYTES, _CHUNK_PARTS = 1 << 20, 1 << 15
#: Bytes of texts that are hashed at once, and of a part of a longer text: both below the 2^24 places that fit beside a hash.
_BLOCK, _PART = 1 << 18, 1 << 22
MOST_BROADCAST = 500_000


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64)


_LETTERS, _FACTORS = _random(256, 11), _random(8, 12) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling; GRAM is a power of 2."""
    h, size, k = _LETTERS[data], 1, 0
    while size < GRAM:
        h = h[: len(h) - size] * _FACTORS[k] + h[size:]
        h ^= h >> np.uint64(29)
        size, k = 2 * size, k + 1
    return h * _FACTORS[k]


def smallest_within(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(texts: list[bytes], least: int) -> list[np.ndarray]:
    """(text, anchor hash, first byte, length, place of the anchor, hash of the bytes) of all stretches."""
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    if len(data) < least:
        return [np.zeros(0, np.int64)] * 6
    sizes = np.array([len(x) for x in texts])
    first = np.cumsum(sizes) - sizes
    h = gram_hashes(data)
    place = np.arange(len(h), dtype=np.uint64)
    at = (smallest_within((h & ~_PLACE) | place, least - GRAM + 1) & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    valid = np.arange(len(at)) + least <= (first + sizes)[owner]
    starts = np.flatnonzero(valid & np.r_[True, ~valid[:-1] | (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    stops = np.flatnonzero(valid & np.r_[~valid[1:] | (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]), True]) + least
    view = memoryview(joined)
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(view[s:e]) for s, e in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts))
    own = owner[starts]
    return [own, h[at[starts]].view(np.int64), starts - first[own], stops - starts, at[starts] - starts, content.view(np.int64)]


def _anchored(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _BLOCK):
            # a very long text is cut in parts that share least - 1 bytes, so no string is lost
            rows, parts, shifts = [], [], []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                for at in range(0, max(1, len(text) - least + 1), _PART):
                    rows.append(i)
                    parts.append(text[at : at + _PART + least - 1])
                    shifts.append(at)
            row, shift = np.array(rows, np.int64), np.array(shifts, np.int64)
            # parts are hashed together as long as they begin within one block, whatever rows they are of
            sizes = np.array([len(x) for x in parts])
            block = (np.cumsum(sizes) - sizes) // _BLOCK
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(parts)]
            for low, high in zip(cuts, cuts[1:]):
                own, anchor, start, length, place, content = stretches(parts[low:high], least)
                at = start + shift[low + own] << 24 | length << 12 | place
                rid = batch.column("rid").to_numpy()[row[low + own]]
                yield pa.record_batch([pa.array(anchor), pa.array(content), pa.array(rid), pa.array(at)], ["anchor", "content", "rid", "at"])

    return run


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` symbols (below 2^31), by prefix doubling, and their places in it."""
    n, most = len(text), int(text.max(initial=0))
    size, bits = (4, 16) if most < 1 << 16 else (3, 21) if most < 1 << 21 else (2, 32)
    padded = np.r_[text, np.zeros(size, np.int64)]
    key = padded[:n].copy()
    for k in range(1, size):
        key = key << bits | padded[k : n + k]
    if size * bits == 64:
        key ^= -(1 << 63)  # so that signed comparison sorts the first symbol as unsigned
    while True:
        order = np.argsort(key)
        ordered = key[order]
        group = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        if size >= depth or group[-1] == n - 1:
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            return order, place
        rank = np.empty(n + size, np.int64)
        rank[order] = group + 1
        rank[n:] = 0
        key = rank[:n] << 32 | rank[size:]
        size *= 2


#: Letters that an interval is extended by at once, as long as so many are wanted.
_STRIDE = 8


def _codes(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` letters from each place on, as one number."""
    code = np.zeros(len(data), np.uint64)
    for k in range(min(width, len(data))):
        code[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * (width - 1 - k))
    return code


def repeated_prefixes(parts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, offset) of every string of ``least`` bytes that occurs twice or more in all parts.

    An interval holds the suffixes with a common prefix, which are neighbours in the order.  It is
    extended backward by the letters before its suffixes, a few at a time: suffixes with the same
    letters go on together.  One that no other follows drops out.
    """
    sizes = np.array([len(x) for x in parts])
    k = len(parts)
    ends = np.cumsum(sizes + 1) - 1
    text = np.empty(int(sizes.sum()) + k, np.int64)
    keep = np.ones(len(text), bool)
    keep[ends] = False
    text[keep] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + k
    text[ends] = np.arange(k)  # separators: all different and below every byte
    order, place = suffix_order(text, least)
    letters = np.where(keep, text - k, 0).astype(np.uint8)
    behind = np.arange(len(text)) - np.repeat(ends - sizes, sizes + 1)  # letters before a place in its part
    row, interval = np.arange(len(text)), np.zeros(len(text), np.int64)
    depth = 0
    while depth < least and len(row):
        stride = _STRIDE if least - depth >= _STRIDE else least - depth
        if depth == 0 or stride != _STRIDE:
            code = _codes(letters, stride)
        at = order[row]
        inside = behind[at] >= stride
        key = place[at[inside] - stride] << 32 | interval[inside]
        key.sort()
        row, interval = key >> 32, key & 0xFFFFFFFF
        if not len(row):
            break
        before = code[order[row]]
        first = np.flatnonzero(np.r_[True, (interval[1:] != interval[:-1]) | (before[1:] != before[:-1])])
        size = np.diff(np.r_[first, len(row)])
        stay = np.repeat(size > 1, size)
        interval = np.repeat(np.arange(len(first)), size)[stay]
        row = row[stay]
        depth += stride
    at = order[row]
    own = np.searchsorted(ends, at)
    return own, at - (ends[own] - sizes[own])


def _expanded(least: int):
    """Marks in the parts that occur once: their bytes that strings of ``least`` bytes found again cover."""

    def marks(group: list[tuple]) -> list[tuple[int, int, int]]:
        own, offset = repeated_prefixes([g[1] for g in group], least)
        by = np.lexsort((offset, own))
        own, offset = own[by], offset[by]
        out = []
        if len(own):
            new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (offset[1:] > offset[:-1] + least)])
            last = np.r_[new[1:] - 1, len(own) - 1]
            for a, b in zip(new.tolist(), last.tolist()):
                _, _, n, rid, start = group[own[a]]
                if n == 1:
                    out.append((rid, start + int(offset[a]), start + int(offset[b]) + least))
        return out

    def record(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ([], [], []))], ["rid", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*x,) for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("group", "bytes", "n", "rid", "start"))))
        chunk, size = [], 0
        for _, group in itertools.groupby(rows, key=lambda x: x[0]):
            group = list(group)
            if len(group) > 1:
                chunk += group
                size += sum(len(x[1]) for x in group)
            if size >= _CHUNK_BYTES or len(chunk) >= _CHUNK_PARTS:
                yield record(marks(chunk))
                chunk, size = [], 0
        if chunk:
            yield record(marks(chunk))

    return run


def _staged(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _slices(stretch: DataFrame, least: int) -> DataFrame:
    """Parts of the stretches of hot anchors, grouped by what is around the anchor too.

    A string's anchor lies up to ``least`` - GRAM bytes after its start.  These distances are cut in
    slices; all strings of a slice have a core of bytes around the anchor in common, which joins the
    anchor in the group key.  Each string belongs to one slice, so none is compared twice or missed.
    """
    width = -(-(least - GRAM + 1) // SLICES)
    rows = stretch.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    # strings start at i = place - r for distances r in [slice * width, (slice + 1) * width)
    low = F.greatest(F.lit(0), F.col("place") - (F.col("slice") + 1) * width + 1)
    high = F.least(F.length("bytes") - least, F.col("place") - F.col("slice") * width)
    rows = rows.withColumn("low", low).withColumn("high", high).where("low <= high")
    core_from = F.col("place") - F.col("slice") * width
    core = F.substring("bytes", core_from + 1, F.lit(least - width + 1))
    return rows.select(
        F.xxhash64("anchor", "slice", core).alias("group"), F.substring("bytes", F.col("low") + 1, F.col("high") - F.col("low") + least).alias("bytes"),
        "n", "rid", (F.col("start") + F.col("low")).alias("start"),
    )


def _single_strings(parts: DataFrame, least: int) -> DataFrame:
    """(rid, start, stop) of the repeated strings of ``parts`` (group, bytes, n, rid, start) that occur once each as parts.

    Each string of ``least`` bytes is a row, and equal ones are counted without being gathered.
    """
    at = F.explode(F.sequence(F.lit(0), F.length("bytes") - least)).alias("i")
    rows = _staged(parts.select("group", "bytes", "n", "rid", "start", at).select("group", F.expr(f"substring(bytes, i + 1, {least})").alias("string"), "n", "rid", (F.col("start") + F.col("i")).alias("start")))
    again = _staged(rows.groupBy("group", "string").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("group", "string"))
    found = rows.where("n = 1").join(again, ["group", "string"], "left_semi")
    return found.select("rid", "start", (F.col("start") + least).alias("stop"))


def repeated_spans(texts: DataFrame, least: int = 200) -> DataFrame:
    """(rid, start, stop), overlapping: all bytes of ``texts`` (rid, text) in a repeated string of ``least`` bytes."""
    found = _staged(texts.where(F.octet_length("text") >= least).mapInArrow(_anchored(least), "anchor long, content long, rid long, at long"))
    # counts are combined before the shuffle, so an anchor that a third of the documents share is a few rows
    again = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("a"), F.max("content").alias("b")).where("n > 1")
    # written out, so that Spark can split a frequent anchor in the join
    again = _staged(again.select("anchor", (F.col("a") != F.col("b")).alias("mixed")))
    hits = _staged(found.join(again, "anchor"))
    place = [F.shiftright("at", 24).alias("start"), F.expr("cast(shiftright(at, 12) & 4095 as int)").alias("length"), F.expr("cast(at & 4095 as int)").alias("place")]
    # the different stretches of each anchor, with how often each occurs and one place where it does
    mixed = hits.where("mixed").groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("one"))
    mixed = _staged(mixed.select("anchor", "content", "n", "one.rid", "one.at"))
    hot = mixed.groupBy("anchor").count().where(F.col("count") > HOT_STRETCHES).select("anchor", F.lit(True).alias("hot"))
    needed = mixed.join(hot, "anchor", "left").select("anchor", "n", "rid", "hot", *place)
    own = join_checked(texts, mixed.select("rid").distinct(), "rid", "left_semi", MOST_BROADCAST)
    stretch = needed.join(own, "rid").withColumn("bytes", F.substring(F.col("text").cast("binary"), F.col("start").cast("int") + 1, F.col("length"))).drop("text")
    stretch = _staged(stretch)
    plain = stretch.where("hot is null").select(F.col("anchor").alias("group"), "bytes", "n", "rid", "start")
    slices = _slices(stretch.where("hot"), least)
    sliced = slices
    slices = slices.groupBy("group", "bytes").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "start")).alias("one"), F.count("*").alias("k"))
    slices = _staged(slices)
    # equal parts of different stretches repeat as a whole; where they are is joined back, so none is a list
    part = ["group", "bytes"]
    often = checkpoint(slices.where(F.col("k") > FREQUENT_COPIES).select(*part))
    alike = [join_checked(sliced, often, part, "left_semi", MOST_BROADCAST // 100)]
    others = join_checked(sliced, often, part, "left_anti", MOST_BROADCAST // 100)
    alike.append(others.join(slices.where(F.col("k").between(2, FREQUENT_COPIES)).select(*part), part, "left_semi"))
    doubled = alike[0].unionByName(alike[1]).select("rid", "start", (F.col("start") + F.length("bytes")).alias("stop"))
    cut = slices.select("group", "bytes", "n", "one.rid", "one.start")
    crowded = slices.groupBy("group").agg(F.count("*").alias("parts")).where(F.col("parts") > CROWDED_PARTS).select("group")
    crowded = checkpoint(crowded)
    if not crowded.isEmpty():
        single = _single_strings(join_checked(cut, crowded, "group", "left_semi", MOST_BROADCAST), least)
        doubled = doubled.unionByName(single)
        cut = join_checked(cut, crowded, "group", "left_anti", MOST_BROADCAST)
    parts = plain.unionByName(cut)
    sorted_parts = parts.repartition("group").sortWithinPartitions("group")
    compared = sorted_parts.mapInArrow(_expanded(least), "rid long, start long, stop long")
    whole = hits.where("not mixed").select("rid", *place[:2])
    # copies of a stretch: those of a very frequent one are found without a shuffle, so none of these keys fills a task
    key = ["anchor", "content"]
    frequent = checkpoint(mixed.where(F.col("n") > FREQUENT_COPIES).select(*key))
    copies = [join_checked(hits.where("mixed"), frequent, key, "left_semi", MOST_BROADCAST)]
    rest = join_checked(hits.where("mixed"), frequent, key, "left_anti", MOST_BROADCAST)
    copies.append(rest.join(mixed.where(F.col("n").between(2, FREQUENT_COPIES)).select(*key), key, "left_semi"))
    for x in copies:
        whole = whole.unionByName(x.select("rid", *place[:2]))
    return compared.unionByName(whole.select("rid", "start", (F.col("start") + F.col("length")).alias("stop"))).unionByName(doubled)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without its (disjoint, sorted) spans."""
    cuts = [0, *itertools.chain.from_iterable(spans), len(text)]
    return b"".join(text[s:e] for s, e in zip(cuts[::2], cuts[1::2]))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", 1 << 22):
        rows = []
        for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist()):
            runs = merged([(x["start"], x["stop"]) for x in spans or ()])
            kept = without(text, runs)
            rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
        n, removed, k, digest, kept = zip(*rows)
        yield pa.record_batch(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, k)), pa.array(digest), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def without_repeats(documents: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each document.

    Every byte that a string of ``least`` bytes covers which also starts elsewhere, in this or any
    other text, is removed; strings are judged on the input and never cross texts.  A null text is
    empty.  ``kept`` are the bytes that remain, which may cut a character in two.  Repeated rows
    are copies of each other, so what they share is removed from all; null ids stay null; other
    columns are ignored; an empty table gives no rows.  Very long texts are hashed part by part.
    ``least`` is from ``GRAM`` to ``MOST_LEAST``.
    """
    if not GRAM <= least <= MOST_LEAST:
        raise ValueError(f"repeated strings of {GRAM} to {MOST_LEAST} bytes can be found, not of {least}")
    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(texts.select("rid", "text"), least)
    grouped = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    rows = texts.join(grouped, "rid", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cleaned, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
