"""Exact removal of repeated word windows by relative Lempel-Ziv parsing.

The reference is the corpus itself: every passage where it occurs first.  It is cut in sections.  A
window of ``width`` words has one anchor, its ``GRAM`` consecutive words with the smallest hash, and
consecutive windows with one anchor are a section, so that equal windows lie at equal places of
sections with equal anchors.  The reference is indexed by anchor and section, in blocks that are the
partitions of these keys.

Documents are parsed against all blocks at once: each section is looked up in the one block that
can hold it.  One that an earlier place has as a whole is a factor; factors whose source goes on where
the last one ended become one longer factor.  At the borders of factors a passage begins or ends within a
section.  Such sections share their anchor with others that differ, and each of their windows is looked up word by word.
Factors of ``width`` words or more are the duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.blocks import as_bytes, pieces_at_spaces, sliced, staged
from trailweave.llm.suffix_dedup import smallest_within
from trailweave.session import checkpoint, drop_folder

GRAM, MOST_WIDTH = 8, 120
_PLACE = np.uint64((1 << 24) - 1)
#: Words that are hashed at once: below the 2^24 places that fit beside a hash.
_BLOCK = 1 << 17
#: Rows of one key beyond which the key is looked up in a list that all executors have; there are so many times fewer such keys than rows.
FREQUENT, MOST_BROADCAST = 2000, 200_000
#: Different words of which a task remembers the hash.
_REMEMBERED = 1 << 19
_FACTORS = np.random.default_rng(21).integers(0, 2**64, GRAM, np.uint64) | np.uint64(1)


class _Hashes(dict):
    """Hash of each word, computed when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: bytes, known: _Hashes) -> np.ndarray:
    """Hash of each word, of which ASCII white space is between, read piece by piece."""
    found = [np.array([known[w] for w in piece.split()], np.uint64) for piece in pieces_at_spaces(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def gram_hashes(words: np.ndarray) -> np.ndarray:
    h = np.zeros(len(words) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h += words[k : k + len(h)] * _FACTORS[k]
    h ^= h >> np.uint64(31)
    return h * _FACTORS[0]


def sections(texts: list[np.ndarray], width: int) -> list[np.ndarray]:
    """(text, anchor, hash of the words, first word, words, place of the anchor) of all sections of texts given as word hashes."""
    words = np.concatenate(texts)
    if len(words) < width:
        return [np.zeros(0, np.int64)] * 6
    sizes = np.array([len(x) for x in texts])
    first = np.cumsum(sizes) - sizes
    h = gram_hashes(words)
    at = (smallest_within((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), width - GRAM + 1) & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    valid = np.arange(len(at)) + width <= (first + sizes)[owner]
    change = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(valid & np.r_[True, ~valid[:-1] | change])
    stops = np.flatnonzero(valid & np.r_[~valid[1:] | change, True]) + width
    view = memoryview(words).cast("B")
    hashed = xxhash.xxh3_64_intdigest
    content = np.fromiter((hashed(view[8 * s : 8 * e]) for s, e in zip(starts.tolist(), stops.tolist())), np.uint64, len(starts))
    own = owner[starts]
    return [own, h[at[starts]].view(np.int64), content.view(np.int64), starts - first[own], stops - starts, at[starts] - starts]


def _sections(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        parts, rows, shifts, size = [], [], [], 0

        def flush(batch: pa.RecordBatch) -> pa.RecordBatch:
            own, anchor, content, start, length, place = sections(parts, width)
            at = (np.array(shifts, np.int64)[own] + start) << 16 | length << 8 | place
            pick = pa.array(np.array(rows, np.int64)[own])
            return pa.record_batch([pa.array(anchor), pa.array(content), batch.column("doc").take(pick), batch.column("tag").take(pick), pa.array(at)], ["anchor", "content", "doc", "tag", "at"])

        for batch in sliced(batches, "text", 1 << 22):
            for i, text in enumerate(as_bytes(batch.column("text"))):
                words = word_hashes(text, known)
                # a very long text is cut in parts that share width - 1 words, so that no window is lost
                for low in range(0, len(words) - width + 1, _BLOCK):
                    parts.append(words[low : low + _BLOCK + width - 1])
                    rows.append(i)
                    shifts.append(low)
                    size += len(parts[-1])
                    if size >= _BLOCK:
                        yield flush(batch)
                        parts, rows, shifts, size = [], [], [], 0
            if parts:
                yield flush(batch)
                parts, rows, shifts, size = [], [], [], 0

    return run


def _windows(width: int):
    """Each window of the sections ``ats`` of a text, by a hash of 128 bits of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashed = _Hashes(), xxhash.xxh3_128_digest
        for batch in sliced(batches, "text", 1 << 22):
            for i, (text, ats) in enumerate(zip(as_bytes(batch.column("text")), batch.column("ats"))):
                words = word_hashes(text, known)
                view = memoryview(np.ascontiguousarray(words)).cast("B")
                at = ats.values.to_numpy()
                start, count = at >> 16, (at >> 8 & 255) - width + 1
                place = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                digest = b"".join(hashed(view[8 * p : 8 * (p + width)]) for p in place.tolist())
                key = np.frombuffer(digest, np.int64).reshape(-1, 2)
                pick = pa.array(np.full(len(place), i))
                yield pa.record_batch([pa.array(key[:, 0]), pa.array(key[:, 1]), batch.column("doc").take(pick), batch.column("tag").take(pick), pa.array(place)], ["a", "b", "doc", "tag", "start"])

    return run


def _matched(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``keys`` (on, n, ...), which has how many rows a key has.

    Rows of frequent keys are matched without a shuffle, so that no key fills a task.
    """
    frequent = checkpoint(keys.where(F.col("n") > FREQUENT).drop("n"))
    often = F.broadcast(frequent) if frequent.count() <= MOST_BROADCAST else frequent
    rest = rows.join(often.select(*on), on, "left_anti").join(keys.where(F.col("n") <= FREQUENT).drop("n"), on)
    return rows.join(often, on).unionByName(rest)


def factors(texts: DataFrame, width: int = 20) -> DataFrame:
    """(doc, tag, start, stop, source, source_start) of words of ``texts`` (doc, tag, text) whose ``width`` words an earlier place has.

    They overlap, and together are all windows that occur earlier: at a smaller ``doc`` (null first), or in
    the same one at an earlier word.  ``source`` is the ``doc`` of the first occurrence.  ``tag`` tells rows apart that share a ``doc``.
    """
    kind = texts.schema["doc"].dataType.simpleString()
    spark = texts.sparkSession
    found, path = staged(texts.mapInArrow(_sections(width), f"anchor long, content long, doc {kind}, tag long, at long"))
    # counts are combined before the shuffle; an anchor that occurs once has no repeated window
    used = [path]
    again, path = staged(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    used.append(path)
    hits, path = staged(_matched(found, again, ["anchor"]))
    used.append(path)
    # the index: each different section with its first place
    first = F.min(F.struct("doc", "at", "tag")).alias("first")
    reference, path = staged(hits.groupBy("anchor", "content").agg(F.count("*").alias("n"), first))
    used.append(path)
    copied = _matched(hits, reference.where("n > 1").select("anchor", "content", "n", F.col("first.doc").alias("source"), F.col("first.at").alias("source_at")), ["anchor", "content"])
    later = ~(F.col("doc").eqNullSafe(F.col("source")) & (F.col("at") == F.col("source_at")))
    start, length = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255)
    whole = copied.where(later).select("doc", "tag", start.alias("start"), (start + length).alias("stop"), "source", F.shiftright("source_at", 16).alias("source_start"))
    # borders: sections that differ around one anchor, looked up window by window
    mixed = reference.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    border = _matched(reference.select("anchor", "first.*"), mixed, ["anchor"])
    border = border.groupBy("doc", "tag").agg(F.collect_list("at").alias("ats"))
    own = texts.alias("t").join(border.alias("b"), F.col("t.tag").eqNullSafe(F.col("b.tag")) & F.col("t.doc").eqNullSafe(F.col("b.doc"))).select("t.doc", "t.tag", "text", "ats")
    windows, path = staged(own.mapInArrow(_windows(width), f"a long, b long, doc {kind}, tag long, start long"))
    used.append(path)
    place = F.min(F.struct("doc", "start")).alias("first")
    known = windows.groupBy("a", "b").agg(F.count("*").alias("n"), place).where("n > 1")
    known, path = staged(known.select("a", "b", "n", F.col("first.doc").alias("source"), F.col("first.start").alias("source_start")))
    used.append(path)
    single = _matched(windows, known, ["a", "b"]).where(~(F.col("doc").eqNullSafe(F.col("source")) & (F.col("start") == F.col("source_start"))))
    spans, _ = staged(whole.unionByName(single.select("doc", "tag", "start", (F.col("start") + width).alias("stop"), "source", "source_start")))
    for path in used:
        drop_folder(spark, path)
    return spans


def longest(pieces: list[dict]) -> list[dict]:
    """Pieces (start, stop, source, source_start) in order, joined as long as the source goes on too."""
    out: list[dict] = []
    for x in sorted(pieces, key=lambda x: (x["start"], -x["stop"])):
        last = out[-1] if out else None
        if last and x["source"] == last["source"] and x["source_start"] - x["start"] == last["source_start"] - last["start"] and x["start"] <= last["stop"]:
            last["stop"] = max(last["stop"], x["stop"])
        elif not last or x["stop"] > last["stop"]:
            out.append(dict(x))
    return out


def _kept(text: bytes, spans: list[dict]) -> tuple[int, int, bytes]:
    """Number of words, of those within ``spans``, and the others joined by one space."""
    n, removed, out = 0, 0, []
    for piece in pieces_at_spaces(text):
        words = piece.split()
        drop = np.zeros(len(words), bool)
        for x in spans:
            drop[max(0, x["start"] - n) : max(0, x["stop"] - n)] = True
        n += len(words)
        gone = int(drop.sum())
        removed += gone
        if gone < len(words):
            out.append(b" ".join(w for w, d in zip(words, drop.tolist()) if not d) if gone else b" ".join(words))
    return n, removed, b" ".join(out)


def _cleaned(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    piece = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("source", kind), ("source_start", pa.int64())]))
    for batch in sliced(batches, "text", 1 << 22):
        rows = []
        for text, pieces in zip(as_bytes(batch.column("text")), batch.column("pieces").to_pylist()):
            spans = longest(pieces or [])
            n, removed, kept = _kept(text, spans)
            rows.append((n, removed, hashlib.sha256(kept).hexdigest(), kept.decode(), spans))
        n, removed, digest, kept, spans = zip(*rows)
        yield pa.record_batch(
            [batch.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.string()), pa.array(spans, piece)],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "factors"],
        )


def without_repeated_windows(documents: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, factors) of each document.

    Each word covered by a window of ``width`` consecutive words that also starts earlier, in a document with a
    smaller id or in the same one, is removed; windows are judged on the input and never cross texts.
    ``kept`` are the other words, joined by one space; ``factors`` (start, stop, source, source_start, in words) are the removed
    passages and where they occur first.  A null text has no words.  Rows that share an id, repeated
    rows too, count as versions of one document: of a window that they have at the same place none is
    earlier.  Rows without an id are such versions of one that comes before all others.  Other columns are
    ignored; an empty table gives no rows; very long texts are read piece by piece.  ``width`` is from ``GRAM`` to ``MOST_WIDTH``.
    """
    if not GRAM <= width <= MOST_WIDTH:
        raise ValueError(f"windows of {GRAM} to {MOST_WIDTH} words can be found, not of {width}")
    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("tag", F.xxhash64("doc", "text"))
    pieces = F.collect_set(F.struct("start", "stop", "source", "source_start")).alias("pieces")
    found = factors(texts.select("doc", "tag", "text"), width).groupBy("doc", "tag").agg(pieces)
    same = F.col("t.tag").eqNullSafe(F.col("p.tag")) & F.col("t.doc").eqNullSafe(F.col("p.doc"))
    rows = texts.alias("t").join(found.alias("p"), same, "left").select("t.doc", "text", "pieces")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cleaned(iter([batch]), batch.schema.field("doc").type)

    piece = f"array<struct<start: long, stop: long, source: {kind}, source_start: long>>"
    return rows.mapInArrow(cleaned, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string, factors {piece}")
