"""Packing documents into sequences of a fixed length.

Only the histogram of piece lengths, which has as many rows as a sequence has tokens whatever
the corpus, goes to the driver.  There the Martello-Toth dominance criteria fix small sets of
lengths for good, the remaining instance goes to best-fit decreasing, and both give patterns:
so many sequences filled alike.  The executors then number the pieces of each length and look
up their places in the patterns.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trailweave.llm.blocks import sliced
from trailweave.llm.token_counts import load_tokenizer
from trailweave.session import checkpoint, join_checked

#: Where the pre-tokenizer surely breaks.
_SPACES = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: Control characters at which str.split() also breaks, though the library takes them as symbols.
_CONTROLS = "\x1c\x1d\x1e\x1f"
#: Words that normalization only lower-cases and that pre-tokenization cuts at changes between letters, digits and
#: symbols: ASCII but for apostrophes (contractions) and "<" (special tokens), and the letters of Latin-1.
_PLAIN = re.compile(r"[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PARTS_OF_PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_WORD_CHARS, _WORDS_KEPT = 32, 400_000
#: The settings of a tokenizer file that make a text's ids its words' ids, and words cut as below (fixed values).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class WordIds:
    """Token ids of texts as little-endian uint32 bytes, each distinct word encoded by the library once.

    The tokenizer drops white space and no token crosses it, so a text's ids are its words' ids.
    A plain word is cut here as the pre-tokenizer cuts it, and its parts go to the library's
    model; any other word takes the library's whole way.  The stores of words and parts are
    emptied when they hold ``_WORDS_KEPT``; longer ones aren't kept.
    """

    def __init__(self, path: str):
        self.tokenizer, self.model = load_tokenizer(path), load_tokenizer(path).model
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.letters = dict(enumerate(_byte_letters()))

    def _part(self, part: str) -> bytes:
        written = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        if len(part) <= _WORD_CHARS:
            self.parts[part] = ids
        return ids

    def _plain(self, word: str) -> bytes:
        get = self.parts.get
        return b"".join([get(x) or self._part(x) for x in _PARTS_OF_PLAIN.findall(word.lower())])

    def of(self, texts: list[str]) -> list[bytes]:
        split = [_SPACES.split(x) if any(map(x.__contains__, _CONTROLS)) else x.split() for x in texts]
        for store in (self.known, self.parts):
            if len(store) > _WORDS_KEPT:
                store.clear()
        known, others = self.known, []
        new = {w for words in split for w in words if w not in known}
        for word in new:
            if _PLAIN.fullmatch(word):
                known[word] = self._plain(word)
            else:
                others.append(word)
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            for word, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[word] = array("I", e.ids).tobytes()
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > _WORD_CHARS:
                del known[word]
        return out


class WholeIds:
    """Token ids of whole texts by any tokenizer of the library, as ``WordIds``."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)

    def of(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def text_ids(path: str) -> WordIds | WholeIds:
    """Encoding by words where the tokenizer's file has the settings under which that is exact."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    plain = found.get("normalizer") == _NORMALIZER and found.get("pre_tokenizer") == _PRE_TOKENIZER and not found.get("post_processor")
    return WordIds(path) if plain and all("<" in x["content"] for x in found.get("added_tokens", ())) else WholeIds(path)


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # pieces of each length are numbered within the task
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64).tolist()
        words = text_ids(path)
        for batch in sliced(batches, "text", 1 << 21):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.of(batch.column("text").to_pylist())):
                ids += bytes(4)  # the end of the document: id 0
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    n = len(part) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            doc, piece, *rest = zip(*rows)
            yield pa.record_batch(
                [pa.array(doc, batch.schema.field("doc_id").type), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in rest)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return run


def token_pieces(
    documents: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, nth): each document's ids and a closing 0, cut at ``size``.

    ``task`` and ``nth`` number the pieces of a length as the tasks that make them meet them, so
    they mean something only once the rows are written.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(_pieces(tokenizer_path, size), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long")


class _Lengths:
    """A histogram of lengths with the sorted list of those left."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.left = sorted(self.n)

    def take(self, length: int, count: int) -> None:
        self.n[length] -= count
        if not self.n[length]:
            del self.n[length]
            self.left.pop(bisect_left(self.left, length))

    def largest(self, most: int, without: dict[int, int]) -> int:
        """The largest length up to ``most`` beyond what ``without`` uses; 0 if there is none."""
        k = bisect_left(self.left, most + 1) - 1
        while k >= 0 and self.n[self.left[k]] <= without.get(self.left[k], 0):
            k -= 1
        return self.left[k] if k >= 0 else 0

    def smallest(self, how_many: int, without: int) -> int:
        """Sum of the ``how_many`` smallest items besides one of length ``without``; -1: not so many."""
        total, need = 0, how_many
        for x in self.left:
            k = min(need, self.n[x] - (x == without))
            total, need = total + k * x, need - k
            if not need:
                return total
        return -1


def _dominating(lengths: _Lengths, j: int, size: int) -> tuple[int, ...] | None:
    """A set with ``j`` that dominates every feasible set with ``j``, by the Martello-Toth criteria.

    A set dominates another if its items can be matched with disjoint parts of the other that
    are no longer, so that some best packing has it.
    """
    room = size - j
    best = lengths.largest(room, {j: 1})
    if not best:
        return (j,)  # nothing else fits
    if best == room:
        return j, best  # whatever else shares the sequence fits in the place of this one
    fits = lambda k: 0 <= lengths.smallest(k, j) <= room
    if not fits(2):
        return j, best  # one more item at most
    if fits(3):
        return None
    # two more items at most: the pair with the largest sum
    pair = (0, 0, 0)
    for a in reversed(lengths.left[: bisect_left(lengths.left, room)]):
        if 2 * a <= pair[0] or a + a < pair[0]:
            break
        if lengths.n[a] > (a == j) and (b := lengths.largest(min(a, room - a), {j: 1, a: 1 + (a == j)})):
            pair = max(pair, (a + b, a, b))
    total, a, b = pair
    if best >= total:
        return j, best
    # the pair dominates if it has the largest item that fits, and no pair has a larger second one
    above = [x for x in lengths.left[bisect_left(lengths.left, b + 1) :] if lengths.n[x] > (x == j)][:2]
    if a == best and (not above or above[0] + (above[0] if lengths.n[above[0]] > 1 + (above[0] == j) else above[-1] if len(above) > 1 else size) > room):
        return j, a, b
    return None


def patterns(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a sequence, how many such sequences)] that pack all items of the histogram."""
    lengths, out = _Lengths(counts), []
    for j in sorted(counts, reverse=True):
        while j in lengths.n and (found := _dominating(lengths, j, size)):
            need = {x: found.count(x) for x in found}
            # as many at once as leave the set dominating: a pair that fills a sequence always, others
            # while the next lengths to choose from stay
            times = min(lengths.n[x] // k for x, k in need.items())
            for x, k in need.items():
                lengths.take(x, k * times)
            out.append((found, times))
    # best-fit decreasing over what is left; alike sequences are held together
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(items: tuple[int, ...], room: int, count: int) -> None:
        if count and room:
            if room not in by_room:
                by_room[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            by_room[room].append((items, count))
        elif count:
            out.append((items, count))

    for x in sorted(lengths.n, reverse=True):
        n = lengths.n[x]
        while n:
            at = bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                items, count = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                room, items, count = size, (), n
            k = room // x
            full = min(count, n // k)
            put(items + (x,) * k, room - k * x, full)
            n, count = n - full * k, count - full
            if n and n < k and count:
                put(items + (x,) * n, room - n * x, 1)
                n, count = 0, count - 1
            if items:
                put(items, room, count)
    return out + [x for room in rooms for x in by_room[room]]


def _places(found: list[tuple[tuple[int, ...], int]]) -> list[np.ndarray]:
    """Sorted arrays (length and first rank as one key, times, first sequence, offset): runs of ranks."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for items, times in found:
        offset = 0
        for x in items:
            at = rank.get(x, 0)
            rows.append((x << 44 | at, times, sequence, offset))
            rank[x] = at + times
            offset += x
        sequence += times
    return [np.array(x, np.int64) for x in zip(*sorted(rows))]


def _placed(places: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _, sequence, offset = places
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            key = length << 44 | rank
            at = np.searchsorted(keys, key, "right") - 1
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(sequence[at] + key - keys[at]), pa.array(offset[at])],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, task, nth), as ``token_pieces`` makes them, with sequence_id and offset.

    Pieces of equal length are interchangeable, so the number of a piece in the order of tasks is
    its rank: no task sorts or holds all pieces of a length.
    """
    pieces = checkpoint(pieces)
    sizes = checkpoint(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # as many rows as a sequence has tokens
    places = _places(patterns(counts, size)) if counts else [np.zeros(0, np.int64)] * 4
    # numbers of each task go on from those of the tasks before it
    before = sizes.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("first"))
    ranked = join_checked(pieces, before, ["length", "task"], "inner")
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(_placed(places), schema)


def packed_documents(
    documents: DataFrame, tokenizer_path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document's ids, closed by a 0, are cut only if longer than ``size``.  Null and empty texts
    are one piece with the closing 0 alone.  Repeated rows are packed as often as they occur; a
    null id stays null.  Other columns are ignored; an empty table gives no pieces.  Of a very long
    text a task holds the words and ids.  A tokenizer file other than those whose settings are
    known here is used through the library on whole texts.
    """
    return pack(token_pieces(documents, tokenizer_path, size, id_col, text_col), size)
