"""SimHash near-duplicates by anchor-point covering.

A fingerprint has one or more lanes of 64 bits, and each lane two halves.  If two fingerprints of
n lanes differ in at most 4n - 1 bits (3 for one lane), one of the 2n halves differs in at most 1.
The anchors of a half are the words of the Hamming [31, 26] code on its low 31 bits, which cover
every half within radius 1.  A fingerprint is at home at its nearest anchor and is replicated to
every anchor within covering radius plus the half's threshold, 1 + 1 = 2: these are 1 or 16.
Two rows within the threshold have each an anchor of the other's home; one meeting is enough, so
only the copies at anchors below a row's own home are made.  Comparing each home row with the
rows of its anchor finds every link.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.blocks import as_bytes, free_name, pieces_at_spaces, sliced
from trailweave.llm.components import connected_components
from trailweave.session import checkpoint, join_checked

SEED = 42
#: Home rows of an anchor from which on its rows are dealt over several tasks.
HOT_ANCHOR = 4096
_CHUNK = 1 << 15
#: Rows of one anchor that a task holds at most, besides those at home there.
_HELD = 1 << 16
#: Linked nodes that a task knows at once; their classes go out before more are met.
_KNOWN = 200_000


def features(text: bytes, width: int) -> list[bytes]:
    """The word shingles, repeats included; a text of fewer words is one shingle."""
    return [x for part in shingle_runs(text, width) for x in part]


def shingle_runs(text: bytes, width: int) -> Iterator[list[bytes]]:
    """The word shingles in order, those of a few MB of text at a time."""
    carried: list[bytes] = []
    first = True
    for piece in pieces_at_spaces(text):
        words = carried + piece.lower().split()  # on bytes: A-Z only, and the six ASCII white spaces
        carried = words[len(words) - width + 1 :] if width > 1 else []
        if len(words) < width:
            carried = words
            continue
        first = False
        joined = b" ".join(words)
        ends = list(itertools.accumulate(map(len, words), lambda a, n: a + 1 + n))
        starts = [0, *(e + 1 for e in ends)]
        yield [joined[s:e] for s, e in zip(starts, ends[width - 1 :])]
    if first and carried:
        yield [b" ".join(carried)]


def fingerprint(text: bytes, width: int = 3, lanes: int = 1, once: bool = False) -> list[int]:
    """The lanes: bit i is 1 if over half the features' hashes have it; no words: 0.

    A feature's hash in lane k is its XXH64 with seed SEED + k.  ``once``: repeated features count once.
    """
    runs: Iterator[list[bytes]] | list[list[bytes]] = shingle_runs(text, width)
    if once:
        runs = [list({x for part in runs for x in part})]
    digest, total = xxhash.xxh64_intdigest, 0
    counts = np.zeros((lanes, 64), np.int64)
    for found in runs:
        total += len(found)
        for lane in range(lanes):
            seed = SEED + lane
            for at in range(0, len(found), _CHUNK):
                part = found[at : at + _CHUNK]
                octets = np.fromiter((digest(x, seed) for x in part), np.uint64, len(part)).astype(">u8").view(np.uint8)
                counts[lane] += np.unpackbits(octets.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * c > total).tobytes(), "big") for c in counts]


def node_of(prints: np.ndarray) -> np.ndarray:
    """One number for each row of lanes: the lane itself if there is one, else a hash of all."""
    node = prints[:, 0].copy()
    for k in range(1, prints.shape[1]):
        node = (node ^ node >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + prints[:, k]
    return node.view(np.int64)


def _printed(width: int, lanes: int, once: bool):
    names = [f"f{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 23):
            prints = np.array([fingerprint(x, width, lanes, once) for x in as_bytes(batch.column("text"))], np.uint64)
            yield pa.record_batch(
                [batch.column("rid"), batch.column("doc_id"), pa.array(node_of(prints)), *(pa.array(prints[:, k].view(np.int64)) for k in range(lanes))],
                ["rid", "doc_id", "node", *names],
            )

    return run


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, doc_id, text), null texts as empty."""
    return documents.select(row_key(id_col, text_col).alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fingerprints(documents: DataFrame, width: int, lanes: int, once: bool, id_col: str, text_col: str) -> DataFrame:
    """(rid, doc_id, node, f0, ...) of each document."""
    kind = documents.schema[id_col].dataType.simpleString()
    return keyed(documents, id_col, text_col).mapInArrow(_printed(width, lanes, once), f"rid long, doc_id {kind}, node long" + "".join(f", f{k} long" for k in range(lanes)))


def _masks() -> np.ndarray:
    """For each syndrome, what to flip to come to each anchor within distance 2, the nearest first.

    Bit p - 1 of a half is position p of the code, so the syndrome is the sum of the positions set.
    A syndrome of 0 is an anchor itself, the only one so near; its row repeats that mask.
    """
    rows = [[0] * 16]
    for s in range(1, 32):
        pairs = [(1 << a - 1) | (1 << (a ^ s) - 1) for a in range(1, 32) if a != s and a < a ^ s]
        rows.append([1 << s - 1, *pairs])
    return np.array(rows, np.int64)


_POSITIONS = np.arange(1, 32, dtype=np.int64)


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the print, anchor key, whether it is the print's home) for all halves."""
    masks, found = _masks(), []
    for half in range(2 * prints.shape[1]):
        word = (prints[:, half // 2] >> np.uint64(32 * (half % 2))).astype(np.int64) & 0x7FFFFFFF
        syndrome = np.zeros(len(word), np.int64)
        for p in _POSITIONS:
            syndrome ^= np.where(word >> (p - 1) & 1, p, 0)
        keys = (word[:, None] ^ masks[syndrome]) | half << 32
        # of two homes, the rows at home at the greater one are copied to the lesser: each pair meets once
        wanted = keys < keys[:, :1]
        wanted[:, 0] = True
        wanted[:, 1:] &= (syndrome != 0)[:, None]
        who, which = np.nonzero(wanted)
        found.append((who, keys[who, which], which == 0))
    return tuple(np.concatenate(x) for x in zip(*found))


def _lanes(batch: pa.RecordBatch) -> np.ndarray:
    names = [x for x in batch.schema.names if x[0] == "f"]
    return np.stack([batch.column(x).to_numpy().view(np.uint64) for x in names], axis=1)


def _replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 4096):
            prints = _lanes(batch.slice(at, 4096))
            who, keys, home = anchors(prints)
            columns = [pa.array(prints[who, k].view(np.int64)) for k in range(prints.shape[1])]
            yield pa.record_batch([pa.array(keys), pa.array(home), *columns], ["anchor", "home", *(f"f{k}" for k in range(len(columns)))])


class Stars:
    """Classes of linked nodes."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def link(self, a: Iterable[int], b: Iterable[int]) -> list[tuple[int, int]]:
        """Those of the links (a, b) that join what the links before them have not joined."""
        kept = []
        for x, y in zip(a, b):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                kept.append((x, y))
        return kept

    def links(self) -> list[tuple[int, int]]:
        """(node, smallest of its class) of all nodes linked so far, which are forgotten."""
        found = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        self.up = {}
        return found


@dataclass
class Cell:
    """Rows sorted by anchor, those at home first: key of the anchor, home, node, its lanes."""

    keys: np.ndarray
    home: np.ndarray
    nodes: np.ndarray
    prints: np.ndarray

    def rows(self, which) -> Cell:
        return Cell(*(x[which] for x in (self.keys, self.home, self.nodes, self.prints)))

    def then(self, other: Cell) -> Cell:
        return Cell(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("keys", "home", "nodes", "prints")))

    def __len__(self) -> int:
        return len(self.keys)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Cell:
        keys = batch.column("anchor").to_numpy() << 20 | batch.column("salt").to_numpy()
        prints = _lanes(batch)
        nodes = batch.column("node").to_numpy() if "node" in batch.schema.names else node_of(prints)
        return cls(keys, batch.column("home").to_numpy(zero_copy_only=False).astype(bool), nodes, prints)


def _close_pairs(c: Cell, most: int) -> Iterator[tuple[list[int], list[int]]]:
    """Pairs of nodes within ``most`` bits at an anchor where one of them is at home; of a large anchor's a spanning forest."""
    cuts = np.flatnonzero(np.diff(c.keys)) + 1
    starts, stops = np.r_[0, cuts], np.r_[cuts, len(c)]
    sizes = stops - starts
    small = (sizes > 1) & (sizes <= 64)
    s = c.rows(np.repeat(small, sizes))
    for shift in range(1, int(sizes[small].max(initial=0))):
        near = np.flatnonzero((s.keys[shift:] == s.keys[:-shift]) & (s.home[shift:] | s.home[:-shift]) & (s.nodes[shift:] != s.nodes[:-shift]))
        near = near[np.bitwise_count(s.prints[near] ^ s.prints[near + shift]).sum(axis=1, dtype=np.int64) <= most]
        yield s.nodes[near].tolist(), s.nodes[near + shift].tolist()
    for low, high in zip(starts[sizes > 64], stops[sizes > 64]):
        g = c.rows(slice(low, high))
        label = np.arange(len(g))
        for i in np.flatnonzero(g.home):
            near = np.flatnonzero(label != label[i])
            near = near[np.bitwise_count(g.prints[near] ^ g.prints[i]).sum(axis=1, dtype=np.int64) <= most]
            if len(near):
                # one row of each label, which then becomes this row's label
                near = near[np.unique(label[near], return_index=True)[1]]
                joined = np.zeros(len(label), bool)
                joined[label[near]] = True
                label[joined[label]] = label[i]
                yield [int(g.nodes[i])] * len(near), g.nodes[near].tolist()


def _compared(most: int, stars: bool):
    def record(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: Cell | None = None
        known = Stars()

        def taken(rows: Cell) -> pa.RecordBatch:
            kept = [x for a, b in _close_pairs(rows, most) for x in known.link(a, b)]
            return record([] if stars else kept)

        for batch in batches:
            if not len(batch):
                continue
            now = Cell.of(batch) if rest is None else rest.then(Cell.of(batch))
            # the last anchor of a batch may go on in the next one
            cut = int(np.searchsorted(now.keys, now.keys[-1]))
            yield taken(now.rows(slice(0, cut)))
            rest = now.rows(slice(cut, None))
            if len(rest) > _HELD:
                # all its home rows are here, as they come first; further copies need only these
                yield taken(rest)
                rest = rest.rows(rest.home)
            if len(known.up) > _KNOWN:
                found = known.links()
                yield record(found if stars else [])
        if rest is not None:
            yield taken(rest)
        yield record(known.links() if stars else [])

    return run


def anchor_pairs(rows: DataFrame, most: int, stars: bool = False) -> DataFrame:
    """Of the pairs (a, b) within ``most`` bits of which one is at home at an anchor of the other, a spanning forest.

    ``stars``: instead of these pairs, each node with the smallest node of the class that a task's
    pairs make; so a dense group is few links however many anchors its rows share.  ``rows``: (anchor, home, f0, ... and, if the lanes
    don't name the node, node).  An anchor with many home rows is dealt over several tasks:
    its home rows are copied to each of them and its other rows are split.
    """
    crowded = rows.where("home").groupBy("anchor").count().where(F.col("count") >= HOT_ANCHOR)
    crowded = checkpoint(crowded.select("anchor", F.ceil(F.col("count") / HOT_ANCHOR).cast("int").alias("parts")))
    if crowded.isEmpty():
        salted = rows.withColumn("salt", F.lit(0))
    else:
        dealt = join_checked(rows, crowded, "anchor")
        # a home row goes to all parts, as home; any other row goes to its own part
        own = F.pmod(F.xxhash64(*[c for c in rows.columns if c[0] == "f" or c == "node"]), F.coalesce("parts", F.lit(1))).cast("int")
        to = F.when(F.col("home"), F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).otherwise(F.array(own))
        salted = dealt.withColumn("salt", F.explode(to)).drop("parts")
    placed = salted.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("home"))
    return placed.mapInArrow(_compared(most, stars), "a long, b long")


def print_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) between nodes of the distinct fingerprints ``prints`` (f0, ...).

    With n lanes, all pairs within ``most`` bits are connected if ``most`` is 4n - 1 or less;
    beyond that, those of them that have a half within 1 bit.
    """
    names = [x for x in prints.columns if x[0] == "f"]
    rows = prints.select(*names).mapInArrow(_replicated, "anchor long, home boolean" + "".join(f", {x} long" for x in names))
    return anchor_pairs(rows, most)


def print_groups(documents: DataFrame, width: int = 3, most: int = 3, lanes: int = 1, once: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, f0, group) of each row: a key of id and text, and a number for each class of linked fingerprints."""
    printed = checkpoint(fingerprints(documents, width, lanes, once, id_col, text_col))
    prints = checkpoint(printed.groupBy("node").agg(*(F.first(f"f{k}").alias(f"f{k}") for k in range(lanes))))
    nodes = connected_components(print_links(prints, most))
    # written out, so that Spark can split a frequent fingerprint in the join
    known = checkpoint(prints.select("node").join(nodes, "node", "left").select("node", F.coalesce("component", "node").alias("group")))
    return printed.join(known, "node").select("rid", "doc_id", "f0", "group")


def least_ids(groups: DataFrame) -> DataFrame:
    """``groups`` (doc_id, group, ...) with ``component_id``, the smallest id of each group."""
    groups = checkpoint(groups)
    least = checkpoint(groups.groupBy("group").agg(F.min("doc_id").alias("component_id")))
    return groups.join(least, "group")


def near_duplicates(
    documents: DataFrame, width: int = 3, most: int = 3, lanes: int = 1, once: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id): first lane of the fingerprint and smallest id reachable over links.

    ``width``: words of a shingle; ``once``: whether repeated shingles count once; ``most``:
    differing bits of a link, over all ``lanes``.  Texts without words, null ones too, have
    fingerprint zero and are linked like any other; very long texts are read in pieces.  Rows with
    a null id are compared as the others; the component of a group without any id is null.
    Repeated rows, also such as share an id only, are rows of their own.  Other columns are
    ignored; an empty table gives no rows.
    """
    found = least_ids(print_groups(documents, width, most, lanes, once, id_col, text_col))
    return found.select(F.col("doc_id").alias(id_col), F.col("f0").alias("fp"), "component_id")


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` with all columns, and of each near-duplicate group only the row with the smallest id.

    Rows without an id stay, as there is nothing to choose by.  Of wholly repeated rows one stays;
    rows that share an id but not their text are judged each by its own text.
    """
    return first_of_each(documents, print_groups(documents, id_col=id_col, text_col=text_col, **options), id_col, text_col)


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of id and text; null ids and null texts have theirs too."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def first_of_each(documents: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` without those that share a group with a smaller id, by ``groups`` (rid, doc_id, group)."""
    found = checkpoint(groups.where("doc_id is not null").select("rid", "doc_id", "group"))
    best = found.groupBy("group").agg(F.min(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("n")).where("n > 1")
    shared = checkpoint(join_checked(found, best.select("group", F.col("best.rid").alias("first")), "group", "inner"))
    rid = free_name(documents, "rid")
    named = lambda x: x.select(F.col("rid").alias(rid)).distinct()
    rows = documents.withColumn(rid, row_key(id_col, text_col))
    rows = join_checked(rows, named(shared.where("rid <> first")), rid, "left_anti")
    repeated = checkpoint(named(shared.where("rid = first").groupBy("rid").count().where("count > 1")))
    if repeated.isEmpty():
        return rows.select(*documents.columns)
    once = join_checked(rows, repeated, rid, "left_semi").dropDuplicates([rid])
    return join_checked(rows, repeated, rid, "left_anti").unionByName(once).select(*documents.columns)


def hex16(fp: Column) -> Column:
    """A signed long as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
