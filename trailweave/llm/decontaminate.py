"""Benchmark passages in documents, by a distributed positional inverted index.

``build_index`` reads the documents once and stores, for each block of documents and each of its
terms, the positions of the term.  A search joins the stored postings with the terms of the
queries, so neither the texts nor the postings of other terms are read again, however many
queries there are.  A phrase starts from its rarest term, by counts over the whole corpus: that
term's positions less its offset are the candidate starts, which are intersected with the
offset-adjusted lists of the other terms, rarer ones first.  Proximity matches are found from the
same lists: all the words of a phrase within a stretch of bounded length, in any order.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.blocks import as_bytes, free_name, pieces_at_spaces, sliced
from trailweave.session import ensure_checkpoint_dir, join_checked

#: Lower-cases A-Z and turns every other ASCII character that isn't a letter or digit into a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of query text that go to the executors at once.
QUERY_BYTES = 4 << 20
#: Bytes of texts in a block of the index; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
_CANDIDATES = 1 << 20
#: No word is empty, so this term holds where the documents of a block begin.
_STARTS = ""


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class _Terms(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _term_ids(text: bytes, terms: _Terms) -> np.ndarray:
    get = terms.__getitem__
    parts = [np.fromiter(map(get, words), np.int32, len(words)) for words in map(words_of, pieces_at_spaces(text))]
    return np.concatenate(parts)


def _gaps(positions: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Each list's first position and then its differences, which are small."""
    gaps = np.diff(positions, prepend=np.int32(0))
    gaps[firsts] = positions[firsts]
    return gaps


def _posted(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in sliced(batches, "text", block_bytes):
            block, terms = next(number), _Terms()
            ids = [_term_ids(x, terms) for x in as_bytes(batch.column("text"))]
            sizes = np.array([len(x) for x in ids], np.int64)
            # a place without a term between documents: no phrase goes on into the next one
            starts = np.cumsum(sizes + 1) - sizes - 1
            every = np.concatenate(ids)
            place = (np.arange(len(every)) + np.repeat(np.arange(len(ids)), sizes)).astype(np.int32)
            counts = np.bincount(every, minlength=len(terms))
            firsts = np.r_[0, np.cumsum(counts)][:-1].astype(np.int64)
            lists = _gaps(place[np.argsort(every, kind="stable")], firsts) if len(every) else place
            at = _gaps(starts.astype(np.int32), np.zeros(1, np.int64))
            n = len(terms) + 1
            offsets = np.r_[0, np.cumsum(np.r_[counts, len(at)])].astype(np.int32)
            names = ["block", "term", "gaps", "rid", "doc_id", "place", "n_words"]
            kind = batch.schema.field("doc_id").type
            yield pa.record_batch(
                [
                    pa.array(np.full(n, block)), pa.array([*(x.decode() for x in terms), _STARTS]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.r_[lists, at])),
                    pa.nulls(n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()),
                ],
                names,
            )
            n = len(batch)
            yield pa.record_batch(
                [
                    pa.array(np.full(n, block)), pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int32())), batch.column("rid"), batch.column("doc_id"),
                    pa.array(np.arange(n, dtype=np.int32)), pa.array(sizes),
                ],
                names,
            )

    return run


@dataclass
class Index:
    """A stored index: ``postings`` (block, term, gaps) and ``documents`` (block, place, rid, doc_id, n_words)."""

    postings: DataFrame
    documents: DataFrame


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Index:
    """Writes the index of all documents as one table in the shared folder.

    A null text has no words; null and repeated ids are kept.  ``rid`` is a hash of id and text.
    The words of a long text are taken a few MB at a time; of all its words a task holds numbers only.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.xxhash64(F.col(id_col), text).alias("rid"), F.col(id_col).alias("doc_id"), text.alias("text"))
    posted = rows.mapInArrow(_posted(block_bytes), f"block long, term string, gaps array<int>, rid long, doc_id {kind}, place int, n_words long")
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    posted.write.parquet(path)
    stored = spark.read.parquet(path)
    return Index(stored.where("term is not null").select("block", "term", "gaps"), stored.where("term is null").select("block", "place", "rid", "doc_id", "n_words"))


@dataclass
class Queries:
    """A part of the query set: items, its vocabulary, and its phrases by length."""

    items: list
    words: list[list[bytes]]
    window: int

    def __post_init__(self):
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(self.words)))}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, words in enumerate(self.words):
            ids = tuple(self.vocabulary[w] for w in words)
            width = min(self.window, len(ids))
            for k in range(len(ids) - width + 1 if ids else 0):
                found.setdefault(width, {}).setdefault(ids[k : k + width], set()).add(item)
        #: for each length: the distinct phrases, and the items that have each
        self.phrases = {width: (np.array(list(x), np.int64), [sorted(y) for y in x.values()]) for width, x in found.items()}

    def rarest_first(self, counts: dict[str, int]) -> None:
        """Drops phrases with a word that the corpus lacks and orders the terms of each other one by their counts."""
        n = np.zeros(len(self.vocabulary), np.int64)
        for w, k in self.vocabulary.items():
            n[k] = counts.get(w.decode(), 0)
        self.order = {}
        for width, (phrases, owners) in self.phrases.items():
            stay = np.flatnonzero(n[phrases].min(axis=1))
            self.phrases[width] = (phrases[stay], [owners[k] for k in stay])
            self.order[width] = np.argsort(n[phrases[stay]], axis=1, kind="stable")


def query_parts(queries: DataFrame, window: int, most: int, item_col: str, text_col: str) -> Iterator[Queries]:
    """The query set in parts of about ``most`` bytes, read row by row."""
    items, words, size = [], [], 0
    rows = queries.select(F.col(item_col), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator()
    for item, text in rows:
        items.append(item)
        words.append(words_of(text.encode()))
        size += len(text)
        if size >= most:
            yield Queries(items, words, window)
            items, words, size = [], [], 0
    yield Queries(items, words, window)


class Lists:
    """The postings of one block for the terms of a query part."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, gaps: np.ndarray, n_terms: int):
        order = np.argsort(terms)
        ends = np.cumsum(sizes)
        positions = np.cumsum(gaps, dtype=np.int64)
        positions -= np.repeat(np.r_[0, positions][ends - sizes], sizes)
        by_term = np.argsort(np.repeat(terms, sizes), kind="stable")
        self.positions = positions[by_term]
        self.sizes = np.zeros(n_terms + 1, np.int64)
        self.sizes[terms[order]] = sizes[order]
        self.firsts = np.cumsum(self.sizes) - self.sizes
        #: term and position as one number, in order: where a list is intersected with shifted candidates
        self.keys = np.repeat(np.sort(terms), sizes[order]) << 32 | self.positions

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.firsts[term] : self.firsts[term] + self.sizes[term]]

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        key = terms << 32 | positions
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def nearest(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Distance from each position to the nearest one of its term in this block."""
        at = np.searchsorted(self.keys, terms << 32 | positions)
        far = np.int64(1 << 31)
        found = np.full(len(at), far)
        for side in (at - 1, at):
            inside = np.clip(side, 0, len(self.keys) - 1)
            own = (self.keys[inside] >> 32 == terms) & (side == inside)
            found = np.minimum(found, np.where(own, np.abs((self.keys[inside] & 0xFFFFFFFF) - positions), far))
        return found

    def pivots(self, phrases: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, position of its rarest term), some at a time, of the phrases all of whose terms the block has."""
        rows = np.flatnonzero(self.sizes[phrases].min(axis=1)) if len(phrases) else np.zeros(0, np.int64)
        rarest = phrases[rows, order[rows, 0]] if len(rows) else rows
        n = self.sizes[rarest]
        runs = (np.cumsum(n) - n) // _CANDIDATES
        for run in np.unique(runs):
            own = np.flatnonzero(runs == run)
            within = np.arange(n[own].sum()) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
            yield np.repeat(rows[own], n[own]), self.positions[np.repeat(self.firsts[rarest[own]], n[own]) + within]

    def phrase(self, phrases: np.ndarray, order: np.ndarray, who: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the pivot, start) of the exact occurrences."""
        start, at = pivot - order[who, 0], np.arange(len(who))
        at = at[start >= 0]
        start = start[at]
        for k in range(1, phrases.shape[1]):
            offset = order[who[at], k]
            hit = self.has(phrases[who[at], offset], start + offset)
            at, start = at[hit], start[hit]
        return at, start

    def near(self, phrases: np.ndarray, order: np.ndarray, who: np.ndarray, pivot: np.ndarray, span: int) -> np.ndarray:
        """Indexes of the pivots that have every other term within ``span`` words, on either side."""
        at = np.arange(len(who))
        for k in range(1, phrases.shape[1]):
            terms = phrases[who[at], order[who[at], k]]
            at = at[self.nearest(terms, pivot[at]) < span]
        return at

    def holds_all(self, terms: list[int], pivot: int, low: int, high: int, span: int) -> bool:
        """Whether ``span`` words in a row, within [low, high) and with the pivot, have all the terms."""
        own = []
        for t in set(terms):
            x = self.of(t)
            own.append(x[np.searchsorted(x, max(low, pivot - span + 1)) : np.searchsorted(x, min(high, pivot + span))])
        for start in sorted({pivot, *(int(y) for x in own for y in x if y <= pivot)}):
            if start + span > pivot and all((k := np.searchsorted(x, start)) < len(x) and x[k] < start + span for x in own):
                return True
        return False


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[list[int], list[int]]:
    """Union of stretches, sorted."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.r_[True, start[1:] > stop[:-1]]
    return start[new].tolist(), stop[np.r_[np.flatnonzero(new)[1:] - 1, len(stop) - 1]].tolist()


def _search_block(lists: Lists, queries: Queries, span: int) -> Iterator[tuple[int, list, list, list, list]]:
    """(place, starts, stops, items, near items) of the block's documents that have any match."""
    spans: dict[int, list] = {}
    items: dict[int, set[int]] = {}
    near: dict[int, set[int]] = {}
    starts = lists.of(len(queries.vocabulary))
    for width, (phrases, owners) in queries.phrases.items():
        order = queries.order[width]
        for who, pivot in lists.pivots(phrases, order):
            at, start = lists.phrase(phrases, order, who, pivot)
            docs = np.searchsorted(starts, start, "right") - 1
            for w, s, d in zip(who[at].tolist(), (start - starts[docs]).tolist(), docs.tolist()):
                spans.setdefault(d, []).append((s, s + width))
                items.setdefault(d, set()).update(owners[w])
                near.setdefault(d, set()).update(owners[w])
            close = np.setdiff1d(lists.near(phrases, order, who, pivot, span), at, assume_unique=True)
            for w, p in zip(who[close].tolist(), pivot[close].tolist()):
                d = int(np.searchsorted(starts, p, "right")) - 1
                known = near.setdefault(d, set())
                high = int(starts[d + 1]) if d + 1 < len(starts) else 1 << 31
                if not known.issuperset(owners[w]) and lists.holds_all(phrases[w].tolist(), p, int(starts[d]), high, span):
                    known.update(owners[w])
    named = lambda own: [str(queries.items[k]) for k in sorted(own) if queries.items[k] is not None]
    for d in sorted(near):
        a, b = _merged(*map(np.array, zip(*spans[d]))) if d in spans else ([], [])
        if a or near[d]:
            yield d, a, b, named(items.get(d, ())), named(near[d])


def _searched(shared, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        names = ["block", "place", "starts", "stops", "items", "near"]
        kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.string())] * 2]

        def found(block: int, parts: list[tuple]) -> pa.RecordBatch:
            lists = Lists(*(np.concatenate(x) for x in zip(*parts)), len(queries.vocabulary))
            rows = [(block, *x) for x in _search_block(lists, queries, span)]
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

        last, parts = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if parts and blocks[low] != last:
                    yield found(last, parts)
                    parts = []
                last, own = int(blocks[low]), batch.slice(low, high - low)
                gaps = own.column("gaps")
                parts.append((own.column("tid").to_numpy(), gaps.value_lengths().to_numpy().astype(np.int64), gaps.flatten().to_numpy()))
        if parts:
            yield found(last, parts)

    return run


def search(index: Index, queries: Queries, span: int) -> DataFrame:
    """(block, place, starts, stops, items, near) of the documents with a match of this part of the queries."""
    spark = index.postings.sparkSession
    terms = [(w.decode(), k) for w, k in queries.vocabulary.items()]
    wanted = F.broadcast(spark.createDataFrame([*terms, (_STARTS, len(terms))], "term string, tid long"))  # bounded by the bytes of a part
    own = index.postings.join(wanted, "term").select("block", "term", "tid", "gaps")
    counts = {r.term: r.n for r in own.groupBy("term").agg(F.sum(F.size("gaps")).alias("n")).collect()}  # as many rows as ``wanted``
    queries.rarest_first(counts)
    placed = own.select("block", "tid", "gaps").repartition("block").sortWithinPartitions("block", "tid")
    schema = "block long, place int, starts array<long>, stops array<long>, items array<string>, near array<string>"
    return placed.mapInArrow(_searched(spark.sparkContext.broadcast(queries), span), schema)


def _joined(found: list[DataFrame]) -> DataFrame:
    """Matches of all parts as one row a document: runs that touch become one, items are listed once."""
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    key, by = ["block", "place"], "block, place"
    runs = rows.select(*key, F.explode(F.arrays_zip("starts", "stops")).alias("x")).select(*key, "x.starts", "x.stops")
    runs = runs.withColumn("before", F.expr(f"max(stops) over (partition by {by} order by starts, stops rows between unbounded preceding and 1 preceding)"))
    runs = runs.withColumn("run", F.expr(f"sum(case when before >= starts then 0 else 1 end) over (partition by {by} order by starts, stops)"))
    runs = runs.groupBy(*key, "run").agg(F.min("starts").alias("start"), F.max("stops").alias("stop"))
    hits = runs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("hits"))
    listed = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return rows.groupBy(*key).agg(listed("items"), listed("near")).join(hits, key, "left")


def matches(
    documents: DataFrame, queries: DataFrame, window: int = 10, span: int = 20, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", query_bytes: int = QUERY_BYTES, block_bytes: int = BLOCK_BYTES,
) -> tuple[Index, DataFrame]:
    """The index, and (block, place, hits, items, near) of the documents that have a match."""
    index = build_index(documents, id_col, text_col, block_bytes)
    found = [search(index, part, span) for part in query_parts(queries, window, query_bytes, item_col, item_text_col)]
    if len(found) > 1:
        return index, _joined(found)
    hits = F.transform(F.arrays_zip("starts", "stops"), lambda x: F.struct(x["starts"].alias("start"), x["stops"].alias("stop")))
    return index, found[0].select("block", "place", hits.alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort(F.array_distinct("near")).alias("near"))


def contamination(documents: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, hits, items, near) of each document.

    ``hits``: [{start, stop}], the maximal runs of word positions inside any occurrence of
    ``window`` consecutive words of an item (all words of a shorter item), by start.
    ``items``: the ids, as strings, of the items that have an occurring window, sorted; ``near``:
    those of the items with a window all of whose words are within ``span`` words of the document
    in any order (so with ``span`` of ``window`` or more, all of ``items`` too).
    A null text has no words; a null item id is not listed though its words are hit; equal items
    and repeated rows count each; very long texts are blocks of their own; other columns are
    ignored; without documents there are no rows and without queries no hits.  The queries go out
    in parts of ``query_bytes``, each of which reads the postings of its own terms.
    """
    index, found = matches(documents, queries, **options)
    rows = index.documents.join(found, ["block", "place"], "left")
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    no_items = F.expr("cast(array() as array<string>)")
    return rows.select("doc_id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", no_items).alias("items"), F.coalesce("near", no_items).alias("near"))


def uncontaminated(documents: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents``, with all columns, without those that have an exact match; null texts have none."""
    index, found = matches(documents, queries, id_col=id_col, text_col=text_col, **options)
    rid = free_name(documents, "rid")
    hit = index.documents.join(found.where(F.size("hits") > 0), ["block", "place"], "left_semi").select(F.col("rid").alias(rid)).distinct()
    rows = documents.withColumn(rid, F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))))
    return join_checked(rows, hit, rid, "left_anti").select(*documents.columns)


def n_hit(hits: str = "hits"):
    """Words inside any hit."""
    return F.aggregate(F.transform(hits, lambda x: x["stop"] - x["start"]), F.lit(0).cast("long"), lambda a, x: a + x)
