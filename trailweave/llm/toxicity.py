"""Toxicity by a convolutional text classifier on hashed word embeddings, in numpy.

A word's embedding is the sum of the vectors of two hash buckets, one of the word and one of its
first characters.  Filters of several widths slide over the words, each filter's maximum over the
text is kept, and a linear layer gives the score.  Thresholds are calibrated for each language,
which is told from frequent words of the text itself, and the scores of a language are shifted so
that its threshold becomes the common one.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.blocks import as_bytes, byte_slices, pieces_at_spaces, sliced
from trailweave.llm.decontaminate import words_of
from trailweave.session import checkpoint

WORD_BUCKETS, HEAD_BUCKETS, HEAD_BYTES = 1 << 16, 1 << 13, 4
WIDTHS = (1, 2, 3)
#: Frequent words of the languages told apart; language 0 is any other.
_LANGUAGES = {
    1: "the and of to in is that was with for on be it are by this from",
    2: "der die und den das von ist des dem mit nicht ein eine zu auf sich",
    3: "le les et des est une du pour dans qui par pas sur au avec",
    4: "el los las del y que por para con una su lo como",
}
_LANGUAGE_OF = {w.encode(): k for k, words in _LANGUAGES.items() for w in words.split()}
N_LANGUAGES = len(_LANGUAGES) + 1
_STORED_WORDS = 150_000
#: Words of a text that are scored at once; pieces of a longer one share the words that a filter spans.
PIECE_WORDS = 1 << 15
#: Bytes of labelled text that one task learns from at a time, passes over all parts, values in a block of the parameters.
PART_BYTES, ROUNDS, BLOCK = 32 << 20, 5, 2048


def packed(codes: np.ndarray) -> np.ndarray:
    """Codes in four bytes each: language, word bucket and head bucket."""
    w, h = buckets(codes)
    return ((codes >> 40) << 29 | w << 13 | h).astype("<u4")


def unpacked(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.int64)
    return codes >> 29 << 40 | (codes >> 13 & 0xFFFF) << 16 | codes & 0x1FFF


class Encoder:
    """Words as (word bucket, head bucket, language), each distinct word hashed once per worker."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _code(self, word: bytes) -> int:
        # bucket 0 of both tables is the empty place between documents
        w = zlib.crc32(word) % (WORD_BUCKETS - 1) + 1
        h = zlib.crc32(word[:HEAD_BYTES], 1) % (HEAD_BUCKETS - 1) + 1
        return (_LANGUAGE_OF.get(word, 0) << 40) | (w << 16) | h

    def of(self, text: bytes) -> np.ndarray:
        return np.concatenate([self._codes(words_of(x)) for x in pieces_at_spaces(text)])

    def _codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > _STORED_WORDS:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = self._code(w)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def buckets(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (codes >> 16) & 0xFFFFFF, codes & 0xFFFF


def language(codes: np.ndarray) -> int:
    """The language with the most frequent words; 0 if the text has none of them."""
    counts = np.bincount(codes >> 40, minlength=N_LANGUAGES)
    return int(counts[1:].argmax()) + 1 if counts[1:].any() else 0


@dataclass
class Model:
    words: np.ndarray  # WORD_BUCKETS x dim
    heads: np.ndarray  # HEAD_BUCKETS x dim
    filters: list[np.ndarray]  # of each width: width x dim x filters
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    shift: np.ndarray = field(default_factory=lambda: np.zeros(N_LANGUAGES))

    @classmethod
    def new(cls, dim: int, filters: int, seed: int) -> Model:
        r = np.random.default_rng(seed)
        draw = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        words, heads = draw(WORD_BUCKETS, dim, by=0.1), draw(HEAD_BUCKETS, dim, by=0.1)
        words[0] = heads[0] = 0
        return cls(
            words, heads, [draw(w, dim, filters, by=(dim * w) ** -0.5) for w in WIDTHS],
            [np.zeros(filters, np.float32) for _ in WIDTHS], draw(filters * len(WIDTHS), by=0.1),
        )


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, each followed by empty places, and where each text's places for filters start and stop.

    A filter begins at each word and once behind the last one; so none reaches the next text.
    """
    gap = np.zeros(max(WIDTHS), np.int64)
    parts = [x for t in texts for x in (t, gap)]
    sizes = np.array([len(t) + len(gap) for t in texts])
    starts = np.cumsum(sizes) - sizes
    return np.concatenate([*parts, gap]), starts, starts + sizes - len(gap) + 1


def _max_between(rows: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Maximum of each column over rows [start, stop) for each pair."""
    return np.maximum.reduceat(rows, np.stack([starts, stops], axis=1).ravel(), axis=0)[::2]


def _first_max(rows: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum and its first row, for each segment and column."""
    top = _max_between(rows, starts, stops)
    sizes = np.diff(np.r_[starts, len(rows)])
    at = np.arange(len(rows))
    hit = (rows == np.repeat(top, sizes, axis=0)) & (at < np.repeat(stops, sizes))[:, None]
    return top, np.minimum.reduceat(np.where(hit, at[:, None], len(rows)), starts, axis=0)


@dataclass
class Gradients:
    """Derivatives of the mean cross-entropy of a batch; those of embeddings as (row of the codes, gradient) pairs."""

    score: np.ndarray  # of each text
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    rows: np.ndarray
    embedded: np.ndarray


def _tops(m: Model, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each width, each filter's maximum over each text and its first place; only ``PIECE_WORDS`` places are laid out at once."""
    n = len(codes) - max(WIDTHS)
    shape = (len(starts), m.filters[0].shape[2])
    found = [(np.full(shape, -np.inf, m.words.dtype), np.zeros(shape, np.int64)) for _ in WIDTHS]
    for at in range(0, n, PIECE_WORDS):
        own = np.flatnonzero((starts < at + PIECE_WORDS) & (stops > at))
        if not len(own):
            continue
        first = max(at, int(starts[own[0]]))
        end = min(at + PIECE_WORDS, n)
        some = min(end + 1, n) - first  # one place more, which no text's own places reach
        w, h = buckets(codes[first : first + some + max(WIDTHS)])
        x = m.words[w] + m.heads[h]
        begin, stop = np.maximum(starts[own], first) - first, np.minimum(stops[own], end) - first
        for (top, place), width, f, b in zip(found, WIDTHS, m.filters, m.bias):
            z, k = _first_max(sum(x[o : o + some] @ f[o] for o in range(width)) + b, begin, stop)
            better = z > top[own]
            top[own] = np.where(better, z, top[own])
            place[own] = np.where(better, k + first, place[own])
    return found


def gradients(m: Model, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> Gradients:
    """Of texts joined by ``_joined``; only the places that give a filter's maximum have a share."""
    w, h = buckets(codes)
    each = m.filters[0].shape[2]
    tops, places = zip(*_tops(m, codes, starts, stops))
    pooled = np.maximum(np.concatenate(tops, axis=1), 0)
    z = pooled @ m.out + m.out_bias
    d = 1 / (1 + np.exp(-z)) - labels
    d = (d * (1 if weights is None else weights) / len(labels)).astype(m.words.dtype)
    back = d[:, None] * m.out[None, :] * (pooled > 0)
    filters, bias, rows, embedded = [], [], [], []
    for k, (width, f) in enumerate(zip(WIDTHS, m.filters)):
        g, place = back[:, k * each : (k + 1) * each], places[k]
        filters.append(np.stack([np.einsum("dfe,df->ef", m.words[w[place + o]] + m.heads[h[place + o]], g) for o in range(width)]))
        bias.append(g.sum(axis=0))
        for o in range(width):
            rows.append((place + o).ravel())
            embedded.append((g[:, :, None] * f[o].T[None]).reshape(-1, f.shape[1]))
    return Gradients(d, filters, bias, pooled.T @ d, np.concatenate(rows), np.concatenate(embedded))


def train(texts: list[np.ndarray], labels: np.ndarray, dim: int = 12, filters: int = 8, epochs: int = 8, batch: int = 24, rate: float = 0.01, dropped: float = 0.2, least_steps: int = 2000, seed: int = 7, start: Model | None = None, weights: np.ndarray | None = None) -> Model:
    """A model fitted by Adam to coded texts and 0/1 labels, from ``start`` on if there is one; ``weights`` are those of the texts.

    A share ``dropped`` of the words is left out each time a text is seen, so that it isn't told by
    a single word of its own.  A small sample is seen more often, for ``least_steps`` in all.
    """
    m, r = copy.deepcopy(start) if start else Model.new(dim, filters, seed), np.random.default_rng(seed)
    dim = m.words.shape[1]
    small = [*m.filters, *m.bias, m.out]
    first, second = [np.zeros_like(x) for x in small], [np.zeros_like(x) for x in small]
    squares = [np.zeros_like(m.words), np.zeros_like(m.heads)]  # of the embeddings' gradients
    step, b_sq = 0, 1e-8
    epochs = max(epochs, -(-least_steps * batch // max(1, len(texts))))
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            codes, starts, stops = _joined([texts[k] for k in own])
            codes[r.random(len(codes), np.float32) < dropped] = 0
            g = gradients(m, codes, starts, stops, labels[own], None if weights is None else weights[own])
            step += 1
            for p, grad, a, b in zip(small, [*g.filters, *g.bias, g.out], first, second):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                p -= rate / 2 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            g0 = float(g.score.sum())
            b_sq += g0 * g0
            m.out_bias -= rate * g0 / b_sq**0.5
            for table, square, ids in zip((m.words, m.heads), squares, buckets(codes[g.rows])):
                unique, inverse = np.unique(ids, return_inverse=True)
                total = np.zeros((len(unique), dim), np.float32)
                np.add.at(total, inverse, g.embedded)
                square[unique] += total * total
                table[unique] -= 4 * rate * total / (np.sqrt(square[unique]) + 1e-6)
            m.words[0] = m.heads[0] = 0
    return m


class Scorer:
    """Logits of texts: each bucket's products with the filters are taken once, so a text only adds rows."""

    def __init__(self, model: Model):
        self.m = model
        self.tables = [[(model.words @ f[o], model.heads @ f[o]) for o in range(len(f))] for f in model.filters]

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """A maximum over a text is that of its pieces' maxima, so a long text is never laid out as a whole."""
        shared = max(WIDTHS) - 1
        step = PIECE_WORDS - shared
        tops, held, size = [], [], 0
        counts = []
        for t in texts:
            cuts = [0, *range(step, len(t) - shared, step)]
            counts.append(len(cuts))
            for at in cuts:
                # but for a text's last piece, only places whose filters are within it count
                held.append((t[at : at + PIECE_WORDS], at == cuts[-1]))
                size += len(held[-1][0])
                if size >= PIECE_WORDS:
                    tops.append(self._tops(held))
                    held, size = [], 0
        if held:
            tops.append(self._tops(held))
        firsts = np.cumsum(counts) - counts
        pooled = np.maximum.reduceat(np.concatenate(tops), firsts, axis=0)
        return np.maximum(pooled, 0) @ self.m.out + self.m.out_bias

    def _tops(self, pieces: list[tuple[np.ndarray, bool]]) -> np.ndarray:
        """Each filter's maximum over each piece."""
        codes, starts, stops = _joined([x for x, _ in pieces])
        stops = stops - np.array([0 if last else max(WIDTHS) for _, last in pieces])
        w, h = buckets(codes)
        n, tops = len(codes) - max(WIDTHS), []
        for table, b in zip(self.tables, self.m.bias):
            conv = np.tile(b, (n, 1))
            for o, (words, heads) in enumerate(table):
                conv += words[w[o : o + n]]
                conv += heads[h[o : o + n]]
            tops.append(_max_between(conv, starts, stops))
        return np.concatenate(tops, axis=1)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scores from 0 to 1; a text without words has nothing that could be toxic and gets 0, whatever was learned."""
        shift = self.m.shift[[language(x) for x in texts]]
        found = 1 / (1 + np.exp(-np.clip(self.logits(texts) + shift, -30, 30)))
        return np.where([len(x) > 0 for x in texts], found, 0.0)


def calibrate(model: Model, counts: np.ndarray, threshold: float, prior: float = 30.0, most_wrong: float = 0.02) -> None:
    """Sets the shift of each language so that its best threshold by F1 becomes ``threshold``.

    ``counts``: rows of (language, logit, texts, texts of label 1).
    No threshold is so low that more than ``most_wrong`` of the clean rows would be rejected.
    A language's own best threshold counts by its positive rows and that of all rows as ``prior`` more of these, so
    that every language with rows of both labels has a threshold of its own, drawn to the common one the fewer they are.
    """
    counts = counts[np.argsort(-counts[:, 1], kind="stable")]

    def best(rows: np.ndarray) -> float:
        z, at = np.unique(-rows[:, 1], return_inverse=True)
        z = -z
        n, y = np.bincount(at, rows[:, 2]), np.bincount(at, rows[:, 3])
        f1 = 2 * np.cumsum(y) / (np.cumsum(n) + y.sum())
        top = np.flatnonzero(f1 >= f1.max() - 1e-9)
        k = top[len(top) // 2]
        own = float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1e-3)
        clean = n - y
        if not clean.any():
            return own
        least = np.flatnonzero(np.cumsum(clean) > most_wrong * clean.sum())[0]
        return max(own, float(z[least]))

    goal = np.log(threshold / (1 - threshold))
    common = best(counts)
    for k in range(N_LANGUAGES):
        own = counts[counts[:, 0] == k]
        positive = float(own[:, 3].sum())
        weight = positive / (positive + prior) if positive < own[:, 2].sum() else 0.0
        model.shift[k] = goal - (weight * best(own) + (1 - weight) * common if weight else common)


_PIECE = 500


def spread(codes: np.ndarray, most: int) -> np.ndarray:
    """``codes``, or of more than ``most`` so many in pieces at even distances, from the first to the last."""
    if len(codes) <= most:
        return codes
    size = min(_PIECE, most)
    starts = np.linspace(0, len(codes) - size, max(1, most // size)).astype(np.int64)
    return np.concatenate([codes[s : s + size] for s in starts])


def fair_share(lengths: list[int], most: int) -> int:
    """The largest length that texts may be cut to, so that all together have at most ``most``; one at least."""
    left, share = most, max(lengths, default=1)
    for k, n in enumerate(sorted(lengths)):
        share = left // (len(lengths) - k)
        if n >= share:
            return max(1, share)
        left -= n
    return max(1, share, max(lengths, default=1))


def _coded():
    """Each row's text as packed codes of its words, the other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in sliced(batches, "text", 1 << 22):
            codes = [packed(encoder.of(x)).tobytes() for x in as_bytes(batch.column("text"))]
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.record_batch([*(batch.column(c) for c in others), pa.array(codes, pa.binary())], [*others, "codes"])

    return run


def _of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Each part's codes and labels; a part's rows follow one another."""
    now, codes, labels = None, [], []
    for batch in batches:
        for part, code, label in zip(*(batch.column(c).to_pylist() for c in ("part", "codes", "label"))):
            if part != now and codes:
                yield now, codes, np.array(labels, np.float32)
                codes, labels = [], []
            now = part
            codes.append(unpacked(np.frombuffer(code, "<u4")))
            labels.append(label)
    if codes:
        yield now, codes, np.array(labels, np.float32)


def _flat(m: Model) -> np.ndarray:
    return np.concatenate([x.ravel() for x in (m.words, m.heads, *m.filters, *m.bias, m.out, np.array([m.out_bias], np.float32))])


def _moved(m: Model, change: np.ndarray) -> Model:
    """``m`` with its parameters, in the order of ``_flat``, changed."""
    m, at = copy.deepcopy(m), 0
    for x in (m.words, m.heads, *m.filters, *m.bias, m.out):
        x += change[at : at + x.size].reshape(x.shape).astype(x.dtype)
        at += x.size
    m.out_bias += float(change[at])
    return m


def _mean_change(group: pa.Table) -> pa.Table:
    """A block's mean change; a value counts for the parts that changed it, as most words aren't in every part."""
    rows = group.sort_by("part")
    total, n = np.zeros(0), np.zeros(0)
    for value in rows.column("change").to_pylist():
        x = np.frombuffer(value, "<f4").astype(np.float64)
        total, n = (total + x, n + (x != 0)) if len(total) else (x, (x != 0).astype(float))
    return pa.table({"block": rows.column("block")[:1], "change": pa.array([(total / np.maximum(n, 1)).astype("<f4").tobytes()], pa.binary())})


def learned(parts: DataFrame, weights: tuple[float, float], n_parts: int) -> Model:
    """A model of all rows of ``parts`` (part, codes, label), each part's rows in one partition and in order.

    Each round, every part's rows but a fifth are learned from, beginning with the common model, and the
    changes are averaged.  Only the parameters, of fixed size, reach the driver.
    """
    spark = parts.sparkSession
    model = Model.new(12, 8, 7)
    rounds = 1 if n_parts == 1 else ROUNDS
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], k=k, shared=shared) -> Iterator[pa.RecordBatch]:
            for part, texts, y in _of_parts(batches):
                learn = np.flatnonzero(np.arange(len(y)) % 5)
                if not len(learn):
                    continue
                steps = {"epochs": ROUNDS} if rounds == 1 else {"epochs": 1, "least_steps": 400, "seed": 7 + k}
                own = train([texts[i] for i in learn], y[learn], start=shared.value, weights=np.where(y[learn] == 1, weights[1], weights[0]), **steps)
                change = (_flat(own) - _flat(shared.value)).astype("<f4")
                blocks = range(0, len(change), BLOCK)
                yield pa.record_batch([pa.array([part] * len(blocks), pa.int64()), pa.array([b // BLOCK for b in blocks], pa.int64()), pa.array([change[b : b + BLOCK].tobytes() for b in blocks], pa.binary())], ["part", "block", "change"])

        changes = parts.mapInArrow(run, "part long, block long, change binary").groupBy("block").applyInArrow(_mean_change, "block long, change binary")
        got = {r["block"]: np.frombuffer(r["change"], "<f4") for r in changes.collect()}  # the parameters, fixed by the numbers of buckets
        if not got:
            break
        model = _moved(model, np.concatenate([got[b] for b in sorted(got)]))
    return model


def held_counts(parts: DataFrame, model: Model) -> np.ndarray:
    """(language, logit, texts, texts of label 1) of all rows that weren't learned from; logits in steps of 1/1024."""
    shared = parts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for _, texts, y in _of_parts(batches):
            held = np.arange(0, len(y), 5)
            for at in range(0, len(held), 64):
                own = [texts[i] for i in held[at : at + 64]]
                z = np.round(np.clip(scorer.logits(own), -30, 30) * 1024).astype(np.int64)
                yield pa.record_batch([pa.array([language(x) for x in own], pa.int64()), pa.array(z), pa.array(y[held[at : at + 64]].astype(np.int64))], ["language", "z", "label"])

    rows = parts.mapInArrow(run, "language long, z long, label long").groupBy("language", "z").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    found = [tuple(r) for r in rows.collect()]  # at most 61,441 steps of each language
    return np.array(found, float).reshape(-1, 4) / np.array([1, 1024, 1, 1])


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, label) of ids that aren't null and labels of 0 and 1; of several labels of an id the highest counts."""
    return labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))


def training_rows(documents: DataFrame, labels: DataFrame, usable: Column, most_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Labelled texts to learn from: of each class the ``most_rows`` ids with the least hashes, however many there are.

    Null ids and labels other than 0 and 1 are left out; of several labels of an id the highest
    counts, and of several texts of an id the one with the least hash.
    """
    known = known_labels(labels, id_col, label_col)
    ranked = known.where(usable).withColumn("h", F.xxhash64("doc_id"))
    of_class = [ranked.where(F.col("label") == c).orderBy("h", "doc_id").limit(most_rows) for c in (0, 1)]
    drawn = of_class[0].unionByName(of_class[1]).select("doc_id", "label")
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), "doc_id")  # bounded by most_rows
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def labelled_parts(documents: DataFrame, labels: DataFrame, usable: Column, n_parts: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(part, codes, label) of all labelled texts, whole, dealt to parts by id; repeated ids as in ``training_rows``.

    Texts travel as codes, and go with their labels to their part in one shuffle.
    """
    known = known_labels(labels, id_col, label_col).where(usable).select("doc_id", "label", F.lit(None).cast("long").alias("h"), F.lit(None).cast("binary").alias("codes"))
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null").withColumn("h", F.xxhash64("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    coded = texts.select("doc_id", "h", "text").mapInArrow(_coded(), f"doc_id {kind}, h long, codes binary").select("doc_id", F.lit(None).cast("int").alias("label"), "h", "codes")
    both = known.unionByName(coded).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)))
    rows = both.repartition(n_parts, "part").groupBy("part", "doc_id").agg(F.max("label").alias("label"), F.min_by("codes", "h").alias("codes"))
    rows = rows.where("label is not null and codes is not null").select("part", "codes", "label")
    return checkpoint(rows.sortWithinPartitions("part", F.xxhash64("codes"), "label"))


def fit(
    documents: DataFrame, labels: DataFrame, usable: Column | None = None, threshold: float = 0.3,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", part_bytes: int = PART_BYTES,
) -> Model | None:
    """A calibrated model from all labelled rows and their whole texts; None if a class has no rows.

    ``usable``: which rows of (doc_id, label) may be learned from.  The rows are dealt to parts of about
    ``part_bytes`` of text, which tasks learn from side by side (``learned``).  A fifth of them is kept for
    calibration, which counts all of these.  The rarer class weighs more, by the root of the classes' ratio.
    Null texts are empty ones, empty tables give no model, and other columns are ignored.
    """
    usable = F.lit(True) if usable is None else usable
    by_class = {r["label"]: r["count"] for r in known_labels(labels, id_col, label_col).where(usable).groupBy("label").count().collect()}
    size = documents.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    share = min(1.0, sum(by_class.values()) / max(1, size["n"]))
    n_parts = max(1, round((size["bytes"] or 0) * share / part_bytes))
    parts = labelled_parts(documents, labels, usable, n_parts, id_col, text_col, label_col)
    n = {r["label"]: r["count"] for r in parts.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    most = max(n.values())
    model = learned(parts, ((most / n[0]) ** 0.5, (most / n[1]) ** 0.5), n_parts)
    calibrate(model, held_counts(parts, model), threshold)
    return model


def toxicity_score(text: Column, model: Model | None) -> Column:
    """Column of scores from 0 to 1 of the whole texts; a null text is scored as the empty one.

    A long text is scored in pieces that share a filter's width, with the same result.  Without a
    model (no labels of both classes) every score is 0.
    """
    from pyspark.sql import SparkSession

    if model is None:
        return F.lit(0.0)
    shared = SparkSession.active().sparkContext.broadcast(model)  # a few MB, fixed by the numbers of buckets

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer, encoder = Scorer(shared.value), Encoder()
        for array in batches:
            parts = [scorer.scores([encoder.of(x) for x in as_bytes(array.slice(s, e - s))]) for s, e in byte_slices(array, 1 << 20)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return scores(F.coalesce(text, F.lit("")))


def fold(doc_id: Column) -> Column:
    """crc32 of an id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4
