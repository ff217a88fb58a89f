"""Quality rules as a short-circuit cascade.

Each rule needs one measure of the text.  Costs and rejections are estimated on a sample; the rule
with the most rejections per cost comes first, the next is the best on what the first one leaves,
and so on.  A document leaves the cascade at the first rule that rejects it, so that later measures
are never taken.  The order decides what is computed and not what is kept.
"""

from __future__ import annotations

import re
import time
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.blocks import sliced

_SYMBOLS, _SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LETTERS_OF_ASCII = re.compile(rb"[A-Za-z]")
WINDOW = 8


def _of_category(text: str, wanted: str) -> int:
    """Characters whose Unicode category begins with ``wanted``."""
    return sum(n for c, n in Counter(text).items() if unicodedata.category(c).startswith(wanted))


def _has_letter(word: bytes) -> bool:
    if word.isascii():
        return bool(_LETTERS_OF_ASCII.search(word))
    return any(unicodedata.category(c)[0] == "L" for c in word.decode())


class Measures:
    """Measures of one text, each taken when first asked for."""

    def __init__(self, text: str):
        self.text, self.taken = text, {}

    def __getitem__(self, name: str):
        if name not in self.taken:
            self.taken[name] = getattr(self, f"_{name}")()
        return self.taken[name]

    def _words(self) -> list[bytes]:
        return self.text.encode().split()  # on bytes: the six ASCII white spaces

    def _n_words(self) -> int:
        return len(self["words"])

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACES))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(_SPACES)]

    def _n_dup_lines(self) -> int:
        return len(self["lines"]) - len(set(self["lines"]))

    def _n_repeat_words(self) -> int:
        """Words inside windows of 8 words that the text has twice or more."""
        words = self["words"]
        n = len(words) - WINDOW + 1
        if n < 2:
            return 0
        hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        key = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            key = key * _STEP + hashes[k : k + n]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        if not same.any():
            return 0
        repeated = order[np.r_[same, False] | np.r_[False, same]]
        # keys are hashes: what they call equal is compared by its words
        found = Counter(tuple(words[k : k + WINDOW]) for k in repeated.tolist())
        repeated = np.array([k for k in repeated.tolist() if found[tuple(words[k : k + WINDOW])] > 1], np.int64)
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, repeated, 1)
        np.add.at(edges, repeated + WINDOW, -1)
        return int((np.cumsum(edges) > 0).sum())

    def _n_stutters(self) -> int:
        """Words equal to the word before them."""
        return sum(map(bytes.__eq__, self["words"], self["words"][1:]))

    def _n_upper(self) -> int:
        return _of_category(self.text, "Lu")

    def _n_letters(self) -> int:
        return _of_category(self.text, "L")

    def _n_wordlike(self) -> int:
        return sum(map(_has_letter, self["words"]))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda m: m["n_words"] < 20),
        Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    ]


def default_rules() -> list[Rule]:
    """The base rules and those on symbols, repeated lines and words, word length, capitals and letters."""
    return [
        *base_rules(),
        Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
        Rule("repeated_lines", lambda m: m["n_dup_lines"] >= 3 and 10 * m["n_dup_lines"] > 3 * len(m["lines"])),
        Rule("stutter", lambda m: 10 * m["n_stutters"] > 3 * m["n_words"]),
        Rule("word_length", lambda m: not 2 * m["n_words"] <= m["word_chars"] <= 20 * m["n_words"]),
        Rule("capitals", lambda m: 2 * m["n_upper"] > m["n_letters"]),
        Rule("no_letters", lambda m: 2 * m["n_wordlike"] < m["n_words"]),
    ]


def _profiled(names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [next(r for r in default_rules() if r.name == name) for name in names]
        cost, found = [0.0] * len(rules), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                rejecting = 0
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejecting |= bool(rule.rejects(Measures(text))) << k  # its own measures, none shared
                    cost[k] += time.perf_counter() - began
                found[rejecting] += 1
        masks = list(found)
        spent = [cost, *([[0.0] * len(rules)] * (len(masks) - 1))]  # the costs of a task come once
        yield pa.record_batch([pa.array(masks, pa.int64()), pa.array([found[m] for m in masks], pa.int64()), pa.array(spent[: len(masks)], pa.list_(pa.float64()))], ["mask", "n", "cost"])

    return run


def best_order(found: dict[int, int], cost: Sequence[float]) -> list[tuple[int, float]]:
    """[(rule, share rejected of what the rules before it leave)], each the best by rejections per cost of those left.

    ``found``: how many rows each set of rules rejects (bit k: rule k); ``cost``: of each rule for all rows.
    """
    left, out = dict(found), []
    for _ in cost:
        total = max(1, sum(left.values()))
        gain = {k: sum(n for m, n in left.items() if m >> k & 1) / total for k in range(len(cost)) if k not in [x for x, _ in out]}
        best = max(gain, key=lambda k: (gain[k] / max(cost[k], 1e-9), -k))
        out.append((best, gain[best]))
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return out


def profile(documents: DataFrame, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, float, float]]:
    """[(rule, seconds a row, share rejected of what the rules before it leave)] on a sample, best first.

    The sample are the ``sample_rows`` rows with the least hashes of id and text, however many rows
    there are (wholly repeated rows come together).  One pass finds these hashes, a second the
    texts; only counts of the sets of rejecting rules and sums of costs reach the driver.
    """
    names = [r.name for r in default_rules()]
    rows = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    keyed = rows.select(F.xxhash64(F.lit(1), "id", "text").alias("key"), "text")
    drawn = keyed.select("key").orderBy("key").limit(sample_rows)
    sample = keyed.join(F.broadcast(drawn.distinct()), "key", "left_semi").select("text")  # sample_rows numbers at most
    rejecting = sample.mapInArrow(_profiled(names), "mask long, n long, cost array<double>")
    sums = [F.sum(F.try_element_at("cost", F.lit(k + 1))).alias(f"c{k}") for k in range(len(names))]
    found = rejecting.groupBy("mask").agg(F.sum("n").alias("n"), *sums).collect()  # as many rows as sets of rules
    n = max(1, sum(r.n for r in found))
    cost = [sum(r[f"c{k}"] or 0.0 for r in found) / n for k in range(len(names))]
    return [(names[k], cost[k], share) for k, share in best_order({r.mask: r.n for r in found}, cost)]


_REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(order: Sequence[str], reported: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = {r.name: r for r in default_rules()}
        ordered = [rules[x] for x in order]
        for batch in sliced(batches, "text", 1 << 22):
            measures, failed = [], []
            for text in batch.column("text").to_pylist():
                m = Measures(text)
                failed.append(next((r.name for r in ordered if r.rejects(m)), None))
                measures.append([m[x] for x in reported])
            columns = list(zip(*measures)) if reported else []
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns), pa.array(failed, pa.string())], ["doc_id", *reported, "failed_rule"]
            )

    return run


def quality_cascade(
    documents: DataFrame, order: Sequence[str] | None = None, reported: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, the ``reported`` measures, failed_rule): the first rule in the cascade that rejects, or null.

    ``order``: names of rules; if none is given it comes from ``profile``.  Measures that aren't
    reported are taken only as far as the cascade asks for them.  A null text counts as empty;
    null ids stay null; other columns are ignored; each repeated row has its own result; an empty
    table gives no rows.  A task holds the words of one text at a time, some 60 bytes a word.
    """
    order = list(order) if order is not None else [x[0] for x in profile(documents, id_col=id_col, text_col=text_col)]
    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = ", ".join([f"doc_id {kind}", *(f"{x} long" for x in reported), "failed_rule string"])
    return texts.mapInArrow(_judged(order, list(reported)), schema)


def quality_report(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, the five base measures, base_failed, kept) of each document."""
    judged = quality_cascade(documents, reported=_REPORTED, **options)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *_REPORTED, failed.alias("base_failed"), (~failed & F.col("failed_rule").isNull()).alias("kept"))
