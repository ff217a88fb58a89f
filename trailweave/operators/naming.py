"""Names of screens: the site's suffix, templates of titles, labels without data values."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.session import checkpoint, join_checked

#: What stands for a data value, and the signs that part a site's name from a title (fixed values).
PLACEHOLDER = "〇〇"
_SUFFIX = r"^.+?((?:\s+[—–\-|｜:：]\s+)(?:(?!\s[—–\-|｜:：]\s).)*)$"
_RUNS = re.compile(f"{PLACEHOLDER}(?:[\\s・、,]*{PLACEHOLDER})+")


def site_suffix(titles: DataFrame, title: str = "title", first: str = "pos") -> DataFrame:
    """One row ``suffix``: the most frequent ending after a separator, if half the titles have it; else ''."""
    rows = titles.where(F.col(title) != "")
    found = rows.withColumn("suffix", F.regexp_extract(title, _SUFFIX, 1))
    total = rows.agg(F.count("*").alias("total"))
    counts = found.where("suffix <> ''").groupBy("suffix").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    best = counts.agg(F.max_by("suffix", F.struct("n", -F.col("first"))).alias("suffix"), F.max("n").alias("n"))
    enough = (F.col("total") >= 2) & (F.col("n") >= F.greatest(F.lit(2.0), F.col("total") / 2))
    return total.join(F.broadcast(best)).select(F.when(enough, F.col("suffix")).otherwise("").alias("suffix"))  # one row each


def strip_site(s: Column, suffix: Column) -> Column:
    has = (suffix != "") & s.endswith(suffix) & (F.length(s) > F.length(suffix))
    return F.when(has, F.left(s, F.length(s) - F.length(suffix))).otherwise(s)


def norm_text(s: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", s or "").split())


#: A value of digits and these signs alone says nothing (fixed values).
_NO_NAME = re.compile(r"[\d\s#.,:/\-]*")


class Folded:
    """A text as values are compared with it: NFKC by character, white space squeezed, and where each piece came from.

    ``cuts[k]``: the place in ``text`` of the k-th character of ``folded``.
    """

    def __init__(self, text: str):
        pieces, cuts = [], []
        for m in re.finditer(r"\s+|[!-~]+|.", text, re.S):
            piece = m[0]
            if piece.isspace():
                piece = " "
            elif not piece.isascii():
                piece = re.sub(r"\s", " ", unicodedata.normalize("NFKC", piece))
            straight = piece.isascii() and len(piece) == m.end() - m.start()
            for k, c in enumerate(piece):
                if c != " " or pieces[-1:] not in ([], [" "]):
                    pieces.append(c)
                    cuts.append(m.start() + k * straight)
        self.text, self.folded, self.cuts = text, "".join(pieces), cuts

    def spans(self, values: Iterable[str]) -> Iterator[tuple[int, int]]:
        """Places in the text of all occurrences of the values."""
        for v in values:
            for m in re.finditer(re.escape(v), self.folded):
                yield self.cuts[m.start()], self.cuts[m.end() - 1] + 1


def scrub_to_placeholder(text: Column, values: Column) -> Column:
    """{text, removed}: ``text`` with the values, compared after NFKC, as placeholders, and what was replaced.

    NFKC isn't among Spark's functions, so texts go to Python in Arrow batches.  The spans of all
    values are sorted once; those that touch are one, and the text is put together around them.
    Placeholders with nothing but separators between them are one.  A value of one character, or of
    digits and signs alone, is no name.
    """

    def scrubbed(t: str, names: set[str]) -> tuple[str, list[str]]:
        kept, removed, at = [], [], 0
        for start, stop in sorted(Folded(t).spans(names)):
            if kept and start <= at:
                removed[-1] += t[at:stop]
            else:
                kept.append(t[at:start])
                removed.append(t[start:stop])
            at = max(at, stop)
        return _RUNS.sub(PLACEHOLDER, PLACEHOLDER.join([*kept, t[at:]])), [x.strip() for x in removed]

    @F.arrow_udf("struct<text:string,removed:array<string>>")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = []
        for t, own in zip(texts.to_pylist(), lists.to_pylist()):
            names = {v for v in map(norm_text, own or ()) if len(v) >= 2 and not _NO_NAME.fullmatch(v)}
            rows.append(dict(zip(("text", "removed"), scrubbed(t or "", names) if names else (t or "", []))))
        return pa.array(rows, pa.struct([("text", pa.string()), ("removed", pa.list_(pa.string()))]))

    return run(text, values)


def pattern_parts(pattern: Column, label: Column) -> Column:
    """What stands at the *s of a pattern in a label; [] if it doesn't match."""

    @F.arrow_udf("array<string>")
    def run(patterns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, re.Pattern] = {}
        for ps, labels in patterns:
            out = []
            for p, label in zip(ps.to_pylist(), labels.to_pylist()):
                if p not in known:
                    parts = (re.escape(x).replace(r"\#", r"\d+(?:[,.]\d+)*") for x in (p or "").split("*"))
                    known[p] = re.compile("^" + "(.+)".join(parts) + "$")
                m = known[p].match(label or "")
                out.append([x.strip() for x in m.groups()] if m else [])
            yield pa.array(out, pa.list_(pa.string()))

    return run(pattern, label)


def nfkc(text: Column) -> Column:
    """NFKC with white space squeezed; a null text is empty."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([norm_text(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def _shared_length(low: Column, high: Column) -> Column:
    """Length of the common beginning of two texts."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([len(os.path.commonprefix(x)) for x in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    return run(low, high)


def _shared_start(rows: DataFrame, group: list[str], text: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the length of the longest beginning that all texts of a group share and that ends at a blank or an end.

    The least and the greatest text tell what all share; whether each of them has a blank there is
    a second sum.  Groups of any size: nothing is gathered.
    """
    ends = rows.groupBy(*group).agg(F.min(text).alias("low"), F.max(text).alias("high")).withColumn("n", _shared_length(F.col("low"), F.col("high")))
    known = join_checked(rows, ends.select(*group, "low", "n"), group, "inner")
    whole = known.groupBy(*group).agg(F.bool_and((F.length(text) == F.col("n")) | (F.substring(text, F.col("n") + 1, F.lit(1)) == " ")).alias("whole"), F.first("low").alias("low"), F.first("n").alias("n"))
    # else up to and with the last blank within what is shared
    start = F.left("low", F.col("n"))
    cut = F.when(F.col("whole"), F.col("n")).otherwise(F.length(start) - F.length(F.substring_index(start, " ", -1)))
    return join_checked(rows, whole.select(*group, cut.alias(out)), group, "inner")


def templates(instances: DataFrame, group: list[str], title: str = "title") -> DataFrame:
    """(group, n, template): name of each screen from the titles of all its instances.

    Where they differ, a placeholder stands between their common beginning and end; both end at
    blanks.  A null title is the empty one; groups may have any number of instances.
    """
    named = checkpoint(instances.select(*group, nfkc(F.col(title)).alias("t")))
    counts = named.groupBy(*group).agg(F.count("*").alias("n_all"), F.min("t").alias("one"), (F.min("t") != F.max("t")).alias("differ"))
    several = join_checked(named.distinct(), counts.where("differ").select(*group), group, "left_semi")
    rows = _shared_start(several, group, "t", "front")
    rows = rows.withColumn("back_to_front", F.reverse(F.substring("t", F.col("front") + 1, F.length("t"))))
    rows = _shared_start(rows, group, "back_to_front", "back")
    # an end that is all that a title has left is none
    rest = F.length("back_to_front")
    sized = rows.groupBy(*group).agg(F.first("front").alias("front"), F.when(F.first("back") < F.min(rest), F.first("back")).otherwise(0).alias("back"))
    whole = join_checked(counts, sized, group, "left")
    joined = F.concat(F.left("one", F.col("front")), F.lit(PLACEHOLDER), F.right("one", F.col("back")))
    template = F.when(F.col("differ"), F.regexp_replace(joined, f"{PLACEHOLDER}(?:[\\s・、,]*{PLACEHOLDER})+", PLACEHOLDER)).otherwise(F.col("one"))
    return whole.select(*group, F.col("n_all").alias("n"), template.alias("template"))


def suggestions(keys: DataFrame, known: list[str]) -> DataFrame:
    """(key, suggestion, distance): the nearest known name of each key, if near enough; the first among equals."""
    tried = F.array(*(F.struct(F.levenshtein(F.lower("key"), F.lit(k.lower())).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(known)))
    best = F.array_min(tried)
    near = best["d"] <= F.greatest(F.lit(2), F.floor(F.length("key") / 4))
    return keys.select("key", F.when(near, best["k"]).alias("suggestion"), best["d"].alias("distance"))
