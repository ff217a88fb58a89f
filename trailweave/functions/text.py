"""Text as columns: folding numbers, squeezing space, data values, fingerprints, clipping, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' scripts see it, beyond ASCII also U+3000, no-break and zero-width ones.
SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: A number with thousands separators or decimals counts as one.
NUMBER = r"[0-9]+(?:[,.][0-9]+)*"
ELLIPSIS = "…"


def fold_digits(s: Column) -> Column:
    """Every number becomes #, so that counts don't change a text's shape."""
    return F.regexp_replace(s, NUMBER, "#")


def squeeze(s: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(s, f"{SPACE}+", " "))


def is_data_text(s: Column) -> Column:
    """Whether two characters or more are left without digits, spaces, punctuation and symbols."""
    return F.length(F.regexp_replace(s, rf"[#0-9\p{{Z}}\p{{P}}\p{{S}}]|{SPACE}", "")) >= 2


def scrub(text: Column, values: Column) -> Column:
    """``text`` (digits folded) with every data value replaced by *, longer values first."""
    folded = F.filter(F.array_distinct(F.transform(values, lambda v: squeeze(fold_digits(v)))), is_data_text)
    ordered = F.array_sort(folded, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(ordered, squeeze(text), lambda t, v: F.replace(t, v, F.lit("*")))


def sorted_set(xs: Column) -> Column:
    return F.array_sort(F.array_distinct(xs))


def fingerprint12(s: Column) -> Column:
    """First 12 hexadecimal digits of the SHA-1."""
    return F.substring(F.sha1(s.cast("binary")), 1, 12)


def clip(s: Column, most: int = 120) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit(ELLIPSIS))).otherwise(s)


def markdown_escape(s: Column) -> Column:
    return F.replace(F.regexp_replace(s, r"([\\`*_\[\]|<>])", r"\\$1"), F.lit("\n"), F.lit(" "))


def html_escape(s: Column) -> Column:
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(written))
    return s


def first_line(s: Column) -> Column:
    return F.split(s, "\n")[0]


def last_matching_line(s: Column, pattern: str, most: int = 200) -> Column:
    """The last line that matches, for the reason in a long error text; the first line if none does."""
    lines = F.filter(F.split(s, "\n"), lambda x: x.rlike(pattern))
    return F.substring(F.trim(F.coalesce(F.try_element_at(lines, F.lit(-1)), first_line(s))), 1, most)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds between two timestamps, from their milliseconds."""
    return F.round((F.unix_millis(end) - F.unix_millis(start)) / 1000).cast("long")


def run_name(ts: Column) -> Column:
    """Folder name of a run: its UTC time, sortable as text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")


def action_text(role: Column, label: Column) -> Column:
    """How a recorded action is named to people."""
    return F.concat(role, F.lit(' "'), label, F.lit('"'))


def stable_key(*columns: str) -> Column:
    """Fingerprint of several columns, to tell whether an observation has settled."""
    return F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def storage_digest(entries: Column) -> Column:
    """Digest of a map of stored keys and values, whatever their order: 'hash:length'."""
    lines = F.array_sort(F.transform(F.map_entries(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    text = F.array_join(lines, "\n")
    return F.concat_ws(":", F.lower(F.hex(F.xxhash64(text))), F.length(text).cast("string"))


def accessible_label(*sources: Column, most: int = 60) -> Column:
    """The first of the sources (label attribute, labelling element, text, value, title, image text) that says something."""
    said = [F.when(squeeze(x) != "", squeeze(x)) for x in sources]
    return F.substring(F.coalesce(*said, F.lit("")), 1, most)


def field_descriptor(tag: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", tag, F.coalesce(kind, F.lit("")), F.coalesce(name, F.lit("")))
