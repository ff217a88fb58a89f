"""Masking of sensitive parameter values in URLs, and in URLs within texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailweave.functions.urls import decode_query

MASK = "***"
#: Names of parameters whose values are masked; * is any text, case is ignored (fixed values).
SENSITIVE = (
    "*token*", "*secret*", "*password*", "*passwd*", "code", "state", "session*", "sid", "*apikey*", "*api_key*",
    "key", "auth*", "signature", "sig", "x-amz-*", "jwt", "otp", "email",
)


def name_pattern(globs: tuple[str, ...]) -> str:
    """One regular expression for a list of globs; matches nothing if there are none."""
    return "(?i)^(?:" + "|".join(".*".join(map(re.escape, g.split("*"))) for g in globs) + ")$" if globs else r"(?!)"


def mask_params(text: Column, globs: tuple[str, ...] = SENSITIVE) -> Column:
    """``?a=1&b=2#c=3`` with the values of sensitive names masked; what is written stays otherwise."""
    pattern = name_pattern(globs)
    # parts with the separator before them
    parts = F.regexp_extract_all(text, F.lit("[?&#]*[^?&#]+|[?&#]+"), F.lit(0))
    name = lambda p: F.regexp_extract(p, "^[?&#]*([^=]+)=", 1)
    value = lambda p: F.regexp_extract(p, "^[?&#]*[^=]+=(.+)$", 1)
    hidden = lambda p: F.when((value(p) != "") & decode_query(name(p)).rlike(pattern), F.concat(F.regexp_extract(p, "^([?&#]*[^=]+=)", 1), F.lit(MASK))).otherwise(p)
    return F.array_join(F.transform(parts, hidden), "")


def mask_url(url: Column, globs: tuple[str, ...] = SENSITIVE) -> Column:
    """An absolute or relative URL with its password and its sensitive parameters, in query and fragment, masked."""
    bare = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/@?#]*?:)[^/@?#]+@", rf"$1\*\*\*@")
    head, tail = F.regexp_extract(bare, r"(?s)^([^?#]*)", 1), F.regexp_extract(bare, r"(?s)^[^?#]*(.*)$", 1)
    return F.concat(head, mask_params(tail, globs))


def mask_urls_in_text(text: Column, globs: tuple[str, ...] = SENSITIVE) -> Column:
    """A text with the URLs in it masked."""
    pattern = r"https?://[^\s\"'<>`]+"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    put = F.zip_with(between, F.transform(found, lambda u: mask_url(u, globs)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(put, "")
