"""URLs as columns: parts, route normalization, external routes, display paths.

The query of a page is part of its route only as far as the options say.  Origins are columns,
not a setting: pages of many origins are normalized in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailweave.functions.text import fold_digits

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
HASH_ROUTE = r"^#!?/"


@dataclass(frozen=True)
class RouteOptions:
    """What of a URL tells pages apart.

    ``path_rules``: (pattern, replacement) pairs, each applied to its first match in the path.
    ``query``: ignore, names or values.  ``structural``: parameters that always count.
    ``data``: parameters whose values are data.  ``learned``: paths below which a segment is data.
    """

    path_rules: tuple[tuple[str, str], ...] = ()
    query: str = "ignore"
    structural: tuple[str, ...] = ()
    data: tuple[str, ...] = ()
    learned: tuple[str, ...] = field(default=())


def decode(s: Column) -> Column:
    """Percent-decoded, + kept; the text itself where an escape is malformed."""
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def decode_query(s: Column) -> Column:
    """As in queries: + is a blank."""
    return F.coalesce(F.try_url_decode(s), s)


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _URL, k)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host with its port, but for the scheme's own."""
    bare = F.lower(_part(url, 2))
    return F.when(scheme(url) == "http", F.regexp_replace(bare, ":80$", "")).when(scheme(url) == "https", F.regexp_replace(bare, ":443$", "")).otherwise(bare)


def origin(url: Column) -> Column:
    """scheme://host, or null if the text isn't an absolute URL."""
    return F.when(_part(url, 2) != "", F.concat(scheme(url), F.lit("://"), host(url)))


def path(url: Column) -> Column:
    return F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def resolve(href: Column, page_url: Column) -> Column:
    """A link's absolute URL: absolute, //host, /path, ?query, #fragment and relative paths."""
    base = origin(page_url)
    folder = F.regexp_replace(path(page_url), "[^/]*$", "")
    relative = F.concat(folder, href)
    # ./ and ../ of relative paths, as far as they occur one after the other
    for _ in range(4):
        relative = F.regexp_replace(F.regexp_replace(relative, r"/\./", "/"), r"/(?!\.\./)[^/]+/\.\./", "/")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(page_url), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(base, href))
        .when(href.startswith("?"), F.concat(base, path(page_url), href))
        .when(href.startswith("#"), F.concat(base, path(page_url), query(page_url), href))
        .when(href == "", page_url)
        .otherwise(F.concat(base, relative))
    )


def is_http(url: Column) -> Column:
    return url.rlike("(?i)^https?:")


def is_external(url: Column, page_url: Column) -> Column:
    return is_http(url) & ~origin(url).eqNullSafe(origin(page_url))


def document_url(url: Column) -> Column:
    """Without an in-page anchor; a fragment that is a route stays."""
    return F.when(fragment(url).rlike(HASH_ROUTE), url).otherwise(F.regexp_replace(url, "#.*$", ""))


def _split(p: Column) -> Column:
    return F.transform(F.filter(F.split(p, "/"), lambda x: x != ""), decode)


def segments(url: Column) -> Column:
    """Decoded path segments; a route in the fragment follows after a segment '#'."""
    own, routed = _split(path(url)), fragment(url).rlike(HASH_ROUTE)
    return F.when(routed, F.concat(own, F.array(F.lit("#")), _split(F.regexp_extract(fragment(url), r"^#!?(/[^?]*)", 1)))).otherwise(own)


def search(url: Column) -> Column:
    """The query that counts: that of a route in the fragment, if it has one."""
    own = F.regexp_extract(fragment(url), r"^#!?/[^?]*(\?.*)$", 1)
    return F.when(own != "", own).otherwise(query(url))


def is_id_like(s: Column) -> Column:
    """Digits only, a UUID, or letters and digits mixed: 8 or more, 16 with - and _."""
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    uuid = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return s.rlike("^[0-9]+$") | s.rlike(uuid) | (mixed & (s.rlike("^[0-9A-Za-z]{8,}$") | s.rlike("^[0-9A-Za-z_-]{16,}$")))


def replace_first(s: Column, pattern: str, replacement: str) -> Column:
    """``s`` with the first match replaced; $1 is a group.  The pattern sees the match without what is around it."""
    found = F.regexp_extract(s, pattern, 0)
    parts = F.split(s, pattern, 2)
    put = F.regexp_replace(found, pattern, replacement)
    return F.when(s.rlike(pattern), F.concat(parts[0], put, F.coalesce(F.get(parts, 1), F.lit("")))).otherwise(s)


def ruled_segments(segs: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    if not rules:
        return segs
    text = F.concat(F.lit("/"), F.array_join(segs, "/"))
    for pattern, replacement in rules:
        text = replace_first(text, pattern, replacement)
    return F.filter(F.split(text, "/"), lambda x: x != "")


def normalized(segs: Column, learned: Column | None = None) -> Column:
    """{norm, values} of segments: data become *, other digits #; a prefix is of normalized segments.

    ``learned``: column with the array of paths below which a segment is data.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("norm"), empty.alias("values"))

    def step(done: Column, s: Column) -> Column:
        below = F.array_contains(learned, F.concat(F.lit("/"), F.array_join(done["norm"], "/"))) & (F.size(done["norm"]) >= 1) if learned is not None else F.lit(False)
        keep = s.isin("*", "#")
        data = ~keep & (is_id_like(s) | below)
        return F.struct(
            F.concat(done["norm"], F.array(F.when(keep, s).when(data, "*").otherwise(fold_digits(s)))).alias("norm"),
            F.when(data, F.concat(done["values"], F.array(s))).otherwise(done["values"]).alias("values"),
        )

    return F.aggregate(segs, start, step)


def query_pairs(q: Column) -> Column:
    """[{k, v}] of a query in order, repeated names too."""
    pairs = F.filter(F.split(F.regexp_replace(q, r"^\?", ""), "&"), lambda x: x != "")
    name = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    value = lambda p: F.regexp_extract(p, "^[^=]*=(.*)$", 1)
    return F.transform(pairs, lambda p: F.struct(decode_query(name(p)).alias("k"), decode_query(value(p)).alias("v")))


def normalized_query(q: Column, options: RouteOptions) -> Column:
    """{query, values, data}: sorted distinct parts that count, data values, and whether data drive the page."""
    pairs = query_pairs(q)
    structural, data = list(options.structural), list(options.data)
    is_data = lambda p: ~p["k"].isin(structural) & p["k"].isin(data) if data else F.lit(False)
    rest = {"values": lambda p: F.concat(p["k"], F.lit("="), fold_digits(p["v"])), "names": lambda p: p["k"], "ignore": lambda p: F.lit(None).cast("string")}[options.query]
    part = lambda p: (
        F.when(p["k"].isin(structural) if structural else F.lit(False), F.concat(p["k"], F.lit("="), fold_digits(p["v"])))
        .when(is_data(p), F.concat(p["k"], F.lit("=*")))
        .otherwise(rest(p))
    )
    named = (lambda p: ~p["k"].isin(structural + data) & (p["v"] != "")) if options.query == "names" else (lambda p: F.lit(False))
    parts = F.array_sort(F.array_distinct(F.filter(F.transform(pairs, part), lambda x: x.isNotNull())))
    values = F.transform(F.filter(pairs, lambda p: is_data(p) | named(p)), lambda p: p["v"])
    return F.struct(F.array_join(parts, "&").alias("query"), values.alias("values"), F.exists(pairs, is_data).alias("data"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is written once in the plan, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def route(url: Column, own_origin: Column | None = None, options: RouteOptions = RouteOptions(), learned: Column | None = None) -> Column:
    """{route, data_values, data_driven} of a URL; null if it isn't http(s) or of another origin."""
    if learned is None and options.learned:
        learned = F.array(*map(F.lit, options.learned))
    original = segments(url)
    ruled = ruled_segments(original, options.path_rules)
    changed = F.filter(F.zip_with(original, ruled, lambda a, b: F.when(a != b, a)), lambda x: x.isNotNull())
    by_rule = F.when(F.size(ruled) == F.size(original), changed).otherwise(F.array().cast("array<string>")) if options.path_rules else F.array().cast("array<string>")

    def found(done: Column, q: Column) -> Column:
        text = F.concat(F.lit("/"), F.array_join(done["norm"], "/"), F.when(q["query"] != "", F.concat(F.lit("?"), q["query"])).otherwise(""))
        return F.struct(
            text.alias("route"), F.concat(by_rule, done["values"], q["values"]).alias("data_values"), (F.array_contains(done["norm"], "*") | q["data"]).alias("data_driven")
        )

    both = F.struct(normalized(ruled, learned).alias("done"), normalized_query(search(url), options).alias("q"))
    whole = _let(both, lambda x: found(x["done"], x["q"]))
    same = is_http(url) & origin(url).isNotNull()
    same = same & origin(url).eqNullSafe(own_origin) if own_origin is not None else same
    return F.when(same, whole)


def external_route(url: Column) -> Column:
    """//host/path of another site, ids folded, without query and fragment; the text itself if it is no URL."""
    folded = F.transform(_split(path(url)), lambda s: F.when(is_id_like(s), "*").otherwise(fold_digits(s)))
    return F.when(origin(url).isNotNull(), F.concat(F.lit("//"), host(url), F.lit("/"), F.array_join(folded, "/"))).otherwise(url)


def display_path(url: Column, base: Column) -> Column:
    """Readable address: path and query of the own site, host and path of another."""
    own = origin(url).eqNullSafe(origin(base))
    return F.when(origin(url).isNull(), url).when(own, decode(F.concat(path(url), query(url)))).otherwise(decode(F.concat(host(url), path(url))))


def instance_key(url: Column) -> Column:
    """What tells instances of a template apart: path without closing /, query and route in the fragment."""
    routed = F.when(fragment(url).rlike(HASH_ROUTE), decode(fragment(url))).otherwise("")
    return F.when(origin(url).isNull(), url).otherwise(F.concat(F.regexp_replace(decode(path(url)), "/+$", ""), query(url), routed))


def data_values_at(route_text: Column, url: Column) -> Column:
    """Values of the URL at the route's * segments and of its name-only parameters."""
    segs = F.filter(F.split(F.split(route_text, r"\?")[0], "/"), lambda x: x != "")
    own = _split(path(url))
    at = F.filter(F.zip_with(segs, own, lambda a, b: F.when(a == "*", b)), lambda x: x.isNotNull())
    names = F.filter(F.split(F.regexp_extract(route_text, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~F.contains(x, F.lit("=")))
    named = F.transform(F.filter(query_pairs(query(url)), lambda p: F.array_contains(names, p["k"])), lambda p: p["v"])
    return F.concat(F.when(F.size(segs) == F.size(own), at).otherwise(F.array().cast("array<string>")), named)


def section(route_text: Column) -> Column:
    """First segment of a route's path."""
    return F.coalesce(F.get(F.split(F.split(route_text, r"\?")[0], "/"), 1), F.lit(""))


def is_allowed_host(url: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Hosts that may be visited: local ones and those listed."""
    name = F.regexp_replace(host(url), r":[0-9]+$", "")
    local = name.isin("localhost", "127.0.0.1", "[::1]") | name.endswith(".local") | name.endswith(".localhost")
    return local | name.isin(*allowed) if allowed else local
