"""Queries over captured pages, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.functions import masking, text, urls
from trailweave.operators import compare, graph, learning, naming, skeleton
from trailweave.session import checkpoint, table
from trailweave.sources import pages as captured
from trailweave.sources import tree

NAMES, VALUES = urls.RouteOptions(query="names"), urls.RouteOptions(query="values", structural=("page",))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def page_routes(spark: SparkSession, d: str) -> DataFrame:
    r = urls.route(F.col("url"))
    return _pages(spark, d).select("page_id", urls.origin(F.col("url")).alias("origin"), r["route"].alias("route"), r["data_driven"].alias("data_driven"), F.array_join(r["data_values"], "|").alias("data_values"))


def page_external_routes(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", urls.external_route(F.col("url")).alias("external_route"))


def page_route_counts(spark: SparkSession, d: str) -> DataFrame:
    return page_routes(spark, d).groupBy("route", "data_driven").agg(F.count("*").alias("n_pages"), F.count_distinct("origin").alias("n_origins"))


def page_query_params_normalized(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    named, valued = urls.route(u, options=NAMES), urls.route(u, options=VALUES)
    return _pages(spark, d).select("page_id", named["route"].alias("by_name"), valued["route"].alias("by_value"), F.array_join(named["data_values"], "|").alias("data_values"))


def page_query_variant_routes(spark: SparkSession, d: str) -> DataFrame:
    return learning.query_variants(_pages(spark, d))


def page_segment_proposals(spark: SparkSession, d: str) -> DataFrame:
    links = _pages(spark, d).select(F.col("url").alias("target"), F.lit(False).alias("in_nav"))
    found = learning.segment_proposals(links, 2)
    return found.select("origin", "prefix", "n_values")


def page_relearned_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """What is learned of the pages' addresses after the later half of the captures took back what it did not find again.

    Each capture is +1; those of the first half, by id, are -1 later.
    """
    pages = _pages(spark, d).select("page_id", F.col("url").alias("target"), F.lit(False).alias("in_nav"))
    half = pages.agg((F.max("page_id") / 2).alias("half"))
    gone = pages.join(F.broadcast(half)).where("page_id < half").select("target", "in_nav", F.lit(-1).alias("sign"))  # one row
    links = pages.select("target", "in_nav", F.lit(1).alias("sign")).unionByName(gone)
    return learning.learned_of_signed(links, 2)


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return captured.links(_pages(spark, d)).select("page_id", "pos", "href", "target", "label", "in_nav", "nth")


def page_headings(spark: SparkSession, d: str) -> DataFrame:
    return captured.headings(_pages(spark, d)).select("page_id", "pos", "tag", "text")


def page_tree_actions(spark: SparkSession, d: str) -> DataFrame:
    """What can be acted on, by the element tree: its place among the page's regions is exact."""
    found = tree.tree_actions(_pages(spark, d), deny="form.danger", volatile="div.ad")
    return found.select("page_id", "pos", "role", "kind", "label", "href", "target", "toggle", "in_nav", "volatile", "nth")


def page_tree_headings(spark: SparkSession, d: str) -> DataFrame:
    return tree.tree_headings(_pages(spark, d), volatile="div.ad")


def page_regions(spark: SparkSession, d: str) -> DataFrame:
    """How many elements each page has, and how many of them lie in its regions."""
    rows = tree.closest(tree.elements(_pages(spark, d)), in_nav="nav, [role=navigation]", in_article="article", in_ad="div.ad")
    inside = lambda name, tag: F.count_if(F.col(name) & (F.col("tag") == tag))
    return rows.groupBy("page_id").agg(
        F.count("*").alias("n_elements"), inside("in_nav", "li").alias("nav_items"), inside("in_article", "p").alias("paragraphs"), inside("in_article", "a").alias("article_links"),
        inside("in_ad", "p").alias("ad_paragraphs"), F.count_if(F.col("in_ad")).alias("ad_elements"),
    )


def _skeletons(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    return skeleton.skeletons(p, captured.headings(p), captured.links(p))


def page_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return _skeletons(spark, d).select("page_id", "route", F.size("lines").alias("n_lines"), "structure", "signature")


def page_same_structure_groups(spark: SparkSession, d: str) -> DataFrame:
    return _skeletons(spark, d).groupBy("signature").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each page with the page before it on its host: pairs grow with the pages, not with a host's square.

    Only ids go through the window; the lines are joined to the pairs.
    """
    rows = checkpoint(_skeletons(spark, d).select("page_id", "origin", "route", "lines"))
    pairs = rows.select("page_id", F.lag("page_id").over(Window.partitionBy("origin").orderBy("page_id")).alias("before")).where("before is not null")
    first = rows.select(F.col("page_id").alias("before"), F.col("lines").alias("a"), F.col("route").alias("route_a"))
    return pairs.join(rows.drop("origin"), "page_id").join(first, "before")


def page_structure_diff(spark: SparkSession, d: str) -> DataFrame:
    x = compare.structure_diff(F.col("a"), F.col("lines"))
    return _neighbours(spark, d).select("page_id", "before", F.array_join(x["only_a"], "|").alias("only_a"), F.array_join(x["only_b"], "|").alias("only_b"))


def page_local_change_pairs(spark: SparkSession, d: str) -> DataFrame:
    local = compare.is_local_change(F.col("a"), F.col("lines"), 0.1)
    return _neighbours(spark, d).select("page_id", "before", (F.col("route") == F.col("route_a")).alias("same_route"), local.alias("local_change"))


def page_masked_urls(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", masking.mask_url(F.col("url"), (*masking.SENSITIVE, "ref", "utm_*")).alias("masked"))


def page_display_paths(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _pages(spark, d).select(
        "page_id", urls.document_url(u).alias("document_url"), urls.display_path(u, F.lit("http://ththre.example.com/")).alias("display_path"), urls.instance_key(u).alias("instance_key"),
        urls.section(urls.route(u)["route"]).alias("section"),
    )


def page_common_nav(spark: SparkSession, d: str) -> DataFrame:
    links = captured.links(_pages(spark, d))
    merged = links.select(F.col("page_id").cast("string").alias("src"), F.col("href").alias("dst"), "label", F.lit(False).alias("error"), F.col("pos").alias("edge_pos"))
    return graph.common_navigation(graph.merged_edges(merged), share=0.02)


def page_text_hash(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", text.fingerprint12(captured.body_text(F.col("html"))).alias("text_hash"))


def site_suffix(spark: SparkSession, d: str) -> DataFrame:
    """The ending that titles share; the last words of the pages' own titles, parted from the rest as sites do it."""
    titles = captured.headings(_pages(spark, d)).where("tag = 'title'").select("text", "page_id")
    last = F.substring_index("text", " ", -1)
    named = titles.select(F.concat(F.left("text", F.length("text") - F.length(last)), F.lit(" - "), last).alias("title"), F.col("page_id").alias("pos"))
    return naming.site_suffix(named)


def page_subtitles(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    heads = captured.headings(p).join(p.select("page_id", urls.route(F.col("url"))["route"].alias("name")), "page_id")
    return graph.subtitles(heads.select(F.col("page_id").alias("node"), "name", "pos", F.col("text").alias("clue")))


def page_rekey_merge(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one route merge if they are as deep in the site's paths."""
    rows = _pages(spark, d).select(F.col("page_id").alias("node"), urls.route(F.col("url"))["route"].alias("signature"), F.size(urls.segments(F.col("url"))).alias("depth"), F.col("page_id").alias("pos"))
    return graph.rekeyed(rows)


def page_redirects(spark: SparkSession, d: str) -> DataFrame:
    """Each page leads to the page before it on its route, so the chains are as long as the routes have pages."""
    r = _pages(spark, d).select("page_id", urls.route(F.col("url"))["route"].alias("route"))
    rows = r.select(F.col("page_id").alias("node"), F.lag("page_id").over(Window.partitionBy("route").orderBy("page_id")).alias("into"))
    return graph.resolve_redirects(rows.where("into is not null"))


def template_names(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    titles = captured.headings(p).where("tag = 'title'").select("page_id", F.col("text").alias("title"))
    named = titles.join(p.select("page_id", urls.origin(F.col("url")).alias("origin"), urls.route(F.col("url"))["route"].alias("route")), "page_id")
    return naming.templates(named, ["origin", "route"])


def page_candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    from trailweave.operators.judging import same_section_candidates

    r = urls.route(F.col("url"))["route"]
    rows = _pages(spark, d).select(F.col("page_id").alias("pos"), F.concat(urls.origin(F.col("url")), F.lit("/"), urls.section(r)).alias("section"), r.alias("route"))
    return same_section_candidates(rows)


QUERIES = {
    f.__name__: f
    for f in (
        page_routes, page_external_routes, page_route_counts, page_query_params_normalized, page_query_variant_routes, page_segment_proposals, page_relearned_prefixes, page_links, page_headings, page_tree_actions, page_tree_headings, page_regions,
        page_skeleton, page_same_structure_groups, page_structure_diff, page_local_change_pairs, page_masked_urls, page_display_paths, page_common_nav, page_text_hash,
        site_suffix, page_subtitles, page_rekey_merge, page_redirects, template_names, page_candidate_pairs,
    )
}

_NUMBER = "'[0-9]+(?:[,.][0-9]+)*'"
_SPACE = r"'[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+'"
_UUID = "'(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}'"


def _id_like(s: str) -> str:
    mixed = f"regexp_matches({s}, '[0-9]') AND regexp_matches({s}, '[A-Za-z]')"
    return f"(regexp_full_match({s}, '[0-9]+') OR regexp_full_match({s}, {_UUID}) OR ({mixed} AND (regexp_full_match({s}, '[0-9A-Za-z]{{8,}}') OR regexp_full_match({s}, '[0-9A-Za-z_-]{{16,}}'))))"


def _fold(s: str) -> str:
    return f"regexp_replace({s}, {_NUMBER}, '#', 'g')"


def _squeeze(s: str) -> str:
    return f"trim(regexp_replace({s}, {_SPACE}, ' ', 'g'))"


def _plain(s: str) -> str:
    out = f"regexp_replace({s}, '(?s)<[^>]*>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return _squeeze(out)


#: Parts of each page's URL, its segments, and both normalized.
_URLS = f"""
parts AS (SELECT page_id, url, html, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$', ['scheme', 'host', 'path', 'query', 'frag']) AS x FROM pages),
u AS (SELECT page_id, url, html, lower(x.scheme) || '://' || lower(x.host) AS origin, lower(x.host) AS host, CASE WHEN x.path = '' THEN '/' ELSE x.path END AS path, x.query AS query, x.frag AS frag FROM parts),
s AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda a: a <> ''), lambda a: url_decode(a)) AS segs FROM u),
n AS (SELECT *, list_transform(segs, lambda a: CASE WHEN a IN ('*', '#') THEN a WHEN {_id_like('a')} THEN '*' ELSE {_fold('a')} END) AS norm FROM s),
r AS (SELECT *, '/' || array_to_string(norm, '/') AS route, list_contains(norm, '*') AS data_driven,
      list_transform(list_filter(string_split(substr(query, 2), '&'), lambda a: a <> ''), lambda a: {{'k': string_split(a, '=')[1], 'v': coalesce(string_split(a, '=')[2], '')}}) AS pairs FROM n)
"""
_HEADS = f"""
h0 AS (SELECT page_id, regexp_extract_all(html, '(?is)<(?:title|h[1-6])\\b[^>]*>.*?</(?:title|h[1-6])\\s*>') AS found FROM pages),
h1 AS (SELECT page_id, unnest(found) AS element, unnest(range(len(found))) AS pos FROM h0),
heads AS (SELECT page_id, CAST(pos AS INT) AS pos, lower(regexp_extract(element, '^<(\\w+)', 1)) AS tag, {_plain('element')} AS text FROM h1)
"""
_LINKS = f"""
l0 AS (SELECT page_id, origin, path, regexp_extract_all(html, '(?is)<nav\\b[^>]*>|</nav>|<a\\s[^>]*>.*?</a\\s*>') AS found FROM r),
l1 AS (SELECT page_id, origin, path, unnest(found) AS t, unnest(range(len(found))) AS k FROM l0),
l2 AS (SELECT *, sum(CASE WHEN lower(t) LIKE '<nav%' THEN 1 WHEN lower(t) LIKE '</nav%' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k) AS depth FROM l1),
l3 AS (SELECT page_id, origin, k, depth > 0 AS in_nav, regexp_extract(t, '(?is)\\shref\\s*=\\s*"([^"]*)"', 1) AS href, substr({_plain('t')}, 1, 60) AS label FROM l2 WHERE lower(t) LIKE '<a%'),
links AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS pos, href, origin || href AS target, label, in_nav, CAST(row_number() OVER (PARTITION BY page_id, label ORDER BY k) - 1 AS INT) AS nth FROM l3)
"""
_SKELETONS = f"""
hl AS (SELECT h.page_id, h.pos, CASE WHEN r.data_driven AND h.tag = 'h1' THEN 'h:h1' ELSE 'h:' || h.tag || ':' || {_squeeze(_fold('h.text'))} END AS line FROM heads h JOIN r USING (page_id) WHERE h.tag <> 'title'),
hg AS (SELECT page_id, list(line ORDER BY pos) AS lines FROM (SELECT page_id, line, min(pos) AS pos FROM hl GROUP BY ALL) GROUP BY page_id),
lt AS (SELECT l.page_id, '/' || array_to_string(list_transform(list_filter(string_split(l.href, '/'), lambda a: a <> ''), lambda a: CASE WHEN {_id_like('a')} THEN '*' ELSE {_fold('a')} END), '/') AS route FROM links l),
ag AS (SELECT lt.page_id, list_sort(list_distinct(list('a:link|' || lt.route))) AS lines FROM lt JOIN r ON r.page_id = lt.page_id AND r.route <> lt.route GROUP BY lt.page_id),
sk AS (SELECT r.page_id, r.origin, r.route, coalesce(hg.lines, []) || coalesce(ag.lines, []) AS lines FROM r LEFT JOIN hg USING (page_id) LEFT JOIN ag USING (page_id)),
sg AS (SELECT *, array_to_string(lines, chr(10)) AS structure, substr(sha1(route || '||' || array_to_string(lines, chr(10))), 1, 12) AS signature FROM sk)
"""
_NEIGHBOURS = """
nb0 AS (SELECT page_id, route, lines, lag(page_id) OVER w AS before, lag(lines) OVER w AS a, lag(route) OVER w AS route_a FROM sg WINDOW w AS (PARTITION BY origin ORDER BY page_id)),
nb AS (SELECT * FROM nb0 WHERE before IS NOT NULL)
"""
_GLOBS = r"(?i)(.*token.*|.*secret.*|.*password.*|.*passwd.*|code|state|session.*|sid|.*apikey.*|.*api_key.*|key|auth.*|signature|sig|x-amz-.*|jwt|otp|email|ref|utm_.*)"

SQL = {
    "page_routes": f"WITH {_URLS} SELECT page_id, origin, route, data_driven, array_to_string(list_filter(segs, lambda a: {_id_like('a')}), '|') AS data_values FROM r",
    "page_external_routes": f"WITH {_URLS} SELECT page_id, '//' || host || '/' || array_to_string(norm, '/') AS external_route FROM r",
    "page_route_counts": f"WITH {_URLS} SELECT route, data_driven, count(*) AS n_pages, count(DISTINCT origin) AS n_origins FROM r GROUP BY ALL",
    "page_query_params_normalized": f"""WITH {_URLS},
        q AS (SELECT *, list_sort(list_distinct(list_transform(pairs, lambda p: p.k))) AS names, list_sort(list_distinct(list_transform(pairs, lambda p: p.k || '=' || {_fold('p.v')}))) AS vals FROM r)
        SELECT page_id, route || CASE WHEN len(names) > 0 THEN '?' || array_to_string(names, '&') ELSE '' END AS by_name, route || CASE WHEN len(vals) > 0 THEN '?' || array_to_string(vals, '&') ELSE '' END AS by_value,
        array_to_string(list_filter(segs, lambda a: {_id_like('a')}) || list_transform(list_filter(pairs, lambda p: p.v <> ''), lambda p: p.v), '|') AS data_values FROM q""",
    "page_query_variant_routes": f"""WITH {_URLS},
        q AS (SELECT DISTINCT origin, route, array_to_string(list_sort(list_transform(pairs, lambda p: p.k || '=' || p.v)), '&') AS rest FROM r)
        SELECT origin, route, count(*) AS n_queries FROM q WHERE rest <> '' GROUP BY ALL HAVING count(*) >= 2""",
    "page_segment_proposals": f"""WITH {_URLS},
        i AS (SELECT DISTINCT url, origin, segs, norm FROM r), places AS (SELECT origin, url, segs, norm, unnest(range(1, len(segs))) AS i FROM i),
        v AS (SELECT origin, '/' || array_to_string(norm[1:i], '/') AS prefix, i, array_to_string(norm[1:i] || ['*'] || norm[i + 2:], '/') AS shape, segs[i + 1] AS value, min(url) AS target FROM places WHERE norm[i + 1] NOT IN ('*', '#') AND norm[i] <> '#' GROUP BY ALL),
        g AS (SELECT origin, prefix, i, shape, count(*) AS n FROM v GROUP BY ALL HAVING count(*) >= 2)
        SELECT origin, prefix, CAST(sum(n) AS BIGINT) AS n_values FROM g GROUP BY ALL""",
    "page_relearned_prefixes": f"""WITH {_URLS},
        i AS (SELECT DISTINCT url, origin, segs, norm FROM r WHERE page_id >= (SELECT max(page_id) / 2 FROM pages)), places AS (SELECT origin, url, segs, norm, unnest(range(1, len(segs))) AS i FROM i),
        v AS (SELECT origin, '/' || array_to_string(norm[1:i], '/') AS prefix, i, array_to_string(norm[1:i] || ['*'] || norm[i + 2:], '/') AS shape, segs[i + 1] AS value, min(url) AS target FROM places WHERE norm[i + 1] NOT IN ('*', '#') AND norm[i] <> '#' GROUP BY ALL),
        g AS (SELECT origin, prefix, i, shape, count(*) AS n FROM v GROUP BY ALL HAVING count(*) >= 2)
        SELECT origin, prefix, CAST(sum(n) AS BIGINT) AS n_values FROM g GROUP BY ALL""",
    "page_links": f"WITH {_URLS}, {_LINKS} SELECT page_id, pos, href, target, label, in_nav, nth FROM links",
    "page_tree_actions": f"""WITH {_URLS}, {_LINKS} SELECT page_id, pos, 'link' AS role, 'click' AS kind, label, href, target, false AS toggle, in_nav, false AS volatile, nth FROM links""",
    "page_tree_headings": f"""WITH {_HEADS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INT) AS pos, tag, text FROM heads WHERE tag <> 'title'""",
    "page_regions": """WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|(<(script|style|title)\\b[^>]*>).*?</(script|style|title)\\s*>', '\\1', 'g') AS h FROM pages),
        x AS (SELECT *, regexp_extract(h, '(?is)<nav\\b.*?</nav>') AS nav, regexp_extract(h, '(?is)<article\\b.*?</article>') AS art, regexp_extract(h, '(?is)<div class="ad">.*?</div>') AS ad FROM b)
        SELECT page_id, len(regexp_extract_all(h, '<[a-zA-Z]')) AS n_elements, len(regexp_extract_all(nav, '(?i)<li\\b')) AS nav_items, len(regexp_extract_all(art, '(?i)<p\\b')) AS paragraphs,
        len(regexp_extract_all(art, '(?i)<a\\b')) AS article_links, len(regexp_extract_all(ad, '(?i)<p\\b')) AS ad_paragraphs, len(regexp_extract_all(ad, '<[a-zA-Z]')) AS ad_elements FROM x""",
    "page_headings": f"WITH {_HEADS} SELECT page_id, pos, tag, text FROM heads",
    "page_skeleton": f"WITH {_URLS}, {_HEADS}, {_LINKS}, {_SKELETONS} SELECT page_id, route, CAST(len(lines) AS INT) AS n_lines, structure, signature FROM sg",
    "page_same_structure_groups": f"WITH {_URLS}, {_HEADS}, {_LINKS}, {_SKELETONS} SELECT signature, count(*) AS n_pages, min(page_id) AS first_page FROM sg GROUP BY ALL",
    "page_structure_diff": f"""WITH {_URLS}, {_HEADS}, {_LINKS}, {_SKELETONS}, {_NEIGHBOURS}
        SELECT page_id, before, array_to_string(list_filter(a, lambda x: NOT list_contains(lines, x))[1:8], '|') AS only_a, array_to_string(list_filter(lines, lambda x: NOT list_contains(a, x))[1:8], '|') AS only_b FROM nb""",
    "page_local_change_pairs": f"""WITH {_URLS}, {_HEADS}, {_LINKS}, {_SKELETONS}, {_NEIGHBOURS},
        x AS (SELECT *, list_filter(a, lambda y: y LIKE 'h:%') AS ah, list_filter(a, lambda y: y NOT LIKE 'h:%') AS ar FROM nb)
        SELECT page_id, before, route = route_a AS same_route, len(ah) + len(ar) > 0 AND len(list_filter(ah, lambda y: NOT list_contains(lines, y))) = 0
        AND (len(ar) = 0 OR len(list_filter(ar, lambda y: list_contains(lines, y))) >= len(ar) * 0.1) AS local_change FROM x""",
    "page_masked_urls": f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS head, regexp_extract_all(regexp_extract(url, '^[^?#]*(.*)$', 1), '[?&#]*[^?&#]+|[?&#]+') AS parts FROM pages)
        SELECT page_id, head || array_to_string(list_transform(parts, lambda a: CASE WHEN regexp_extract(a, '^[?&#]*[^=]+=(.+)$', 1) <> '' AND regexp_full_match(regexp_extract(a, '^[?&#]*([^=]+)=', 1), '{_GLOBS}')
        THEN regexp_extract(a, '^([?&#]*[^=]+=)', 1) || '***' ELSE a END), '') AS masked FROM p""",
    "page_display_paths": f"""WITH {_URLS} SELECT page_id, CASE WHEN regexp_matches(frag, '^#!?/') THEN url ELSE regexp_replace(url, '#.*$', '') END AS document_url,
        CASE WHEN origin = 'http://ththre.example.com' THEN path || query ELSE host || path END AS display_path, regexp_replace(path, '/+$', '') || query || CASE WHEN regexp_matches(frag, '^#!?/') THEN frag ELSE '' END AS instance_key,
        coalesce(string_split(route, '/')[2], '') AS section FROM r""",
    "page_common_nav": f"""WITH {_URLS}, {_LINKS}, m AS (SELECT DISTINCT page_id, label, href FROM links), t AS (SELECT count(DISTINCT page_id) AS with_out FROM m)
        SELECT label, href AS dst, count(DISTINCT page_id) AS sources FROM m, t GROUP BY label, href, with_out HAVING count(DISTINCT page_id) >= greatest(3, ceil(with_out * 0.02))""",
    "page_text_hash": f"""SELECT page_id, substr(sha1({_plain("regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<head\\b.*?</head\\s*>|<template\\b.*?</template\\s*>', ' ', 'g')")}), 1, 12) AS text_hash FROM pages""",
    "site_suffix": f"""WITH {_HEADS}, t AS (SELECT left(text, length(text) - length(string_split(text, ' ')[-1])) || ' - ' || string_split(text, ' ')[-1] AS title, page_id FROM heads WHERE tag = 'title'),
        c AS (SELECT regexp_extract(title, '^.+?((?:\\s+[—–\\-|｜:：]\\s+)(?:[^\\s]|\\s[^—–\\-|｜:：]|\\s[—–\\-|｜:：][^\\s])*)$', 1) AS suffix, count(*) AS n, min(page_id) AS f FROM t WHERE title <> '' GROUP BY ALL),
        b AS (SELECT * FROM c WHERE suffix <> '' ORDER BY n DESC, f LIMIT 1), z AS (SELECT count(*) AS total FROM t WHERE title <> '')
        SELECT CASE WHEN total >= 2 AND n >= greatest(2, total / 2) THEN suffix ELSE '' END AS suffix FROM z, b""",
    "page_subtitles": f"""WITH {_URLS}, {_HEADS}, c AS (SELECT h.page_id AS node, r.route AS name, h.pos, h.text AS clue FROM heads h JOIN r USING (page_id)),
        z AS (SELECT name, count(DISTINCT node) AS size FROM c GROUP BY ALL HAVING count(DISTINCT node) >= 2), sh AS (SELECT name, clue, count(DISTINCT node) - 1 AS shared FROM c GROUP BY ALL),
        k AS (SELECT node, clue, shared, size, row_number() OVER (PARTITION BY node ORDER BY shared, pos) AS k FROM c JOIN z USING (name) JOIN sh USING (name, clue) WHERE clue <> '')
        SELECT node, clue AS subtitle FROM k WHERE k = 1 AND shared < size - 1""",
    "page_rekey_merge": f"""WITH {_URLS}, a AS (SELECT page_id AS node, route AS signature, CAST(len(segs) AS INT) AS depth, min(page_id) OVER (PARTITION BY route, len(segs)) AS final FROM r),
        b AS (SELECT *, dense_rank() OVER (PARTITION BY signature ORDER BY final) AS k FROM a)
        SELECT node, signature, depth, final, CASE WHEN k > 1 THEN signature || '~' || k ELSE signature END AS new_signature FROM b""",
    "page_redirects": f"""WITH RECURSIVE {_URLS}, e AS (SELECT * FROM (SELECT page_id AS node, lag(page_id) OVER (PARTITION BY route ORDER BY page_id) AS into_node FROM r) WHERE into_node IS NOT NULL),
        w AS (SELECT node, into_node AS final FROM e UNION ALL SELECT w.node, e.into_node FROM w JOIN e ON e.node = w.final) SELECT node, min(final) AS final FROM w GROUP BY node""",
    "template_names": f"""WITH {_URLS}, {_HEADS}, t AS (SELECT r.origin, r.route, trim(regexp_replace(h.text, '\\s+', ' ', 'g')) AS t FROM heads h JOIN r USING (page_id) WHERE h.tag = 'title'),
        g AS (SELECT origin, route, count(*) AS n, min(t) AS lo, max(t) AS hi, list(t) AS ts FROM t GROUP BY ALL),
        a AS (SELECT *, coalesce(list_min(list_filter(range(1, least(length(lo), length(hi)) + 1), lambda i: substr(lo, i, 1) <> substr(hi, i, 1))) - 1, least(length(lo), length(hi))) AS c FROM g),
        b AS (SELECT *, CASE WHEN len(list_filter(ts, lambda x: length(x) <> c AND substr(x, c + 1, 1) <> ' ')) = 0 THEN c ELSE c - length(string_split(left(lo, c), ' ')[-1]) END AS front FROM a),
        d AS (SELECT *, list_transform(ts, lambda x: reverse(substr(x, front + 1))) AS rs FROM b),
        e AS (SELECT *, list_min(rs) AS rlo, list_max(rs) AS rhi FROM d),
        f AS (SELECT *, coalesce(list_min(list_filter(range(1, least(length(rlo), length(rhi)) + 1), lambda i: substr(rlo, i, 1) <> substr(rhi, i, 1))) - 1, least(length(rlo), length(rhi))) AS rc FROM e),
        h AS (SELECT *, CASE WHEN len(list_filter(rs, lambda x: length(x) <> rc AND substr(x, rc + 1, 1) <> ' ')) = 0 THEN rc ELSE rc - length(string_split(left(rlo, rc), ' ')[-1]) END AS back0 FROM f),
        k AS (SELECT *, CASE WHEN back0 < list_min(list_transform(rs, lambda x: length(x))) THEN back0 ELSE 0 END AS back FROM h)
        SELECT origin, route, n, CASE WHEN lo = hi THEN lo ELSE left(lo, front) || '〇〇' || right(lo, CAST(back AS INT)) END AS template FROM k""",
    "page_candidate_pairs": f"""WITH {_URLS}, x AS (SELECT page_id AS pos, origin || '/' || coalesce(string_split(route, '/')[2], '') AS section, route FROM r),
        near AS (SELECT a.pos, b.pos AS other, a.route = b.route AS same_route, row_number() OVER (PARTITION BY a.pos, a.route = b.route ORDER BY b.pos DESC) AS k,
              row_number() OVER (PARTITION BY a.pos ORDER BY b.pos DESC) AS place_all FROM x a JOIN x b ON a.section = b.section AND b.pos < a.pos),
        c AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY same_route DESC, other DESC) AS place FROM near WHERE CASE WHEN same_route THEN k <= 8 ELSE place_all <= 16 END)
        SELECT pos, other, same_route FROM c WHERE place <= 8""",
}
