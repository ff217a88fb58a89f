"""DuckDB SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

REPEATS = """
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM b)),
c AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
x AS (SELECT p.rid, p.i, CASE WHEN p.i - lag(p.i) OVER (PARTITION BY p.rid ORDER BY p.i) <= 200 THEN 0 ELSE 1 END AS new FROM p JOIN c USING (k)),
y AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM x),
s AS (SELECT rid, min(i) AS start, max(i) + 200 AS stop FROM y GROUP BY rid, run),
t AS (SELECT s.rid, s.start, s.stop, substr(b.h, 2 * coalesce(lag(s.stop) OVER w, 0) + 1, 2 * (s.start - coalesce(lag(s.stop) OVER w, 0))) AS piece
      FROM s JOIN b USING (rid) WINDOW w AS (PARTITION BY s.rid ORDER BY s.start)),
g AS (SELECT rid, count(*) AS n_spans, sum(stop - start) AS n_removed, max(stop) AS last, string_agg(piece, '' ORDER BY start) AS kept FROM t GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN g USING (rid)
"""


def _words_of(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORDS}')"


CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words_of("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words_of("text")} AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(10, len(w)) AS width, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
v AS (SELECT DISTINCT width FROM q),
p AS (SELECT rid, width, i, array_to_string(w[i:i + width - 1], ' ') AS phrase FROM (SELECT rid, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, v WHERE len(w) >= width)),
h AS (SELECT p.rid, p.i, p.width, q.item FROM p JOIN q USING (width, phrase)),
n AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + width)) AS k FROM h) GROUP BY rid),
-- proximity: all words of a window within 20 words of the document, looked for around the window's rarest word
y AS (SELECT DISTINCT item, list_sort(list_distinct(string_split(phrase, ' '))) AS ws FROM q WHERE item IS NOT NULL),
o AS (SELECT rid, word, i FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d)),
f AS (SELECT word, count(*) AS n FROM o GROUP BY word),
r AS (SELECT ws, arg_min(word, n) AS word FROM (SELECT ws, unnest(ws) AS word FROM (SELECT DISTINCT ws FROM y)) JOIN f USING (word) GROUP BY ws HAVING count(*) = len(ws)),
z AS (SELECT y.item, y.ws, o.rid, o.i, d.w FROM y JOIN r USING (ws) JOIN o USING (word) JOIN d ON d.rid = o.rid WHERE list_has_all(d.w[greatest(1, o.i - 19):o.i + 19], y.ws)),
e AS (SELECT rid, count(DISTINCT item) AS n_near FROM (SELECT rid, item, ws, w, unnest(range(greatest(1, i - 19), i + 1)) AS s FROM z) WHERE list_has_all(w[s:s + 19], ws) GROUP BY rid),
m AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM h WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid) LEFT JOIN e USING (rid)
"""

ARCHIVE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('{_BASE32}', CAST((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS INT) >> (15 - 5 * (k % 4))) & 31 AS INT) + 1, 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

_SPACES = r"[\x20\x09-\x0D]"
_TOKEN = r"[^\x20\x09-\x0D]+"

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{_TOKEN}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_TOKEN}')) AS lines FROM d),
g AS (SELECT rid, i, md5(array_to_string(w[i:i + 7], ' ')) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS k FROM r) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACES}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words, len(lines) AS n_lines,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS n_letters,
        len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_wordlike FROM w LEFT JOIN n USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR 10 * n_stutters > 3 * n_words OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words
            OR 2 * n_upper > n_letters OR 2 * n_wordlike < n_words) AS kept
FROM f
"""

FIRST_WINDOWS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS w FROM documents),
p AS (SELECT rid, doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
f AS (SELECT rid, i, row(doc_id IS NOT NULL, doc_id, i) AS own, min(row(doc_id IS NOT NULL, doc_id, i)) OVER (PARTITION BY k) AS first FROM p),
r AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS i FROM f WHERE own IS DISTINCT FROM first),
k AS (SELECT x.rid, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x ANTI JOIN r ON r.rid = x.rid AND r.i = x.i GROUP BY x.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""


def _lloyd(k: int, dims: int, rounds: int) -> str:
    steps = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
x AS MATERIALIZED (SELECT rid, unnest(v) AS x, unnest(range(1, {dims} + 1)) AS p FROM v),
s AS (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v FROM v),
c0 AS MATERIALIZED (SELECT c, unnest(v) AS x, unnest(range(1, {dims} + 1)) AS p FROM s WHERE c < {k})"""
    ]
    for t in range(rounds + 1):
        pairs = f"SELECT rid, c, CAST(sum((x.x - y.x) * (x.x - y.x)) AS BIGINT) AS d FROM x JOIN c{t} y USING (p) GROUP BY rid, c"
        steps.append(f"a{t} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM ({pairs}) GROUP BY rid)")
        if t < rounds:
            sums = f"SELECT c, p, sum(x) AS s, count(*) AS n FROM x JOIN a{t} USING (rid) GROUP BY c, p"
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT o.c, o.p, CASE WHEN n IS NULL THEN o.x ELSE {floor} END AS x FROM c{t} o LEFT JOIN ({sums}) m ON m.c = o.c AND m.p = o.p)")
    steps.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return (
        ",\n".join(steps)
        + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN h USING (c)"""
    )


def _field(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _merkle(levels: int, above: int) -> str:
    """``levels`` over the leaves of a group and ``above`` over the groups: as many as the largest table in use needs, or more."""
    steps = [
        f"""WITH bits AS (SELECT range AS b, list_reduce(list_concat([range], list_transform(range(8), lambda z: 0)), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS t FROM range(256)),
lookup AS MATERIALIZED (SELECT list(t ORDER BY b) AS t FROM bits),
ids AS (SELECT row_number() OVER () AS rid, * FROM documents),
crc AS (SELECT rid, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])) AS c FROM ids, lookup),
d AS (SELECT rid, doc_id, source, {_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} AS head, text, CASE WHEN xor(c, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM ids JOIN crc USING (rid)),
l AS (SELECT rid, doc_id, source, sha256(head || {_field("text")}) AS leaf, sha256(head || {_field("cut")}) AS cut FROM d),
n0 AS MATERIALIZED (SELECT rid, doc_id, leaf, cut, dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM l)"""
    ]

    def climb(first: str, name: str, n: int) -> None:
        source = first
        for k in range(1, n + 1):
            steps.append(f"{name}{k} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN max(i) = 0 AND max(m) = 0 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, max(i) OVER (PARTITION BY g) AS m FROM {source}) GROUP BY g, i // 3)")
            source = f"{name}{k}"

    climb("n0", "n", levels)
    steps.append(f"t0 AS MATERIALIZED (SELECT 0 AS g, g AS i, h FROM n{levels})")
    climb("t0", "t", above)
    # siblings of each leaf, level by level, and the leaf folded with them
    steps.append("f0 AS MATERIALIZED (SELECT rid, g, i, cut AS h, '' AS proof FROM n0)")

    def fold(source: str, to: str, nodes: str, key: str) -> None:
        near = f"SELECT f.rid, string_agg(CASE WHEN n.i < f.i THEN n.h END, '' ORDER BY n.i) AS a, string_agg(CASE WHEN n.i > f.i THEN n.h END, '' ORDER BY n.i) AS b FROM {source} f JOIN {nodes} n ON n.g = f.{key} AND n.i // 3 = f.i // 3 GROUP BY f.rid"
        alone = f"(SELECT g, max(i) = 0 AS alone FROM {nodes} GROUP BY g)"
        steps.append(f"{to} AS MATERIALIZED (SELECT f.rid, f.g, f.i // 3 AS i, CASE WHEN alone THEN f.h ELSE sha256(coalesce(a, '') || f.h || coalesce(b, '')) END AS h, proof || coalesce(a, '') || coalesce(b, '') AS proof FROM {source} f JOIN ({near}) USING (rid) JOIN {alone} o ON o.g = f.{key})")

    for k in range(levels):
        fold(f"f{k}", f"f{k + 1}", f"n{k}", "g")
    steps.append(f"u0 AS MATERIALIZED (SELECT rid, 0 AS g, g AS i, h, proof FROM f{levels})")
    for k in range(above):
        fold(f"u{k}", f"u{k + 1}", f"t{k}", "g")
    return (
        ",\n".join(steps)
        + f"""
SELECT n0.doc_id, n0.leaf, s.h AS subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = r.h AS verified
FROM n0 JOIN u{above} u USING (rid) JOIN n{levels} s ON s.g = n0.g CROSS JOIN t{above} r"""
    )


SQL = {"op4_suffix_dedup": REPEATS, "op6_quality_rules": QUALITY, "op7_decontamination": CONTAMINATION, "op9_warc": ARCHIVE, "op11_substring_dedup": FIRST_WINDOWS, "op12_centroid_clustering": _lloyd(8, 64, 10), "op13_merkle_manifest": _merkle(15, 8)}
