"""Queries over event logs as visits and steps between screens, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions.text import fingerprint12
from trailweave.operators import graph, planning, rundiff
from trailweave.session import table
from trailweave.sources import runs
from trailweave.streaming import live

#: The place before a user's first event.
ROOT = "start"
#: Events before this day are the earlier run, those from it on the later one.
SPLIT = "2024-01-16"
BUDGET, PER_SHAPE, REPEATS = 8, 2, 3


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _screens(spark: SparkSession, d: str) -> DataFrame:
    return runs.event_screens(_events(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return runs.event_edges(_events(spark, d), ROOT)


def event_transitions(spark: SparkSession, d: str) -> DataFrame:
    return graph.merged_edges(_edges(spark, d)).select("src", "dst", "label", "n", "first_pos")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return graph.discovery_tree(_edges(spark, d), ROOT)


def event_discovery_tree(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("node", "parent", "chapter")


def event_tree_numbers(spark: SparkSession, d: str) -> DataFrame:
    return graph.discovery_numbers(_edges(spark, d), ROOT)


def event_path_to(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("node", "depth", F.array_join("path", " > ").alias("path"))


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    return graph.chapters(_screens(spark, d).select(F.col("screen").alias("node")), _tree(spark, d), ROOT)


def event_chapters(spark: SparkSession, d: str) -> DataFrame:
    return _chapters(spark, d)


def _chapter_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.chapter_links(graph.chapter_link_labels(graph.merged_edges(_edges(spark, d)), _chapters(spark, d)))


def event_chapter_links(spark: SparkSession, d: str) -> DataFrame:
    return _chapter_links(spark, d).select("chapter_from", "chapter_to", "n", "n_labels")


def top_label_per_link(spark: SparkSession, d: str) -> DataFrame:
    return _chapter_links(spark, d).select("chapter_from", "chapter_to", "label", F.col("label_n").alias("n"))


def event_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return graph.scenarios(_tree(spark, d), ROOT).select("leaf", F.array_join("path", " > ").alias("path"), "steps", "chapter")


def _run_nodes(spark: SparkSession, d: str, later: bool) -> DataFrame:
    """One node for each screen of a user; a first screen is also known by the user and kind alone."""
    when = F.col("ts") >= F.lit(SPLIT).cast("timestamp")
    visits = _screens(spark, d).where(when if later else ~when)
    g = visits.groupBy("user_id", "kind", "screen").agg(
        F.min("event_id").alias("pos"), F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("kind") == "error", F.col("k").cast("string")))).alias("console_errors")
    )
    node, family = F.concat_ws("/", F.col("user_id").cast("string"), "screen"), F.concat_ws("/", F.col("user_id").cast("string"), "kind")
    alias = F.when(F.col("screen").endswith("/0"), F.array(fingerprint12(family))).otherwise(F.array().cast("array<string>"))
    return g.select(
        node.alias("id"), "pos", fingerprint12(node).alias("signature"), alias.alias("alias_signatures"), F.col("kind").alias("route"), F.lit(3).alias("schema_version"),
        fingerprint12(F.col("n").cast("string")).alias("text_hash"), "console_errors", F.array().cast("array<string>").alias("failed_requests"),
    )


def _run_diff(spark: SparkSession, d: str) -> DataFrame:
    return rundiff.diff_nodes(_run_nodes(spark, d, True), _run_nodes(spark, d, False))


def event_run_diff_added(spark: SparkSession, d: str) -> DataFrame:
    return _run_diff(spark, d).where("status = 'added'").select("id")


def event_run_diff_changed(spark: SparkSession, d: str) -> DataFrame:
    return _run_diff(spark, d).where("status = 'changed'").select("id", "prev_id")


def event_run_diff_removed(spark: SparkSession, d: str) -> DataFrame:
    return rundiff.removed_nodes(_run_nodes(spark, d, True), _run_nodes(spark, d, False)).select("id")


def event_new_errors(spark: SparkSession, d: str) -> DataFrame:
    return _run_diff(spark, d).where("new_errors").select("id", "status")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    current, previous = _run_nodes(spark, d, True), _run_nodes(spark, d, False)
    later = runs.event_edges(_events(spark, d).where(F.col("ts") >= F.lit(SPLIT).cast("timestamp")))
    return rundiff.gate_counts(current, later, rundiff.diff_nodes(current, previous), rundiff.removed_nodes(current, previous))


def event_summary(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


def event_gate(spark: SparkSession, d: str) -> DataFrame:
    found = rundiff.gate(_counts(spark, d), rundiff.GATES)
    return found.select("failed", F.array_join("reasons", "; ").alias("reasons"), F.array_join("notes", "; ").alias("notes"))


def event_issues(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "error", "console").when((F.col("kind") == "purchase") & (F.col("k") >= 90), "request").when((F.col("kind") == "click") & (F.col("k") < 5), "action")
    items = _screens(spark, d).select(F.col("user_id").alias("key"), kind.alias("kind"), (F.col("ts") >= F.lit("2024-01-29").cast("timestamp")).alias("is_new")).where("kind is not null")
    return rundiff.issues(items)


def event_round_robin_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = planning.round_robin(_screens(spark, d), "user_id", "kind", "event_id", PER_SHAPE)
    return plan.select("user_id", "event_id", "kind", "turn", "plan_pos")


def event_budgeted_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = planning.budgeted(_screens(spark, d).withColumn("counts", F.col("kind") != "view"), "user_id", "event_id", BUDGET, "counts")
    return plan.groupBy("user_id").agg(F.count_if("within").alias("within"), F.count_if(~F.col("within")).alias("over"))


def event_first_r_sources(spark: SparkSession, d: str) -> DataFrame:
    return planning.first_sources(_screens(spark, d), "screen", "user_id", "event_id", REPEATS)


def event_first_of_family(spark: SparkSession, d: str) -> DataFrame:
    return planning.first_of_family(_screens(spark, d), "user_id", "screen", "event_id").groupBy("user_id").agg(F.count_if("deferred").alias("deferred"), F.count_if(~F.col("deferred")).alias("tried"))


def event_consecutive_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = _screens(spark, d).withColumn("hit", F.col("kind") == "error")
    return planning.islands(rows, "user_id", "event_id", "hit").groupBy("user_id").agg(F.max("streak").cast("long").alias("longest"), F.count_if(F.col("streak") == 3).alias("thrice"))


def event_quiet_sessions(spark: SparkSession, d: str) -> DataFrame:
    return live.quiet_sessions(_events(spark, d), "6 hours")


def event_first_errors(spark: SparkSession, d: str) -> DataFrame:
    return live.first_errors(_events(spark, d)).select("user_id", "props", "ts")


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    kind = F.when(F.col("error"), "error").when(F.col("src") == F.col("dst"), "local").otherwise("nav")
    return e.select(F.concat_ws(" ", F.col("user_id").cast("string"), "src", "label").alias("key"), kind.alias("kind"), F.when(kind == "nav", F.col("dst")).alias("nav"))


def event_consistency_inference(spark: SparkSession, d: str) -> DataFrame:
    return planning.consistency(_outcomes(spark, d))


def event_deferred_decisions(spark: SparkSession, d: str) -> DataFrame:
    tried = planning.consistency(_outcomes(spark, d))
    asked = _outcomes(spark, d).select("key").distinct()
    return planning.resolve_deferred(asked, tried, 2).groupBy("decision").agg(F.count("*").alias("n"), F.count("nav").alias("with_place"))


def event_adjacent_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.adjacent_runs(_screens(spark, d).select("user_id", "event_id", "kind"), "user_id", "event_id", "kind")
    return rows.groupBy("user_id").agg(F.max("run").cast("long").alias("runs"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        event_transitions, event_discovery_tree, event_tree_numbers, event_path_to, event_chapters, event_chapter_links, top_label_per_link, event_scenarios, event_run_diff_added, event_run_diff_changed,
        event_run_diff_removed, event_new_errors, event_summary, event_gate, event_issues, event_round_robin_plan, event_budgeted_plan, event_first_r_sources, event_first_of_family,
        event_consecutive_errors, event_quiet_sessions, event_first_errors, event_consistency_inference, event_deferred_decisions, event_adjacent_runs,
    )
}

_SCREENS = """
s AS (SELECT event_id, ts, user_id, kind, k, kind || '/' || CAST(coalesce(k, 0) // 10 AS VARCHAR) AS screen
      FROM (SELECT event_id, ts, user_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))
"""
_EDGES = f"""{_SCREENS},
e AS (SELECT event_id AS edge_pos, ts, user_id, src, screen AS dst, kind AS label, kind = 'error' AS error
      FROM (SELECT *, coalesce(lag(screen) OVER (PARTITION BY user_id ORDER BY ts, event_id), '{ROOT}') AS src FROM s)),
m AS (SELECT src, dst, label, count(*) AS n, min(edge_pos) AS first_pos FROM e WHERE NOT error GROUP BY ALL)
"""
_TREE = f"""{_EDGES},
st AS (SELECT dst, arg_min(src, edge_pos) AS src, min(edge_pos) AS edge_pos FROM e WHERE NOT error AND src <> dst AND dst <> '{ROOT}' GROUP BY dst),
t AS (SELECT '{ROOT}' AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, '{ROOT}' AS path, '{ROOT}' AS chapter
      UNION ALL SELECT st.dst, t.node, t.depth + 1, t.path || ' > ' || st.dst, CASE WHEN t.node = '{ROOT}' THEN st.dst ELSE t.chapter END FROM t JOIN st ON st.src = t.node)
"""
_CHAPTERS = f"""{_TREE}, ch AS (SELECT DISTINCT s.screen AS node, coalesce(t.chapter, '{ROOT}') AS chapter FROM s LEFT JOIN t ON t.node = s.screen),
cl AS (SELECT a.chapter AS chapter_from, b.chapter AS chapter_to, m.label, sum(m.n) AS n FROM m JOIN ch a ON a.node = m.src JOIN ch b ON b.node = m.dst WHERE m.src <> m.dst AND a.chapter <> b.chapter GROUP BY ALL)
"""
_RUNS = f"""{_SCREENS},
g AS (SELECT ts >= TIMESTAMP '{SPLIT}' AS later, user_id, kind, screen, min(event_id) AS pos, count(*) AS n, list_distinct(list(CAST(k AS VARCHAR)) FILTER (WHERE kind = 'error')) AS errors FROM s GROUP BY ALL),
n AS (SELECT later, CAST(user_id AS VARCHAR) || '/' || screen AS id, CAST(user_id AS VARCHAR) || '/' || kind AS family, screen LIKE '%/0' AS has_alias, pos, substr(sha1(CAST(n AS VARCHAR)), 1, 12) AS text_hash, coalesce(errors, []) AS errors FROM g),
sg AS (SELECT later, id, pos, 0 AS k, substr(sha1(id), 1, 12) AS sig FROM n UNION ALL SELECT later, id, pos, 1, substr(sha1(family), 1, 12) FROM n WHERE has_alias),
ow AS (SELECT sig, id AS prev_id FROM (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY pos, k) AS r FROM sg WHERE NOT later) WHERE r = 1),
mt AS (SELECT c.id, arg_min(ow.prev_id, c.k) AS prev_id FROM sg c JOIN ow USING (sig) WHERE c.later GROUP BY c.id),
df AS (SELECT c.id, mt.prev_id, CASE WHEN mt.prev_id IS NULL THEN 'added' WHEN mt.prev_id = c.id AND p.text_hash IS DISTINCT FROM c.text_hash THEN 'changed' ELSE 'same' END AS status,
       len(list_filter(c.errors, lambda x: NOT list_contains(coalesce(p.errors, []), x))) > 0 AS new_errors, len(c.errors) > 0 AS has_errors
       FROM (SELECT * FROM n WHERE later) c LEFT JOIN mt USING (id) LEFT JOIN (SELECT * FROM n WHERE NOT later) p ON p.id = mt.prev_id),
rm AS (SELECT DISTINCT id FROM n WHERE NOT later AND id NOT IN (SELECT a.id FROM sg a JOIN sg b USING (sig) WHERE NOT a.later AND b.later))
"""
_COUNTS = f"""{_RUNS},
le AS (SELECT kind = 'error' AS error FROM (SELECT kind, lag(screen) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM s WHERE ts >= TIMESTAMP '{SPLIT}') WHERE src IS NOT NULL),
c AS (SELECT (SELECT count(*) FROM df) AS screens, (SELECT count(*) FROM le) AS actions, (SELECT count(*) FROM df WHERE has_errors) AS error_screens, (SELECT count(*) FROM le WHERE error) AS failed_actions,
      (SELECT count(*) FROM df WHERE status = 'added') AS added, (SELECT count(*) FROM df WHERE status = 'changed') AS changed, (SELECT count(*) FROM rm) AS removed, (SELECT count(*) FROM df WHERE new_errors) AS new_errors)
"""
_OUTCOMES = f"""{_EDGES},
o AS (SELECT CAST(user_id AS VARCHAR) || ' ' || src || ' ' || label AS key, CASE WHEN error THEN 'error' WHEN src = dst THEN 'local' ELSE 'nav' END AS kind, CASE WHEN NOT error AND src <> dst THEN dst END AS nav FROM e),
k0 AS (SELECT key, count(*) AS tries, CASE WHEN bool_and(kind = 'local') THEN 'local' WHEN bool_and(kind = 'nav') AND count(DISTINCT nav) = 1 THEN 'nav' ELSE 'mixed' END AS verdict, min(nav) AS one FROM o GROUP BY key),
kn AS (SELECT key, tries, verdict, CASE WHEN verdict = 'nav' THEN one END AS nav FROM k0)
"""
_said = lambda name, column: f"CASE WHEN {column} > 0 THEN '{name}: ' || {column} END"

SQL = {
    "event_transitions": f"WITH {_EDGES} SELECT src, dst, label, n, first_pos FROM m",
    "event_discovery_tree": f"WITH RECURSIVE {_TREE} SELECT node, parent, chapter FROM t",
    "event_tree_numbers": f"""WITH RECURSIVE {_TREE}, o AS (SELECT node, parent, depth, chapter, edge_pos FROM t LEFT JOIN st ON st.dst = t.node),
        w AS (SELECT node, node AS above, parent AS nxt, [edge_pos] AS ord FROM o UNION ALL SELECT w.node, o.node, o.parent, [o.edge_pos] || w.ord FROM w JOIN o ON o.node = w.nxt),
        z AS (SELECT above AS node, count(*) AS size FROM w GROUP BY above), f AS (SELECT node, ord FROM w WHERE nxt IS NULL)
        SELECT o.node, o.parent, CAST(o.depth AS BIGINT) AS depth, o.chapter, row_number() OVER (ORDER BY f.ord NULLS FIRST) - 1 AS pre, z.size FROM o JOIN f ON f.node = o.node JOIN z ON z.node = o.node""",
    "event_path_to": f"WITH RECURSIVE {_TREE} SELECT node, depth, path FROM t",
    "event_chapters": f"WITH RECURSIVE {_CHAPTERS} SELECT node, chapter FROM ch",
    "event_chapter_links": f"WITH RECURSIVE {_CHAPTERS} SELECT chapter_from, chapter_to, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS INT) AS n_labels FROM cl GROUP BY ALL",
    "top_label_per_link": f"""WITH RECURSIVE {_CHAPTERS} SELECT chapter_from, chapter_to, label, CAST(n AS BIGINT) AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY chapter_from, chapter_to ORDER BY n DESC, label) AS r FROM cl) WHERE r = 1""",
    "event_scenarios": f"WITH RECURSIVE {_TREE} SELECT node AS leaf, path, depth AS steps, chapter FROM t WHERE node <> '{ROOT}' AND node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)",
    "event_run_diff_added": f"WITH {_RUNS} SELECT id FROM df WHERE status = 'added'",
    "event_run_diff_changed": f"WITH {_RUNS} SELECT id, prev_id FROM df WHERE status = 'changed'",
    "event_run_diff_removed": f"WITH {_RUNS} SELECT id FROM rm",
    "event_new_errors": f"WITH {_RUNS} SELECT id, status FROM df WHERE new_errors",
    "event_summary": f"WITH {_COUNTS} SELECT * FROM c",
    "event_gate": f"""WITH {_COUNTS} SELECT new_errors + removed + error_screens + failed_actions > 0 AS failed,
        concat_ws('; ', {_said('new-errors', 'new_errors')}, {_said('removed', 'removed')}, {_said('errors', 'error_screens')}, {_said('failed-actions', 'failed_actions')}) AS reasons, '' AS notes FROM c""",
    "event_issues": f"""WITH {_SCREENS}, i AS (SELECT user_id AS key, CASE WHEN kind = 'error' THEN 3 WHEN kind = 'purchase' AND k >= 90 THEN 2 WHEN kind = 'click' AND k < 5 THEN 2 END AS sev, ts >= TIMESTAMP '2024-01-29' AS is_new FROM s),
        g AS (SELECT key, count(*) AS n, max(sev) AS severity, bool_or(is_new) AS any_new FROM i WHERE sev IS NOT NULL GROUP BY key)
        SELECT key, n, severity, any_new, CAST(10 * severity + CASE WHEN any_new THEN 5 ELSE 0 END + least(n, 4) AS BIGINT) AS score FROM g""",
    "event_round_robin_plan": f"""WITH {_SCREENS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) AS turn, min(event_id) OVER (PARTITION BY user_id, kind) AS f FROM s)
        SELECT user_id, event_id, kind, CAST(turn AS INT) AS turn, CAST(row_number() OVER (PARTITION BY user_id ORDER BY turn, f) AS INT) AS plan_pos FROM r WHERE turn <= {PER_SHAPE}""",
    "event_budgeted_plan": f"""WITH {_SCREENS}, w AS (SELECT user_id, sum(CASE WHEN kind <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) <= {BUDGET} AS ok FROM s)
        SELECT user_id, count(*) FILTER (WHERE ok) AS within, count(*) FILTER (WHERE NOT ok) AS over FROM w GROUP BY user_id""",
    "event_first_r_sources": f"""WITH {_SCREENS}, f AS (SELECT screen, user_id, min(event_id) AS first_order FROM s GROUP BY ALL)
        SELECT screen, user_id, first_order FROM (SELECT *, row_number() OVER (PARTITION BY screen ORDER BY first_order, user_id) AS r FROM f) WHERE r <= {REPEATS}""",
    "event_first_of_family": f"""WITH {_SCREENS}, f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, screen ORDER BY event_id) AS r FROM s)
        SELECT user_id, count(*) FILTER (WHERE r > 1) AS deferred, count(*) FILTER (WHERE r = 1) AS tried FROM f GROUP BY user_id""",
    "event_consecutive_errors": f"""WITH {_SCREENS}, b AS (SELECT user_id, event_id, kind, sum(CASE WHEN kind = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS blk FROM s),
        x AS (SELECT user_id, sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, blk ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS streak FROM b)
        SELECT user_id, CAST(max(streak) AS BIGINT) AS longest, count(*) FILTER (WHERE streak = 3) AS thrice FROM x GROUP BY user_id""",
    "event_quiet_sessions": """WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
        x AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM x GROUP BY user_id, k""",
    "event_first_errors": "SELECT user_id, props, min(ts) AS ts FROM events WHERE event_type = 'error' GROUP BY ALL",
    "event_consistency_inference": f"WITH {_OUTCOMES} SELECT key, tries, verdict, nav FROM kn",
    "event_deferred_decisions": f"""WITH {_OUTCOMES} SELECT CASE WHEN tries >= 2 AND verdict = 'local' THEN 'skip' WHEN tries >= 2 AND verdict = 'nav' THEN 'infer' ELSE 'try' END AS decision, count(*) AS n, count(nav) AS with_place FROM kn GROUP BY ALL""",
    "event_adjacent_runs": f"""WITH {_SCREENS}, x AS (SELECT user_id, CASE WHEN kind = lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM s)
        SELECT user_id, CAST(sum(new) AS BIGINT) AS runs, count(*) AS n FROM x GROUP BY user_id""",
}
