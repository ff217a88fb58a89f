"""Queries that reach actions, recorded runs, plans and the text helpers, each with its SQL for another engine.

Events stand in for actions: the event type for the role and the parameter for the label.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions import actions, masking, text, urls
from trailweave.operators import compare, figures, graph, judging, learning, naming, planning, recording, rundiff
from trailweave.plans import event_queries as ev
from trailweave.plans import page_queries as pg
from trailweave.session import checkpoint, ensure_checkpoint_dir, table
from trailweave.sources import pages as captured
from trailweave.sources import runs
from trailweave.streaming import live

OWN = "http://ththre.example.com"
RULES = urls.RouteOptions(path_rules=((r"/(en|fr)/", "/lang/"), (r"/([0-9])[0-9]+", "/$1x")))


def page_link_keys(spark: SparkSession, d: str) -> DataFrame:
    """Shape of every link: its route on the own site, the host elsewhere."""
    links = captured.links(table(spark, d, "pages"))
    key = actions.action_key(F.lit("link"), F.col("label"), F.col("target"), F.lit(False), F.lit(OWN))
    return links.select("page_id", "pos", key.alias("key"))


def _acts(spark: SparkSession, d: str) -> DataFrame:
    """Events as actions of a user's screen."""
    e = ev._screens(spark, d)
    role = F.when(F.col("kind") == "view", "link").when(F.col("kind") == "signup", "tab").when(F.col("kind") == "error", "summary").otherwise("button")
    kind = F.when(F.col("kind") == "purchase", "submit").otherwise("click")
    target = F.when(F.col("kind") == "view", F.concat(F.lit(f"{OWN}/item/"), F.coalesce(F.col("k").cast("string"), F.lit("none"))))
    label = F.concat(F.lit("Item "), F.coalesce(F.col("k").cast("string"), F.lit("none")))
    return e.select("event_id", "user_id", "screen", "ts", F.col("k"), role.alias("role"), kind.alias("kind"), target.alias("href"), label.alias("label"), (F.col("kind") == "error").alias("toggle"))


def event_action_keys(spark: SparkSession, d: str) -> DataFrame:
    role, label, target, toggle, kind = (F.col(c) for c in ("role", "label", "href", "toggle", "kind"))
    folds = F.create_map(F.lit("button|Item #"), F.lit("Item *"))
    return _acts(spark, d).select(
        "event_id",
        actions.action_key(role, label, target, toggle, F.lit(OWN), None, folds).alias("key"),
        actions.family_key(role, label, kind, target).alias("family"),
        actions.common_key(role, label, kind, F.lit(False), toggle, target, F.lit(OWN)).alias("common"),
        actions.is_clean(role, kind, F.lit(False), F.coalesce(target, F.lit("")), toggle).alias("clean"),
        actions.short_label(role, label, target).alias("short"),
        actions.step_text(role, label, target, F.lit(1)).alias("step"),
    )


def event_key_repeats(spark: SparkSession, d: str) -> DataFrame:
    """From how many users each common action is tried."""
    role, label, target, toggle, kind = (F.col(c) for c in ("role", "label", "href", "toggle", "kind"))
    rows = _acts(spark, d).withColumn("key", actions.common_key(role, label, kind, F.lit(False), toggle, target, F.lit(OWN))).where("key is not null")
    rows = rows.withColumn("most", actions.repeats(F.col("key"), toggle, 3, 2))
    tried = planning.first_sources(rows, "key", "user_id", "event_id", 3)
    most = rows.groupBy("key").agg(F.max("most").alias("most"))
    return tried.groupBy("key").agg(F.count("*").alias("n")).join(most, "key").select("key", F.least("n", "most").cast("long").alias("tries"))


def event_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What each step did: in place, or to another screen; a screen's kind is its route."""
    e = ev._edges(spark, d)
    key = F.concat(F.when(F.col("label") == "view", "L|").otherwise("C|"), "label")
    kind_of = lambda c: F.substring_index(c, "/", 1)
    x = actions.outcome(key, F.col("src"), F.col("dst"), kind_of("src"), kind_of("dst"))
    return e.select("edge_pos", x["kind"].alias("kind"), x["nav"].alias("nav"))


def event_counters(spark: SparkSession, d: str) -> DataFrame:
    return recording.counters(ev._edges(spark, d))


def event_collected(spark: SparkSession, d: str) -> DataFrame:
    """The first screens that each user saw; a run records five samples."""
    return recording.collected(ev._screens(spark, d), "user_id", "screen", "event_id", 5)


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = ev._screens(spark, d)
    kind = F.when(F.col("kind") == "error", "console").when(F.col("kind") == "purchase", "requestfailed").otherwise("response")
    said = F.when(F.col("k") % 2 == 0, "net::ERR_ABORTED").otherwise(F.concat(F.lit("timeout after "), F.col("k").cast("string")))
    return e.select(
        F.col("user_id").alias("node"), F.col("event_id").alias("pos"), kind.alias("kind"), F.when(F.col("k") >= 50, "error").otherwise("warning").alias("level"), said.alias("text"),
        F.lit("GET").alias("method"), F.concat(F.lit("/api/"), "screen").alias("url"), (F.col("k") * 10).alias("status"),
    )


def event_failures(spark: SparkSession, d: str) -> DataFrame:
    return recording.failures(_log(spark, d))


def event_dirty_screens(spark: SparkSession, d: str) -> DataFrame:
    e = ev._edges(spark, d)
    steps = e.select("edge_pos", (F.col("label") != "purchase").alias("clean"), (F.col("edge_pos") % 97 == 0).alias("stored"))
    return recording.dirty_nodes(graph.discovery_tree(e, ev.ROOT), steps, ev.ROOT)


def event_compound_plan(spark: SparkSession, d: str) -> DataFrame:
    """The first ten screens of a user that still fit after the clicks that were tried before."""
    s = ev._screens(spark, d)
    used = s.where("kind = 'click'").groupBy("user_id").agg(F.count("*").alias("n"))
    plan = recording.compound_plan(s.where("kind <> 'click'"), used, 30, "user_id", "event_id")
    return plan.groupBy("user_id").agg(F.count_if("within").alias("within"), F.count_if(~F.col("within")).alias("cut"))


def event_chapter_stats(spark: SparkSession, d: str) -> DataFrame:
    s = ev._screens(spark, d).groupBy(F.col("screen").alias("node")).agg(
        F.count_if(F.col("kind") == "error").alias("errors"), (F.min("event_id") > 500).alias("added"), F.bool_or(F.col("k") == 7).alias("changed"), F.bool_and(F.col("kind") == "signup").alias("external")
    )
    return recording.chapter_stats(ev._chapters(spark, d), s)


def event_issue_places(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "error", "console").when(F.col("kind") == "purchase", "request").when(F.col("kind") == "click", "diff")
    items = ev._screens(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), kind.alias("kind"), (F.col("k") > 20).alias("is_new")).where("kind is not null")
    return recording.issue_items(items, None, True).select("key", "pos", "kind", "place")


def event_screen_summary(spark: SparkSession, d: str) -> DataFrame:
    a = _acts(spark, d).select(F.col("user_id").alias("page_id"), F.col("event_id").alias("pos"), "label", F.concat_ws("|", "role", text.fold_digits(F.col("label"))).alias("key"))
    return recording.screen_summary(a).select("page_id", "key", "n", F.array_join("labels", ";").alias("labels"))


def event_pair_keys(spark: SparkSession, d: str) -> DataFrame:
    m = graph.merged_edges(ev._edges(spark, d))
    return m.groupBy(actions.pair_key(F.col("src"), F.col("dst")).alias("pair")).agg(F.sum("n").alias("n"))


def event_revealed(spark: SparkSession, d: str) -> DataFrame:
    """Screens of the later run that a user had not seen in the earlier one, the first eight."""
    later = F.col("ts") >= F.lit(ev.SPLIT).cast("timestamp")
    s = ev._screens(spark, d).select(F.col("user_id").alias("node"), F.col("screen").alias("key"), F.col("event_id").alias("pos"), later.alias("later"))
    return compare.revealed(s.where("later").drop("later"), s.where("not later").drop("later"))


def event_new_instances(spark: SparkSession, d: str) -> DataFrame:
    """How often a screen occurs in the later run beyond the earlier one, by user."""
    later = F.col("ts") >= F.lit(ev.SPLIT).cast("timestamp")
    s = ev._screens(spark, d)
    return compare.widget_instances(s.where(~later).select("user_id", "screen"), s.where(later).select("user_id", "screen")).groupBy("user_id").agg(F.count("*").alias("n"))


def event_relocated(spark: SparkSession, d: str) -> DataFrame:
    """Actions of the earlier run found again among those of the later one."""
    a = _acts(spark, d).withColumn("later", F.col("ts") >= F.lit(ev.SPLIT).cast("timestamp"))
    test_id = F.when(F.col("k") % 10 == 3, F.concat(F.lit("t"), F.col("k").cast("string")))
    rows = a.select("event_id", F.col("user_id").alias("page_id"), "role", "label", F.lit(0).alias("nth"), test_id.alias("test_id"), "toggle", F.when(F.col("role") == "link", F.lit("/item/#")).alias("key"), "later")
    wanted = rows.where("not later").withColumnRenamed("event_id", "want_id").drop("later")
    return compare.relocate(wanted, rows.where("later").withColumnRenamed("event_id", "pos").drop("later"))


def event_truncation(spark: SparkSession, d: str) -> DataFrame:
    g = ev._screens(spark, d).groupBy(F.col("screen").alias("node")).agg(F.count("*").alias("planned"), F.count_if(F.col("kind") != "error").alias("tried"))
    return planning.truncation(g)


def event_local_actions(spark: SparkSession, d: str) -> DataFrame:
    e = ev._edges(spark, d)
    attempts = e.select(F.col("src").alias("node"), F.col("label").alias("key"), (~F.col("error")).alias("tried"), (F.col("src") != F.col("dst")).alias("changed"), F.col("edge_pos").alias("pos"))
    return planning.local_actions(attempts)


def event_rewired(spark: SparkSession, d: str) -> DataFrame:
    """Steps after screens of one kind above 50 have merged into the kind's first one."""
    e = ev._edges(spark, d)
    high = ev._screens(spark, d).select(F.col("screen").alias("node")).distinct().where(F.substring_index("node", "/", -1).cast("int") >= 5)
    final = high.select("node", F.concat(F.substring_index("node", "/", 1), F.lit("/0")).alias("final"))
    return graph.rewired(e, final).groupBy("src", "dst").agg(F.count("*").alias("n"))


def event_stabilized(spark: SparkSession, d: str) -> DataFrame:
    s = ev._screens(spark, d).select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), F.col("kind").alias("fp"))
    return live.stabilized(s).select("page", "seq", "fp")


def event_without_late(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("done_ts", F.col("ts") + F.make_dt_interval(secs=F.round(F.col("value"))))
    return live.without_late(e, "60 seconds").groupBy("event_type").agg(F.count("*").alias("n"))


def event_settled(spark: SparkSession, d: str) -> DataFrame:
    """Where each user's events first repeat, or fail twice in a row."""
    rows = ev._screens(spark, d).select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), F.col("screen").alias("fp"), (F.col("kind") == "error").alias("failed"))
    return live.settled(rows, 2)


def event_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first event at which each user meets a kind or a screen."""
    rows = ev._screens(spark, d).select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), F.array("kind", "screen").alias("items"))
    return live.first_seen(rows)


def _learned(spark: SparkSession, d: str) -> DataFrame:
    """What the sites' own addresses and their pages' links teach, until nothing more is learned."""
    p = table(spark, d, "pages")
    own = p.select(F.col("url").alias("target"), F.lit(False).alias("in_nav"))
    return learning.learned_to_fixpoint(own.unionByName(captured.links(p).select("target", "in_nav")), 2)


def page_learned_to_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    return _learned(spark, d).select("origin", "prefix", "round", "n_values")


def page_learned_routes(spark: SparkSession, d: str) -> DataFrame:
    found = learning.learned_routes(table(spark, d, "pages").select("page_id", "url"), _learned(spark, d))
    return found.select("page_id", "route", F.array_join("data_values", "|").alias("data_values"), "data_driven")


def page_learned_prefixes(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select(F.col("url").alias("target"), F.lit(False).alias("in_nav"))
    return learning.learned_prefixes(links, 2).select("origin", F.array_join("learned", " ").alias("learned"))


def page_link_names(spark: SparkSession, d: str) -> DataFrame:
    """Pages as links of one list to data-driven routes: titles that name one address."""
    p = table(spark, d, "pages")
    titles = captured.headings(p).where("tag = 'title'").select("page_id", F.col("text").alias("label"))
    r = urls.route(F.col("url"))
    rows = p.select("page_id", F.col("url").alias("target"), r["route"].alias("route"), r["data_driven"].alias("data_driven")).join(titles, "page_id")
    return learning.names(rows.withColumn("page_id", F.lit(1))).select("route", "label")


def page_ruled_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes under rules of one's own, each applied to its first match."""
    r = urls.route(F.col("url"), options=RULES)
    return table(spark, d, "pages").select("page_id", r["route"].alias("route"), F.array_join(r["data_values"], "|").alias("data_values"))


def page_address_facts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", urls.is_http(u).alias("http"), urls.is_external(u, F.lit(f"{OWN}/x")).alias("external"), urls.is_allowed_host(u, ("ththre.example.com",)).alias("allowed"),
        F.array_join(urls.data_values_at(urls.route(u, options=pg.NAMES)["route"], u), "|").alias("data_values"),
        urls.resolve(F.lit("../up?x=1"), u).alias("resolved"), masking.mask_url(F.concat(urls.path(u), F.lit("?code=1&page=2")), masking.SENSITIVE).alias("masked_path"),
    )


def page_allowed_links(spark: SparkSession, d: str) -> DataFrame:
    links = captured.allowed(captured.links(table(spark, d, "pages")), ("the", "NICHT"), ("/an", "[0-9]$"))
    return links.groupBy("page_id").agg(F.count("*").alias("n"), F.min("label").alias("first_label"))


def page_titles_scrubbed(spark: SparkSession, d: str) -> DataFrame:
    """Titles without their second word, which stands in for a data value."""
    titles = captured.headings(table(spark, d, "pages")).where("tag = 'title'").select("page_id", F.col("text").alias("title"))
    word = F.get(F.split("title", " "), 1)
    x = naming.scrub_to_placeholder(F.col("title"), F.array(word))
    return titles.withColumn("x", x).select("page_id", F.col("x.text").alias("scrubbed"), F.size("x.removed").alias("removed"))


def page_title_parts(spark: SparkSession, d: str) -> DataFrame:
    """What stands at the * of a title's pattern: all but its first and last word."""
    titles = captured.headings(table(spark, d, "pages")).where("tag = 'title'").select("page_id", F.col("text").alias("title")).where("title like '% % %'")
    pattern = F.concat(F.substring_index("title", " ", 1), F.lit(" * "), F.substring_index("title", " ", -1))
    plain = ~F.contains("title", F.lit("*")) & ~F.contains("title", F.lit("#"))
    return titles.where(plain).withColumn("parts", naming.pattern_parts(pattern, F.col("title"))).select("page_id", F.array_join("parts", "|").alias("parts"))


def page_known_widgets(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages that a table of widget lines knows, literally or by pattern."""
    lines = pg._skeletons(spark, d).select(F.explode("lines").alias("line"))
    table_of_lines = spark.createDataFrame([("a:link|/th*",), ("h:h1:*the*",), ("a:link|/to",), ("h:h1:*a",)], "line string")
    return compare.known_lines(lines, compare.widget_patterns(table_of_lines))


def doc_run_texts(spark: SparkSession, d: str) -> DataFrame:
    """The helpers that name things to people, on the lines of documents."""
    t = F.coalesce("text", F.lit(""))
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    return table(spark, d, "documents").select(
        "doc_id", F.sha1(text.last_matching_line(t, "the").cast("binary")).alias("reason"), text.run_name(when).alias("run"),
        text.seconds_between(when, when + F.expr("interval 2500 milliseconds")).alias("seconds"), text.action_text(F.lit("link"), F.left(text.first_line(t), F.lit(20))).alias("action"),
        F.sha1(text.accessible_label(F.lit("  "), text.first_line(t)).cast("binary")).alias("label"), text.field_descriptor(F.lit("input"), F.col("lang"), F.col("source")).alias("field"),
        actions.round2(F.col("n_chars") / 7.0).alias("rounded"),
    )


def label_merge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of an external judge: which pairs merge and which actions may be tried, from the labels."""
    x = table(spark, d, "labels").where("toxic is not null and quality is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"), F.max("quality").cast("double").alias("quality"))
    score = judging.merge_score(F.col("quality") * 0.9, F.col("toxic") * 0.8, F.col("doc_id") % 5 == 0)
    ok = judging.accepted(F.col("toxic") * 0.6, F.when(F.col("doc_id") % 2 == 0, "link").otherwise("button"), F.col("doc_id") % 3 == 0)
    return x.select("doc_id", F.round(score, 6).alias("score"), ok.alias("accepted"))


def doc_cached_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions on documents whose answers another document's equal question already has."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    digest = F.sha1(F.to_json(F.struct("lang", "source")).cast("binary"))
    cache = docs.where("lang = 'en'").groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("answer"))
    return judging.cached_answers(docs, cache, "lang", "source").select("doc_id", "answer")


def _run_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each week of events as a run: its screens and steps."""
    e = table(spark, d, "events").withColumn("run", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    s = ev._screens(spark, d).join(e.select("event_id", "run"), "event_id")
    nodes = s.groupBy("run", "screen").agg(F.min("event_id").alias("pos"), F.array_sort(F.collect_set(F.when(F.col("kind") == "error", F.concat(F.lit("at http://x.test/?token=1&k="), F.col("k").cast("string"))))).alias("console_errors"))
    none = F.array().cast("array<string>")
    nodes = nodes.select(
        "run", "pos", F.col("screen").alias("id"), text.fingerprint12(F.col("screen")).alias("signature"), F.concat(F.lit("http://x.test/"), "screen", F.lit("?session=9")).alias("url"),
        F.substring_index("screen", "/", 1).alias("route"), F.col("screen").alias("title"), F.lit(1).alias("depth"), text.fingerprint12(F.col("pos").cast("string")).alias("text_hash"), "console_errors",
        none.alias("failed_requests"), none.alias("alias_signatures"),
    )
    steps = ev._edges(spark, d).join(e.select(F.col("event_id").alias("edge_pos"), "run"), "edge_pos")
    edges = steps.select("run", "edge_pos", "src", "dst", F.lit("link").alias("role"), "label", F.lit("/x").alias("href"), F.when(F.col("error"), "no").alias("error"), F.lit(False).alias("inferred"))
    stop = F.when(F.col("run") == "2024-01-22", "interrupted")
    meta = e.select("run").distinct().select("run", F.lit(ev.ROOT).alias("root"), F.lit("http://x.test/?key=2").alias("base_url"), stop.alias("stop_kind"), F.create_map(F.lit("maxStates"), F.lit("60")).alias("config"))
    return nodes, edges, meta


def _written(spark: SparkSession, d: str) -> DataFrame:
    """The runs, the first written alone and the others beside it, as the library's reader finds them."""
    folder = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    documents = checkpoint(runs.run_documents(*_run_tables(spark, d)))
    first = documents.agg(F.min("run")).first()[0]
    runs.write_runs(documents.where(F.col("run") == first), folder)
    runs.write_runs(documents.where(F.col("run") != first), folder)
    return runs.read_runs(spark, folder)


def event_runs_written(spark: SparkSession, d: str) -> DataFrame:
    """Runs assembled, written as documents and read again: counts, masked addresses, and which one to compare the last with."""
    found = _written(spark, d)
    base = runs.baseline(found, "2024-01-29").select("run", F.lit(True).alias("base"))
    n = runs.nodes(found).groupBy("run").agg(F.count("*").alias("screens"), F.sum(F.size("console_errors")).alias("errors"), F.min("url").alias("first_url"), F.max(F.get("console_errors", 0)).alias("last_error"))
    e = runs.edges(found).groupBy("run").agg(F.count("*").alias("actions"), F.count("error").alias("failed"))
    rows = runs.heads(found).select("run", F.col("meta.baseUrl").alias("base_url"), F.col("meta.totalStates").cast("long").alias("total_states")).join(n, "run").join(e, "run").join(base, "run", "left")
    return rows.withColumn("base", F.coalesce("base", F.lit(False)))


def event_run_figures(spark: SparkSession, d: str) -> DataFrame:
    """What the steps of writing all weeks' runs counted as their rows passed: screens, those with errors, steps, failed ones."""
    nodes, edges, _ = _run_tables(spark, d)
    gathered = figures.Figures()
    gathered.run("screens", nodes, checkpoint, F.size("console_errors") > 0)
    gathered.run("steps", edges, checkpoint, F.col("error").isNotNull())
    return gathered.table(spark).drop("ms")


def event_run_summary(spark: SparkSession, d: str) -> DataFrame:
    counts = ev._counts(spark, d)
    meta = spark.range(1).select(F.lit("http://x.test").alias("base_url"), F.lit(None).cast("string").alias("stop_kind"))
    doc = runs.summary_document(counts, rundiff.gate(counts, ("errors",)), meta)
    at = lambda p: F.get_json_object("summary", f"$.{p}")
    return doc.select(at("baseUrl").alias("base_url"), at("screens").cast("long").alias("screens"), at("diff.newErrors").cast("long").alias("new_errors"), at("gate.failed").cast("boolean").alias("failed"))


QUERIES = {
    f.__name__: f
    for f in (
        page_link_keys, event_action_keys, event_key_repeats, event_outcomes, event_counters, event_collected, event_failures, event_dirty_screens, event_compound_plan, event_chapter_stats,
        event_issue_places, event_screen_summary, event_pair_keys, event_revealed, event_new_instances, event_relocated, event_truncation, event_local_actions, event_rewired, event_stabilized,
        event_without_late, event_settled, event_first_seen, page_learned_prefixes, page_learned_to_fixpoint, page_learned_routes, page_link_names, page_ruled_routes, page_address_facts, page_allowed_links, page_titles_scrubbed, page_title_parts, page_known_widgets,
        doc_run_texts, label_merge_scores, doc_cached_answers, event_run_figures, event_runs_written, event_run_summary,
    )
}

_E, _S = ev._EDGES, ev._SCREENS
_PAGES = f"WITH {pg._URLS}, {pg._HEADS}, {pg._LINKS}"
_ACTS = f"""{_S}, a AS (SELECT event_id, user_id, screen, ts, k, CASE kind WHEN 'view' THEN 'link' WHEN 'signup' THEN 'tab' WHEN 'error' THEN 'summary' ELSE 'button' END AS role,
    CASE WHEN kind = 'purchase' THEN 'submit' ELSE 'click' END AS kind, CASE WHEN kind = 'view' THEN '{OWN}/item/' || coalesce(CAST(k AS VARCHAR), 'none') END AS href, 'Item ' || coalesce(CAST(k AS VARCHAR), 'none') AS label,
    kind = 'error' AS toggle FROM s),
    ak AS (SELECT *, {pg._fold('label')} AS shape, CASE WHEN k IS NULL THEN '/item/none' ELSE '/item/*' END AS route FROM a),
    ck AS (SELECT *, CASE WHEN kind = 'submit' THEN NULL WHEN role = 'link' THEN 'L|link|' || route ELSE 'C|' || role || '|' || shape END AS common FROM ak)"""
_LATER = f"ts >= TIMESTAMP '{ev.SPLIT}'"
_TITLES = "ti AS (SELECT page_id, text AS title FROM heads WHERE tag = 'title')"

SQL = {
    "page_link_keys": f"""{_PAGES} SELECT page_id, pos, 'link|' || CASE WHEN target LIKE '{OWN}/%' THEN '/' || array_to_string(list_transform(list_filter(string_split(substr(target, {len(OWN) + 1}), '/'), lambda x: x <> ''),
        lambda x: CASE WHEN {pg._id_like('x')} THEN '*' ELSE {pg._fold('x')} END), '/') ELSE '//' || lower(regexp_extract(target, '^[^/]*//([^/?#]*)', 1)) END AS key FROM links""",
    "event_action_keys": f"""WITH {_ACTS} SELECT event_id, role || '|' || CASE WHEN role = 'link' THEN route WHEN toggle THEN '~' WHEN role = 'button' AND shape = 'Item #' THEN 'Item *' ELSE shape END AS key,
        CASE WHEN role <> 'link' THEN role || '|' || shape || CASE WHEN kind = 'submit' THEN '|submit' ELSE '' END END AS family, common,
        CASE WHEN kind = 'submit' THEN false ELSE role IN ('link', 'tab') OR toggle END AS clean,
        CASE role WHEN 'link' THEN label WHEN 'button' THEN '[' || label || ']' WHEN 'tab' THEN '<' || label || '>' ELSE '> ' || label END AS short,
        CASE WHEN role IN ('link', 'summary') THEN 'Open' WHEN role = 'tab' THEN 'Switch to' ELSE 'Press' END || ' "' || label || '"' AS step FROM ck""",
    "event_key_repeats": f"""WITH {_ACTS} SELECT common AS key, CAST(least(count(DISTINCT user_id), 3, max(CASE WHEN role = 'link' THEN 3 WHEN toggle THEN 1 ELSE 2 END)) AS BIGINT) AS tries FROM ck WHERE common IS NOT NULL GROUP BY common""",
    "event_outcomes": f"""WITH {_E}, x AS (SELECT *, label <> 'view' AND (src = dst OR string_split(src, '/')[1] = string_split(dst, '/')[1]) AS loc FROM e)
        SELECT edge_pos, CASE WHEN loc THEN 'local' ELSE 'nav' END AS kind, CASE WHEN NOT loc THEN dst END AS nav FROM x""",
    "event_counters": f"WITH {_E} SELECT count(*) AS attempts, count(*) FILTER (WHERE error) AS failed, CAST(0 AS BIGINT) AS inferred, count(*) FILTER (WHERE src = dst) AS loops, count(DISTINCT dst) AS screens FROM e",
    "event_collected": f"""WITH {_S}, f AS (SELECT user_id, screen, min(event_id) AS first FROM s GROUP BY ALL)
        SELECT user_id, screen, first, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first, screen) AS k FROM f) WHERE k <= 5""",
    "event_failures": f"""WITH {_S}, l AS (SELECT user_id AS node, event_id AS pos, kind, k, screen, CASE WHEN k % 2 = 0 THEN 'net::ERR_ABORTED' ELSE 'timeout after ' || k END AS said FROM s)
        SELECT node, pos, 'console' AS list, said AS text FROM l WHERE kind = 'error' AND k >= 50 UNION ALL
        SELECT node, pos, 'request', 'GET /api/' || screen || ' (' || coalesce(said, 'failed') || ')' FROM l WHERE kind = 'purchase' AND coalesce(said, 'failed') NOT LIKE '%ERR_ABORTED%' UNION ALL
        SELECT node, pos, 'request', CAST(k * 10 AS VARCHAR) || ' GET /api/' || screen FROM l WHERE kind NOT IN ('error', 'purchase') AND k * 10 >= 400""",
    "event_dirty_screens": f"""WITH RECURSIVE {_E}, st AS (SELECT dst, arg_min(src, edge_pos) AS src, min(edge_pos) AS edge_pos FROM e WHERE NOT error AND src <> dst AND dst <> '{ev.ROOT}' GROUP BY dst),
        t AS (SELECT '{ev.ROOT}' AS node, false AS dirty UNION ALL SELECT st.dst, t.dirty OR e.label = 'purchase' OR st.edge_pos % 97 = 0 FROM t JOIN st ON st.src = t.node JOIN e ON e.edge_pos = st.edge_pos) SELECT node, dirty FROM t""",
    "event_compound_plan": f"""WITH {_S}, u AS (SELECT user_id, count(*) AS n FROM s WHERE kind = 'click' GROUP BY ALL),
        p AS (SELECT s.user_id, row_number() OVER (PARTITION BY s.user_id ORDER BY event_id) + coalesce(n, 0) <= 30 AS ok FROM s LEFT JOIN u USING (user_id) WHERE kind <> 'click')
        SELECT user_id, count(*) FILTER (WHERE ok) AS within, count(*) FILTER (WHERE NOT ok) AS cut FROM p GROUP BY user_id""",
    "event_chapter_stats": f"""WITH RECURSIVE {ev._CHAPTERS}, nd AS (SELECT screen AS node, count(*) FILTER (WHERE kind = 'error') AS errors, min(event_id) > 500 AS added, bool_or(k = 7) AS changed, bool_and(kind = 'signup') AS external FROM s GROUP BY screen)
        SELECT chapter, count(*) AS screens, count(*) FILTER (WHERE errors > 0) AS with_errors, bool_or(added) AS any_added, bool_or(changed) AS any_changed, bool_or(external) AS any_external FROM ch JOIN nd USING (node) GROUP BY chapter""",
    "event_issue_places": f"""WITH {_S}, i AS (SELECT user_id AS key, event_id AS pos, CASE kind WHEN 'error' THEN 'console' WHEN 'purchase' THEN 'request' WHEN 'click' THEN 'diff' END AS kind FROM s WHERE k > 20)
        SELECT key, pos, kind, CAST(row_number() OVER (PARTITION BY key ORDER BY CASE kind WHEN 'console' THEN 3 WHEN 'request' THEN 2 ELSE 1 END DESC, pos) AS INT) AS place FROM i WHERE kind IS NOT NULL""",
    "event_screen_summary": f"""WITH {_ACTS}, g AS (SELECT user_id AS page_id, role || '|' || shape AS key, label, min(event_id) AS pos, count(*) AS c FROM ak GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY page_id, key ORDER BY pos, label) AS k FROM g)
        SELECT page_id, key, CAST(sum(c) AS BIGINT) AS n, string_agg(label, ';' ORDER BY k) FILTER (WHERE k <= 2) AS labels FROM r GROUP BY ALL""",
    "event_pair_keys": f"WITH {_E} SELECT least(src, dst) || '|' || greatest(src, dst) AS pair, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY ALL",
    "event_revealed": f"""WITH {_S}, f AS (SELECT user_id AS node, screen AS key, min(event_id) AS pos FROM s WHERE {_LATER} AND (user_id, screen) NOT IN (SELECT user_id, screen FROM s WHERE NOT ({_LATER})) GROUP BY ALL)
        SELECT node, key, pos FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pos, key) AS k FROM f) WHERE k <= 8""",
    "event_new_instances": f"""WITH {_S} SELECT user_id, count(*) AS n FROM (SELECT user_id, screen FROM s WHERE {_LATER} EXCEPT ALL SELECT user_id, screen FROM s WHERE NOT ({_LATER})) GROUP BY user_id""",
    "event_relocated": f"""WITH {_ACTS}, r AS (SELECT event_id, user_id, role, label, shape, toggle, CASE WHEN k % 10 = 3 THEN 't' || k END AS test_id, {_LATER} AS later FROM ak),
        p AS (SELECT *, count(test_id) OVER (PARTITION BY user_id, test_id) = 1 AND test_id IS NOT NULL AS one_id, count(*) FILTER (WHERE toggle) OVER (PARTITION BY user_id, role) = 1 AS one_toggle FROM r WHERE later),
        w AS (SELECT * FROM r WHERE NOT later),
        c AS (SELECT w.event_id AS want_id, p.event_id AS pos, CASE WHEN w.label = p.label THEN 1 WHEN w.test_id = p.test_id AND one_id THEN 2 WHEN w.shape = p.shape THEN 3 WHEN w.toggle AND p.toggle AND one_toggle THEN 4 WHEN w.role = 'link' THEN 5 END AS tier
              FROM w JOIN p ON p.user_id = w.user_id AND p.role = w.role)
        SELECT want_id, pos, CAST(tier AS INT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY want_id ORDER BY tier, pos) AS k FROM c WHERE tier IS NOT NULL) WHERE k = 1""",
    "event_truncation": f"""WITH {_S}, g AS (SELECT screen AS node, count(*) AS planned, count(*) FILTER (WHERE kind <> 'error') AS tried FROM s GROUP BY screen)
        SELECT node, (planned - tried) || ' of ' || planned || ' actions not tried' AS note FROM g WHERE planned > tried""",
    "event_local_actions": f"""WITH {_E} SELECT src AS node, label AS key, count(*) AS count, count(*) FILTER (WHERE NOT error) AS tried, count(*) FILTER (WHERE NOT error AND src <> dst) AS changed, min(edge_pos) AS first_pos FROM e GROUP BY ALL""",
    "event_rewired": f"""WITH {_E}, f AS (SELECT DISTINCT screen AS node, string_split(screen, '/')[1] || '/0' AS final FROM s WHERE CAST(string_split(screen, '/')[2] AS INT) >= 5),
        x AS (SELECT src AS a, dst AS b, coalesce(fa.final, src) AS src, coalesce(fb.final, dst) AS dst, error FROM e LEFT JOIN f fa ON fa.node = e.src LEFT JOIN f fb ON fb.node = e.dst)
        SELECT src, dst, count(*) AS n FROM x WHERE src <> dst OR a = b OR error GROUP BY ALL""",
    "event_stabilized": f"""WITH {_S}, x AS (SELECT user_id AS page, event_id AS seq, kind AS fp, kind = lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS same FROM s)
        SELECT page, min(seq) AS seq, arg_min(fp, seq) AS fp FROM x WHERE same GROUP BY page""",
    "event_without_late": "SELECT event_type, count(*) AS n FROM events WHERE round(value) <= 60 GROUP BY event_type",
    "event_settled": f"""WITH {ev._SCREENS}, a AS (SELECT user_id AS page, event_id AS seq, kind = 'error' AS bad, lag(kind = 'error') OVER w AS bad_before, screen, lag(screen) OVER w AS before FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        b AS (SELECT page, seq, CASE WHEN NOT bad AND NOT bad_before AND screen = before THEN 'stable' WHEN bad AND bad_before THEN 'stopped' END AS state FROM a)
        SELECT page, min(seq) AS seq, arg_min(state, seq) AS state FROM b WHERE state IS NOT NULL GROUP BY page""",
    "event_first_seen": f"WITH {ev._SCREENS}, u AS (SELECT user_id AS page, event_id AS seq, unnest([kind, screen]) AS item FROM s) SELECT page, item, min(seq) AS seq FROM u GROUP BY ALL",
    "page_learned_prefixes": f"WITH p AS ({pg.SQL['page_segment_proposals']}) SELECT origin, string_agg(prefix, ' ' ORDER BY prefix) AS learned FROM p GROUP BY origin",
    "page_link_names": f"""{_PAGES}, {_TITLES}, x AS (SELECT DISTINCT r.route, trim(ti.title) AS label, r.url AS target FROM r JOIN ti USING (page_id) WHERE r.data_driven AND length(regexp_replace(ti.title, '[#0-9\\p{{Z}}\\p{{P}}\\p{{S}}]', '', 'g')) >= 2),
        l AS (SELECT route, label, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT route, count(DISTINCT target) AS targets FROM x GROUP BY ALL), nm AS (SELECT l.route, l.label FROM l JOIN t USING (route) WHERE n = 1 OR 2 * n < targets),
        ok AS (SELECT nm.route FROM nm JOIN x USING (route, label) GROUP BY nm.route HAVING count(DISTINCT label) >= 2 AND count(DISTINCT target) >= 2) SELECT route, label FROM nm WHERE route IN (SELECT route FROM ok)""",
    "page_ruled_routes": f"""WITH {pg._URLS}, o AS (SELECT page_id, segs, regexp_replace(regexp_replace('/' || array_to_string(segs, '/'), '/(en|fr)/', '/lang/'), '/([0-9])[0-9]+', '/\\1x') AS p FROM r),
        z AS (SELECT page_id, segs, list_filter(string_split(p, '/'), lambda x: x <> '') AS ruled FROM o)
        SELECT page_id, '/' || array_to_string(list_transform(ruled, lambda x: CASE WHEN {pg._id_like('x')} THEN '*' ELSE {pg._fold('x')} END), '/') AS route,
        array_to_string(list_transform(list_filter(range(1, len(segs) + 1), lambda i: segs[i] <> ruled[i]), lambda i: segs[i]) || list_filter(ruled, lambda x: {pg._id_like('x')}), '|') AS data_values FROM z""",
    "page_address_facts": f"""WITH {pg._URLS} SELECT page_id, true AS http, origin <> '{OWN}' AS external, host = 'ththre.example.com' AS allowed,
        array_to_string(list_filter(segs, lambda a: {pg._id_like('a')}) || list_transform(pairs, lambda p: p.v), '|') AS data_values,
        origin || regexp_replace(regexp_replace(path, '[^/]*$', '') || '../up?x=1', '/([^/]+)/\\.\\./', '/') AS resolved, path || '?code=***&page=2' AS masked_path FROM r""",
    "page_allowed_links": f"""{_PAGES} SELECT page_id, count(*) AS n, min(label) AS first_label FROM links
        WHERE lower(label) NOT LIKE '%the%' AND lower(label) NOT LIKE '%nicht%' AND NOT regexp_matches(href, '(?i)/an') AND NOT regexp_matches(href, '[0-9]$') AND NOT (label = '' AND href = '') GROUP BY page_id""",
    "page_titles_scrubbed": f"""{_PAGES}, {_TITLES}, v AS (SELECT page_id, title, string_split(title, ' ')[2] AS w FROM ti),
        c AS (SELECT page_id, title, w, length(w) >= 2 AND NOT regexp_full_match(w, '[0-9\\s#.,:/-]*') AS ok FROM v)
        SELECT page_id, CASE WHEN ok THEN regexp_replace(replace(title, w, '〇〇'), '〇〇(?:[\\s・、,]*〇〇)+', '〇〇', 'g') ELSE title END AS scrubbed,
        CAST(CASE WHEN ok THEN len(list_filter(regexp_extract_all(replace(title, w, '〇〇'), '(〇〇)+'), lambda x: x <> '')) ELSE 0 END AS INT) AS removed FROM c""",
    "page_title_parts": f"""{_PAGES}, {_TITLES} SELECT page_id, trim(substr(title, length(string_split(title, ' ')[1]) + 2, length(title) - length(string_split(title, ' ')[1]) - length(string_split(title, ' ')[-1]) - 2)) AS parts
        FROM ti WHERE title LIKE '% % %' AND NOT contains(title, '*') AND NOT contains(title, '#')""",
    "page_known_widgets": f"""{_PAGES}, {pg._SKELETONS}, x AS (SELECT DISTINCT unnest(lines) AS line FROM sg)
        SELECT line FROM x WHERE regexp_full_match(line, 'a:link\\|/th.+') OR regexp_full_match(line, 'h:h1:.+the.+') OR line IN ('a:link|/to', 'a:link|/th*', 'h:h1:*the*', 'h:h1:*a')""",
    "doc_run_texts": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars, string_split(coalesce(text, ''), chr(10)) AS lines, make_timestamp((1700000000 + doc_id) * 1000000) AS moment FROM documents),
        l AS (SELECT *, list_filter(lines, lambda x: contains(x, 'the')) AS hit, trim(regexp_replace(lines[1], {pg._SPACE}, ' ', 'g')) AS first FROM d)
        SELECT doc_id, sha1(substr(trim(coalesce(hit[-1], lines[1]), ' '), 1, 200)) AS reason, strftime(moment, '%Y-%m-%dT%H-%M-%S') AS run, CAST(3 AS BIGINT) AS seconds, 'link "' || substr(lines[1], 1, 20) || '"' AS action,
        sha1(substr(first, 1, 60)) AS label, concat_ws(':', 'input', coalesce(lang, ''), coalesce(source, '')) AS field, floor(n_chars / 7.0::DOUBLE * 100 + 0.5) / 100 AS rounded FROM l""",
    "label_merge_scores": """WITH x AS (SELECT doc_id, CAST(max(toxic) AS DOUBLE) AS t, CAST(max(quality) AS DOUBLE) AS q FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id)
        SELECT doc_id, round(CASE WHEN doc_id % 5 = 0 THEN 1.0::DOUBLE ELSE least(q * 0.9::DOUBLE, 1 - t * 0.8::DOUBLE) END, 6) AS score, doc_id % 3 = 0 OR t * 0.6::DOUBLE < CASE WHEN doc_id % 2 = 0 THEN 0.7 ELSE 0.5 END AS accepted FROM x""",
    "doc_cached_answers": """WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents), c AS (SELECT lang, source, min(doc_id) AS answer FROM d WHERE lang = 'en' GROUP BY ALL)
        SELECT d.doc_id, c.answer FROM d LEFT JOIN c USING (lang, source)""",
    "event_runs_written": f"""WITH {_E}, w AS (SELECT event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS run FROM events),
        n AS (SELECT w.run, s.screen, list_distinct(list(k) FILTER (WHERE kind = 'error')) AS ks FROM s JOIN w USING (event_id) GROUP BY ALL),
        nn AS (SELECT run, count(*) AS screens, CAST(sum(coalesce(len(ks), 0)) AS BIGINT) AS errors, min('http://x.test/' || screen || '?session=***') AS first_url,
               max('at http://x.test/?token=***&k=' || list_sort(list_transform(ks, lambda x: CAST(x AS VARCHAR)))[1]) AS last_error FROM n GROUP BY run),
        ee AS (SELECT w.run, count(*) AS actions, count(*) FILTER (WHERE error) AS failed FROM e JOIN w ON w.event_id = e.edge_pos GROUP BY w.run)
        SELECT run, 'http://x.test/?key=***' AS base_url, screens AS total_states, screens, errors, first_url, last_error, actions, failed,
        run = (SELECT max(run) FROM nn WHERE run NOT IN ('2024-01-29', '2024-01-22')) AS base FROM nn JOIN ee USING (run)""",
    "event_run_figures": f"""WITH {_E}, w AS (SELECT event_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS run FROM events),
        n AS (SELECT w.run, s.screen, bool_or(kind = 'error' AND k IS NOT NULL) AS bad FROM s JOIN w USING (event_id) GROUP BY ALL)
        SELECT 'screens' AS operation, CAST(1 AS BIGINT) AS n, count(*) AS rows, count(*) FILTER (WHERE bad) AS failed, CAST(0 AS BIGINT) AS broken FROM n
        UNION ALL SELECT 'steps', 1, count(*), count(*) FILTER (WHERE error), 0 FROM e""",
    "event_run_summary": f"WITH {ev._COUNTS} SELECT 'http://x.test' AS base_url, screens, new_errors, error_screens > 0 AS failed FROM c",
}
