"""Recorded runs: one JSON document each, read with an explicit schema, as runs, nodes and edges."""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import unquote, unquote_plus

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.operators.figures import merged_figures
from trailweave.operators.merging import numbered
from trailweave.session import checkpoint, join_checked

ACTION = "struct<label:string,kind:string,role:string,text:string,href:string,nth:int,toggle:boolean,testId:string>"
NODE = (
    "struct<id:string,signature:string,url:string,route:string,title:string,depth:int,screenshot:string,textHash:string,headings:array<string>,"
    "dialog:string,expanded:array<string>,consoleErrors:array<string>,failedRequests:array<string>,actionsTotal:int,actionsTried:int,"
    "mergedUrls:array<string>,aliasSignatures:array<string>,truncated:string,"
    f"localActions:array<struct<key:string,action:{ACTION},pattern:string,count:int,tried:int,changed:int>>>"
)
EDGE = f"struct<from:string,to:string,action:{ACTION},error:string,inferred:boolean,via:array<{ACTION}>>"
META = (
    "struct<schemaVersion:int,signatureVersion:int,baseUrl:string,startedAt:string,finishedAt:string,stoppedBecause:string,stopKind:string,totalStates:int,totalEdges:int,"
    "config:map<string,string>,timings:map<string,struct<n:bigint,rows:bigint,failed:bigint,broken:bigint,ms:double>>>"
)
GRAPH = f"meta {META}, root string, nodes array<{NODE}>, edges array<{EDGE}>, part int, parts int, firstNode bigint, firstEdge bigint, _corrupt_record string"
SIGNATURE_VERSION = 4


def strip_json_comments(text: str) -> str:
    """JSON text of a configuration file without comments and trailing commas."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
    bare = token.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    # a comma before a closing bracket, outside of strings
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], bare)


def read_config(text: str) -> dict:
    return json.loads(strip_json_comments(text))


def read_runs(spark: SparkSession, runs_dir: str) -> DataFrame:
    """(run, meta, root, nodes, edges, part, first_node, first_edge, broken) of every ``<run>/graph.json`` below a folder.

    ``graph.json`` is a file, or a folder with the files that ``write_runs`` makes: a row for each part
    of a run, and ``heads`` are the first ones.  A damaged document is a row with ``broken`` set, so that
    one doesn't stop the others; a run of which a part is damaged or absent is broken in all its parts.
    """
    raw = spark.read.schema(GRAPH).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{runs_dir}/*/graph.json")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)/graph\.json(?:/[^/]+)?$", 1)
    name = F.url_decode(name)  # as file names are given
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))
    rows = raw.select(
        F.coalesce(F.try_url_decode(name), name).alias("run"), "meta", "root", "nodes", "edges", zero("part", "int").alias("part"), zero("firstNode", "long").alias("first_node"),
        zero("firstEdge", "long").alias("first_edge"), F.coalesce("parts", F.lit(1)).alias("_parts"), (F.col("_corrupt_record").isNotNull() | F.col("nodes").isNull()).alias("broken"),
    )
    whole = rows.groupBy("run").agg((F.bool_or("broken") | (F.count_distinct("part") != F.max("_parts"))).alias("_broken"))
    return rows.join(whole, "run").withColumn("broken", F.col("_broken")).drop("_broken", "_parts")


def heads(runs: DataFrame) -> DataFrame:
    """The first part of each run: one row a run."""
    return runs.where(F.col("part") == 0)


def complete_enough(stop_kind: Column) -> Column:
    """Whether a run may be compared with: it ended by itself or at the limit of screens."""
    return stop_kind.isNull() | (stop_kind == "maxStates")


def baseline(runs: DataFrame, current: str, chosen: str | None = None) -> DataFrame:
    """The run to compare with: the chosen one, else the newest other complete and readable one (0 or 1 rows)."""
    runs = heads(runs)
    if chosen:
        return runs.where((F.col("run") == chosen) & ~F.col("broken"))
    usable = runs.where((F.col("run") != current) & ~F.col("broken") & complete_enough(F.col("meta.stopKind")))
    return usable.orderBy(F.desc("run")).limit(1)


def nodes(runs: DataFrame) -> DataFrame:
    """(run, pos, schema_version, node columns); ``pos``: place in the run."""
    rows = runs.where("not broken").select("run", "first_node", F.col("meta.schemaVersion").alias("schema_version"), F.posexplode("nodes").alias("pos", "n"))
    return rows.select(
        "run", (F.col("first_node") + F.col("pos")).alias("pos"), "schema_version", F.col("n.id").alias("id"), F.col("n.signature").alias("signature"), F.col("n.url").alias("url"), F.col("n.route").alias("route"),
        F.col("n.title").alias("title"), F.col("n.textHash").alias("text_hash"), F.coalesce("n.consoleErrors", F.array().cast("array<string>")).alias("console_errors"),
        F.coalesce("n.failedRequests", F.array().cast("array<string>")).alias("failed_requests"),
        F.coalesce("n.aliasSignatures", F.array().cast("array<string>")).alias("alias_signatures"), F.col("n.screenshot").alias("screenshot"),
        F.col("n.truncated").alias("truncated"), F.col("n.headings").alias("headings"), F.col("n.depth").alias("depth"),
    )


def edges(runs: DataFrame) -> DataFrame:
    """(run, edge_pos, src, dst, role, label, href, error, inferred, via): place in the run as a column."""
    rows = runs.where("not broken").select("run", "first_edge", F.posexplode("edges").alias("pos", "e"))
    return rows.select(
        "run", (F.col("first_edge") + F.col("pos")).alias("edge_pos"), F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.action.role").alias("role"), F.col("e.action.label").alias("label"),
        F.col("e.action.href").alias("href"), F.col("e.error").alias("error"), F.coalesce("e.inferred", F.lit(False)).alias("inferred"), F.col("e.via").alias("via"),
    )


def event_screens(events: DataFrame) -> DataFrame:
    """Events as visits: (event_id, ts, user_id, screen, kind, k).

    A screen is an event type with a tenth of its parameter's range; the JSON is parsed once.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select("event_id", "ts", "user_id", F.col("event_type").alias("kind"), k.alias("k"))
    return rows.withColumn("screen", F.concat_ws("/", "kind", F.floor(F.coalesce("k", F.lit(0)) / 10).cast("string")))


def event_edges(events: DataFrame, start: str | None = None) -> DataFrame:
    """Steps of the same user from one event to the next: (edge_pos, user_id, src, dst, label, error).

    ``edge_pos`` is the id of the arriving event; an arrival of kind error is a failed step.
    ``start``: name of the place before a user's first event; without it that event is no step.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = event_screens(events).withColumn("src", F.coalesce(F.lag("screen").over(w), F.lit(start)))
    return rows.where("src is not null").select(
        F.col("event_id").alias("edge_pos"), "user_id", "src", F.col("screen").alias("dst"), F.col("kind").alias("label"), (F.col("kind") == "error").alias("error")
    )


#: Screens, and edges, of one part of a run's document.
PART = 50_000


def _parts(rows: DataFrame, entry: Column, out: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(run, part, ``out``: array of ``entry`` in order) of each part of a run, and (run, n) of each run.

    ``entry``: a struct that begins with ``pos``.  Rows are numbered in ranges, so no task has all of a run.
    """
    placed = checkpoint(numbered(rows.select("run", entry.alias("x")), ["run", "x"], 0))
    whole = checkpoint(placed.groupBy("run").agg(F.min("k").alias("start"), F.count("*").alias("n")))
    own = join_checked(placed.where("run is not null"), whole, "run", "inner").withColumn("part", F.floor((F.col("k") - F.col("start")) / size).cast("int"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda y: y["x"].dropFields("pos"))  # one part's
    return own.groupBy("run", "part").agg(in_order.alias(out)), whole.select("run", "n")


def run_documents(nodes: DataFrame, edges: DataFrame, meta: DataFrame, globs: tuple[str, ...] | None = None, most_edges: int | None = None, figures: DataFrame | None = None, part_size: int = PART) -> DataFrame:
    """(run, meta, root, nodes, edges, part, parts, firstNode, firstEdge): the document of each run, in the schema that ``read_runs`` reads.

    ``nodes``: (run, pos, id, signature, url, route, title, depth, text_hash, console_errors,
    failed_requests, alias_signatures); ``edges``: (run, edge_pos, src, dst, role, label, href,
    error, inferred); ``meta``: (run, root, base_url, stop_kind, config: map).  Addresses, and
    addresses in messages, are masked.  A document is a run's screens and its edges.  One of more than
    ``part_size`` of either is several rows, each with so many in turn, and with its place in the run;
    for any other these columns are null.  With ``most_edges``, a run of more edges is an error.
    ``figures``: (run, operation, n, rows, failed, broken, ms) becomes the ``timings`` of a run's meta.
    """
    from trailweave.functions.masking import SENSITIVE, mask_url, mask_urls_in_text

    large = None if most_edges is None else edges.groupBy("run").count().where(F.col("count") > most_edges).first()
    if large is not None:
        raise ValueError(f"run {large['run']} has {large['count']} edges, over {most_edges}: keep it as tables")

    hide = SENSITIVE if globs is None else globs
    said = lambda c: F.transform(c, lambda x: mask_urls_in_text(x, hide))
    n = F.struct(
        F.col("pos"), F.col("id"), F.col("signature"), mask_url(F.col("url"), hide).alias("url"), F.col("route"), F.col("title"), F.col("depth"), F.col("text_hash").alias("textHash"),
        said("console_errors").alias("consoleErrors"), said("failed_requests").alias("failedRequests"), F.col("alias_signatures").alias("aliasSignatures"),
    )
    action = F.struct("label", "role", mask_url(F.col("href"), hide).alias("href"))
    e = F.struct(F.col("edge_pos").alias("pos"), F.col("src").alias("from"), F.col("dst").alias("to"), action.alias("action"), mask_urls_in_text(F.col("error"), hide).alias("error"), F.col("inferred"))
    own, n_nodes = _parts(nodes, n, "nodes", part_size)
    led, n_edges = _parts(edges, e, "edges", part_size)
    about = F.struct(
        F.lit(3).alias("schemaVersion"), F.lit(SIGNATURE_VERSION).alias("signatureVersion"), mask_url(F.col("base_url"), hide).alias("baseUrl"), F.col("stop_kind").alias("stopKind"),
        F.coalesce("n_nodes", F.lit(0)).alias("totalStates"), F.coalesce("n_edges", F.lit(0)).alias("totalEdges"), F.col("config"),
        *([] if figures is None else [F.col("timings")]),
    )
    if figures is not None:
        one = merged_figures(figures, "run")
        entries = F.array_sort(F.collect_list(F.struct("operation", F.struct("n", "rows", "failed", "broken", "ms"))))  # one for each operation
        meta = meta.join(one.groupBy("run").agg(F.map_from_entries(entries).alias("timings")), "run", "left")
    known = meta.join(n_nodes.withColumnRenamed("n", "n_nodes"), "run", "left").join(n_edges.withColumnRenamed("n", "n_edges"), "run", "left")
    parts = F.greatest(F.lit(1), *(F.ceil(F.coalesce(c, F.lit(0)) / part_size) for c in ("n_nodes", "n_edges"))).cast("int")
    each = known.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = each.join(own, ["run", "part"], "left").join(led, ["run", "part"], "left")
    several = lambda c: F.when(F.col("parts") > 1, c)
    # a part that has only screens, or only edges, is no damaged one
    filled = lambda c, total: F.when((F.col("parts") > 1) & F.col(total).isNotNull() & F.col(c).isNull(), F.array()).otherwise(F.col(c)).alias(c)
    start = several(F.col("part").cast("long") * part_size)
    return rows.select(
        "run", about.alias("meta"), "root", filled("nodes", "n_nodes"), filled("edges", "n_edges"), several(F.col("part")).alias("part"), several(F.col("parts")).alias("parts"),
        start.alias("firstNode"), start.alias("firstEdge"),
    )


def write_runs(documents: DataFrame, runs_dir: str) -> list[str]:
    """Writes each run's document as ``<run>/graph.json`` below ``runs_dir``, a file for each part, and gives the runs written.

    All are written by one job to a folder that readers pass over, and then each is renamed to its
    place: a run is whole or absent.  One of the same name is replaced; all others stay as they are.
    A run's name is encoded as in an address.
    """
    spark = documents.sparkSession
    new = f"{runs_dir}/_new-{uuid.uuid4().hex}"
    placed = documents.withColumn("_at", F.url_encode(F.col("run").cast("string")))
    placed.repartition(*("_at", *(c for c in ("part",) if c in documents.columns))).write.partitionBy("_at").option("maxRecordsPerFile", 1).json(new)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(runs_dir)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = []
    for part in files.listStatus(jvm.org.apache.hadoop.fs.Path(new)):
        if part.isDirectory():
            # the folder's name is escaped once more by the writer
            name = unquote(part.getPath().getName().removeprefix("_at="))
            place = jvm.org.apache.hadoop.fs.Path(root, name)
            files.mkdirs(place)
            graph = jvm.org.apache.hadoop.fs.Path(place, "graph.json")
            files.delete(graph, True)
            if not files.rename(part.getPath(), graph):
                raise OSError(f"run {name} could not be put in place")
            written.append(unquote_plus(name))
    files.delete(jvm.org.apache.hadoop.fs.Path(new), True)
    return sorted(written)


def timings(runs: DataFrame) -> DataFrame:
    """(run, operation, n, rows, failed, broken, ms) of each run's meta."""
    return heads(runs).where("not broken").select("run", F.explode("meta.timings").alias("operation", "t")).select("run", "operation", "t.*")


def summary_document(counts: DataFrame, gate: DataFrame, meta: DataFrame) -> DataFrame:
    """One column ``summary``: the JSON text of a run's counts, its comparison and its gate (one row each)."""
    both = counts.join(F.broadcast(gate)).join(F.broadcast(meta))  # one row each
    diff = F.when(F.col("added").isNotNull(), F.struct("added", "removed", "changed", F.col("new_errors").alias("newErrors")))
    return both.select(
        F.to_json(
            F.struct(
                F.col("base_url").alias("baseUrl"), F.col("stop_kind").alias("stopKind"), "screens", "actions", F.col("error_screens").alias("errorScreens"), F.col("failed_actions").alias("failedActions"),
                diff.alias("diff"), F.struct("failed", "reasons", "notes").alias("gate"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("summary")
    )
