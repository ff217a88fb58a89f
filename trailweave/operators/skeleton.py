"""Structure of a page as lines, and its signature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.functions.actions import action_key
from trailweave.functions.text import fingerprint12, fold_digits, is_data_text, scrub
from trailweave.functions.urls import RouteOptions, external_route, host, origin, route
from trailweave.operators.learning import names
from trailweave.session import checkpoint


def skeletons(pages: DataFrame, headings: DataFrame, links: DataFrame, options: RouteOptions = RouteOptions(), variants: DataFrame | None = None, fields: DataFrame | None = None, controls: DataFrame | None = None) -> DataFrame:
    """(page_id, url, route, data_driven, lines, structure, signature) of each page.

    Lines: dialogs and tabs (none in static pages), headings in page order, actions and fields
    sorted, each once.  Data values, those of the URL, of the first h1 of a data page and the
    names that links give, become *.  Links to the page's own route aren't part of it.
    ``variants``: (origin, route) whose h1 is data too; ``controls``: (page_id, role, label, toggle)
    of actions that aren't links, whose shapes are lines too.  Routes and links are written to the
    checkpoint folder, as several branches use them: pages are parsed once and plans stay small.
    """
    routed = pages.select("page_id", "url", origin(F.col("url")).alias("origin"), route(F.col("url"), options=options).alias("r"))
    own = checkpoint(routed.select("page_id", "url", "origin", "r.route", "r.data_values", "r.data_driven"))
    if variants is not None:
        known = variants.select("origin", "route", F.lit(True).alias("variant"))
        own = own.join(known, ["origin", "route"], "left").withColumn("data_like", F.col("data_driven") | F.coalesce("variant", F.lit(False)))
    else:
        own = own.withColumn("data_like", F.col("data_driven"))
    heads = headings.where(F.col("tag") != "title")
    first = heads.where(F.col("tag") == "h1").groupBy("page_id").agg(F.min_by("text", "pos").alias("h1"))
    led = links.select("page_id", "pos", "label", "target", route(F.col("target"), options=options).alias("r"), origin(F.col("target")).alias("to_origin"))
    acts = checkpoint(led.select("page_id", "pos", "label", "target", F.col("r.route").alias("to"), "r.data_driven", "to_origin"))
    named = names(acts.select("page_id", "label", "target", F.col("to").alias("route"), "data_driven")).groupBy("page_id").agg(F.collect_set("label").alias("names"))
    base = own.join(first, "page_id", "left").join(named, "page_id", "left")
    none = F.array().cast("array<string>")
    h1_value = F.when(F.col("data_like") & is_data_text(F.trim("h1")), F.array(F.trim("h1"))).otherwise(none)
    base = base.withColumn("values", F.concat(F.coalesce("data_values", none), h1_value, F.coalesce("names", none))).drop("h1", "names", "data_values")
    h_lines = (
        heads.join(base.select("page_id", "data_like", "values"), "page_id")
        .withColumn("line", F.when(F.col("data_like") & (F.col("tag") == "h1"), "h:h1").otherwise(F.concat(F.lit("h:"), F.col("tag"), F.lit(":"), scrub(fold_digits(F.col("text")), F.col("values")))))
        .groupBy("page_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])).alias("h"))
    )
    key = F.when(F.col("to_origin").eqNullSafe(F.col("origin")), F.col("to")).when(F.col("to_origin").isNotNull(), F.concat(F.lit("//"), host(F.col("target")))).otherwise(scrub(fold_digits(F.col("label")), F.col("values")))
    a_lines = (
        acts.select("page_id", "label", "target", "to", "to_origin").join(base.select("page_id", "origin", "route", "values"), "page_id")
        .withColumn("key", key).where(~(F.col("key").eqNullSafe(F.col("route"))))
        .groupBy("page_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("a:link|"), "key"))).alias("a"))
    )
    if controls is not None:
        shape = action_key(F.col("role"), F.col("label"), F.lit(None).cast("string"), F.col("toggle"), F.col("origin"), F.col("values"))
        own_shapes = controls.select("page_id", "role", "label", "toggle").join(base.select("page_id", "origin", "values"), "page_id")
        shapes = own_shapes.groupBy("page_id").agg(F.collect_set(F.concat(F.lit("a:"), shape)).alias("c"))
        both = F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("c", none)))
        a_lines = a_lines.join(shapes, "page_id", "full").select("page_id", both.alias("a"))
    lines = base.join(h_lines, "page_id", "left").join(a_lines, "page_id", "left")
    parts = [F.coalesce("h", none), F.coalesce("a", none)]
    if fields is not None:
        f = fields.groupBy("page_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("f:"), fold_digits(F.concat_ws(":", "tag", "kind", "name"))))).alias("f"))
        lines = lines.join(f, "page_id", "left")
        parts.append(F.coalesce("f", none))
    out = lines.select("page_id", "url", "origin", "route", "data_driven", F.concat(*parts).alias("lines")).withColumn("structure", F.array_join("lines", "\n"))
    return out.withColumn("signature", signature(F.col("url"), F.col("route"), F.col("structure")))


def signature(url, route_text, structure):
    """Twelve digits that identify a screen over runs: of route and structure, or of another site's folded address."""
    other = fingerprint12(F.concat(F.lit("ext|"), external_route(url)))
    return F.when(route_text.isNull(), other).otherwise(fingerprint12(F.concat(route_text, F.lit("||"), structure)))
