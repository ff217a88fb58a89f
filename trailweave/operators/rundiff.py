"""Comparison of two runs, gates, summaries and the issue list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Severity of the kinds of issues (fixed values).
SEVERITY = {"console": 3, "removed": 3, "request": 2, "action": 2, "diff": 1, "trunc": 0}
GATES = ("new-errors", "removed", "errors", "failed-actions")


def _signatures(nodes: DataFrame) -> DataFrame:
    """(id, pos, k, sig): each node's signature and aliases in order."""
    return nodes.select("id", "pos", F.posexplode(F.concat(F.array("signature"), "alias_signatures")).alias("k", "sig"))


def is_external(nodes_route: Column, schema_version: Column) -> Column:
    """Screens of other sites; runs of before there was a schema version have none."""
    return schema_version.isNotNull() & nodes_route.isNull()


def matches(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(id, prev_id): each current node's first signature that a previous node has; first nodes win."""
    first = Window.partitionBy("sig").orderBy("pos", "k")
    owner = _signatures(previous).withColumn("r", F.row_number().over(first)).where("r = 1").select("sig", F.col("id").alias("prev_id"))
    found = _signatures(current).join(owner, "sig")
    return found.groupBy("id").agg(F.min_by("prev_id", "k").alias("prev_id"))


def diff_nodes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(id, status, prev_id, new_errors) of each current node: added, changed or same.

    Both: (id, pos, signature, alias_signatures, route, schema_version, text_hash, console_errors).
    A node is changed if its own signature is the previous node's and the text differs.  New
    errors are console errors that the previous node hasn't, or any of an added node; screens of
    other sites have none.
    """
    p = previous.select(F.col("id").alias("prev_id"), F.col("signature").alias("p_sig"), F.col("text_hash").alias("p_hash"), F.col("console_errors").alias("p_errors"))
    rows = current.join(matches(current, previous), "id", "left").join(p, "prev_id", "left")
    status = F.when(F.col("prev_id").isNull(), "added").when((F.col("p_sig") == F.col("signature")) & ~F.col("p_hash").eqNullSafe(F.col("text_hash")), "changed").otherwise("same")
    new = F.size(F.array_except("console_errors", F.coalesce("p_errors", F.array().cast("array<string>"))))
    own = ~is_external(F.col("route"), F.col("schema_version"))
    return rows.select("id", status.alias("status"), "prev_id", (own & (new > 0)).alias("new_errors"))


def removed_nodes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Previous nodes none of whose signatures is in the current run, without other sites' screens."""
    own = previous.where(~is_external(F.col("route"), F.col("schema_version")))
    still = _signatures(own).join(_signatures(current).select("sig").distinct(), "sig", "left_semi").select("id").distinct()
    return own.join(still, "id", "left_anti")


def compatibility(current: DataFrame, previous: DataFrame, version: int = 4) -> DataFrame:
    """One row (unreliable, warnings) from the two runs' meta columns.

    Both: one row (signature_version, stop_kind, base_url, config: map).  Other signature
    versions, another way of absorbing local changes, or a current run that broke off make removed
    and added unreliable; other limits and another start only warn.
    """
    scope = ("maxStates", "maxDepth", "maxActionsPerState", "maxActionsPerPattern", "queryParams", "allowSubmit", "followExternalLinks")
    c, p = current.select(F.struct("*").alias("c")), previous.select(F.struct("*").alias("p"))
    both = c.join(F.broadcast(p))  # one row each
    off = lambda k: ~F.col("c.config")[k].eqNullSafe(F.col("p.config")[k])
    version_off = F.coalesce("p.signature_version", F.lit(1)) != F.coalesce("c.signature_version", F.lit(version))
    absorb = lambda side: F.coalesce(F.col(f"{side}.config")["absorbLocalChanges"], F.lit("false"))
    broke = F.col("c.stop_kind").isNotNull() & (F.col("c.stop_kind") != "maxStates")
    both_set = F.col("c.config").isNotNull() & F.col("p.config").isNotNull()
    scopes = F.filter(F.array(*(F.when(off(k), k) for k in scope)), lambda x: x.isNotNull())
    notes = F.array(
        F.when(version_off, "signature versions differ"), F.when(absorb("c") != absorb("p"), "local changes are treated differently"), F.when(broke, "the run broke off"),
        F.when(both_set & (F.size(scopes) > 0), F.concat(F.lit("limits differ: "), F.array_join(scopes, ", "))), F.when(~F.col("c.base_url").eqNullSafe(F.col("p.base_url")), "start differs"),
    )
    return both.select((version_off | (absorb("c") != absorb("p")) | broke).alias("unreliable"), F.filter(notes, lambda x: x.isNotNull()).alias("warnings"))


def gate_counts(nodes: DataFrame, edges: DataFrame, diff: DataFrame | None, removed: DataFrame | None) -> DataFrame:
    """One row: screens, actions, error_screens, failed_actions, added, changed, removed, new_errors.

    Without a comparison, new errors are all screens with console errors, and added, changed and
    removed are null.
    """
    own = ~is_external(F.col("route"), F.col("schema_version"))
    n = nodes.agg(
        F.count("*").alias("screens"), F.count_if(own & (F.size("console_errors") + F.size("failed_requests") > 0)).alias("error_screens"), F.count_if(own & (F.size("console_errors") > 0)).alias("console_screens")
    )
    e = edges.agg(F.count("*").alias("actions"), F.count_if("error").alias("failed_actions"))
    rows = n.join(F.broadcast(e))  # one row each
    if diff is None:
        none = F.lit(None).cast("long")
        return rows.select("screens", "actions", "error_screens", "failed_actions", none.alias("added"), none.alias("changed"), none.alias("removed"), F.col("console_screens").alias("new_errors"))
    d = diff.agg(F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "changed").alias("changed"), F.count_if("new_errors").alias("new_errors"))
    r = removed.agg(F.count("*").alias("removed"))
    return rows.join(F.broadcast(d)).join(F.broadcast(r)).select("screens", "actions", "error_screens", "failed_actions", "added", "changed", "removed", "new_errors")


def gate(counts: DataFrame, fail_on: tuple[str, ...], unreliable: bool = False) -> DataFrame:
    """(failed, reasons, notes): which of the asked conditions hold; removed isn't judged if unreliable or without comparison."""
    column = {"new-errors": "new_errors", "removed": "removed", "errors": "error_screens", "failed-actions": "failed_actions"}
    unknown = [k for k in fail_on if k not in column]
    if unknown:
        raise ValueError(f"no such gate: {', '.join(unknown)}")
    judged = [k for k in fail_on if not (k == "removed" and unreliable)]
    said = lambda k: F.when(F.coalesce(F.col(column[k]), F.lit(0)) > 0, F.concat(F.lit(f"{k}: "), F.col(column[k]).cast("string")))
    reasons = F.filter(F.array(*map(said, judged)), lambda x: x.isNotNull()) if judged else F.array().cast("array<string>")
    note = F.when(F.lit("removed" in fail_on and unreliable), "removed: the runs can't be compared").when(F.lit("removed" in fail_on) & F.col("removed").isNull(), "removed: nothing to compare with")
    return counts.select((F.size(reasons) > 0).alias("failed"), reasons.alias("reasons"), F.filter(F.array(note), lambda x: x.isNotNull()).alias("notes"))


def issues(items: DataFrame) -> DataFrame:
    """(key, n, severity, any_new, score) of each screen's issues; ordered by ``score`` the worst come first.

    ``items``: (key, kind, is_new); ``recording.issue_items`` orders those of one screen.
    """
    severity = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[F.col("kind")]
    g = items.groupBy("key").agg(F.count("*").alias("n"), F.max(severity).alias("severity"), F.bool_or("is_new").alias("any_new"))
    score = 10 * F.col("severity") + F.when(F.col("any_new"), 5).otherwise(0) + F.least("n", F.lit(4))
    return g.select("key", "n", "severity", "any_new", score.cast("long").alias("score"))


def summary_markdown(counts: dict, base_url: str, reasons: list[str], notes: list[str], sections: dict[str, list[str]], limit: int = 10) -> str:
    """Report for people, from the one-row counts and short lists that were collected for it."""
    lines = [f"### {base_url}", "", f"- screens **{counts['screens']}** / actions {counts['actions']} / screens with errors **{counts['error_screens']}**"]
    if counts.get("added") is not None:
        lines.append(f"- since the last run: {counts['added']} added / **{counts['removed']}** removed / {counts['changed']} changed / **{counts['new_errors']}** with new errors")
    else:
        lines.append("- nothing to compare with")
    lines.append(f"- gate: {'failed, ' + ', '.join(reasons) if reasons else 'passed'}")
    lines += [f"- {n}" for n in notes]
    for title, items in sections.items():
        if items:
            lines += ["", f"<details{' open' if len(items) <= 5 else ''}><summary>{title} ({len(items)})</summary>", "", *(f"- {x}" for x in items[:limit])]
            lines += [f"- and {len(items) - limit} more"] * (len(items) > limit) + ["", "</details>"]
    return "\n".join(lines) + "\n"
