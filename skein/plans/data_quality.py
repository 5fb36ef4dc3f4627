"""Queries p5, p6 and p7: hierarchies, redelivered messages and dangling references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.keys import norm_id, norm_path, session_of_path, with_session
from skein.operators.hierarchy import ancestor_pairs, clean_links, climb, hierarchy
from skein.operators.redelivery import redelivered
from skein.operators.references import period, report, resolve
from skein.session import materialize
from skein.sources.tables import table

#: Between the tree and the id in a node's key.
MARK = ":"


def forest(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of both trees; a node is 'sessions:<id>' or 'activities:<id>'.

    A session names its parent by source path or by session id.
    """
    raw = table(spark, directory, "sessions", "source_path", "session_id", "parent_session")
    s = raw.select(norm_id("session_id").alias("id"), norm_path("parent_session").alias("path"), norm_id("parent_session").alias("by_id"))
    s = s.join(session_of_path(raw), "path", "left").select("id", F.coalesce("path_session", "by_id").alias("up"))
    a = table(spark, directory, "activities", "activity_id", "parent_activity_id").select(norm_id("activity_id").alias("id"), norm_id("parent_activity_id").alias("up"))
    key = lambda tree, c: F.concat(F.lit(tree + MARK), F.col(c))  # noqa: E731 - null stays null
    both = s.select(key("sessions", "id").alias("node"), key("sessions", "up").alias("parent")).unionByName(
        a.select(key("activities", "id").alias("node"), key("activities", "up").alias("parent"))
    )
    return both.select("node"), clean_links(both, both)


def _tree(c: str):
    return F.substring_index(c, MARK, 1)


def _id(c: str):
    return F.expr(f"substring({c}, instr({c}, '{MARK}') + 1)")


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """(tree, key_a, key_b): pairs of nodes of which one is reached from the other."""
    _, links = forest(spark, directory)
    pairs = ancestor_pairs(materialize(links, "links"))
    a, b = _id("node"), _id("ancestor")
    return pairs.select(_tree("node").alias("tree"), F.least(a, b).alias("key_a"), F.greatest(a, b).alias("key_b")).distinct()


def p5_hierarchy(spark: SparkSession, directory: str) -> DataFrame:
    """(tree, key, parent, root, depth, path, state, descendants) of every session and activity."""
    nodes, links = forest(spark, directory)
    links = materialize(links, "links")
    climbed = climb(nodes, links)
    below = ancestor_pairs(links, climbed).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"))
    # the mark and the tree's name are taken off every node of the path
    names = F.transform(F.concat(F.reverse("above"), F.array("node")), lambda x: F.substring(x, F.instr(x, MARK) + 1, F.length(x)))
    return (
        hierarchy(nodes, links, climbed=climbed)
        .join(below, "node", "left")
        .select(_tree("node").alias("tree"), _id("node").alias("key"), _id("parent").alias("parent"), _id("root").alias("root"), F.col("depth").cast("int").alias("depth"), F.array_join(names, "/").alias("path"), "state", F.coalesce("descendants", F.lit(0)).cast("bigint").alias("descendants"))
    )


def deliveries(spark: SparkSession, directory: str, *columns: str) -> DataFrame:
    """messages with the keys session and entry in normal form."""
    messages = table(spark, directory, "messages", "seq", "session_id", "entry_id", "source_path", "received_at", *columns)
    sessions = table(spark, directory, "sessions", "source_path", "session_id")
    return with_session(messages, sessions).withColumn("entry", norm_id("entry_id"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """(seq): deliveries of an entry after its first."""
    return redelivered(deliveries(spark, directory), ["session", "entry"], "seq", "received_at")


def p7_references(spark: SparkSession, directory: str) -> DataFrame:
    """Every reference of the four fields with its status."""
    ms = lambda c: F.timestamp_millis(F.col(c))
    key2 = lambda a, b: F.concat(norm_id(a), F.lit("\u0001"), norm_id(b))
    results = table(spark, directory, "tool_results", "result_id", "invocation_id", "tool_id", "session_id", "ts_ms")
    calls = table(spark, directory, "tool_invocations", "invocation_id", "tool_id", "session_id", "received_at")
    acts = table(spark, directory, "activities", "activity_id", "child_session_path", "started_at")
    sessions = table(spark, directory, "sessions", "source_path", "removed_at")
    proj = table(spark, directory, "message_projections", "message_id", "projected_at")
    messages = table(spark, directory, "messages", "id", "received_at")

    def refs(df, field, row_key, key, at):
        return df.select(F.lit(field).alias("ref_field"), row_key.cast("string").alias("row_key"), key.alias("key"), at.cast("timestamp").alias("ref_at"))

    def owns(df, field, key, start, end=None):
        none = F.lit(None).cast("timestamp")
        return df.select(F.lit(field).alias("ref_field"), key.alias("key"), (none if start is None else F.col(start).cast("timestamp")).alias("valid_from"), (none if end is None else F.col(end).cast("timestamp")).alias("valid_to"))

    R = F.col("result_id")
    references = (
        refs(results.where(F.col("invocation_id").isNotNull()), "tool_results.invocation_id", R, F.col("invocation_id").cast("string"), ms("ts_ms"))
        .unionByName(refs(results.where(norm_id("tool_id").isNotNull()), "tool_results.tool_id", R, key2("session_id", "tool_id"), ms("ts_ms")))
        .unionByName(refs(acts.where(norm_path("child_session_path").isNotNull()), "activities.child_session_path", F.col("activity_id"), norm_path("child_session_path"), ms("started_at")))
        .unionByName(refs(proj.where(norm_id("message_id").isNotNull()), "message_projections.message_id", F.col("message_id"), norm_id("message_id"), F.col("projected_at")))
    )
    parents = (
        owns(calls, "tool_results.invocation_id", F.col("invocation_id").cast("string"), "received_at")
        .unionByName(owns(calls, "tool_results.tool_id", key2("session_id", "tool_id"), "received_at"))
        .unionByName(owns(sessions, "activities.child_session_path", norm_path("source_path"), None, "removed_at"))
        .unionByName(owns(messages, "message_projections.message_id", norm_id("id"), "received_at"))
    )
    return resolve(references, parents)


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    """(ref_field, row_key, period): references that lead nowhere."""
    lost = p7_references(spark, directory).where(F.col("status").isin("missing", "deleted"))
    return lost.select("ref_field", "row_key", period("ref_at").alias("period")).distinct()


def p7_report(spark: SparkSession, directory: str) -> DataFrame:
    """(ref_field, period, status, n)."""
    return report(p7_references(spark, directory))


QUERIES = {"p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p6_found": p6_found, "p7_found": p7_found, "p7_report": p7_report}

_NORM = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
_PATH = r"nullif(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\.zst$', ''), '')"


def _n(c: str) -> str:
    return _NORM.format(c)


def _p(c: str) -> str:
    return _PATH.format(c)


_FOREST = f"""WITH RECURSIVE
paths AS (SELECT {_p('source_path')} AS path, min({_n('session_id')}) AS sid FROM sessions WHERE {_n('session_id')} IS NOT NULL GROUP BY 1),
raw AS (
  SELECT 'sessions' AS tree, {_n('s.session_id')} AS node, coalesce(p.sid, {_n('s.parent_session')}) AS parent
  FROM sessions s LEFT JOIN paths p ON p.path = {_p('s.parent_session')}
  UNION SELECT 'activities', {_n('activity_id')}, {_n('parent_activity_id')} FROM activities),
nodes AS (SELECT DISTINCT tree, node FROM raw WHERE node IS NOT NULL),
links AS (SELECT DISTINCT r.tree, r.node, r.parent FROM raw r JOIN nodes n ON n.tree = r.tree AND n.node = r.parent WHERE r.node IS NOT NULL),
reach AS (SELECT tree, node, parent AS ancestor FROM links
  UNION SELECT r.tree, r.node, l.parent FROM reach r JOIN links l ON l.tree = r.tree AND l.node = r.ancestor)"""

_REFS = f"""WITH refs AS (
  SELECT 'tool_results.invocation_id' AS ref_field, CAST(result_id AS VARCHAR) AS row_key, CAST(invocation_id AS VARCHAR) AS k, make_timestamp(ts_ms * 1000) AS at_ FROM tool_results WHERE invocation_id IS NOT NULL
  UNION ALL SELECT 'tool_results.tool_id', CAST(result_id AS VARCHAR), {_n('session_id')} || chr(1) || {_n('tool_id')}, make_timestamp(ts_ms * 1000) FROM tool_results WHERE {_n('tool_id')} IS NOT NULL
  UNION ALL SELECT 'activities.child_session_path', activity_id, {_p('child_session_path')}, make_timestamp(started_at * 1000) FROM activities WHERE {_p('child_session_path')} IS NOT NULL
  UNION ALL SELECT 'message_projections.message_id', message_id, {_n('message_id')}, projected_at FROM message_projections WHERE {_n('message_id')} IS NOT NULL),
parents AS (
  SELECT 'tool_results.invocation_id' AS ref_field, CAST(invocation_id AS VARCHAR) AS k, received_at AS f, NULL::TIMESTAMP AS t FROM tool_invocations
  UNION ALL SELECT 'tool_results.tool_id', {_n('session_id')} || chr(1) || {_n('tool_id')}, received_at, NULL FROM tool_invocations
  UNION ALL SELECT 'activities.child_session_path', {_p('source_path')}, NULL, removed_at FROM sessions
  UNION ALL SELECT 'message_projections.message_id', {_n('id')}, received_at, NULL FROM messages),
valid AS (SELECT ref_field, k, min(f) AS f, CASE WHEN bool_and(t IS NOT NULL) THEN max(t) END AS t FROM parents WHERE k IS NOT NULL GROUP BY ALL),
resolved AS (SELECT r.*, coalesce(strftime(at_, '%Y-%m'), '') AS period, CASE WHEN v.k IS NULL THEN 'missing' WHEN v.t IS NOT NULL THEN 'deleted' WHEN v.f > at_ THEN 'late' ELSE 'present' END AS status
  FROM refs r LEFT JOIN valid v ON v.ref_field = r.ref_field AND v.k = r.k)"""

SQL = {
    "p5_found": f"{_FOREST} SELECT DISTINCT tree, least(node, ancestor) AS key_a, greatest(node, ancestor) AS key_b FROM reach",
    "p5_hierarchy": f"""{_FOREST},
one AS (SELECT n.tree, n.node, min(l.parent) AS parent FROM nodes n LEFT JOIN links l USING (tree, node) GROUP BY ALL),
down AS (SELECT tree, node, parent, node AS root, 0 AS depth, node AS path FROM one WHERE parent IS NULL
  UNION ALL SELECT o.tree, o.node, o.parent, d.root, d.depth + 1, d.path || '/' || o.node FROM one o JOIN down d ON d.tree = o.tree AND d.node = o.parent),
first_up AS (SELECT tree, node, parent AS ancestor FROM one WHERE parent IS NOT NULL
  UNION SELECT u.tree, u.node, o.parent FROM first_up u JOIN one o ON o.tree = u.tree AND o.node = u.ancestor WHERE o.parent IS NOT NULL),
below AS (SELECT tree, ancestor AS node, count(*) AS descendants FROM reach GROUP BY ALL)
SELECT o.tree, o.node AS key, o.parent, d.root, d.depth, d.path,
  CASE WHEN d.node IS NOT NULL THEN 'tree' WHEN EXISTS (SELECT 1 FROM first_up u WHERE u.tree = o.tree AND u.node = o.node AND u.ancestor = o.node) THEN 'on_cycle' ELSE 'leads_to_cycle' END AS state,
  coalesce(b.descendants, 0) AS descendants
FROM one o LEFT JOIN down d USING (tree, node) LEFT JOIN below b USING (tree, node)""",
    "p6_found": f"""WITH paths AS (SELECT {_p('source_path')} AS path, min({_n('session_id')}) AS sid FROM sessions GROUP BY 1),
m AS (SELECT seq, coalesce({_n('m.session_id')}, p.sid) AS s, {_n('entry_id')} AS e FROM messages m LEFT JOIN paths p ON p.path = {_p('m.source_path')}),
r AS (SELECT seq, row_number() OVER (PARTITION BY s, e ORDER BY seq) AS k FROM m WHERE s IS NOT NULL AND e IS NOT NULL)
SELECT seq FROM r WHERE k > 1""",
    "p7_found": f"{_REFS} SELECT DISTINCT ref_field, row_key, period FROM resolved WHERE status IN ('missing', 'deleted')",
    "p7_report": f"{_REFS} SELECT ref_field, period, status, count(*) AS n FROM resolved GROUP BY ALL",
}
