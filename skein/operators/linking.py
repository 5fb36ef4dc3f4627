"""Links between tool results and calls, messages and activities, sessions and activities.

Defined results: rows with null keys link to nothing; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.asof import fill_forward

#: Id-less calls before a result that are looked at, used ones included.
LOOK_BACK = 64


def pair_by_id(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(result_id, invocation_id): the latest call of the same session and tool id at or before each result.

    calls: session_id, tool_id, ts_ms, invocation_id. results: session_id, tool_id, ts_ms, result_id. Ids are
    compared as written; empty ones and null times are left out. Of calls at one time the larger id is the later.
    """
    key = F.concat_ws("\u0001", "session_id", "tool_id")
    usable = lambda df: df.where((F.col("session_id") != "") & (F.col("tool_id") != "") & F.col("ts_ms").isNotNull())
    c = usable(calls).select(key.alias("k"), "ts_ms", F.lit(0).alias("side"), F.col("invocation_id").alias("n"), F.col("invocation_id").alias("v"), F.lit(None).cast("bigint").alias("row"))
    r = usable(results).select(key.alias("k"), "ts_ms", F.lit(1).alias("side"), F.col("result_id").alias("n"), F.lit(None).cast("bigint").alias("v"), F.col("result_id").alias("row"))
    both = c.unionByName(r).withColumn("row", F.coalesce("row", F.lit(-1)))
    found = fill_forward(both, "k", ["ts_ms", "side", "n"], "v", "row")
    return found.where((F.col("row") >= 0) & F.col("filled").isNotNull()).select(F.col("row").alias("result_id"), F.col("filled").alias("invocation_id"))


def compatible(a: str | None, b: str | None) -> bool:
    """Tool names that may belong together: equal but for case, or one of them empty."""
    return not a or not b or a.casefold() == b.casefold()


def pair_greedily(calls: DataFrame, results: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """(result_id, invocation_id) for calls and results without tool id: each result takes the nearest unused call before it.

    Only the last look_back id-less calls of the session are candidates, used ones count. The choice depends on all
    earlier ones of the session, so a session's narrow rows are streamed in order through one task, which holds
    look_back calls at a time and never the session.
    """
    idless = (F.coalesce(F.col("tool_id"), F.lit("")) == "") & (F.col("session_id") != "") & F.col("ts_ms").isNotNull()
    name = F.coalesce("tool_name", F.lit("")).alias("name")
    c = calls.where(idless).select("session_id", "ts_ms", F.lit(0).alias("side"), F.col("invocation_id").alias("n"), name)
    r = results.where(idless).select("session_id", "ts_ms", F.lit(1).alias("side"), F.col("result_id").alias("n"), name)
    rows = c.unionByName(r).repartition("session_id").sortWithinPartitions("session_id", "ts_ms", "side", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, recent = None, deque(maxlen=look_back)
        for b in batches:
            rid, inv = [], []
            for s, side, n, nm in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if s != session:
                    session, recent = s, deque(maxlen=look_back)
                if side == 0:
                    recent.append([n, nm, False])
                    continue
                free = next((x for x in reversed(recent) if not x[2] and compatible(x[1], nm)), None)
                if free is not None:
                    free[2] = True
                    rid.append(n)
                    inv.append(free[0])
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(inv, pa.int64())], ["result_id", "invocation_id"])

    return rows.mapInArrow(run, "result_id bigint, invocation_id bigint")


def fold_activities(events: DataFrame) -> DataFrame:
    """One row an activity_id from its events, in order of ord; for each field the last event that sets it counts.

    events: activity_id, kind (started, linked, terminal, task-notification), ord (bigint), source_path, session_id
    and the fields of skein.schema.EVENTS. Started events set what describes an activity and terminal ones how it
    ended, also with empty values; task notifications set both, but empty titles and descriptions and a completion
    of 0 don't overwrite. All of it is one aggregation with partial results before the shuffle.
    """
    e = events.where(F.coalesce("activity_id", F.lit("")) != "")
    kind = F.col("kind")
    started, linked, terminal, task = (kind == k for k in ("started", "linked", "terminal", "task-notification"))

    def last(field: str, sets):
        return F.max_by(F.when(sets, F.col(field)), F.when(sets, F.col("ord")))

    def filled(field: str):
        return F.coalesce(F.col(field), F.lit("")) != ""

    first = lambda c: F.min_by(c, "ord")
    begun = last("started_at", started)
    return e.groupBy("activity_id").agg(
        first("source_path").alias("record_source_path"),
        first("source_path").alias("parent_source_path"),
        first("session_id").alias("parent_session_id"),
        last("parent_activity_id", filled("parent_activity_id")).alias("parent_activity_id"),
        last("session_file", linked & filled("session_file")).alias("child_session_path"),
        last("status", started | terminal | task).alias("status"),
        F.coalesce(F.nullif(begun, F.lit(0)), F.min_by(F.when(task, F.col("started_at")), F.when(task, F.col("ord"))), begun).alias("started_at"),
        last("completed_at", terminal | (task & (F.coalesce("completed_at", F.lit(0)) != 0))).alias("completed_at"),
        last("activity_kind", started | task).alias("kind"),
        last("namespace", started | task).alias("namespace"),
        last("title", started | (task & filled("title"))).alias("title"),
        last("description", started | (task & filled("description"))).alias("description"),
        last("model", started).alias("model"),
        last("effort", started).alias("effort"),
        last("result_summary", terminal | task).alias("result_summary"),
        last("tool_uses", terminal).alias("tool_uses"),
        last("entry_id", started).alias("start_entry_id"),
        last("parent_id", started).alias("start_parent_id"),
        last("entry_id", linked).alias("linked_entry_id"),
        last("entry_id", terminal).alias("terminal_entry_id"),
        last("parent_id", terminal).alias("terminal_parent_id"),
    )


def link_messages(messages: DataFrame, events: DataFrame) -> DataFrame:
    """messages with activity_id and activity_role of the events whose parent entry they are.

    The last message of an entry in its source gets the role ('start' for started events) of the first such event,
    unless it already has both. messages: source_path, entry_id, seq, activity_id, activity_role, any other columns.
    """
    first = (
        events.where(F.col("parent_id") != "")
        .groupBy("source_path", F.col("parent_id").alias("entry_id"))
        .agg(F.min(F.struct("ord", F.col("activity_id").alias("a"), F.when(F.col("kind") == "started", "start").otherwise(F.col("kind")).alias("r"))).alias("__e"))
    )
    last = messages.groupBy("source_path", "entry_id").agg(F.max("seq").alias("seq"))
    marks = first.join(last, ["source_path", "entry_id"]).select("seq", F.col("__e.a").alias("__a"), F.col("__e.r").alias("__r"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    free = F.col("__a").isNotNull() & (blank("activity_id") | blank("activity_role"))
    joined = messages.join(marks, "seq", "left")
    return joined.withColumns({"activity_id": F.when(free, F.col("__a")).otherwise(F.col("activity_id")), "activity_role": F.when(free, F.col("__r")).otherwise(F.col("activity_role"))}).select(messages.columns)


def reconcile_attached(sessions: DataFrame, activities: DataFrame) -> DataFrame:
    """activities, with one running activity for every attached session with a parent that no activity names as child.

    The new activity is named by the session's id and belongs to the parent's source path; ids that exist are left alone,
    and of several files of one session the first by path counts.
    """
    orphan = (
        sessions.where((F.col("visibility") == "attached") & (F.coalesce("parent_session", F.lit("")) != "") & (F.coalesce("session_id", F.lit("")) != ""))
        .join(activities.select(F.col("child_session_path").alias("source_path")).where(F.col("source_path").isNotNull()), "source_path", "left_anti")
        .join(activities.select(F.col("activity_id").alias("session_id")), "session_id", "left_anti")
        .groupBy("session_id")
        .agg(F.min(F.struct("source_path", "parent_session")).alias("s"))
        .select("session_id", "s.source_path", "s.parent_session")
    )
    new = {"activity_id": F.col("session_id"), "record_source_path": F.col("source_path"), "parent_source_path": F.col("parent_session"), "child_session_path": F.col("source_path"), "status": F.lit("running")}
    cols = [(new.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in activities.schema.fields]
    return activities.unionByName(orphan.select(*cols))
