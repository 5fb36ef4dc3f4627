"""Queries over ingest: transcripts are written from the tables, read by the parsers, and compared with the tables again.

The files hold 512 lines' rows each and exist as rows of (path, content), as a listing of real files gives them.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema as S
from skein.functions.shape import within_budget
from skein.operators import retrieve as R
from skein.operators import secrets
from skein.operators.linking import fold_activities
from skein.plans.retrieval import NOW_MS, _busiest
from skein.plans.secrets import _count
from skein.session import scratch
from skein.sources.lines import REQUEST_MARK
from skein.sources.tables import table
from skein.sources.transcripts import changed, discover, one_child_owner, parse, unique_ids

PART = 512
#: The time of all activity events.
EVENT_MS = 1_750_000_000_000


def _iso(c: str) -> Column:
    return F.date_format(F.timestamp_millis(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _files(lines: DataFrame) -> DataFrame:
    """(path, content) of lines (part, place, line, line): a file holds the lines of one part, PART rows at most."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "lines"))), lambda x: x["lines"]), "\n")
    return lines.groupBy("part").agg(body.alias("body")).select(F.concat(F.lit("/t/"), "part", F.lit(".jsonl")).alias("path"), F.encode("body", "utf-8").alias("content"))


def _messages(spark: SparkSession, directory: str) -> DataFrame:
    m = table(spark, directory, "messages", "seq", "entry_id", "session_id", "ts_ms", "type", "prose").where(F.col("ts_ms").isNotNull() & (F.coalesce("entry_id", F.lit("")) != ""))
    return m.withColumns({"part": F.concat(F.lit("part-"), F.floor(F.col("seq") / PART).cast("string")), "n": F.col("seq").cast("string"), "at": _iso("ts_ms"), "said": F.concat(F.lit("["), F.col("seq").cast("string"), F.lit(" "), F.coalesce("prose", F.lit("")), F.lit("]"))})


def _parsed(files: DataFrame) -> DataFrame:
    m = parse(files).where(F.col("message").isNotNull()).select("source_path", "message.*")
    call, result = F.get("tool_calls", F.lit(0)), F.get("tool_results", F.lit(0))
    return m.select(
        F.col("source_path").alias("path"), "id", "session_id", "ts_ms", "type", "content", "prose", call["id"].alias("call_id"), call["name"].alias("call_name"), call["arguments"].alias("call_arguments"),
        result["id"].alias("result_of"), result["name"].alias("result_name"), result["content"].alias("result_content"), result["is_error"].alias("is_error"),
    )


def _plain_lines(spark: SparkSession, directory: str) -> DataFrame:
    m, k = _messages(spark, directory), F.col("seq") % 4
    s = lambda c: F.col(c) if c in ("said", "n") else F.lit(c)
    say = F.struct(F.lit("text").alias("type"), F.col("said").alias("text"))
    head = [F.col("entry_id").alias("uuid"), F.col("session_id").alias("sessionId"), F.col("at").alias("timestamp")]
    record = lambda kind, role, content, *more: F.to_json(F.struct(kind.alias("type"), *head, F.struct(role.alias("role"), content.alias("content"), *more).alias("message")))
    use = F.array(
        F.struct(s("text").alias("type"), s("said").alias("text"), F.lit(None).cast("string").alias("thinking"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<n:bigint>").alias("input")),
        F.struct(s("thinking").alias("type"), F.lit(None).cast("string").alias("text"), s("hm").alias("thinking"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<n:bigint>").alias("input")),
        F.struct(s("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("thinking"), _text("t", F.col("n")).alias("id"), s("Run").alias("name"), F.struct(F.col("seq").alias("n")).alias("input")),
    )
    result = F.array(F.struct(s("tool_result").alias("type"), _text("t", F.col("n")).alias("tool_use_id"), F.array(say).alias("content"), F.lit(True).alias("is_error")))
    line = (
        F.when(k == 0, record(F.col("type"), F.col("type"), F.col("said")))
        .when(k == 1, record(F.col("type"), F.col("type"), use))
        .when(k == 2, record(F.lit("message"), F.lit("toolResult"), F.array(say), _text("t", F.col("n")).alias("toolCallId"), F.lit("Run").alias("toolName")))
        .otherwise(record(F.lit("user"), F.lit("user"), result))
    )
    broken = F.when(F.col("seq") % 10 == 5, F.lit('{"type": "user", "message"\n{"type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "no id"}}\n{"type": 7, "uuid": "x"}\n')).otherwise("")
    return m.select("part", F.col("seq").alias("place"), F.concat(broken, line).alias("lines"))


def ingest_plain(spark, directory):
    """Messages in the plain and the header envelope, with broken lines between them."""
    return _parsed(_files(_plain_lines(spark, directory)))


def _write_files(folder: str):
    """Files to a folder that all tasks share, by their number plain, packed, or both, the packed one then being empty; what was written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                name = os.path.basename(path)
                n = int(name.removeprefix("part-").removesuffix(".jsonl"))
                place = os.path.join(folder, f"d{n % 5}")
                os.makedirs(place, exist_ok=True)
                for suffix, data in ((("", content),), ((".zst", zstandard.compress(content)),), (("", content), (".zst", zstandard.compress(b""))))[n % 3]:
                    with open(os.path.join(place, name + suffix), "wb") as f:
                        f.write(data)
                with open(os.path.join(place, name + ".txt"), "wb") as f:
                    f.write(b"no transcript")
            yield b[["path"]]

    return run


def ingest_files(spark, directory):
    """(what, name, messages): real files in folders, plain and packed, found and read; those of session 3; those that a listing of the even ones lacks.

    The shared folder must be a file system that tasks see as files.
    """
    folder = scratch(spark, "transcripts").removeprefix("file://")
    _files(_plain_lines(spark, directory)).mapInPandas(_write_files(folder), "path string").write.format("noop").mode("overwrite").save()
    listed = discover(spark, [folder, folder + "/missing"])
    name, number = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    read = parse(listed).where(F.col("message").isNotNull()).groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("messages"))
    one = discover(spark, [folder], session="3")
    new = changed(listed, listed.where(number % 2 == 0).select("path", "mtime_ms", "size"))
    row = lambda what, df, n: df.select(F.lit(what).alias("what"), name.alias("name"), n.alias("messages"))
    none = F.lit(0).cast("bigint")
    return row("read", read, F.col("messages")).unionByName(row("session", one, none)).unionByName(row("changed", new, none))


def _call_line(n: Column, at: Column) -> Column:
    return _text('{"type":"response_item","timestamp":"', at, '","payload":{"type":"function_call","call_id":"c', n, '","name":"Run","arguments":"{\\"n\\":', n, '}"}}')


def ingest_rollout(spark, directory):
    """Messages in the rollout envelope, with mirrored events, prefixed requests, calls without ids and failed results."""
    m, k = _messages(spark, directory), F.col("seq") % 4
    item = lambda payload, *more: F.to_json(F.struct(F.lit("response_item").alias("type"), F.col("at").alias("timestamp"), payload.alias("payload"), *more))
    event = lambda kind, *more: F.to_json(F.struct(F.lit("event_msg").alias("type"), F.col("at").alias("timestamp"), F.struct(F.lit(kind).alias("type"), F.col("said").alias("message")).alias("payload"), *more))
    spoken = lambda role, text: F.struct(F.lit("message").alias("type"), F.lit(role).alias("role"), _text("m-", F.col("n")).alias("id"), F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text"))).alias("content"))
    output = F.struct(F.lit("function_call_output").alias("type"), _text("m-", F.col("n")).alias("id"), _text("c", (F.col("seq") - 1).cast("string")).alias("call_id"), F.col("said").alias("output"), F.lit(False).alias("success"))
    lines = (
        F.when(k == 0, F.concat_ws("\n", item(spoken("user", _text("before\n" + REQUEST_MARK + "\n", F.col("said")))), event("user_message")))
        .when(k == 1, F.concat_ws("\n", event("agent_message", _text("ev-", F.col("n")).alias("id")), item(spoken("assistant", F.col("said")))))
        .when(k == 2, _call_line(F.col("n"), F.col("at")))
        .otherwise(item(output))
    )
    meta = m.select("part").distinct().select("part", F.lit(-1).cast("bigint").alias("place"), _text('{"type":"session_meta","payload":{"cwd":"/w","id":"s-', F.col("part"), '"}}').alias("lines"))
    return _parsed(_files(m.select("part", F.col("seq").alias("place"), lines.alias("lines")).unionByName(meta)))


_FOLDED = ["activity_id", "parent_source_path", "parent_session_id", "parent_activity_id", "child_session_path", "status", "started_at", "completed_at", "kind", "namespace", "title", "description", "model", "effort", "result_summary", "tool_uses", "start_entry_id", "start_parent_id", "linked_entry_id", "terminal_entry_id"]


def ingest_activities(spark, directory):
    """Activities from their started, linked and terminal events; of those that name one child the last started stays."""
    a = table(spark, directory, "activities").where(F.coalesce("activity_id", F.lit("")) != "")
    a = a.withColumn("part", F.concat(F.lit("act-"), F.substring(F.sha2("activity_id", 256), 1, 3)))
    at = F.lit(EVENT_MS)

    def event(name: str, **data: Column) -> Column:
        fields = F.struct(*(v.alias(k) for k, v in {"activityId": F.col("activity_id"), **data}.items()))
        return F.to_json(F.struct(F.lit("custom").alias("type"), F.lit(f"pi:activity-{name}").alias("customType"), _text(f"{name}-", F.col("activity_id")).alias("id"), F.lit("" if name == "linked" else "p").alias("parentId"), F.date_format(F.timestamp_millis(at), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), fields.alias("data")))

    c = F.col
    lines = F.concat_ws(
        "\n",
        event("started", parentActivityId=c("parent_activity_id"), status=F.lit("running"), title=c("title"), description=c("description"), kind=c("kind"), namespace=c("namespace"), model=c("model"), effort=c("effort"), startedAt=c("started_at")),
        event("linked", sessionFile=c("child_session_path")),
        event("terminal", status=c("status"), completedAt=c("completed_at"), toolUses=c("tool_uses"), resultSummary=c("result_summary")),
    )
    parsed = parse(_files(a.select("part", F.col("activity_id").alias("place"), lines.alias("lines"))))
    own = parsed.where(F.col("session").isNotNull()).select("source_path", "session.session_id")
    events = parsed.where(F.col("event").isNotNull()).select("source_path", "event.*").join(own, "source_path").withColumn("ord", F.col("n").cast("bigint"))
    return one_child_owner(fold_activities(events.select([f.name for f in S.parse(S.EVENTS).fields]))).select(*_FOLDED)


def ingest_unique_ids(spark, directory):
    """Ids made unique: the first delivery keeps its own."""
    m = table(spark, directory, "messages", "id", "seq", "source_path").where(F.col("source_path").isNotNull())
    return unique_ids(m).select("seq", "id")


#: One secret of each kind and none, planted in turn.
PLANTED = (
    "-----BEGIN RSA PRIVATE KEY-----x-----END RSA PRIVATE KEY-----", "bearer abcdefghijklmnop", "postgres://user:pa55word@host/db", "ghp_" + "a" * 24, "eyJhbGciOiJ9.eyJzdWIiOiIx.abcdefgh12",
    "x-api-key: abcdef", "password = hunter2hunter2", "https://x/?token=%2F%2F%2F%2F", "nothing",
)


def planted_secrets(spark, directory):
    """(kind, rows, matches, left): matches and characters left by the kind of secret planted in every message."""
    m = table(spark, directory, "messages", "seq", "content").select((F.col("seq") % len(PLANTED)).cast("int").alias("kind"), "content")
    m = m.select("kind", F.concat(F.coalesce("content", F.lit("")), F.lit(" "), F.element_at(F.array(*map(F.lit, PLANTED)), F.col("kind") + 1)).alias("text"))
    return secrets.scrub(m, "text").groupBy("kind").agg(F.count("*").alias("rows"), F.sum("matches").alias("matches"), F.sum(F.length("clean")).cast("bigint").alias("left"))


def page_within_budget(spark, directory):
    """The newest whole messages that fit into 60,000 characters."""
    page = R.last(R.Corpus(spark, directory), 200).select("seq", "ts_ms", F.length(F.coalesce("content", F.lit(""))).cast("bigint").alias("size"))
    ranked = page.withColumn("rank", F.struct(F.coalesce(-F.col("ts_ms"), F.lit(0)), -F.col("seq")))
    return within_budget(ranked, "rank", "size", 60_000).select("seq", "allowance")


def last_of_session(spark, directory):
    """The newest messages of the busiest session."""
    return R.last(R.Corpus(spark, directory), 60, R.Scope(session=_busiest(spark, directory)), NOW_MS).select("seq", "session_id", "ts_ms")


def search_relaxed(spark, directory):
    """No message holds both words, so those of any come."""
    return R.search_relaxed(R.Corpus(spark, directory), R.SearchOptions("bisect zzznothing", 30), NOW_MS)[0].select("rank", "seq")


def read_by_prefix(spark, directory):
    """A message named by the beginning of its id, with its neighbours."""
    c = R.Corpus(spark, directory)
    one = c.messages.groupBy("id").agg(F.count("*").alias("n"), F.max("ts_ms").alias("t")).where((F.col("n") == 1) & (F.length("id") > 30)).orderBy(F.desc("t"), "id").first().id
    return R.around(c, one[:-1].upper(), 2, 2).select("session_id", "seq", "ts_ms")


def activities_of_session(spark, directory):
    """The activities of the session that most activities name as parent."""
    c = R.Corpus(spark, directory)
    busy = c.activities.where("parent_session_id <> ''").groupBy("parent_session_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "parent_session_id").first().parent_session_id
    return R.activities(c, 0, session=busy).select("activity_id", "parent_session_id", "child_session_id")


def activity_by_prefix(spark, directory):
    """The activity with the largest id, named by its beginning."""
    c = R.Corpus(spark, directory)
    return R.activity(c, c.activities.agg(F.max("activity_id")).first()[0][:-1].upper()).select("activity_id", "status")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (ingest_plain, ingest_files, ingest_rollout, ingest_activities, ingest_unique_ids, planted_secrets, page_within_budget, last_of_session, search_relaxed, read_by_prefix, activities_of_session, activity_by_prefix)
}

_ROWS = f"""m AS (SELECT *, 'part-' || CAST(seq // {PART} AS VARCHAR) AS part, '[' || seq || ' ' || coalesce(prose, '') || ']' AS said, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso,
  coalesce(nullif(session_id, ''), first_value(nullif(session_id, '') IGNORE NULLS) OVER (PARTITION BY seq // {PART} ORDER BY seq ROWS UNBOUNDED PRECEDING), 'part-' || CAST(seq // {PART} AS VARCHAR)) AS own
  FROM messages WHERE ts_ms IS NOT NULL AND coalesce(entry_id, '') <> '')"""
_DOLLAR = "list_value(" + ", ".join("'" + s.replace("'", "''") + "'" for s in PLANTED) + ")"
_BUSY = "(SELECT session_id FROM messages WHERE session_id <> '' GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 1)"


def _clean(col: str) -> str:
    text = col
    for _, pattern, new, over in secrets.PATTERNS:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return text


SQL = {
    "ingest_plain": f"""WITH {_ROWS} SELECT '/t/' || part || '.jsonl' AS path, CASE WHEN own = part THEN entry_id ELSE own || ':' || entry_id END AS id, own AS session_id, ts_ms,
CASE seq % 4 WHEN 2 THEN 'toolResult' WHEN 3 THEN 'user' ELSE coalesce(type, '') END AS type, CASE WHEN seq % 4 = 1 THEN said || chr(10) || 'hm' || chr(10) || '[tool: Run] {{"n":' || seq || '}}' ELSE said END AS content,
CASE WHEN seq % 4 < 2 AND coalesce(type, '') <> 'toolResult' THEN said ELSE '' END AS prose, CASE WHEN seq % 4 = 1 THEN 't' || seq END AS call_id, CASE WHEN seq % 4 = 1 THEN 'Run' END AS call_name, CASE WHEN seq % 4 = 1 THEN '{{"n":' || seq || '}}' END AS call_arguments,
CASE WHEN seq % 4 > 1 THEN 't' || seq END AS result_of, CASE seq % 4 WHEN 2 THEN 'Run' WHEN 3 THEN '' END AS result_name, CASE WHEN seq % 4 > 1 THEN said END AS result_content, CASE seq % 4 WHEN 2 THEN false WHEN 3 THEN true END AS is_error FROM m""",
    "ingest_files": f"""WITH p AS (SELECT seq // {PART} AS n, count(*) AS c FROM messages WHERE ts_ms IS NOT NULL AND coalesce(entry_id, '') <> '' GROUP BY 1),
f AS (SELECT n, c, 'part-' || n || CASE WHEN n % 3 = 1 THEN '.jsonl.zst' ELSE '.jsonl' END AS name FROM p)
SELECT 'read' AS what, name, c AS messages FROM f UNION ALL SELECT 'session', name, 0 FROM f WHERE n = 3 UNION ALL SELECT 'changed', name, 0 FROM f WHERE n % 2 = 1""",
    "ingest_rollout": f"""WITH {_ROWS} SELECT '/t/' || part || '.jsonl' AS path,
CASE seq % 4 WHEN 1 THEN 'ev-' || seq WHEN 2 THEN 'codex-' || sha256('{{"type":"response_item","timestamp":"' || iso || '","payload":{{"type":"function_call","call_id":"c' || seq || '","name":"Run","arguments":"{{\\"n\\":' || seq || '}}"}}}}') ELSE 'm-' || seq END AS id,
's-' || part AS session_id, ts_ms, CASE WHEN seq % 4 = 0 THEN 'user' ELSE 'assistant' END AS type, CASE seq % 4 WHEN 0 THEN 'before' || chr(10) || '{REQUEST_MARK}' || chr(10) || said WHEN 2 THEN '[tool: Run] {{"n":' || seq || '}}' ELSE said END AS content,
CASE WHEN seq % 4 < 2 THEN said ELSE '' END AS prose, CASE WHEN seq % 4 = 2 THEN 'c' || seq END AS call_id, CASE WHEN seq % 4 = 2 THEN 'Run' END AS call_name, CASE WHEN seq % 4 = 2 THEN '{{"n":' || seq || '}}' END AS call_arguments,
CASE WHEN seq % 4 = 3 THEN 'c' || (seq - 1) END AS result_of, CASE WHEN seq % 4 = 3 THEN '' END AS result_name, CASE WHEN seq % 4 = 3 THEN said END AS result_content, CASE WHEN seq % 4 = 3 THEN true END AS is_error FROM m""",
    "ingest_activities": f"""WITH a AS (SELECT activity_id, '/t/act-' || left(sha256(activity_id), 3) || '.jsonl' AS parent_source_path, 'act-' || left(sha256(activity_id), 3) AS parent_session_id, nullif(parent_activity_id, '') AS parent_activity_id, nullif(child_session_path, '') AS child_session_path,
coalesce(status, '') AS status, coalesce(nullif(started_at, 0), {EVENT_MS}) AS started_at, coalesce(nullif(completed_at, 0), {EVENT_MS}) AS completed_at, coalesce(kind, '') AS kind, coalesce(namespace, '') AS namespace, coalesce(title, '') AS title, coalesce(description, '') AS description,
coalesce(model, '') AS model, coalesce(effort, '') AS effort, coalesce(result_summary, '') AS result_summary, coalesce(tool_uses, 0) AS tool_uses, 'started-' || activity_id AS start_entry_id, 'p' AS start_parent_id, 'linked-' || activity_id AS linked_entry_id, 'terminal-' || activity_id AS terminal_entry_id
FROM activities WHERE coalesce(activity_id, '') <> '')
SELECT * FROM a QUALIFY child_session_path IS NULL OR row_number() OVER (PARTITION BY child_session_path ORDER BY started_at DESC, activity_id DESC) = 1""",
    "ingest_unique_ids": """WITH m AS (SELECT seq, coalesce(nullif(id, ''), 'message') AS id, source_path, min(seq) OVER (PARTITION BY coalesce(nullif(id, ''), 'message')) AS f FROM messages WHERE source_path IS NOT NULL),
k AS (SELECT seq, row_number() OVER (PARTITION BY id, source_path ORDER BY seq) AS k FROM m WHERE seq <> f)
SELECT m.seq, CASE WHEN m.seq = f THEN id ELSE id || ':' || left(sha256(source_path), 12) || CASE WHEN k > 1 THEN ':' || k ELSE '' END END AS id FROM m LEFT JOIN k ON k.seq = m.seq""",
    "planted_secrets": f"""WITH t AS (SELECT (seq % {len(PLANTED)})::INT AS kind, coalesce(content, '') || ' ' || ({_DOLLAR})[seq % {len(PLANTED)} + 1] AS text FROM messages)
SELECT kind, count(*) AS rows, sum({_count('text')})::BIGINT AS matches, sum(length({_clean('text')}))::BIGINT AS "left" FROM t GROUP BY 1""",
    "page_within_budget": """WITH p AS (SELECT seq, length(coalesce(content, ''))::BIGINT AS size, row_number() OVER w AS r FROM messages WINDOW w AS (ORDER BY ts_ms DESC NULLS LAST, seq DESC) QUALIFY r <= 200),
s AS (SELECT *, sum(size) OVER (ORDER BY r) AS spent FROM p) SELECT seq, least(size, 60000) AS allowance FROM s WHERE spent <= 60000 OR r = 1""",
    "last_of_session": f"SELECT seq, session_id, ts_ms FROM messages WHERE session_id = {_BUSY} ORDER BY ts_ms DESC NULLS LAST, seq DESC LIMIT 60",
    "activities_of_session": """WITH own AS (SELECT source_path AS path, min(session_id) AS sid FROM sessions GROUP BY 1), b AS (SELECT parent_session_id AS s FROM activities WHERE parent_session_id <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT activity_id, coalesce(nullif(parent_session_id, ''), p.sid, nullif(parent_source_path, ''), '') AS parent_session_id, coalesce(c.sid, '') AS child_session_id FROM activities a LEFT JOIN own p ON p.path = a.parent_source_path LEFT JOIN own c ON c.path = a.child_session_path
WHERE coalesce(nullif(parent_session_id, ''), p.sid) = (SELECT s FROM b) OR c.sid = (SELECT s FROM b)""",
    "activity_by_prefix": "SELECT activity_id, coalesce(status, '') AS status FROM activities WHERE activity_id = (SELECT max(activity_id) FROM activities)",
}


def _also_searches() -> None:
    """SQL that is built from that of the searches."""
    from skein.plans import retrieval as T

    SQL["search_relaxed"] = T._rank([T._has("pt", "bisect"), T._has("pt", "zzznothing")], f"{T._PROSE} AND ({T._has('pt', 'bisect')} > 0 OR {T._has('pt', 'zzznothing')} > 0)", 30, out="rank, seq")
    SQL["read_by_prefix"] = f"WITH hits AS (SELECT session_id, seq, ts_ms FROM messages WHERE id = (SELECT id FROM messages WHERE length(id) > 30 GROUP BY 1 HAVING count(*) = 1 ORDER BY max(ts_ms) DESC NULLS LAST, id LIMIT 1)), {T._NEAREST.format('TRUE', 2, 2)} SELECT session_id, seq, ts_ms FROM kept"


_also_searches()
