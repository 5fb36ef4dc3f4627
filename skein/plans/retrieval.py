"""Retrieval, linking and projection queries over the derived tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import iso_seconds, prefix, preview
from skein.operators import linking, retrieve as R
from skein.session import scratch
from skein.sources.index import build_index
from skein.sources.tables import table

#: The present, for all queries: 2026-06-01.
NOW_MS = 1_780_272_000_000


def _c(spark: SparkSession, directory: str, stemming: bool = False) -> R.Corpus:
    return R.Corpus(spark, directory, stemming)


def _busiest(spark: SparkSession, directory: str) -> str:
    """The session with most messages, the smallest id among equals."""
    return table(spark, directory, "messages", "session_id").where("session_id <> ''").groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session_id").first().session_id


def last_messages(spark, directory):
    return R.last(_c(spark, directory), 50).select("seq", "id", "session_id", "ts_ms", "type", preview("content", 200).alias("preview"))


def last_prose_of_type(spark, directory):
    scope = R.Scope(type="assistant", prose_only=True, hours=24 * 90)
    return R.last(_c(spark, directory), 100, scope, NOW_MS).select("seq", "ts_ms", prefix("prose").alias("prose_prefix"))


def last_of_cwd(spark, directory):
    return R.last(_c(spark, directory), 0, R.Scope(cwd="/work/tidepool"), NOW_MS).select("seq", "source_path", "ts_ms")


def last_excluding(spark, directory):
    return R.last(_c(spark, directory), 40, R.Scope(exclude=_busiest(spark, directory)), NOW_MS).select("seq", "session_id", "ts_ms")


def _page(df: DataFrame) -> DataFrame:
    return df.select("rank", "seq", F.round("score", 6).alias("score"))


def search_all_terms(spark, directory):
    return _page(R.search(_c(spark, directory), R.SearchOptions("router window", 30), NOW_MS))


#: The index of each directory that an application has built.
_built: dict[tuple[str, str], str] = {}


def _indexed(spark: SparkSession, directory: str) -> R.Corpus:
    """The directory's corpus with an index of plain words, in the shared folder; it goes when the application ends."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _built:
        folder = scratch(spark, "index")
        build_index(spark, directory, folder, stemming=False)
        _built[key] = folder
    return R.Corpus(spark, _built[key])


def indexed_search(spark, directory):
    """search_all_terms over postings and stored words."""
    return _page(R.search(_indexed(spark, directory), R.SearchOptions("router window", 30), NOW_MS))


def indexed_command_search(spark, directory):
    """command_search over stored command documents."""
    return R.commands(_indexed(spark, directory), "make walker", limit=50).select("invocation_id", "message_id", "ts_ms", F.length("output").alias("output_chars"))


def indexed_session_list(spark, directory):
    """session_list over stored source projections."""
    return R.sessions(_indexed(spark, directory), limit=100)


def search_any_term(spark, directory):
    return _page(R.search(_c(spark, directory), R.SearchOptions("bisect quillback", 30, any=True), NOW_MS))


def search_phrase(spark, directory):
    """A term of several words is a phrase whose last word is a prefix."""
    return _page(R.search(_c(spark, directory), R.SearchOptions("reads-twice", 25), NOW_MS))


def search_everything(spark, directory):
    """Over content as well, so tool traffic is found too."""
    return _page(R.search(_c(spark, directory), R.SearchOptions("scheduler", 25, scope=R.Scope()), NOW_MS))


def search_per_session(spark, directory):
    return _page(R.search(_c(spark, directory), R.SearchOptions("loader", 30, per_session=2), NOW_MS))


def search_window(spark, directory):
    return _page(R.search(_c(spark, directory), R.SearchOptions("parser", 30, window=1000), NOW_MS))


def search_raw(spark, directory):
    return _page(R.search(_c(spark, directory), R.SearchOptions('ranker AND ("reads twice" OR bisect) NOT prose : watcher', 30, raw=True), NOW_MS))


def search_near(spark, directory):
    return _page(R.search(_c(spark, directory), R.SearchOptions("NEAR(cache flag, 6)", 30, raw=True, scope=R.Scope()), NOW_MS))


def search_noise(spark, directory):
    hits = R.search(_c(spark, directory), R.SearchOptions("limit", 30, reduce_noise=True), NOW_MS)
    return hits.select("rank", "seq", "noise")


def search_stemmed(spark, directory):
    """With Porter stems: 'building' finds 'builds'."""
    return _page(R.search(_c(spark, directory, True), R.SearchOptions("building agreed", 30, any=True), NOW_MS))


def search_inflected(spark, directory):
    """Inflected words by their stems: both are beginnings of all their forms, which SQL can look for."""
    return _page(R.search(_c(spark, directory, stemming=True), R.SearchOptions("routers windowing", 30), NOW_MS))


def search_context(spark, directory):
    c = _c(spark, directory)
    hits = R.search(c, R.SearchOptions("bisect", 5), NOW_MS)
    return R.context(c, hits, 3, 8).select("session_id", "seq", "ts_ms", F.array_join("hit_ids", "|").alias("hit_ids"))


def read_around(spark, directory):
    """The neighbours of the newest message whose id is unique."""
    c = _c(spark, directory)
    one = c.messages.groupBy("id").agg(F.count("*").alias("n"), F.max("ts_ms").alias("t")).where("n = 1").orderBy(F.desc("t"), "id").first().id
    return R.around(c, one, 6, 6).select("session_id", "seq", "ts_ms")


def session_list(spark, directory):
    return R.sessions(_c(spark, directory), limit=100)


def session_search(spark, directory):
    return R.sessions(_c(spark, directory), query="quillback builds", limit=0, exclude="none").select("source_path", "session_id", "message_count")


def activity_list(spark, directory):
    return R.activities(_c(spark, directory), limit=100).select("activity_id", "status", "kind", "started_at", "completed_at", "tool_uses", "parent_session_id", "child_session_id", iso_seconds("started_at").alias("started"))


def activity_status(spark, directory):
    return R.activities(_c(spark, directory), limit=0, status="COMPLETED").select("activity_id", "status", "title")


def message_lineage(spark, directory):
    c = _c(spark, directory)
    return R.lineage(c, c.messages.select("seq", "source_path", "activity_id", "activity_role")).where("activity_id <> ''").select("seq", "activity_id", "activity_role", "parent_activity_id", "parent_session_id", "child_session_id")


def command_list(spark, directory):
    return R.commands(_c(spark, directory), limit=100, tool="bash").select("invocation_id", "tool", "arguments", "session_id", "ts_ms")


def command_search(spark, directory):
    return R.commands(_c(spark, directory), query="make walker", limit=50).select("invocation_id", "message_id", "ts_ms", F.length("output").alias("output_chars"))


def command_output_search(spark, directory):
    return R.commands(_c(spark, directory), query="FAIL web/queue", match="output", limit=50, outputs=False).select("invocation_id", "ts_ms")


def table_counts(spark, directory):
    return R.info(_c(spark, directory))


def source_counts(spark, directory):
    return R.info_sources(_c(spark, directory))


def source_projections(spark, directory):
    return R.source_projection(table(spark, directory, "messages", "source_path", "seq", "id", "ts_ms", "content", "prose"))


def message_prefixes(spark, directory):
    m = table(spark, directory, "messages", "seq", "content", "prose")
    return m.select("seq", prefix("content").alias("content_prefix"), prefix("prose").alias("prose_prefix"), F.octet_length("content").cast("bigint").alias("content_bytes"), F.octet_length("prose").cast("bigint").alias("prose_bytes"))


def tool_pairs_by_id(spark, directory):
    calls = table(spark, directory, "tool_invocations", "invocation_id", "session_id", "tool_id", "ts_ms")
    results = table(spark, directory, "tool_results", "result_id", "session_id", "tool_id", "ts_ms")
    return linking.pair_by_id(calls, results)


def tool_pairs_greedy(spark, directory):
    calls = table(spark, directory, "tool_invocations", "invocation_id", "session_id", "tool_id", "tool_name", "ts_ms")
    results = table(spark, directory, "tool_results", "result_id", "session_id", "tool_id", "tool_name", "ts_ms")
    return linking.pair_greedily(calls, results)


def attached_activities(spark, directory):
    out = linking.reconcile_attached(table(spark, directory, "sessions"), table(spark, directory, "activities"))
    return out.select("activity_id", "parent_source_path", "child_session_path", "status")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        last_messages, last_prose_of_type, last_of_cwd, last_excluding, search_all_terms, indexed_search, indexed_command_search, indexed_session_list, search_any_term, search_phrase, search_everything, search_per_session,
        search_window, search_raw, search_near, search_noise, search_stemmed, search_inflected, search_context, read_around, session_list, session_search, activity_list, activity_status,
        message_lineage, command_list, command_search, command_output_search, table_counts, source_counts, source_projections, message_prefixes, tool_pairs_by_id, tool_pairs_greedy, attached_activities,
    )
}

_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_FLAT = r"trim(regexp_replace({0}, '[\s\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"


def _pre(c: str) -> str:
    return f"left({_FLAT.format(c)}, 514)"


_DOCS = f"WITH docs AS (SELECT *, {_TOK.format('content')} AS ct, {_TOK.format('prose')} AS pt, len({_TOK.format('content')}) + len({_TOK.format('prose')}) AS d FROM messages), all_ AS (SELECT count(*) AS n, avg(d) AS mean FROM docs)"


def _has(field: str, word: str) -> str:
    return f"len(list_filter({field}, lambda x: starts_with(x, '{word}')))"


def _rank(leaves: list[str], where: str, limit: int, order: str = "", extra: str = "", out: str = "rank, seq, round(score, 6) AS score", joins: str = "") -> str:
    """A ranked search in SQL: leaves are the counts of each phrase in a document, where the condition of a hit."""
    stats = ", ".join(f"sum(({e} > 0)::INT) AS n{i}" for i, e in enumerate(leaves))
    score = " - ".join(f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / mean))" for i in range(len(leaves)))
    counts = ", ".join(f"({e})::DOUBLE AS f{i}" for i, e in enumerate(leaves))
    full = f"{order}score, ts_ms DESC NULLS LAST, seq DESC"
    return f"""{_DOCS}, st AS (SELECT {stats} FROM docs), hit AS (SELECT docs.*, {counts} FROM docs {joins} WHERE {where}),
sc AS (SELECT hit.*, -({score.replace(' - (CASE', ' + (CASE')}) AS score{extra} FROM hit, st, all_)
SELECT {out} FROM (SELECT *, row_number() OVER (ORDER BY {full}) AS rank FROM sc) WHERE rank <= {limit}"""


def _bigram(field: str, a: str, b: str) -> str:
    """Instances of a two-word phrase whose second word is a prefix."""
    return f"len(list_filter(range(1, len({field})), lambda i: {field}[i] = '{a}' AND starts_with({field}[i + 1], '{b}')))"


def _exact(field: str, word: str) -> str:
    return f"len(list_filter({field}, lambda x: x = '{word}'))"


def _bigram_exact(field: str, a: str, b: str) -> str:
    return f"len(list_filter(range(1, len({field})), lambda i: {field}[i] = '{a}' AND {field}[i + 1] = '{b}'))"


_NOISE = f"""CASE WHEN p LIKE '---%' AND p LIKE '%name:%' AND p LIKE '%description:%' OR p LIKE '%"results"%' AND p LIKE '%"budget"%' AND p LIKE '%"relaxed"%'
OR p LIKE '{{"results":%' AND p LIKE '%"sessionid":%' AND p LIKE '%"id":%' OR p LIKE '{{"commands":%' AND p LIKE '%"messageid":%' AND p LIKE '%"tool":%' THEN 1 ELSE 0 END""".replace("p LIKE", f"lower(coalesce({_pre('content')}, '') || ' ' || coalesce({_pre('prose')}, '')) LIKE")

_PROSE = "coalesce(prose, '') <> ''"
_HITS5 = _rank([_has("pt", "bisect")], f"{_PROSE} AND f0 > 0".replace("f0", _has("pt", "bisect")), 5, out="rank, seq, id, session_id, ts_ms")
_NEAREST = """near AS (
  SELECT h.seq AS hit_seq, m.*, CASE WHEN (m.ts_ms, m.seq) <= (h.ts_ms, h.seq) THEN 0 ELSE 1 END AS side FROM hits h JOIN messages m ON m.session_id = h.session_id WHERE m.seq = h.seq OR {0}),
kept AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY hit_seq, side ORDER BY CASE WHEN side = 0 THEN -ts_ms ELSE ts_ms END, CASE WHEN side = 0 THEN -seq ELSE seq END) <= CASE WHEN side = 0 THEN {1} + 1 ELSE {2} END AND ts_ms IS NOT NULL)"""
_TIES = "ORDER BY ts_ms DESC NULLS LAST, seq DESC"
_BUSY = "(SELECT session_id FROM messages WHERE session_id <> '' GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 1)"
_CMD = "EXISTS (SELECT 1 FROM messages m JOIN sessions s ON s.source_path = m.source_path WHERE m.id = i.message_id)"
_OUT = "(SELECT string_agg(content, chr(10) ORDER BY ts_ms NULLS FIRST, result_id) FROM tool_results r WHERE r.invocation_id = i.invocation_id AND content <> '')"
_OWN = "own AS (SELECT source_path AS path, min(session_id) AS sid FROM sessions GROUP BY 1)"

SQL = {
    "last_messages": f"SELECT seq, id, session_id, ts_ms, type, CASE WHEN length({_FLAT.format('content')}) <= 200 THEN {_FLAT.format('content')} ELSE left({_FLAT.format('content')}, 200) || '…' END AS preview FROM messages {_TIES} LIMIT 50",
    "last_prose_of_type": f"SELECT seq, ts_ms, {_pre('prose')} AS prose_prefix FROM messages WHERE type = 'assistant' AND prose <> '' AND ts_ms >= {NOW_MS - 24 * 90 * R.HOUR_MS} {_TIES} LIMIT 100",
    "last_of_cwd": "SELECT seq, source_path, ts_ms FROM messages WHERE source_path IN (SELECT source_path FROM sessions WHERE cwd = '/work/tidepool')",
    "last_excluding": f"SELECT seq, session_id, ts_ms FROM messages WHERE session_id <> {_BUSY} {_TIES} LIMIT 40",
    "search_all_terms": _rank([_has("pt", "router"), _has("pt", "window")], f"{_PROSE} AND {_has('pt', 'router')} > 0 AND {_has('pt', 'window')} > 0", 30),
    "search_any_term": _rank([_has("pt", "bisect"), _has("pt", "quillback")], f"{_PROSE} AND ({_has('pt', 'bisect')} > 0 OR {_has('pt', 'quillback')} > 0)", 30),
    "search_phrase": _rank([_bigram("pt", "reads", "twice")], f"{_PROSE} AND {_bigram('pt', 'reads', 'twice')} > 0", 25),
    "search_everything": _rank([f"{_has('ct', 'scheduler')} + {_has('pt', 'scheduler')}"], f"{_has('ct', 'scheduler')} + {_has('pt', 'scheduler')} > 0", 25),
    "search_per_session": _rank([_has("pt", "loader")], f"{_PROSE} AND {_has('pt', 'loader')} > 0", 30).replace("FROM sc)", "FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score, ts_ms DESC NULLS LAST, seq DESC) <= 2))"),
    "search_window": _rank([_has("pt", "parser")], f"{_PROSE} AND {_has('pt', 'parser')} > 0 AND seq IN (SELECT seq FROM messages {_TIES} LIMIT 1000)", 30),
    "search_raw": _rank([_exact("pt", "ranker"), _bigram_exact("pt", "reads", "twice"), _exact("pt", "bisect")], f"{_PROSE} AND {_exact('pt', 'ranker')} > 0 AND ({_bigram_exact('pt', 'reads', 'twice')} > 0 OR {_exact('pt', 'bisect')} > 0) AND {_exact('pt', 'watcher')} = 0", 30),
    "search_near": _rank(
        [f"{_exact('ct', 'cache')} + {_exact('pt', 'cache')}", f"{_exact('ct', 'flag')} + {_exact('pt', 'flag')}"],
        " OR ".join(f"len(list_filter(range(1, len({f}) + 1), lambda i: {f}[i] IN ('cache', 'flag') AND list_contains({f}[greatest(1, i - 7):i], 'cache') AND list_contains({f}[greatest(1, i - 7):i], 'flag'))) > 0" for f in ("ct", "pt")),
        30,
    ),
    "search_noise": _rank([_has("pt", "limit")], f"{_PROSE} AND {_has('pt', 'limit')} > 0", 30, order="noise, ", extra=f", {_NOISE} AS noise", out="rank, seq, noise"),
    "search_context": f"WITH hits AS ({_HITS5}), {_NEAREST.format(_PROSE.replace('prose', 'm.prose'), 3, 8)} SELECT k.session_id, k.seq, any_value(k.ts_ms) AS ts_ms, string_agg(h.id, '|' ORDER BY h.rank) AS hit_ids FROM kept k JOIN hits h ON h.seq = k.hit_seq GROUP BY ALL",
    "read_around": f"WITH hits AS (SELECT session_id, seq, ts_ms FROM messages WHERE id = (SELECT id FROM messages GROUP BY 1 HAVING count(*) = 1 ORDER BY max(ts_ms) DESC NULLS LAST, id LIMIT 1)), {_NEAREST.format('TRUE', 6, 6)} SELECT session_id, seq, ts_ms FROM kept",
    "session_list": f"""WITH newest AS (SELECT source_path, count(*) AS message_count, nullif(arg_max(CASE WHEN coalesce(prose, '') <> '' THEN prose ELSE coalesce(content, chr(0)) END, row(coalesce(ts_ms, -1), seq)), chr(0)) AS body, max(ts_ms) AS latest_ts_ms FROM messages GROUP BY 1), {_OWN}
SELECT s.source_path, coalesce(s.session_id, '') AS session_id, coalesce(cwd, '') AS cwd, coalesce(visibility, '') AS visibility, coalesce(o.sid, nullif(s.parent_session, ''), '') AS parent, latest_ts_ms, {_pre('body')} AS preview, message_count
FROM sessions s JOIN newest USING (source_path) LEFT JOIN own o ON o.path = s.parent_session ORDER BY latest_ts_ms DESC NULLS LAST, s.session_id, s.source_path LIMIT 100""",
    "session_search": f"""SELECT source_path, coalesce(session_id, '') AS session_id, (SELECT count(*) FROM messages m WHERE m.source_path = s.source_path) AS message_count FROM sessions s WHERE session_id <> 'none'
AND source_path IN (SELECT source_path FROM messages WHERE {_has(_TOK.format('prose'), 'quillback')} > 0 AND {_has(_TOK.format('prose'), 'builds')} > 0)""",
    "activity_list": f"""WITH {_OWN} SELECT activity_id, coalesce(status, '') AS status, coalesce(kind, '') AS kind, coalesce(started_at, 0) AS started_at, coalesce(completed_at, 0) AS completed_at, coalesce(tool_uses, 0) AS tool_uses,
coalesce(nullif(parent_session_id, ''), p.sid, nullif(parent_source_path, ''), '') AS parent_session_id, coalesce(c.sid, '') AS child_session_id, CASE WHEN coalesce(started_at, 0) = 0 THEN '' ELSE strftime(make_timestamp(started_at * 1000), '%Y-%m-%dT%H:%M:%SZ') END AS started
FROM activities a LEFT JOIN own p ON p.path = a.parent_source_path LEFT JOIN own c ON c.path = a.child_session_path ORDER BY coalesce(nullif(a.started_at, 0), a.completed_at) DESC NULLS LAST, activity_id LIMIT 100""",
    "activity_status": "SELECT activity_id, status, coalesce(title, '') AS title FROM activities WHERE lower(status) = 'completed'",
    "message_lineage": f"""WITH {_OWN}, wide AS (SELECT a.*, p.sid AS ps, c.sid AS cs FROM activities a LEFT JOIN own p ON p.path = a.parent_source_path LEFT JOIN own c ON c.path = a.child_session_path),
child AS (SELECT * FROM wide WHERE child_session_path <> '' QUALIFY row_number() OVER (PARTITION BY child_session_path ORDER BY started_at DESC NULLS LAST, activity_id DESC) = 1)
SELECT * FROM (SELECT m.seq, coalesce(nullif(m.activity_id, ''), ch.activity_id, '') AS activity_id, coalesce(nullif(m.activity_role, ''), CASE WHEN ch.activity_id IS NOT NULL THEN 'child' END, '') AS activity_role,
coalesce(nullif(d.parent_activity_id, ''), ch.parent_activity_id, '') AS parent_activity_id, coalesce(nullif(d.parent_session_id, ''), d.ps, nullif(ch.parent_session_id, ''), ch.ps, '') AS parent_session_id, coalesce(d.cs, ch.cs, '') AS child_session_id
FROM messages m LEFT JOIN child ch ON ch.child_session_path = m.source_path LEFT JOIN wide d ON d.activity_id = m.activity_id) WHERE activity_id <> ''""",
    "command_list": f"SELECT invocation_id, tool_name AS tool, arguments, session_id, ts_ms FROM tool_invocations i WHERE lower(tool_name) = 'bash' AND {_CMD} ORDER BY ts_ms DESC NULLS LAST, message_id, invocation_id LIMIT 100",
    "command_search": f"""WITH d AS (SELECT i.*, coalesce(tool_name, '') || ' ' || coalesce(arguments, '') AS a, coalesce({_OUT}, '') AS o FROM tool_invocations i WHERE {_CMD})
SELECT invocation_id, message_id, ts_ms, length(o) AS output_chars FROM d WHERE {' AND '.join(f"({_has(_TOK.format('a'), w)} > 0 OR {_has(_TOK.format('o'), w)} > 0)" for w in ('make', 'walker'))} ORDER BY ts_ms DESC NULLS LAST, message_id, invocation_id LIMIT 50""",
    "command_output_search": f"""WITH d AS (SELECT i.*, {_TOK.format(f"coalesce({_OUT}, '')")} AS o FROM tool_invocations i WHERE {_CMD})
SELECT invocation_id, ts_ms FROM d WHERE {_has('o', 'fail')} > 0 AND {_bigram('o', 'web', 'queue')} > 0 ORDER BY ts_ms DESC NULLS LAST, message_id, invocation_id LIMIT 50""",
    "table_counts": "SELECT 'messages' AS name, count(*) AS n FROM messages UNION ALL SELECT 'sessions', count(*) FROM sessions UNION ALL SELECT 'activities', count(*) FROM activities UNION ALL SELECT 'sources', count(DISTINCT source_path) FROM sessions",
    "source_counts": "SELECT s.source_path AS path, any_value(s.n) AS sessions, count(m.seq) AS messages FROM (SELECT source_path, count(*) AS n FROM sessions GROUP BY 1) s LEFT JOIN messages m ON m.source_path IS NOT DISTINCT FROM s.source_path AND m.source_path IS NOT NULL GROUP BY 1",
    "source_projections": f"""SELECT source_path, count(*) AS message_count, max(ts_ms) AS latest_ts_ms, arg_max(id, row(coalesce(ts_ms, -1), seq)) AS latest_id,
{_pre("arg_max(CASE WHEN coalesce(prose, '') <> '' THEN prose ELSE coalesce(content, chr(0)) END, row(coalesce(ts_ms, -1), seq))").replace("left(", "nullif(left(", 1)}, chr(0)) AS latest_prefix FROM messages GROUP BY 1""",
    "message_prefixes": f"SELECT seq, {_pre('content')} AS content_prefix, {_pre('prose')} AS prose_prefix, octet_length(encode(content))::BIGINT AS content_bytes, octet_length(encode(prose))::BIGINT AS prose_bytes FROM messages",
    "tool_pairs_by_id": """SELECT r.result_id, arg_max(c.invocation_id, row(c.ts_ms, c.invocation_id)) AS invocation_id FROM tool_results r JOIN tool_invocations c ON c.session_id = r.session_id AND c.tool_id = r.tool_id AND c.ts_ms <= r.ts_ms
WHERE r.session_id <> '' AND r.tool_id <> '' GROUP BY 1""",
    "tool_pairs_greedy": """WITH RECURSIVE e0 AS (SELECT session_id AS s, ts_ms, 0 AS side, invocation_id AS n, lower(coalesce(tool_name, '')) AS nm FROM tool_invocations WHERE coalesce(tool_id, '') = '' AND session_id <> '' AND ts_ms IS NOT NULL
UNION ALL SELECT session_id, ts_ms, 1, result_id, lower(coalesce(tool_name, '')) FROM tool_results WHERE coalesce(tool_id, '') = '' AND session_id <> '' AND ts_ms IS NOT NULL),
ev AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ts_ms, side, n) AS k FROM e0),
st AS (SELECT DISTINCT s, 0::BIGINT AS k, []::STRUCT(n BIGINT, nm VARCHAR, used BOOLEAN)[] AS pool, NULL::BIGINT AS rid, NULL::BIGINT AS inv FROM ev
UNION ALL SELECT s, k, CASE WHEN side = 0 THEN list_append(pool, {'n': n, 'nm': nm, 'used': false})[-64:] ELSE list_transform(pool, lambda x: {'n': x.n, 'nm': x.nm, 'used': x.used OR (hit IS NOT NULL AND x.n = hit)}) END, CASE WHEN hit IS NOT NULL THEN n END, hit
  FROM (SELECT e.s, e.k, e.side, e.n, e.nm, st.pool, CASE WHEN e.side = 1 THEN list_filter(st.pool, lambda x: NOT x.used AND (x.nm = '' OR e.nm = '' OR x.nm = e.nm))[-1].n END AS hit FROM st JOIN ev e ON e.s = st.s AND e.k = st.k + 1))
SELECT rid AS result_id, inv AS invocation_id FROM st WHERE rid IS NOT NULL""",
    "attached_activities": """SELECT activity_id, parent_source_path, child_session_path, status FROM activities UNION ALL
SELECT session_id, parent_session, source_path, 'running' FROM sessions s WHERE visibility = 'attached' AND parent_session <> '' AND session_id <> ''
AND NOT EXISTS (SELECT 1 FROM activities a WHERE a.child_session_path = s.source_path) AND NOT EXISTS (SELECT 1 FROM activities a WHERE a.activity_id = s.session_id) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY source_path) = 1""",
}
SQL |= {"indexed_search": SQL["search_all_terms"], "search_inflected": SQL["search_all_terms"], "indexed_command_search": SQL["command_search"], "indexed_session_list": SQL["session_list"]}
