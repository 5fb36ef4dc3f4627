"""Queries of the subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.keys import norm_id
from skein.llm import conversations as talk
from skein.llm import personal_info
from skein.llm.leaks import leaks
from skein.llm.nearest_time import nearest_in_time
from skein.llm.packing import CAPACITY, fill_containers, summary
from skein.llm.residue import residue
from skein.llm.splitting import split_items
from skein.session import materialize
from skein.sources.tables import table

TOLERANCE_MS = 5000


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """(invocation_id, result_id): the nearest call of each result that names none."""
    results = table(spark, directory, "tool_results", "result_id", "session_id", "tool_id", "ts_ms").where(norm_id("tool_id").isNull())
    calls = table(spark, directory, "tool_invocations", "invocation_id", "session_id", "ts_ms")
    pairs = nearest_in_time(
        results.select(norm_id("session_id").alias("entity"), F.col("ts_ms").alias("at"), F.col("result_id").alias("left_id")),
        calls.select(norm_id("session_id").alias("entity"), F.col("ts_ms").alias("at"), F.col("invocation_id").alias("right_id")),
        TOLERANCE_MS,
    )
    return pairs.select(F.col("right_id").alias("invocation_id"), F.col("left_id").alias("result_id")).distinct()


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """(session_id): sessions to leave out."""
    return talk.dropped_sessions(
        table(spark, directory, "messages", "seq", "session_id", "entry_id", "source_path", "ts_ms", "type", "prose", "batch_no"),
        table(spark, directory, "sessions", "source_path", "session_id"),
    )


def p2_conversations(spark: SparkSession, directory: str) -> DataFrame:
    """(session, at, seq, speaker, words): the turns of the sessions that are kept."""
    whole = talk.conversations(table(spark, directory, "messages"), table(spark, directory, "sessions"))
    return whole.select("session", "at", "seq", "speaker", "words")


def p2_assembly(spark: SparkSession, directory: str) -> DataFrame:
    """(session, seq, path, step, place): every message once, with its place on the merged path it lies on."""
    return talk.assemble(table(spark, directory, "messages"), table(spark, directory, "sessions")).select("session", "seq", "path", "step", "place")


def items(spark: SparkSession, directory: str) -> DataFrame:
    """(item_table, item_key, content) of messages and tool_results."""
    m = table(spark, directory, "messages", "seq", "content").select(F.lit("messages").alias("item_table"), F.col("seq").alias("item_key"), "content")
    r = table(spark, directory, "tool_results", "result_id", "content").select(F.lit("tool_results").alias("item_table"), F.col("result_id").alias("item_key"), "content")
    return m.unionByName(r)


def p3_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """(item_table, item_key, piece_no, piece, overlap)."""
    return split_items(items(spark, directory), ["item_table", "item_key"], "content")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """(item_table, item_key): what had to be split."""
    return p3_pieces(spark, directory).where(F.col("piece_no") == 0).select("item_table", "item_key").distinct()


def p3_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """(item_table, item_key, whole, fits): a hash of what the pieces give without their overlaps, and whether all of them are small enough."""
    pieces = p3_pieces(spark, directory).withColumn("own", F.expr("substring(piece, overlap + 1)"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")
    return pieces.groupBy("item_table", "item_key").agg(F.md5(joined).alias("whole"), (F.max(F.length("piece")) <= 4000).alias("fits"))


def p4_mentions(spark: SparkSession, directory: str) -> DataFrame:
    """(item_table, item_key, start, end, pii_kind): every piece of personal information in messages.content and tool_results.content."""
    texts = items(spark, directory).withColumnRenamed("content", "text")
    found = personal_info.mentions(texts, ["item_table", "item_key"], personal_info.learn(texts))
    return found.withColumnRenamed("kind", "pii_kind").distinct()


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """(item_table, item_key, pii_kind)."""
    return p4_mentions(spark, directory).select("item_table", "item_key", "pii_kind").distinct()


def p4_redacted(spark: SparkSession, directory: str) -> DataFrame:
    """(item_table, item_key, content, prose): the texts with placeholders; prose is null for tool_results."""
    m = table(spark, directory, "messages", "seq", "content", "prose").select(F.lit("messages").alias("item_table"), F.col("seq").alias("item_key"), "content", "prose")
    r = table(spark, directory, "tool_results", "result_id", "content").select(F.lit("tool_results").alias("item_table"), F.col("result_id").alias("item_key"), "content", F.lit(None).cast("string").alias("prose"))
    both = m.unionByName(r)
    # prose teaches where it says something that the content doesn't hold
    more = both.where(~F.coalesce(F.contains("content", "prose"), F.lit(False))).select(F.col("prose").alias("text"))
    return personal_info.redact(both, personal_info.learn(both.select(F.col("content").alias("text")).unionByName(more)), ["content", "prose"])


def p8_containers(spark: SparkSession, directory: str) -> DataFrame:
    """(container, doc_id, piece_no, first_token, n_tokens): the documents in containers of 2,048 tokens."""
    return fill_containers(table(spark, directory, "documents", "doc_id", "text"))


def p8_placed(spark: SparkSession, directory: str) -> DataFrame:
    """(doc_id, whole, split, fits): whether a document's pieces follow on each other from its first token, whether there are several only where it is longer than a container, and whether no container is overfull."""
    placed = materialize(p8_containers(spark, directory), "placed")
    fill = placed.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    pieces = F.array_sort(F.collect_list(F.struct("first_token", "n_tokens")))
    rows = placed.join(fill, "container").groupBy("doc_id").agg(pieces.alias("p"), F.max("fill").alias("fill"), F.sum("n_tokens").alias("n"))
    follows = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: F.when(i == 1, F.element_at("p", i)["first_token"] == 0).otherwise(F.element_at("p", i)["first_token"] == F.element_at("p", F.greatest(i - 1, F.lit(1)))["first_token"] + F.element_at("p", F.greatest(i - 1, F.lit(1)))["n_tokens"]))
    return rows.select("doc_id", follows.alias("whole"), ((F.size("p") > 1) == (F.col("n") > CAPACITY)).alias("split"), (F.col("fill") <= CAPACITY).alias("fits"))


def p8_summary(spark: SparkSession, directory: str) -> DataFrame:
    """(containers, tokens, bound, unused_share)."""
    return summary(p8_containers(spark, directory))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    """(item_id, doc_id): which evaluation item leaks into which document."""
    return leaks(table(spark, directory, "documents", "doc_id", "text"), table(spark, directory, "eval_items", "item_id", "text")).select("item_id", "doc_id")


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    """(doc_id): documents of template residue, filler, error pages or script notices."""
    return residue(table(spark, directory, "documents", "doc_id", "text")).select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_conversations": p2_conversations, "p2_assembly": p2_assembly, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_round_trip": p3_round_trip, "p4_found": p4_found, "p4_mentions": p4_mentions, "p4_redacted": p4_redacted, "p8_containers": p8_containers, "p8_placed": p8_placed, "p8_summary": p8_summary, "p9_found": p9_found, "p10_found": p10_found}

_N = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
_P = r"nullif(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\.zst$', ''), '')"


def _n(c: str) -> str:
    return _N.format(c)


def _p(c: str) -> str:
    return _P.format(c)


_TURNS = f"""WITH paths AS (SELECT {_p('source_path')} AS path, min({_n('session_id')}) AS sid FROM sessions GROUP BY 1),
m AS (SELECT seq, ts_ms, content, coalesce({_n('m.session_id')}, p.sid) AS s, {_n('entry_id')} AS e, regexp_matches(coalesce(prose, ''), '[^\\s\\p{{Z}}\\p{{C}}]') AS said,
  CASE WHEN {_n('type')} IN ('user', 'human') THEN 'user' WHEN {_n('type')} IN ('assistant', 'ai', 'model', 'agent', 'bot') THEN 'assistant' ELSE {_n('type')} END AS role
  FROM messages m LEFT JOIN paths p ON p.path = {_p('m.source_path')}),
once AS (SELECT * FROM m WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s, coalesce(e, CAST(seq AS VARCHAR)) ORDER BY seq) = 1),
broken AS (SELECT DISTINCT s FROM once WHERE said AND (role IS NULL OR ts_ms IS NULL)),
turns AS (SELECT *, lead(role) OVER w AS after, row_number() OVER w AS k FROM once WHERE said AND role IN ('user', 'assistant') AND ts_ms IS NOT NULL WINDOW w AS (PARTITION BY s ORDER BY ts_ms, seq)),
kept AS (SELECT s FROM turns GROUP BY s HAVING bool_and(NOT (role = 'user' AND coalesce(after, 'user') = 'user')) AND bool_and(k > 1 OR role = 'user') AND s NOT IN (SELECT s FROM broken))"""

SQL = {
    "p1_found": f"""WITH r AS (SELECT result_id, {_n('session_id')} AS s, ts_ms FROM tool_results WHERE {_n('tool_id')} IS NULL AND ts_ms IS NOT NULL),
c AS (SELECT invocation_id, {_n('session_id')} AS s, ts_ms FROM tool_invocations)
SELECT invocation_id, result_id FROM (
  SELECT c.invocation_id, r.result_id, row_number() OVER (PARTITION BY r.result_id ORDER BY abs(r.ts_ms - c.ts_ms), c.invocation_id) AS k
  FROM r JOIN c ON r.s = c.s AND c.ts_ms BETWEEN r.ts_ms - {TOLERANCE_MS} AND r.ts_ms + {TOLERANCE_MS}) WHERE k = 1""",
    "p2_found": f"""{_TURNS}
SELECT DISTINCT session_id FROM (SELECT {_n('session_id')} AS session_id FROM sessions UNION SELECT {_n('session_id')} FROM messages) WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT s FROM kept)""",
    "p2_conversations": f"""{_TURNS} SELECT s AS session, ts_ms AS at, seq, role AS speaker, content AS words FROM turns WHERE s IN (SELECT s FROM kept)""",
    "p3_found": "SELECT 'messages' AS item_table, seq AS item_key FROM messages WHERE length(content) > 4000 UNION SELECT 'tool_results', result_id FROM tool_results WHERE length(content) > 4000",
    "p3_round_trip": "SELECT 'messages' AS item_table, seq AS item_key, md5(content) AS whole, true AS fits FROM messages WHERE length(content) > 4000 UNION ALL SELECT 'tool_results', result_id, md5(content), true FROM tool_results WHERE length(content) > 4000",
    "p8_placed": "SELECT doc_id, true AS whole, true AS split, true AS fits FROM documents WHERE text <> ''",
    "p9_found": r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS ws FROM documents),
i AS (SELECT item_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS ws FROM eval_items),
ig AS (SELECT DISTINCT id, hash(array_to_string(ws[k:k + 11], ' ')) AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 10)) AS k FROM i WHERE len(ws) >= 12)),
dg AS (SELECT id, hash(array_to_string(ws[k:k + 11], ' ')) AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 10)) AS k FROM w WHERE len(ws) >= 12))
SELECT DISTINCT ig.id AS item_id, dg.id AS doc_id FROM ig JOIN dg USING (g)""",
}
