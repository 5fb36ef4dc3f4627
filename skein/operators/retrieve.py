"""Retrieval over a corpus: newest messages, ranked search, neighbours, context, sessions, activities, commands, counts.

All functions are DataFrame to DataFrame and take the present as now_ms. Limits of 0 mean no limit. A Corpus
reads only the columns a query needs; filters on sessions, types and times reach the Parquet scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import plain_tokens, prefix, stem_tokens
from skein.plans import match as M
from skein.session import materialize
from skein.sources.index import candidates
from skein.sources.tables import table

HOUR_MS = 3_600_000
#: Parameters of the ranking function; scores are negative, lower is better.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


class NotFound(LookupError):
    """No row has the id."""


class Ambiguous(LookupError):
    """Several rows begin with the id."""


@dataclass
class Corpus:
    """The tables of one snapshot directory. stemming: tokens by Porter stems (stored or made), else plain words in the JVM."""

    spark: SparkSession
    directory: str
    stemming: bool = False

    def read(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.directory, name, *columns)

    @cached_property
    def messages(self) -> DataFrame:
        return self.read("messages")

    @cached_property
    def sessions(self) -> DataFrame:
        return self.read("sessions")

    @cached_property
    def activities(self) -> DataFrame:
        return self.read("activities")

    def token_column(self, df: DataFrame, source: str) -> Column:
        """The token array of a text column: the stored one where there is one, else made here."""
        if f"{source}_tokens" in df.columns:
            return F.col(f"{source}_tokens")
        return stem_tokens(source) if self.stemming else plain_tokens(source)

    @cached_property
    def index(self) -> DataFrame | None:
        """The postings, where the directory has them."""
        return self.stored("postings")

    def stored(self, name: str) -> DataFrame | None:
        """A table that a snapshot keeps for its readers, where the directory has it."""
        try:
            return self.read(name)
        except AnalysisException:
            return None

    def candidates(self, node: M.Node) -> DataFrame:
        """The messages that hold a word of any phrase that counts: all hits, and all that the phrases' counts need."""
        if self.index is None:
            return self.messages
        words = [w for p in M.phrases(node) for w in M.necessary(p)]
        return self.messages.join(candidates(self.index, words), "seq", "left_semi")

    @property
    def analyze(self) -> M.Analyzer:
        return M.stemmed if self.stemming else M.plain


@dataclass(frozen=True)
class Scope:
    """Filters that all message queries share. exclude is ignored where a session is given."""

    session: str = ""
    exclude: str = ""
    cwd: str = ""
    type: str = ""
    prose_only: bool = False
    hours: int = 0


def in_scope(df: DataFrame, corpus: Corpus, scope: Scope, now_ms: int) -> DataFrame:
    if scope.session:
        df = df.where(F.col("session_id") == scope.session)
    elif scope.exclude:
        df = df.where(F.col("session_id") != scope.exclude)
    if scope.cwd:
        df = df.join(corpus.sessions.where(F.col("cwd") == scope.cwd).select("source_path").distinct(), "source_path", "left_semi")
    if scope.type:
        df = df.where(F.col("type") == scope.type)
    if scope.prose_only:
        df = df.where(F.col("prose") != "")
    if scope.hours > 0:
        df = df.where(F.col("ts_ms") >= now_ms - scope.hours * HOUR_MS)
    return df


def limited(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n) if n > 0 else df


def last(corpus: Corpus, n: int = 10, scope: Scope = Scope(), now_ms: int = 0) -> DataFrame:
    """The newest messages, newest first; of equal times the later delivered."""
    return limited(in_scope(corpus.messages, corpus, scope, now_ms).orderBy(F.desc("ts_ms"), F.desc("seq")), n)


def noise(content_prefix: Column, prose_prefix: Column) -> Column:
    """1 for copied front matter and echoed search output, else 0."""
    p = F.lower(F.concat(F.coalesce(content_prefix, F.lit("")), F.lit(" "), F.coalesce(prose_prefix, F.lit(""))))
    every = lambda *ps: [p.like(x) for x in ps]
    # What such texts begin with and hold.
    rules = [
        every("---%", "%name:%", "%description:%"),
        every('%"results"%', '%"budget"%', '%"relaxed"%'),
        every('{"results":%', '%"sessionid":%', '%"id":%'),
        every('{"commands":%', '%"messageid":%', '%"tool":%'),
    ]
    out = F.lit(False)
    for r in rules:
        both = r[0]
        for c in r[1:]:
            both = both & c
        out = out | both
    return F.when(out, 1).otherwise(0)


def score(corpus: Corpus, docs: DataFrame, node: M.Node) -> Column:
    """The BM25 score of a row from its column __f (Evaluator.features).

    docs: rows with __f that hold all documents of every phrase; one pass counts them and one row comes back. Without
    an index docs is the whole corpus and gives its number and mean size as well; with one they are stored.
    """
    n = len(M.phrases(node))
    counts = [F.count_if(F.col(f"__f.c{i}") > 0).alias(f"n{i}") for i in range(n)]
    stats = docs.agg(F.count("*").alias("n"), F.avg("__f.size").alias("mean"), *counts).first()
    total, mean = stats.n, stats.mean
    if corpus.index is not None:
        whole = corpus.read("corpus").first()
        total, mean = whole.n, whole.words / max(1, whole.n)
    out = F.lit(0.0)
    for i in range(n):
        idf = math.log((total - stats[f"n{i}"] + 0.5) / (stats[f"n{i}"] + 0.5))
        tf = F.col(f"__f.c{i}").cast("double")
        out = out - (idf if idf > 0 else IDF_FLOOR) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__f.size") / (mean or 1.0)))
    return out


@dataclass(frozen=True)
class SearchOptions:
    """What to search and how to order it. window: only the newest so many messages of the scope; type and prose don't narrow the window."""

    pattern: str
    limit: int = 20
    any: bool = False
    raw: bool = False
    scope: Scope = Scope(prose_only=True)
    window: int = 0
    per_session: int = 0
    reduce_noise: bool = False


def compile_search(corpus: Corpus, o: SearchOptions) -> M.Node | None:
    fields = ("prose",) if o.scope.prose_only else None
    if o.raw:
        return M.raw(o.pattern, analyze=corpus.analyze, fields=fields)
    return M.literal(o.pattern, o.any, corpus.analyze, fields)


def search(corpus: Corpus, o: SearchOptions, now_ms: int = 0) -> DataFrame:
    """Messages that match, best first, with columns score, noise and rank."""
    node = compile_search(corpus, o)
    if node is None:
        return corpus.messages.where(F.lit(False)).withColumns({"score": F.lit(0.0), "noise": F.lit(0), "rank": F.lit(0)})
    sources = {"content": corpus.token_column(corpus.messages, "content"), "prose": corpus.token_column(corpus.messages, "prose")}
    features = M.Evaluator.bind(sources, lambda ev: ev.features(node))
    docs = corpus.candidates(node).withColumn("__f", features)
    hits = in_scope(docs, corpus, o.scope, now_ms)
    if o.window > 0:
        whole = Scope(session=o.scope.session, exclude=o.scope.exclude, cwd=o.scope.cwd, hours=o.scope.hours)
        newest = in_scope(corpus.messages, corpus, whole, now_ms).orderBy(F.desc("ts_ms"), F.desc("seq")).limit(o.window).select("seq")
        hits = hits.join(newest, "seq", "left_semi")
    hits = hits.where("__f.hit").withColumn("score", score(corpus, docs.select("__f"), node)).drop("__f", "content_tokens", "prose_tokens")
    hits = hits.withColumn("noise", noise(prefix("content"), prefix("prose")))
    order = [*([F.asc("noise")] if o.reduce_noise else []), F.asc("score"), F.desc("ts_ms"), F.desc("seq")]
    if o.per_session > 0:
        # row_number() <= n is limited within tasks before the shuffle, so a hot session sends n rows a task
        hits = hits.withColumn("__k", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where(F.col("__k") <= o.per_session).drop("__k")
    page = limited(hits.orderBy(*order), o.limit)
    if not o.limit:
        return page.withColumn("rank", F.lit(0))
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def search_relaxed(corpus: Corpus, o: SearchOptions, now_ms: int = 0) -> tuple[DataFrame, bool]:
    """The hits; if there are none and several terms were all asked for, those of any term, and whether that found some.

    A page is written once, as it is asked several times: whether it is empty, for its rows and for their surroundings.
    """
    page = materialize(search(corpus, o, now_ms), "page")
    if o.any or o.raw or len(o.pattern.split()) < 2 or not page.isEmpty():
        return page, False
    loose = materialize(search(corpus, SearchOptions(**{**o.__dict__, "any": True}), now_ms), "page")
    return loose, not loose.isEmpty()


def resolve(corpus: Corpus, message_id: str) -> str:
    """The full id: exact, or the one id that begins so (letter case of ASCII doesn't matter). NotFound or Ambiguous."""
    ids = corpus.messages.select("id")
    if ids.where(F.col("id") == message_id).limit(1).count():
        return message_id
    found = [r.id for r in ids.where(F.lower("id").startswith(message_id.lower())).distinct().limit(2).collect()]
    if not found:
        raise NotFound(message_id)
    if len(found) > 1:
        raise Ambiguous(message_id)
    return found[0]


def neighbours(corpus: Corpus, hits: DataFrame, before: int, after: int, prose_only: bool = False, bounded: bool = True) -> DataFrame:
    """(hit_seq, and the message columns): every hit with its neighbours in the session by (ts_ms, seq).

    hits: session_id, seq, ts_ms; bounded says that they are a page of a top-k, which may be broadcast. With prose_only neighbours
    need prose, hits don't. For each hit and side the nearest rows are kept, limited within tasks before the shuffle.
    """
    h = hits.select(F.col("session_id").alias("__s"), F.col("seq").alias("hit_seq"), F.col("ts_ms").alias("__t"))
    near = corpus.messages.join(F.broadcast(h) if bounded else h, F.col("session_id") == F.col("__s"))
    here, key, mark = F.col("seq") == F.col("hit_seq"), F.struct("ts_ms", "seq"), F.struct(F.col("__t").alias("ts_ms"), F.col("hit_seq").alias("seq"))
    if prose_only:
        near = near.where(here | (F.col("prose") != ""))
    side = F.when(here, 0).when(key < mark, -1).otherwise(1)
    ahead = near.where(key <= mark).withColumn("__k", F.row_number().over(Window.partitionBy("hit_seq").orderBy(F.desc("ts_ms"), F.desc("seq")))).where(F.col("__k") <= before + 1)
    behind = near.where(key > mark).withColumn("__k", F.row_number().over(Window.partitionBy("hit_seq").orderBy("ts_ms", "seq"))).where(F.col("__k") <= after)
    return ahead.unionByName(behind).withColumn("side", side).drop("__k", "__s", "__t")


def around(corpus: Corpus, message_id: str, before: int = 5, after: int = 5, prose_only: bool = False) -> DataFrame:
    """A message with its neighbours, in order of time."""
    full = resolve(corpus, message_id)
    hit = corpus.messages.where(F.col("id") == full).orderBy("seq").limit(1)
    return neighbours(corpus, hit, before, after, prose_only).drop("hit_seq", "side").orderBy("ts_ms", "seq")


def context(corpus: Corpus, hits: DataFrame, before: int = 3, after: int = 8, prose_only: bool = True, bounded: bool = True) -> DataFrame:
    """The neighbours of all hits, each message once, with hit_ids (the hits it is near to, best first), by session and time."""
    near = neighbours(corpus, hits, before, after, prose_only, bounded)
    names = hits.select(F.col("seq").alias("hit_seq"), F.col("id").alias("__hit"), F.col("rank").alias("__rank"))
    ids = near.join(F.broadcast(names) if bounded else names, "hit_seq").groupBy("session_id", "seq").agg(F.transform(F.array_sort(F.collect_set(F.struct("__rank", "__hit"))), lambda x: x["__hit"]).alias("hit_ids"))
    rows = near.drop("hit_seq", "side").dropDuplicates(["session_id", "seq"])
    return rows.join(ids, ["session_id", "seq"]).orderBy("session_id", "ts_ms", "id")


def source_projection(messages: DataFrame) -> DataFrame:
    """(source_path, message_count, latest_ts_ms, latest_id, latest_prefix): per source file."""
    # stored prefixes spare the bodies
    c, p = ("content_prefix", "prose_prefix") if "content_prefix" in messages.columns else ("content", "prose")
    newest = F.max(F.struct("ts_ms", "seq", "id", F.col(c).alias("c"), F.col(p).alias("p")))
    g = messages.groupBy("source_path").agg(F.count("*").alias("message_count"), newest.alias("m"))
    body = F.when(F.coalesce(F.col("m.p"), F.lit("")) != "", F.col("m.p")).otherwise(F.col("m.c"))
    return g.select("source_path", "message_count", F.col("m.ts_ms").alias("latest_ts_ms"), F.col("m.id").alias("latest_id"), prefix(body).alias("latest_prefix"))


def sessions(corpus: Corpus, query: str = "", limit: int = 20, cwd: str = "", exclude: str = "", any_: bool = False) -> DataFrame:
    """One row a source file, newest first: session_id, cwd, visibility, parent, latest_ts_ms, preview, message_count."""
    s = corpus.sessions
    parents = s.select(F.col("source_path").alias("parent_session"), F.col("session_id").alias("__parent")).dropDuplicates(["parent_session"])
    projections = corpus.stored("source_projections")
    rows = s.join(source_projection(corpus.messages) if projections is None else projections, "source_path").join(parents, "parent_session", "left")
    if cwd:
        rows = rows.where(F.col("cwd") == cwd)
    if exclude:
        rows = rows.where(F.col("session_id") != exclude)
    if query:
        node = M.literal(query, any_, corpus.analyze, ("prose",))
        prose = {"prose": corpus.token_column(corpus.messages, "prose")}
        hit = F.lit(False) if node is None else M.Evaluator.bind(prose, lambda ev: ev.matches(node))
        rows = rows.join(corpus.messages.where(hit).select("source_path").distinct(), "source_path", "left_semi")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = rows.select(
        "source_path", text("session_id").alias("session_id"), text("cwd").alias("cwd"), text("visibility").alias("visibility"),
        F.coalesce("__parent", F.nullif("parent_session", F.lit("")), F.lit("")).alias("parent"), "latest_ts_ms", F.col("latest_prefix").alias("preview"), "message_count",
    )
    return limited(out.orderBy(F.desc("latest_ts_ms"), "session_id", "source_path"), limit)


def _owners(corpus: Corpus, path: str, name: str) -> DataFrame:
    return corpus.sessions.select(F.col("source_path").alias(path), F.col("session_id").alias(name)).dropDuplicates([path])


def activities(corpus: Corpus, limit: int = 20, session: str = "", status: str = "") -> DataFrame:
    """Activities, newest first, with the ids of their parent and child sessions."""
    a = corpus.activities.join(_owners(corpus, "parent_source_path", "__p"), "parent_source_path", "left").join(_owners(corpus, "child_session_path", "__c"), "child_session_path", "left")
    parent = F.coalesce(F.nullif("parent_session_id", F.lit("")), "__p")
    if session:
        a = a.where((parent == session) | (F.col("__c") == session))
    if status:
        a = a.where(F.lower("status") == status.lower())
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    names = ["activity_id", "status", "title", "description", "model", "effort", "parent_activity_id", "kind", "namespace", "result_summary", "start_entry_id", "start_parent_id", "linked_entry_id", "terminal_entry_id", "terminal_parent_id"]
    out = a.select(*map(text, names), *map(number, ["tool_uses", "started_at", "completed_at"]), F.coalesce(parent, F.nullif("parent_source_path", F.lit("")), F.lit("")).alias("parent_session_id"), F.coalesce("__c", F.lit("")).alias("child_session_id"), F.coalesce(F.nullif("started_at", F.lit(0)), "completed_at").alias("__at"))
    return limited(out.orderBy(F.desc("__at"), "activity_id").drop("__at"), limit)


def activity(corpus: Corpus, activity_id: str) -> DataFrame:
    """One activity by its id or a unique beginning of it."""
    ids = corpus.activities.select("activity_id")
    full = activity_id
    if not ids.where(F.col("activity_id") == activity_id).limit(1).count():
        found = [r[0] for r in ids.where(F.lower("activity_id").startswith(activity_id.lower())).limit(2).collect()]
        if not found:
            raise NotFound(activity_id)
        if len(found) > 1:
            raise Ambiguous(activity_id)
        full = found[0]
    return activities(corpus, limit=0).where(F.col("activity_id") == full)


def lineage(corpus: Corpus, messages: DataFrame) -> DataFrame:
    """messages with activity_id, activity_role, parent_activity_id, parent_session_id and child_session_id resolved.

    A message's own activity goes before the activity whose child session its file is.
    """
    a = corpus.activities
    owner = lambda path, name: _owners(corpus, path, name)
    wide = a.join(owner("parent_source_path", "__ps"), "parent_source_path", "left").join(owner("child_session_path", "__cs"), "child_session_path", "left")
    cols = ["activity_id", "parent_activity_id", "parent_session_id", "__ps", "__cs"]
    child = wide.where(F.coalesce("child_session_path", F.lit("")) != "").groupBy(F.col("child_session_path").alias("source_path")).agg(F.max(F.struct("started_at", *cols)).alias("__child"))
    direct = wide.select(F.col("activity_id").alias("__id"), F.struct(*cols).alias("__direct"))
    m = messages.join(child, "source_path", "left").join(direct, F.col("activity_id") == F.col("__id"), "left")
    nz = lambda c: F.nullif(F.col(c), F.lit(""))
    return m.withColumns({
        "parent_activity_id": F.coalesce(nz("__direct.parent_activity_id"), F.col("__child.parent_activity_id"), F.lit("")),
        "parent_session_id": F.coalesce(nz("__direct.parent_session_id"), F.col("__direct.__ps"), nz("__child.parent_session_id"), F.col("__child.__ps"), F.lit("")),
        "child_session_id": F.coalesce(F.col("__direct.__cs"), F.col("__child.__cs"), F.lit("")),
        "activity_role": F.coalesce(nz("activity_role"), F.when(F.col("__child").isNotNull(), "child"), F.lit("")),
        "activity_id": F.coalesce(nz("activity_id"), F.col("__child.activity_id"), F.lit("")),
    }).drop("__id", "__child", "__direct")


def command_docs(invocations: DataFrame, results: DataFrame) -> DataFrame:
    """invocations with arguments_text (tool name and arguments) and output (its results' texts, in order of time)."""
    out = (
        results.where(F.col("invocation_id").isNotNull() & (F.coalesce("content", F.lit("")) != ""))
        .groupBy("invocation_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "result_id", "content"))), lambda r: r["content"]), "\n").alias("output"))
    )
    text = F.concat(F.coalesce("tool_name", F.lit("")), F.lit(" "), F.coalesce("arguments", F.lit("")))
    return invocations.withColumn("arguments_text", text).join(out, "invocation_id", "left").withColumn("output", F.coalesce("output", F.lit("")))


def commands(corpus: Corpus, query: str = "", match: str = "both", limit: int = 20, tool: str = "", scope: Scope = Scope(), now_ms: int = 0, outputs: bool = True) -> DataFrame:
    """Tool calls, newest first: invocation_id, tool, arguments, session_id, message_id, ts_ms, output.

    Calls whose message or session is missing are left out. Outputs are only gathered where asked for or searched.
    """
    node = M.command_query(query, match, corpus.analyze)
    calls = corpus.read("tool_invocations")
    if query and node is None:
        calls = calls.where(F.lit(False))
    if scope.session:
        calls = calls.where(F.col("session_id") == scope.session)
    elif scope.exclude:
        calls = calls.where(F.col("session_id") != scope.exclude)
    if tool:
        calls = calls.where(F.lower("tool_name") == tool.lower())
    if scope.hours > 0:
        calls = calls.where(F.col("ts_ms") >= now_ms - scope.hours * HOUR_MS)
    known = corpus.sessions.where(F.col("cwd") == scope.cwd) if scope.cwd else corpus.sessions
    owners = corpus.messages.select(F.col("id").alias("message_id"), "source_path").join(known.select("source_path").distinct(), "source_path", "left_semi")
    calls = calls.join(owners.select("message_id"), "message_id", "left_semi")
    if node is not None:
        kept = corpus.stored("command_documents")
        docs = command_docs(calls, corpus.read("tool_results", "invocation_id", "content", "ts_ms", "result_id")) if kept is None else kept.join(calls.select("invocation_id"), "invocation_id", "left_semi")
        sources = {"arguments": corpus.token_column(docs, "arguments_text"), "output": corpus.token_column(docs, "output")}
        calls = docs.where(M.Evaluator.bind(sources, lambda ev: ev.matches(node)))
    page = limited(calls.orderBy(F.desc("ts_ms"), "message_id", "invocation_id"), limit)
    if outputs and "output" not in page.columns:
        page = command_docs(page, corpus.read("tool_results", "invocation_id", "content", "ts_ms", "result_id")).orderBy(F.desc("ts_ms"), "message_id", "invocation_id")
    keep = ["invocation_id", F.col("tool_name").alias("tool"), "arguments", "session_id", "message_id", "ts_ms", *(["output"] if outputs else [])]
    return page.select(*keep)


def info(corpus: Corpus) -> DataFrame:
    """(name, n): rows of each table and the number of sources."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return (
        one("messages", corpus.messages.select("seq")).unionByName(one("sessions", corpus.sessions.select("source_path")))
        .unionByName(one("activities", corpus.activities.select("activity_id"))).unionByName(one("sources", corpus.sessions.select("source_path").distinct()))
    )


def info_sources(corpus: Corpus) -> DataFrame:
    """(path, sessions, messages): sessions and messages of each source; sources without messages have 0."""
    counts = corpus.messages.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("messages"))
    named = corpus.sessions.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("sessions"))
    return named.join(counts, "path", "left").select("path", "sessions", F.coalesce("messages", F.lit(0)).alias("messages"))
