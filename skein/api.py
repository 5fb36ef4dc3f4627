"""The public queries as functions from parameters to response documents; the command line and the HTTP server share them."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema as S
from skein.functions.shape import COMPACT, DEFAULT_BUDGET, most_rows, response, stamp
from skein.functions.text import excerpt, preview_text, stem, tokenize
from skein.operators import retrieve as R
from skein.operators import secrets
from skein.plans import match as M
from skein.session import temporary
from skein.sources.store import Store
from skein.sources.transcripts import Config, discover

LIMITS = {"search": 20, "last": 10, "sessions": 20, "activities": 20, "commands": 20, "context": 3}


class BadRequest(ValueError):
    """A parameter that can't be used."""


@dataclass
class Params:
    """All parameters; the defaults are those of the commands. limit -1 stands for the command's own."""

    pattern: str = ""
    id: str = ""
    limit: int = -1
    session: str = ""
    exclude_session: str = ""
    cwd: str = ""
    type: str = ""
    all: bool = False
    any: bool = False
    raw: bool = False
    hours: int = 0
    window: int = 0
    per_session: int = 0
    reduce_noise: bool = False
    before: int = -1
    after: int = -1
    length: int = 200
    budget: int = DEFAULT_BUDGET
    full: bool = False
    status: str = ""
    tool: str = ""
    match: str = "both"
    output: bool = False
    sources: bool = False
    secrets: bool = False
    since_hours: int = 48
    apply: bool = False
    secret_files: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for name in ("hours", "window", "per_session", "length", "budget", "since_hours"):
            if getattr(self, name) < 0:
                raise BadRequest(f"{name} must not be negative")
        if self.raw and self.any:
            raise BadRequest("raw and any exclude each other")

    def scope(self) -> R.Scope:
        return R.Scope(self.session, self.exclude_session, self.cwd, self.type, not self.all, self.hours)

    def count(self, command: str) -> int:
        return LIMITS[command] if self.limit < 0 else self.limit


def current_session(environment: dict[str, str] | None = None) -> str:
    """The session the caller itself runs in, to be left out of searches."""
    env = os.environ if environment is None else environment
    if env.get("PI_SESSION_ID"):
        return env["PI_SESSION_ID"]
    name = os.path.basename(env.get("PI_SESSION_FILE", "")).removesuffix(".zst").removesuffix(".jsonl")
    return name.rpartition("_")[2] if "_" in name else ""


def highlight(text: str, phrases: list[M.Phrase], length: int) -> str:
    """An excerpt of the place that shows the most different phrases of a search; those that mustn't occur don't count."""
    wanted = [(w, p.prefix and i + 1 == len(p.words), k) for k, p in enumerate(phrases) for i, w in enumerate(p.words)]
    hits = []
    for a, b, w in tokenize(text):
        s = stem(w)
        found = next((k for x, begins, k in wanted if s == x or (begins and s.startswith(x))), None)
        if found is not None:
            hits.append((a, b, found))
    return excerpt(text, hits, min(length, COMPACT))


def camel(name: str) -> str:
    """A column's name as responses write it."""
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


class Service:
    """Queries over the current snapshot of a store."""

    def __init__(self, spark: SparkSession, store: str, roots: list[str] | None = None):
        self.spark, self.store = spark, Store(spark, store)
        self.roots = Config().roots() if roots is None else roots

    def corpus(self) -> R.Corpus:
        folder = self.store.current()
        if folder is None:
            raise R.NotFound("there is no snapshot yet; refresh first")
        return R.Corpus(self.spark, folder, stemming=True)

    @staticmethod
    def _rows(df: DataFrame, p: Params | None = None) -> list[dict[str, Any]]:
        """The page's rows; where short previews are asked for, only the stored prefixes of the bodies are read."""
        if p and not p.full and 0 < p.length <= COMPACT and "content_prefix" in df.columns:
            df = df.withColumns({"content": F.col("content_prefix"), "prose": F.col("prose_prefix")})
        return [r.asDict(recursive=True) for r in df.drop("content_tokens", "prose_tokens", "content_prefix", "prose_prefix", "tool_calls", "tool_results").collect()]

    def last(self, p: Params, now_ms: int) -> dict[str, Any]:
        n = 0 if p.limit < 0 and p.hours else p.count("last")
        c, most = self.corpus(), most_rows(p.budget, p.full)
        unread = 0
        if not n and most:  # an open page ends where its budget must be spent; what lies beyond is only counted
            n, unread = most, max(0, R.last(c, 0, p.scope(), now_ms).count() - most)
        rows = self._rows(R.lineage(c, R.last(c, n, p.scope(), now_ms)).orderBy(F.desc("ts_ms"), F.desc("seq")), p)
        return response(rows, p.length, p.budget, p.full, not p.all, unread=unread)

    @staticmethod
    def _options(p: Params, limit: int) -> R.SearchOptions:
        return R.SearchOptions(p.pattern, limit, p.any, p.raw, p.scope(), p.window, p.per_session, p.reduce_noise)

    def _search(self, c: R.Corpus, p: Params, command: str, now_ms: int) -> tuple[list[dict[str, Any]], DataFrame, bool, bool]:
        n = p.count(command)
        page, relaxed = R.search_relaxed(c, self._options(p, n + 1 if n else 0), now_ms)
        rows = self._rows(R.lineage(c, page).orderBy("rank"))
        more = bool(n) and len(rows) > n
        return (rows[:n] if n else rows), page.where(F.col("rank") <= n) if n else page, more, relaxed

    def search(self, p: Params, now_ms: int) -> dict[str, Any]:
        c = self.corpus()
        with temporary():
            rows, _, more, relaxed = self._search(c, p, "search", now_ms)
        phrases = M.phrases(R.compile_search(c, self._options(p, 0)))
        for r in rows:
            r["preview"] = highlight((r["prose"] if not p.all else r["content"]) or "", phrases, p.length) or None
        return response(rows, p.length, p.budget, p.full, not p.all, more, relaxed)

    def read(self, p: Params) -> dict[str, Any]:
        before, after = (5 if x < 0 else x for x in (p.before, p.after))
        c = self.corpus()
        near = R.lineage(c, R.around(c, p.id, before, after, not p.all)).orderBy("ts_ms", "seq")
        return response(self._rows(near, p), p.length, p.budget, p.full, not p.all)

    def context(self, p: Params, now_ms: int) -> dict[str, Any]:
        before, after = 3 if p.before < 0 else p.before, 8 if p.after < 0 else p.after
        c = self.corpus()  # hits and neighbours from one snapshot
        with temporary():
            rows, page, more, relaxed = self._search(c, p, "context", now_ms)
            near = self._rows(R.lineage(c, R.context(c, page, before, after, not p.all, bounded=p.count("context") > 0)).orderBy("session_id", "ts_ms", "id"), p) if rows else []
        whole = response(near, p.length, p.budget, p.full, not p.all, more, relaxed)
        return whole | {"query": p.pattern, "totalHits": len(rows), "hits": response(rows, p.length, 0, p.full, not p.all)["results"]}

    def sessions(self, p: Params) -> dict[str, Any]:
        c = self.corpus()
        ask = lambda any_: R.sessions(c, p.pattern, p.count("sessions"), p.cwd, p.exclude_session, any_).collect()
        rows = ask(p.any)
        if not rows and len(p.pattern.split()) > 1 and not p.any:
            rows = ask(True)
        return {"sessions": [{"sessionId": r.session_id, "cwd": r.cwd, "visibility": r.visibility, "parentSessionId": r.parent, "lastTimestamp": stamp(r.latest_ts_ms) if r.latest_ts_ms else "", "lastPreview": preview_text(r.preview or "", p.length), "messageCount": r.message_count} for r in rows], "total": len(rows)}

    @staticmethod
    def _activity(r: Any, full: bool) -> dict[str, Any]:
        d = r.asDict()
        for k in ("started_at", "completed_at"):
            d[k] = stamp(d[k]) if d[k] else ""
        short = d if full else {k: preview_text(v, 100) if isinstance(v, str) and k in ("title", "description", "result_summary") else v for k, v in d.items()}
        return {camel(k): v for k, v in short.items()}

    def activities(self, p: Params) -> dict[str, Any]:
        rows = R.activities(self.corpus(), p.count("activities"), p.session, p.status).collect()
        return {"activities": [self._activity(r, p.full) for r in rows], "total": len(rows)}

    def activity(self, p: Params) -> dict[str, Any]:
        return {"activities": [self._activity(R.activity(self.corpus(), p.id).first(), True)], "total": 1}

    def commands(self, p: Params, now_ms: int) -> dict[str, Any]:
        n = p.count("commands")
        rows = R.commands(self.corpus(), p.pattern, p.match, n + 1 if n else 0, p.tool, p.scope(), now_ms, p.output).collect()
        more = bool(n) and len(rows) > n
        out = []
        for r in rows[:n] if n else rows:
            try:
                arguments = json.loads(r.arguments) if r.arguments else None
            except ValueError:
                arguments = r.arguments
            out.append({"tool": r.tool, "arguments": arguments, "sessionId": r.session_id, "messageId": r.message_id, "timestamp": stamp(r.ts_ms) if r.ts_ms else ""} | ({"output": r.output} if p.output else {}))
        return {"commands": out, "total": len(out), "truncated": more}

    def info(self, p: Params) -> dict[str, Any]:
        c, fresh = self.corpus(), self.store.freshness(self.roots)
        n, wrong = {r.name: r.n for r in R.info(c).collect()}, self.store.check()
        out = {
            "indexPath": c.directory, "schemaVersion": S.SCHEMA_VERSION, "messageCount": n["messages"], "sessionCount": n["sessions"], "activityCount": n["activities"], "fileCount": n["sources"],
            "currentSession": current_session(), "indexHealthy": not wrong, "lockHealthy": self.store.lock_is_free(), "binaryPath": os.path.dirname(os.path.abspath(__file__)),
            "freshness": {"attempted": stamp(fresh.attempted_ms), "succeeded": stamp(fresh.succeeded_ms), "error": fresh.error, "roots": fresh.roots},
        }
        if p.sources:  # streamed, as there is a row a file
            out["sources"] = [{"path": r.path, "messageCount": r.messages, "sessionCount": r.sessions} for r in R.info_sources(c).orderBy("path").toLocalIterator()]
        return out

    def doctor(self, p: Params, now_ms: int) -> dict[str, Any]:
        wrong, fresh = self.store.check(), self.store.freshness(self.roots)
        there = [r for r in self.roots if os.path.isdir(r)]
        checks = [
            {"name": "index", "ok": not wrong, "detail": "; ".join(wrong)},
            {"name": "lock", "ok": self.store.lock_is_free(), "detail": ""},
            {"name": "roots", "ok": bool(there), "detail": ", ".join(there)},
            {"name": "freshness", "ok": not fresh.error and not fresh.stale(now_ms), "detail": fresh.error or stamp(fresh.succeeded_ms)},
        ]
        out: dict[str, Any] = ({} if self.store.current() is None or wrong else self.info(p)) | {"ok": all(c["ok"] for c in checks if c["name"] != "freshness"), "checks": checks}
        if p.secrets:
            out |= self.redact(Params(**{**p.__dict__, "apply": False}), now_ms)
        return out

    def redact(self, p: Params, now_ms: int) -> dict[str, Any]:
        """Scan the files for secrets; with apply rewrite them and read the changed ones again. Also counts those in the snapshot."""
        since = now_ms - p.since_hours * R.HOUR_MS if p.since_hours else 0
        values = secrets.normalize(secrets.values_from_environment() + secrets.values_from_files(p.secret_files))
        files = discover(self.spark, self.roots).drop("content")
        found = secrets.scan(files, since, values, p.apply).collect()
        if p.apply and any(r.matches for r in found):
            self.store.refresh(self.roots, now_ms, force=True)
        messages = self.store.table("messages").where(F.col("ts_ms") >= since)
        left = secrets.count_matches(messages, "content", ["seq"], values).agg(F.sum("matches")).first()[0] or 0
        return {"filesScanned": len(found), "recordsScanned": sum(r.records for r in found), "matches": sum(r.matches for r in found), "findings": [{"path": r.path, "matches": r.matches} for r in found if r.matches], "snapshotMatches": left, "applied": p.apply}

    def refresh(self, now_ms: int, force: bool = True, background: bool = False) -> dict[str, Any]:
        return self.store.refresh(self.roots, now_ms, force, background).__dict__

    def rebuild(self, now_ms: int, session: str = "") -> dict[str, Any]:
        return self.store.rebuild(self.roots, now_ms, session).__dict__


ERRORS: tuple[tuple[type[Exception], str, int], ...] = ((BadRequest, "bad_request", 400), (M.BadQuery, "bad_query", 400), (R.NotFound, "not_found", 404), (R.Ambiguous, "ambiguous", 409))
