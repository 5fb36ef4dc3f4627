"""Snapshots: immutable Parquet tables under a manifest that is replaced atomically.

    <store>/CURRENT           name of the current snapshot
    <store>/v000001/manifest.json, messages.parquet, sessions.parquet, ...
    <store>/.lock             held by the one writer

Readers pin the snapshot they open. A refresh parses only files that are new or changed, takes all other rows over
from the snapshot before, and pairs tool results again only for the sessions it touched.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import shutil
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schema as S
from skein.session import materialize, temporary
from skein.sources.index import write_index, write_projections
from skein.sources.transcripts import LINE_BITS, build_tables, changed, discover, link_results, one_child_owner, parse, stem_path

THROTTLE_MS, LOCK_SECONDS, KEEP = 30_000, 30.0, 3


class Busy(RuntimeError):
    """Another writer holds the lock."""


class WrongVersion(RuntimeError):
    """The snapshot was written by a newer version."""


@dataclass
class Stats:
    """What a refresh did."""

    files: int = 0
    messages: int = 0
    skipped: bool = False


@dataclass
class Freshness:
    """When the roots of a profile were last tried and last read."""

    attempted_ms: int = 0
    succeeded_ms: int = 0
    error: str = ""
    roots: list[str] = field(default_factory=list)

    def stale(self, now_ms: int) -> bool:
        return now_ms - self.succeeded_ms >= THROTTLE_MS


def profile(roots: list[str]) -> str:
    """The name of a set of roots."""
    return hashlib.sha256("\n".join(sorted({os.path.abspath(r) for r in roots})).encode()).hexdigest()


class Store:
    """A snapshot store in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)

    # reading

    def current(self) -> str | None:
        """The folder of the current snapshot, None before the first. WrongVersion if it is newer than this code."""
        with contextlib.suppress(FileNotFoundError):
            with open(os.path.join(self.root, "CURRENT")) as f:
                folder = os.path.join(self.root, f.read().strip())
            if self.manifest(folder)["schema_version"] > S.SCHEMA_VERSION:
                raise WrongVersion(folder)
            return folder
        return None

    @staticmethod
    def manifest(folder: str) -> dict:
        with open(os.path.join(folder, "manifest.json")) as f:
            return json.load(f)

    def table(self, name: str) -> DataFrame:
        """A table of the current snapshot, empty before the first."""
        folder = self.current()
        if folder is None:
            return self.spark.createDataFrame([], S.TABLES[name])
        return self.spark.read.parquet(os.path.join(folder, f"{name}.parquet"))

    def freshness(self, roots: list[str]) -> Freshness:
        with contextlib.suppress(FileNotFoundError):
            with open(os.path.join(self.root, "freshness.json")) as f:
                return Freshness(**json.load(f).get(profile(roots), {}))
        return Freshness()

    def check(self) -> list[str]:
        """What is wrong with the current snapshot: tables that are missing, unreadable or of another length."""
        folder, wrong = self.current(), []
        if folder is None:
            return ["no snapshot"]
        for name, rows in self.manifest(folder)["rows"].items():
            try:
                n = self.table(name).count()
                wrong += [f"{name}: {n} rows, the manifest has {rows}"] if n != rows else []
            except Exception as e:  # noqa: BLE001 - any unreadable table is a finding
                wrong.append(f"{name}: {type(e).__name__}")
        return wrong

    # writing

    @contextlib.contextmanager
    def lock(self, seconds: float = LOCK_SECONDS) -> Iterator[None]:
        os.makedirs(self.root, exist_ok=True)
        with open(os.path.join(self.root, ".lock"), "w") as f:
            until = time.monotonic() + seconds
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except OSError:
                    if time.monotonic() >= until:
                        raise Busy(self.root) from None
                    time.sleep(0.05)
            yield

    def lock_is_free(self) -> bool:
        """Whether the writers' lock can be had at once."""
        try:
            with self.lock(0.0):
                return True
        except (Busy, OSError):
            return False

    def refresh(self, roots: list[str], now_ms: int, force: bool = False, background: bool = False) -> Stats:
        """Bring the snapshot up to date with the roots, at most every THROTTLE_MS unless forced; in background not at all while another writes."""
        try:
            with self.lock(0.0 if background else LOCK_SECONDS):
                fresh = self.freshness(roots)
                if not force and now_ms - fresh.attempted_ms < THROTTLE_MS:
                    return Stats(skipped=True)
                fresh.attempted_ms, fresh.roots = now_ms, sorted(roots)
                try:
                    with temporary():
                        stats = self._sync(discover(self.spark, roots), now_ms)
                    fresh.succeeded_ms, fresh.error = now_ms, ""
                    return stats
                except Exception as e:
                    fresh.error = f"{type(e).__name__}: {e}".splitlines()[0][:200]
                    raise
                finally:
                    self._note(roots, fresh)
        except Busy:
            if background:
                return Stats(skipped=True)
            raise

    def rebuild(self, roots: list[str], now_ms: int, session: str = "") -> Stats:
        """Read everything again; with a session only its files. Without one the store starts clean. Missing roots are ignored."""
        with self.lock():
            if not session:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(os.path.join(self.root, "CURRENT"))
            with temporary():
                return self._sync(discover(self.spark, roots, session), now_ms, every=True)

    def _note(self, roots: list[str], fresh: Freshness) -> None:
        path, every = os.path.join(self.root, "freshness.json"), {}
        with contextlib.suppress(FileNotFoundError):
            with open(path) as f:
                every = json.load(f)
        self._replace(path, json.dumps({**every, profile(roots): fresh.__dict__}))

    @staticmethod
    def _replace(path: str, text: str) -> None:
        with open(path + ".new", "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(path + ".new", path)

    def _sync(self, files: DataFrame, now_ms: int, every: bool = False) -> Stats:
        known = self.table("files")
        todo = files if every else changed(files, known)
        listed = materialize(todo.select("path", "mtime_ms", "size"), "changed")
        n = listed.count()
        if not n and self.current():
            return Stats()
        old = {name: self.table(name) for name in S.TABLES}
        last = old["messages"].agg(F.max("seq")).first()[0]
        first = 0 if last is None else (last >> LINE_BITS) + 1
        new = build_tables(self.spark, parse(todo), first)
        new["files"] = listed
        tables = merge(old, new)
        rows = self._write(tables, now_ms)
        return Stats(files=n, messages=new["messages"].count() if rows["messages"] else 0)

    def _write(self, tables: dict[str, DataFrame], now_ms: int) -> dict[str, int]:
        current = self.current()
        number = int(os.path.basename(current)[1:]) + 1 if current else 1
        while os.path.exists(folder := os.path.join(self.root, f"v{number:06d}")):
            number += 1
        rows = {}
        for name, df in tables.items():
            want = [F.col(f.name).cast(f.dataType).alias(f.name) for f in S.parse(S.TABLES[name]).fields]
            out = os.path.join(folder, f"{name}.parquet")
            df = df.select(*want)
            if name == "messages":  # sorted files let scans skip sessions and times by their statistics
                df = df.repartitionByRange("session_id", "ts_ms").sortWithinPartitions("session_id", "ts_ms")
            df.write.parquet(out)
            rows[name] = self.spark.read.parquet(out).count()
            if name == "messages":
                write_index(self.spark.read.parquet(out), folder)
        write_projections(self.spark, folder, folder)
        self._replace(os.path.join(folder, "manifest.json"), json.dumps({"schema_version": S.SCHEMA_VERSION, "created_ms": now_ms, "rows": rows}))
        self._replace(os.path.join(self.root, "CURRENT"), os.path.basename(folder))
        for name in sorted(x for x in os.listdir(self.root) if x.startswith("v"))[:-KEEP]:
            shutil.rmtree(os.path.join(self.root, name), ignore_errors=True)
        return rows


def merge(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The next snapshot: rows of replaced files (either representation) give way to the new ones.

    Files that have vanished keep their rows. Tool results are paired again for the sessions that lost or got rows.
    """
    gone = new["sessions"].select(stem_path("source_path").alias("__stem")).distinct()

    def kept(df: DataFrame, path: str) -> DataFrame:
        return df.join(gone, stem_path(path) == F.col("__stem"), "left_anti")

    out = {name: kept(old[name], "source_path").unionByName(new[name].select(old[name].columns)) for name in ("messages", "sessions", "events")}
    out["files"] = kept(old["files"], "path").unionByName(new["files"].select(old["files"].columns))
    fresh = new["activities"].select([f.name for f in S.parse(S.ACTIVITIES).fields])
    acts = kept(old["activities"], "record_source_path").join(fresh.select("activity_id"), "activity_id", "left_anti")
    out["activities"] = one_child_owner(acts.unionByName(fresh))
    live = out["messages"].select(F.col("id").alias("message_id"), F.col("seq").alias("__seq"))
    cols = old["tool_invocations"].columns
    same = lambda df: df.join(live, (df.message_id == live.message_id) & (df.seq == live["__seq"]), "left_semi")
    out["tool_invocations"] = same(old["tool_invocations"]).unionByName(new["tool_invocations"].select(cols))
    results = same(old["tool_results"]).unionByName(new["tool_results"].select(old["tool_results"].columns))
    lost = old["messages"].join(gone, stem_path("source_path") == F.col("__stem"), "left_semi").select("session_id")
    touched = materialize(lost.unionByName(new["messages"].select("session_id")).distinct(), "touched")
    again = link_results(out["tool_invocations"].join(touched, "session_id", "left_semi"), results.join(touched, "session_id", "left_semi").drop("invocation_id"))
    out["tool_results"] = results.join(touched, "session_id", "left_anti").unionByName(again.select(results.columns))
    return out
