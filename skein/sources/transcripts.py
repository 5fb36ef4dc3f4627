"""Transcript files (*.jsonl, *.jsonl.zst) to tables."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import schema as S
from skein.functions.text import prefix, stem_tokens
from skein.operators.linking import fold_activities, link_messages, pair_by_id, pair_greedily, reconcile_attached
from skein.session import materialize
from skein.sources.lines import parse_file

PLAIN, PACKED = ".jsonl", ".jsonl.zst"
#: Longest line, in bytes, by representation; a longer one fails its file.
LINE_LIMITS = {PLAIN: 16 << 20, PACKED: 64 << 20}
#: Lines of one file that an order number has room for, and parts of one message.
LINE_BITS, PART_BITS = 24, 10


@dataclass
class Config:
    """Where transcripts are looked for by default."""

    home: str = field(default_factory=lambda: str(Path.home()))
    environment: dict[str, str] = field(default_factory=lambda: dict(os.environ))

    def roots(self) -> list[str]:
        """The existing default roots, sorted."""
        rollout = self.environment.get("CODEX_HOME") or os.path.join(self.home, ".codex")
        every = [os.path.join(self.home, ".claude", "projects"), os.path.join(self.home, ".pi", "agent", "sessions"), os.path.join(rollout, "sessions"), os.path.join(rollout, "archived_sessions")]
        return sorted(p for p in every if os.path.isdir(p))


def stem_path(col: str = "path"):
    """A file's path without the compression suffix; both representations of a file share it."""
    return F.regexp_replace(col, r"\.zst$", "")


def session_name(path: str) -> str:
    name = os.path.basename(path)
    return name.removesuffix(PACKED) if name.endswith(PACKED) else name.removesuffix(PLAIN)


def session_matches(name: str, session: str) -> bool:
    """Whether a file name belongs to a session: equal, or ending in _id or -id."""
    return name == session or name.endswith((f"_{session}", f"-{session}"))


def discover(spark: SparkSession, roots: list[str], session: str = "") -> DataFrame:
    """(path, mtime_ms, size, content) of all transcript files under the roots; a plain file hides its packed twin.

    Missing roots are ignored. content is only read if a later step uses it.
    """
    present = sorted({os.path.abspath(r) for r in roots if os.path.exists(r)})
    if not present:
        return spark.createDataFrame([], "path string, mtime_ms bigint, size bigint, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").load(present)
    files = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), "content")
    files = files.where(F.col("path").endswith(PLAIN) | F.col("path").endswith(PACKED))
    if session:
        name = F.regexp_extract("path", r"([^/]*)\.jsonl(?:\.zst)?$", 1)
        files = files.where((name == session) | name.endswith(f"_{session}") | name.endswith(f"-{session}"))
    plain = files.where(F.col("path").endswith(PLAIN)).select(F.col("path").alias("__twin"))
    return files.join(plain, (stem_path() == F.col("__twin")) & F.col("path").endswith(PACKED), "left_anti")


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files that aren't in the manifest with the same time and size."""
    return files.join(manifest.select("path", "mtime_ms", "size"), ["path", "mtime_ms", "size"], "left_anti")


def read_lines(path: str, content: bytes) -> Iterator[str]:
    """The lines of a file; ValueError at a line over the limit."""
    limit = LINE_LIMITS[PACKED if path.endswith(PACKED) else PLAIN]
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True) if path.endswith(PACKED) else io.BytesIO(content)
    with io.BufferedReader(stream) as lines:
        while line := lines.readline(limit + 1):
            if len(line) > limit and not line.endswith(b"\n"):
                raise ValueError(f"{path}: a line of more than {limit} bytes")
            yield line.decode("utf-8", "replace").rstrip("\r\n")



def _struct(ddl: str) -> str:
    """A table's columns as those of a struct."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = ddl[at:i].strip().split(" ", 1)
            parts.append(f"{name}:{kind}")
            at = i + 1
    return f"struct<{','.join(parts)}>"


def check_numbers(path: str, messages: list[dict]) -> None:
    """ValueError where lines or tool parts outnumber what their numbers have room for, as numbers would be given twice."""
    if messages and messages[-1]["line"] >= 1 << LINE_BITS:
        raise ValueError(f"{path}: more than {1 << LINE_BITS} lines")
    if any(len(m[k]) > 1 << PART_BITS for m in messages for k in ("tool_calls", "tool_results")):
        raise ValueError(f"{path}: more than {1 << PART_BITS} tool parts in one message")


def parse(files: DataFrame) -> DataFrame:
    """(source_path, message, event, session, error): what each file holds, one of the last four a row. One file at a time in memory."""
    message, event = S.PARSED_MESSAGES.replace("source_path string, ", ""), S.EVENTS.replace("source_path string, session_id string, ord bigint, ", "") + ", n int"
    session = S.SESSIONS.replace("source_path string, ", "")
    out = f"source_path string, message {_struct(message)}, event {_struct(event)}, session {_struct(session)}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    messages, events, s = parse_file(read_lines(path, content), session_name(path))
                    check_numbers(path, messages)
                    rows = [(path, m, None, None, None) for m in messages] + [(path, None, {**e, "n": i}, None, None) for i, e in enumerate(events)]
                    rows.append((path, None, None, s.__dict__, None))
                except (ValueError, zstandard.ZstdError) as e:
                    rows = [(path, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["source_path", "message", "event", "session", "error"])

    return files.select("path", "content").mapInPandas(run, out)


class ParseError(RuntimeError):
    """A file that can't be read; nothing of the run is kept."""


def file_numbers(spark: SparkSession, paths: DataFrame, first: int = 0) -> DataFrame:
    """(source_path, file_no) in order of path, counted by partition and not in one task."""
    ordered = paths.select("source_path").distinct().orderBy("source_path")
    return ordered.rdd.zipWithIndex().map(lambda x: (x[0].source_path, x[1] + first)).toDF("source_path string, file_no bigint")


def unique_ids(messages: DataFrame) -> DataFrame:
    """messages with ids made unique: the first keeps its id, others get a part of their path's hash, then a number.

    Only rows whose id is taken go through the window, which is over (id, file) and so never larger than a file.
    """
    m = messages.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.lit("message")))
    first = m.groupBy("id").agg(F.min("seq").alias("__first"), F.count("*").alias("__n"))
    many = first.where(F.col("__n") > 1).select("id", "__first")
    twice = m.join(many, "id").where(F.col("seq") != F.col("__first"))
    k = F.row_number().over(Window.partitionBy("id", "source_path").orderBy("seq"))
    again = twice.withColumn("__k", k).select("seq", F.concat("id", F.lit(":"), F.substring(F.sha2("source_path", 256), 1, 12), F.when(F.col("__k") > 1, F.concat(F.lit(":"), F.col("__k").cast("string"))).otherwise("")).alias("__id"))
    return m.join(again, "seq", "left").withColumn("id", F.coalesce("__id", "id")).drop("__id").select(messages.columns)


def build_tables(spark: SparkSession, parsed: DataFrame, first_file: int = 0) -> dict[str, DataFrame]:
    """The tables of the parsed files; their order numbers begin at first_file."""
    parsed = materialize(parsed, "parsed")
    bad = parsed.where(F.col("error").isNotNull()).select("error").limit(1).collect()
    if bad:
        raise ParseError(bad[0].error)
    numbers = materialize(file_numbers(spark, parsed, first_file), "files")
    order = lambda n: F.col("file_no") * (1 << LINE_BITS) + F.col(n)
    own = parsed.where(F.col("session").isNotNull()).select("source_path", "session.*")
    events = parsed.where(F.col("event").isNotNull()).select("source_path", "event.*").join(own.select("source_path", "session_id"), "source_path").join(numbers, "source_path").withColumn("ord", order("n"))
    events = materialize(events.select([f.name for f in S.parse(S.EVENTS).fields]), "events")
    m = parsed.where(F.col("message").isNotNull()).select("source_path", "message.*").join(numbers, "source_path").withColumn("seq", order("line")).drop("line", "file_no")
    m = link_messages(unique_ids(materialize(m, "rows")), events)
    m = m.withColumns({
        "char_count": F.octet_length("content").cast("bigint"), "prose_char_count": F.octet_length("prose").cast("bigint"), "content_prefix": prefix("content"), "prose_prefix": prefix("prose"),
        "content_tokens": stem_tokens("content"), "prose_tokens": stem_tokens("prose"),
    }).select([f.name for f in S.parse(S.MESSAGES).fields])
    m = materialize(m, "messages")
    activities = reconcile_attached(own, fold_activities(events))
    return {"messages": m, "sessions": own, "activities": one_child_owner(activities), "events": events, **tool_tables(m)}


def one_child_owner(activities: DataFrame) -> DataFrame:
    """activities with at most one for each child path: the one that started last, the larger id among equals."""
    named = F.coalesce("child_session_path", F.lit("")) != ""
    best = activities.where(named).groupBy("child_session_path").agg(F.max_by("activity_id", F.struct(F.coalesce("started_at", F.lit(0)), "activity_id")).alias("activity_id"))
    return activities.where(~named).unionByName(activities.where(named).join(best, ["child_session_path", "activity_id"], "left_semi"))


def tool_tables(messages: DataFrame) -> dict[str, DataFrame]:
    """tool_invocations, and tool_results linked to them, from the messages' arrays."""
    number = F.col("seq") * (1 << PART_BITS) + F.col("pos")
    calls = messages.select("id", "session_id", "ts_ms", "seq", F.posexplode("tool_calls").alias("pos", "c")).select(
        number.alias("invocation_id"), F.col("id").alias("message_id"), "session_id", F.col("c.id").alias("tool_id"), F.col("c.name").alias("tool_name"), F.col("c.arguments").alias("arguments"), "ts_ms", "seq"
    )
    results = messages.select("id", "session_id", "ts_ms", "seq", F.posexplode("tool_results").alias("pos", "r")).select(
        number.alias("result_id"), F.col("id").alias("message_id"), "session_id", F.col("r.id").alias("tool_id"), F.col("r.name").alias("tool_name"), F.col("r.content").alias("content"), F.col("r.is_error").alias("is_error"), "ts_ms", "seq"
    )
    return {"tool_invocations": calls, "tool_results": link_results(calls, results)}


def link_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """results with invocation_id: by tool id where there is one, else greedily."""
    links = pair_by_id(calls, results).unionByName(pair_greedily(calls, results))
    return results.join(links, "result_id", "left").select([f.name for f in S.parse(S.TOOL_RESULTS).fields])
