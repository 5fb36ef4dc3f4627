"""Schemas of the tables, and the version of their layout."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1


def parse(ddl: str) -> T.StructType:
    """A StructType from its DDL."""
    return T.StructType.fromDDL(ddl)


# What the parser brings out of one file.
CALLS = "array<struct<id:string,name:string,arguments:string>>"
RESULTS = "array<struct<id:string,name:string,content:string,is_error:boolean>>"
PARSED_MESSAGES = f"source_path string, line bigint, id string, entry_id string, session_id string, ts_ms bigint, type string, content string, prose string, activity_id string, activity_role string, tool_calls {CALLS}, tool_results {RESULTS}"
EVENTS = (
    "source_path string, session_id string, ord bigint, kind string, entry_id string, parent_id string, ts_ms bigint, activity_id string, parent_activity_id string, session_file string, status string, "
    "started_at bigint, completed_at bigint, title string, description string, activity_kind string, namespace string, model string, effort string, result_summary string, tool_uses int"
)
SESSIONS = "source_path string, session_id string, parent_session string, cwd string, visibility string"
FILES = "path string, mtime_ms bigint, size bigint"

# Tables of a snapshot.
MESSAGES = (
    "seq bigint, id string, entry_id string, source_path string, session_id string, ts_ms bigint, type string, content string, prose string, char_count bigint, prose_char_count bigint, "
    f"activity_id string, activity_role string, tool_calls {CALLS}, tool_results {RESULTS}, content_prefix string, prose_prefix string, content_tokens array<string>, prose_tokens array<string>"
)
ACTIVITIES = (
    "activity_id string, record_source_path string, parent_source_path string, parent_session_id string, parent_activity_id string, child_session_path string, status string, started_at bigint, completed_at bigint, "
    "kind string, namespace string, title string, description string, model string, effort string, result_summary string, tool_uses int, start_entry_id string, start_parent_id string, linked_entry_id string, terminal_entry_id string, terminal_parent_id string"
)
INVOCATIONS = "invocation_id bigint, message_id string, session_id string, tool_id string, tool_name string, arguments string, ts_ms bigint, seq bigint"
TOOL_RESULTS = "result_id bigint, message_id string, session_id string, tool_id string, tool_name string, content string, is_error boolean, ts_ms bigint, seq bigint, invocation_id bigint"
TABLES = {"messages": MESSAGES, "sessions": SESSIONS, "activities": ACTIVITIES, "tool_invocations": INVOCATIONS, "tool_results": TOOL_RESULTS, "events": EVENTS, "files": FILES}
