"""Reading the lines of one transcript file: three envelopes of JSON records become messages, events and a session.

The envelopes are told apart line by line: 'rollout' records wrap their content in a payload or item; 'header'
files begin with a session record and wrap messages with a role; 'plain' files repeat the session on every line.
Tool arguments keep the bytes they were written with, so values carry their raw text.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from datetime import datetime
from json.decoder import JSONDecoder, scanstring
from typing import Any

_decode = JSONDecoder().raw_decode
_BLANK = re.compile(r"[ \t\n\r]*")
_STAMP = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?:Z|[+-]\d\d:\d\d)$")


class Raw:
    """A JSON value together with the text it was written as."""

    __slots__ = ("text", "value")

    def __init__(self, text: str, value: Any):
        self.text, self.value = text, value

    @classmethod
    def of(cls, text: str) -> Raw:
        start = _BLANK.match(text).end()
        value, end = _decode(text, start)
        if _BLANK.match(text, end).end() != len(text):
            raise ValueError("text after the value")
        return cls(text[start:end], value)

    def __bool__(self) -> bool:
        return True

    def members(self) -> dict[str, Raw]:
        """An object's members; {} for anything else."""
        out: dict[str, Raw] = {}
        if not isinstance(self.value, dict):
            return out
        t, i = self.text, _BLANK.match(self.text, 1).end()
        while t[i] == '"':
            key, i = scanstring(t, i + 1)
            i = _BLANK.match(t, _BLANK.match(t, i).end() + 1).end()
            value, end = _decode(t, i)
            out[key] = Raw(t[i:end], value)
            i = _BLANK.match(t, end).end()
            if t[i] == ",":
                i = _BLANK.match(t, i + 1).end()
        return out

    def items(self) -> list[Raw]:
        """An array's elements; [] for anything else."""
        out: list[Raw] = []
        if not isinstance(self.value, list):
            return out
        t, i = self.text, _BLANK.match(self.text, 1).end()
        while t[i] != "]":
            value, end = _decode(t, i)
            out.append(Raw(t[i:end], value))
            i = _BLANK.match(t, end).end()
            if t[i] == ",":
                i = _BLANK.match(t, i + 1).end()
        return out


NULL = Raw("null", None)


def millis(stamp: str) -> int | None:
    """Epoch milliseconds, cut, of an RFC 3339 time; None if it isn't one."""
    if not _STAMP.match(stamp):
        return None
    try:
        t = datetime.fromisoformat(stamp.replace(",", "."))
    except ValueError:
        return None
    delta = t - datetime.fromisoformat("1970-01-01T00:00:00+00:00")
    return (delta.days * 86_400 + delta.seconds) * 1000 + delta.microseconds // 1000


def text_of(obj: dict[str, Raw], *keys: str) -> str:
    """The first string among the keys that isn't blank."""
    return next((obj[k].value for k in keys if k in obj and isinstance(obj[k].value, str) and obj[k].value.strip()), "")


@dataclass
class Call:
    id: str = ""
    name: str = ""
    arguments: str = ""

    def rendered(self) -> str:
        return f"[tool: {self.name}]" + (f" {self.arguments}" if self.arguments else "")


@dataclass
class Result:
    id: str = ""
    name: str = ""
    content: str = ""
    is_error: bool = False


@dataclass
class Body:
    """What a record's content comes to."""

    content: str = ""
    prose: str = ""
    calls: list[Call] = field(default_factory=list)
    results: list[Result] = field(default_factory=list)

    def add(self, other: Body) -> Body:
        join = lambda a, b: "\n".join(x for x in (a, b) if x)
        return Body(join(self.content, other.content), join(self.prose, other.prose), self.calls + other.calls, self.results + other.results)


@dataclass
class Session:
    session_id: str = ""
    parent_session: str = ""
    cwd: str = ""
    visibility: str = ""


# --- content of the plain and header envelopes -----------------------------------------------------------------

_BLOCK_STRINGS = ("type", "text", "thinking", "name", "id", "tool_use_id")


def blocks(raw: Raw) -> list[dict[str, Raw]] | None:
    """The content blocks of an array; None if it isn't an array of well-formed blocks."""
    if not isinstance(raw.value, list):
        return None
    out = []
    for item in raw.items():
        if item.value is not None and not isinstance(item.value, dict):
            return None
        b = item.members()
        if any(k in b and not isinstance(b[k].value, (str, type(None))) for k in _BLOCK_STRINGS) or ("is_error" in b and not isinstance(b["is_error"].value, (bool, type(None)))):
            return None
        out.append(b)
    return out


def _s(b: dict[str, Raw], key: str) -> str:
    v = b[key].value if key in b else None
    return v if isinstance(v, str) else ""


def flatten(raw: Raw | None) -> str:
    """Content as one searchable string: strings trimmed, blocks one a line."""
    if raw is None or raw.value is None:
        return ""
    if isinstance(raw.value, str):
        return raw.value.strip()
    return "\n".join(p for p in map(_render, blocks(raw) or []) if p)


def _render(b: dict[str, Raw]) -> str:
    kind = _s(b, "type")
    if kind in ("text", "thinking"):
        return _s(b, kind).strip()
    if kind in ("tool_use", "toolCall"):
        given = b.get("input" if kind == "tool_use" else "arguments")
        return Call(name=_s(b, "name"), arguments=given.text if given else "").rendered()
    return flatten(b.get("content")) if kind == "tool_result" else ""


def spoken(raw: Raw | None) -> str:
    """Only what was said: a string, or the text blocks."""
    if raw is None or raw.value is None:
        return ""
    if isinstance(raw.value, str):
        return raw.value.strip()
    return "\n".join(_s(b, "text") for b in blocks(raw) or [] if _s(b, "type") == "text").strip()


def tools(raw: Raw | None, message: dict[str, Raw]) -> tuple[list[Call], list[Result]]:
    calls, results = [], []
    for b in (blocks(raw) or []) if raw else []:
        kind = _s(b, "type")
        if kind in ("tool_use", "toolCall"):
            given = b.get("input") or b.get("arguments")
            calls.append(Call(_s(b, "id") or _s(b, "tool_use_id"), _s(b, "name"), given.text if given else ""))
        elif kind == "tool_result":
            results.append(Result(_s(b, "tool_use_id"), "", flatten(b.get("content")), bool(b["is_error"].value) if "is_error" in b else False))
    if _s(message, "role") == "toolResult" and (_s(message, "toolCallId") or _s(message, "toolName")):
        results.append(Result(_s(message, "toolCallId"), _s(message, "toolName"), flatten(raw)))
    return calls, results


def _tag(text: str, name: str) -> str:
    m = re.search(rf"<{re.escape(name)}>(.*?)</{re.escape(name)}>", text, re.S)
    return m[1].strip() if m else ""


# --- content of the rollout envelope -----------------------------------------------------------------------------

# The kinds of rollout records and items, and the keys in which their parts are found, in order.
ROLLOUT_TYPES = frozenset("session_meta response_item event_msg turn_context compacted token_count user_message agent_message task_complete".split())
ROLLOUT_ONLY = frozenset("session_meta turn_context compacted token_count event_msg user_message agent_message".split())
CALL_TYPES = frozenset("function_call custom_tool_call local_shell_call shell_call shell_command exec_command mcp_tool_call mcp_call mcp_tool_use tool_search_call web_search_call tool_call tool_use computer_call command_execution".split())
RESULT_TYPES = frozenset("function_call_output custom_tool_call_output local_shell_call_output shell_call_output shell_command_output exec_command_output mcp_tool_call_output mcp_call_output tool_search_output tool_result tool_output command_execution_output".split())
SHELL_TYPES = frozenset("local_shell_call shell_call shell_command exec_command command_execution".split())
MCP_TYPES = frozenset("mcp_tool_call mcp_call mcp_tool_use".split())
THOUGHT_TYPES = frozenset("reasoning summary summary_text".split())
TEXT_KEYS = tuple("text message content output result body stdout stderr error summary summary_text reasoning".split())
ID_KEYS = tuple("call_id callId tool_call_id toolCallId tool_use_id toolUseId id".split())
NAME_KEYS = tuple("name tool_name toolName function_name functionName tool".split())
ARGUMENT_KEYS = tuple("arguments args input parameters action command".split())
OUTPUT_KEYS = tuple("output result content text error".split())
EVENT_KEYS = tuple("message last_agent_message text content output".split())
FAILED = frozenset(("failed", "declined", "incomplete"))
REQUEST_MARK = "## My request for Codex:"


def inner(raw: Raw) -> Raw:
    """The innermost item or payload."""
    obj = raw.members()
    nested = next((obj[k] for k in ("item", "payload") if k in obj and isinstance(obj[k].value, dict) and obj[k].value), None)
    return inner(nested) if nested else raw


def any_text(raw: Raw | None, keys: tuple[str, ...] = TEXT_KEYS) -> str:
    """The first text found in a value: itself, under the usual keys, or in its elements."""
    if raw is None:
        return ""
    if isinstance(raw.value, str):
        return raw.value.strip()
    if isinstance(raw.value, dict):
        obj = raw.members()
        return next((t for t in (any_text(obj.get(k)) for k in keys) if t), "")
    return "\n".join(t for t in map(any_text, raw.items()) if t)


def requested(text: str) -> str:
    """A user's text after the mark that separates it from what the client put in front."""
    return text.partition(REQUEST_MARK)[2].strip() if REQUEST_MARK in text else text.strip()


def raw_string(obj: dict[str, Raw], keys: tuple[str, ...]) -> str:
    hit = next((obj[k] for k in keys if k in obj), None)
    if hit is None:
        return ""
    return hit.value if isinstance(hit.value, str) else hit.text if hit.value is not None else ""


def rollout_call(obj: dict[str, Raw]) -> Call:
    kind = text_of(obj, "type").lower()
    name = text_of(obj, *NAME_KEYS)
    default = "local_shell" if kind in SHELL_TYPES else "mcp_tool" if kind in MCP_TYPES else kind
    arguments = raw_string(obj, ARGUMENT_KEYS)
    if not arguments and "function" in obj:
        function = obj["function"].members()
        arguments = raw_string(function, ("arguments", "args", "input"))
        if not name and default == kind and function:
            default = text_of(function, "name")
    return Call(text_of(obj, *ID_KEYS), name or default, arguments)


def rollout_result(obj: dict[str, Raw]) -> Result:
    out = next((obj[k] for k in OUTPUT_KEYS if k in obj), None)
    content = "" if out is None else out.value if isinstance(out.value, str) else any_text(out) or out.text
    flag = next((obj[k].value for k in ("isError", "is_error") if k in obj and isinstance(obj[k].value, bool)), False)
    failed = flag or "error" in obj or text_of(obj, "status").lower() in FAILED or ("success" in obj and obj["success"].value is False)
    return Result(text_of(obj, *ID_KEYS), text_of(obj, *NAME_KEYS), content, failed)


def rollout_tool(obj: dict[str, Raw]) -> Body:
    kind = text_of(obj, "type").lower()
    if kind in RESULT_TYPES:
        r = rollout_result(obj)
        return Body(content=r.content, results=[r])
    c = rollout_call(obj)
    return Body(content=Call(c.id, c.name or "tool", c.arguments).rendered(), calls=[c])


def rollout_body(raw: Raw | None) -> Body:
    """Content of a rollout item, whatever its shape."""
    if raw is None:
        return Body()
    if isinstance(raw.value, str):
        return Body(raw.value.strip(), raw.value.strip())
    if isinstance(raw.value, list):
        out = Body()
        for item in raw.items():
            out = out.add(rollout_body(item))
        return out
    obj = raw.members()
    kind = text_of(obj, "type").lower()
    if kind in CALL_TYPES or kind in RESULT_TYPES:
        return rollout_tool(obj)
    if kind in THOUGHT_TYPES:
        return Body(content=any_text(raw))
    if "content" in obj:
        return rollout_body(obj["content"])
    text = text_of(obj, "text", "value") or any_text(raw)
    return Body(text, text)


# --- the parser ----------------------------------------------------------------------------------------------------

_STRINGS = ("uuid", "id", "parentId", "sessionId", "timestamp", "type", "cwd", "parentSession", "visibility", "customType")

# Marker records and the limits of their fields, in bytes.
ACTIVITY_MARK = "pi:activity-"
CHOICE_MARK = "pi-remote:jev-model-choice"
CHOICE_LIMITS = {"activityId": 256, "model": 160, "thinking": 40}
FALLBACK_REASONS = frozenset("missing_key no_fallback_candidate single_candidate low_confidence invalid_answer timeout error".split())


class Parser:
    """State of one file: its session, its events, and the rollout texts already said."""

    def __init__(self) -> None:
        self.session = Session()
        self.events: list[dict[str, Any]] = []
        self.rollout = False
        self.said: set[tuple[str, str]] = set()
        self.echoed: set[tuple[str, str]] = set()

    def line(self, text: str) -> dict[str, Any] | None:
        """The message of a line, or None; events and the session are kept aside."""
        try:
            rec = Raw.of(text).members()
        except (ValueError, RecursionError):
            return None
        if not rec or any(k in rec and not isinstance(rec[k].value, (str, type(None))) for k in _STRINGS):
            return None
        kind = _s(rec, "type")
        wrapped = [rec[k] for k in ("payload", "item") if k in rec]
        if kind in ROLLOUT_TYPES or wrapped:
            found = self._rollout(rec, kind, wrapped, text)
            if found or wrapped or kind in ROLLOUT_ONLY:
                return found
        if kind == "session":
            self.session = Session(_s(rec, "id"), _s(rec, "parentSession"), _s(rec, "cwd"), _s(rec, "visibility"))
            return None
        self.session.session_id = self.session.session_id or _s(rec, "sessionId")
        self.session.cwd = self.session.cwd or _s(rec, "cwd")
        return self._choice(rec) or (None if self._event(rec) else self._message(rec))

    def _message(self, rec: dict[str, Raw]) -> dict[str, Any] | None:
        entry, at = _s(rec, "uuid") or _s(rec, "id"), millis(_s(rec, "timestamp"))
        if not entry or at is None:
            return None
        kind, raw, details = _s(rec, "type"), rec.get("content"), rec.get("details")
        message = rec["message"].members() if "message" in rec else {}
        if "content" in message:
            raw, details = message["content"], message.get("details")
            if kind == "message":
                kind = _s(message, "role")
        content = flatten(raw)
        if not content:
            return None
        calls, results = tools(raw, message)
        named = details.members() if details else {}
        agent = _s(named, "agentId") or (_s(named, "id") if _s(rec, "type") == "custom_message" and _s(rec, "customType") == "subagent-notification" else "")
        return self._row(entry, _s(rec, "sessionId") or self.session.session_id, at, kind, content, "" if kind == "toolResult" else spoken(raw), calls, results, agent, "response" if agent else "")

    @staticmethod
    def _row(entry, session, at, kind, content, prose, calls=(), results=(), activity="", role="") -> dict[str, Any]:
        return {"id": entry, "entry_id": entry, "session_id": session, "ts_ms": at, "type": kind, "content": content, "prose": prose, "activity_id": activity, "activity_role": role, "tool_calls": [c.__dict__ for c in calls], "tool_results": [r.__dict__ for r in results]}

    def _choice(self, rec: dict[str, Raw]) -> dict[str, Any] | None:
        """A model-choice marker as a message of its decision only."""
        if _s(rec, "type") != "custom" or _s(rec, "customType") != CHOICE_MARK or not _s(rec, "id"):
            return None
        d = rec["data"].value if "data" in rec and isinstance(rec["data"].value, dict) else {}
        at, get = millis(_s(rec, "timestamp")), lambda k: d.get(k) or ""
        if at is None or any(not isinstance(get(k), str) or len(get(k).encode()) > n for k, n in CHOICE_LIMITS.items()) or not get("model") or not get("thinking"):
            return None
        outcome, sure, reason = d.get("outcome"), d.get("confidence"), get("reason")
        if sure is not None and (isinstance(sure, bool) or not isinstance(sure, (int, float)) or not 0 <= sure <= 1):
            return None
        if not (outcome == "jev" and sure is not None and not reason or outcome == "fallback" and reason in FALLBACK_REASONS):
            return None
        verb = "Jev selected" if outcome == "jev" else "fallback to"
        parts = [f"Jev model choice: {verb} {d['model']} at {d['thinking']} effort"]
        if outcome == "fallback":
            parts.append("fallback reason: " + reason.replace("_", " "))
        if sure is not None:
            parts.append(f"Jev confidence: {sure * 100:.0f}%")
        if get("activityId"):
            parts.append("activity id: " + d["activityId"])
        prose = "; ".join(parts)
        return self._row(_s(rec, "id"), self.session.session_id or _s(rec, "sessionId"), at, "custom", prose, prose, activity=get("activityId"))

    def _event(self, rec: dict[str, Raw]) -> bool:
        """Keep a record that tells of an activity; whether it was one."""
        kind, custom, at = _s(rec, "type"), _s(rec, "customType"), millis(_s(rec, "timestamp"))
        if kind in ("queue-operation", "user", "custom_message"):
            message = rec.get("message")
            text = flatten(message.members().get("content") if message else rec.get("content"))
            task = _tag(text, "task-id") if "<task-notification>" in text else ""
            if task and at is not None:
                status, summary = _tag(text, "status") or "running", _tag(text, "summary")
                self._keep("task-notification", _s(rec, "uuid") or _s(rec, "id") or task, _s(rec, "parentId"), at, activity_id=task, status=status, started_at=at, completed_at=0 if status == "running" else at,
                           title=summary, description=_tag(text, "output-file"), activity_kind="task", namespace="claude", result_summary=summary)
                return True
        name = custom.removeprefix(ACTIVITY_MARK)
        if kind != "custom" or not custom.startswith(ACTIVITY_MARK) or name not in ("started", "linked", "terminal") or at is None:
            return False
        d = rec["data"].value if "data" in rec and isinstance(rec["data"].value, dict) else {}
        strings = {"activity_id": "activityId", "parent_activity_id": "parentActivityId", "session_file": "sessionFile", "status": "status", "title": "title", "description": "description", "activity_kind": "kind", "namespace": "namespace", "model": "model", "effort": "effort", "result_summary": "resultSummary"}
        numbers = {"started_at": "startedAt", "completed_at": "completedAt", "tool_uses": "toolUses"}
        fields = {k: d.get(v) or "" for k, v in strings.items()} | {k: d.get(v) or 0 for k, v in numbers.items()}
        if not fields["activity_id"] or any(not isinstance(fields[k], str) for k in strings) or any(not isinstance(fields[k], int) for k in numbers):
            return False
        fields["started_at"] = fields["started_at"] or at
        if name == "terminal":
            fields["completed_at"] = fields["completed_at"] or at
        self._keep(name, _s(rec, "id"), _s(rec, "parentId"), at, **fields)
        return True

    def _keep(self, kind: str, entry: str, parent: str, at: int, **fields: Any) -> None:
        empty = {"parent_activity_id": "", "session_file": "", "model": "", "effort": "", "tool_uses": 0}
        self.events.append({**empty, "kind": kind, "entry_id": entry, "parent_id": parent, "ts_ms": at, **fields})

    # rollout records

    def _rollout(self, rec: dict[str, Raw], kind: str, wrapped: list[Raw], line: str) -> dict[str, Any] | None:
        self.rollout = True
        self.session.session_id = self.session.session_id or _s(rec, "sessionId")
        self.session.cwd = self.session.cwd or _s(rec, "cwd")
        raw = wrapped[0] if wrapped else rec.get("message", NULL)
        if kind == "session_meta":
            meta = inner(raw).members()
            meta = meta["session_meta"].members() if "session_meta" in meta else meta
            s = self.session
            s.session_id = text_of(meta, "id", "session_id", "sessionId") or s.session_id
            s.cwd = text_of(meta, "cwd", "working_directory", "project_root") or s.cwd
            s.parent_session = text_of(meta, "parent_session", "parentSession") or s.parent_session
            return None
        if kind in ("response_item", "message", "response"):
            return self._item(rec, inner(raw), line)
        if kind in ("event_msg", "user_message", "agent_message", "task_complete"):
            return self._echo(rec, inner(raw), kind, line)
        return None

    def _item(self, rec: dict[str, Raw], item: Raw, line: str) -> dict[str, Any] | None:
        """A canonical item: a spoken message, a tool record, or an older textual form."""
        obj = item.members()
        if not obj:
            text = any_text(item)
            return self._say(rec, item, "assistant", Body(text, text), line)
        kind, role = text_of(obj, "type").lower(), text_of(obj, "role").lower()
        if role in ("user", "assistant") and (kind in ("", "message") or "content" in obj or "text" in obj):
            body = rollout_body(obj.get("content"))
            if not body.content:
                text = text_of(obj, "text", "message")
                body = Body(text, text, body.calls, body.results)
            key = (role, requested(body.prose) if role == "user" else body.prose.strip())
            return None if body.prose and key in self.echoed else self._say(rec, item, role, body, line)
        if kind in CALL_TYPES or kind in RESULT_TYPES:
            body = rollout_tool(obj)
            return self._say(rec, item, "assistant", Body(body.content, "", body.calls, body.results), line)
        if role:
            return None
        text = any_text(item)
        return self._say(rec, item, "assistant", Body(text, "" if kind in THOUGHT_TYPES else text), line)

    def _echo(self, rec: dict[str, Raw], raw: Raw, kind: str, line: str) -> dict[str, Any] | None:
        """An event that mirrors a message; kept only if neither it nor the message came before."""
        obj = raw.members()
        if "event" in obj:
            raw, obj = obj["event"], obj["event"].members()
        told = text_of(obj, "type", "event_type").lower() or kind.lower().removesuffix("_message")
        role = "user" if told in ("user_message", "user") else "assistant" if told in ("agent_message", "assistant", "assistant_message", "task_complete") else ""
        text = next((t for t in (any_text(obj.get(k)) for k in EVENT_KEYS) if t), "") or any_text(rec.get("message"))
        text = requested(text) if role == "user" else text.strip()
        if not role or not text or (role, text) in self.said or (role, text) in self.echoed:
            return None
        self.echoed.add((role, text))
        return self._say(rec, raw, role, Body(text, text), line)

    def _say(self, rec: dict[str, Raw], item: Raw, role: str, body: Body, line: str) -> dict[str, Any] | None:
        content, prose = body.content.strip(), body.prose.strip()
        if role == "user":
            prose = requested(prose)
        if not content:
            return None
        if prose:
            self.said.add((role, prose))
        obj = item.members()
        at = millis(_s(rec, "timestamp") or text_of(obj, "timestamp", "created_at", "createdAt"))
        if not at:
            return None  # without a time it can't be placed
        entry = text_of(obj, "id", "message_id") or _s(rec, "id") or "codex-" + hashlib.sha256(line.encode()).hexdigest()
        return self._row(entry, _s(rec, "sessionId") or self.session.session_id, at, role, content, prose, body.calls, body.results)


def parse_file(lines, name: str) -> tuple[list[dict[str, Any]], list[dict[str, Any]], Session]:
    """(messages, events, session) of one file in order; name is the file's name without suffixes."""
    parser, messages = Parser(), []
    for n, text in enumerate(lines):
        m = parser.line(text)
        if m is None:
            continue
        own = m["session_id"]
        if own and own != name and not parser.rollout:
            m["id"] = f"{own}:{m['id']}"
        m["session_id"] = own or name
        messages.append({**m, "line": n})
    parser.session.session_id = parser.session.session_id or name
    return messages, parser.events, parser.session
