"""Transcript files to snapshots: parsing, ids, links, refresh."""

import json

import pytest
import zstandard

from skein.sources.lines import Raw, millis, parse_file
from skein.sources.store import Store
from skein.sources.transcripts import ParseError, session_matches

T0 = "2026-08-25T00:00:0{}Z"


def j(**kw):
    return json.dumps(kw)


def plain(n, uuid, content, session="session-a", kind="user", **kw):
    return j(type=kind, uuid=uuid, sessionId=session, timestamp=T0.format(n), message={"content": content}, **kw)


def test_raw_keeps_text():
    m = Raw.of('{"a": {"x":1.00},  "b" : ["y", {"z": "\\u0041"}] }').members()
    assert m["a"].text == '{"x":1.00}' and [i.text for i in m["b"].items()] == ['"y"', '{"z": "\\u0041"}']
    with pytest.raises(ValueError):
        Raw.of("{} x")


def test_times():
    assert millis("1970-01-01T00:00:01.123456789Z") == 1123 and millis("1970-01-01T02:00:00+02:00") == 0
    assert millis("yesterday") is None and millis("1970-01-01 00:00:00Z") is None


def test_plain_envelope():
    call = {"type": "tool_use", "id": "tool-1", "name": "Bash", "input": {"command": "docker compose up"}}
    lines = [plain(1, "call", [call, {"type": "text", "text": " hi "}, {"type": "thinking", "thinking": "hm"}, {"type": "new"}], kind="assistant"), "", "{bad", plain(2, "empty", "  "), j(uuid=1, type="user")]
    messages, events, session = parse_file(lines, "f")
    assert [m["id"] for m in messages] == ["session-a:call"] and session.session_id == "session-a" and not events
    m = messages[0]
    assert m["content"] == '[tool: Bash] {"command": "docker compose up"}\nhi\nhm' and m["prose"] == "hi" and m["tool_calls"][0]["name"] == "Bash"


def test_header_envelope_and_events():
    lines = [
        j(type="session", id="s1", cwd="/w", parentSession="/p.jsonl", visibility="attached", timestamp=T0.format(0)),
        j(type="message", id="m1", timestamp=T0.format(1), message={"role": "toolResult", "toolCallId": "t", "toolName": "Read", "content": [{"type": "text", "text": "body"}]}),
        j(type="custom", customType="pi:activity-started", id="e1", parentId="m1", timestamp=T0.format(2), data={"activityId": "a", "kind": "subagent", "title": "T"}),
        j(type="custom", customType="pi:activity-terminal", id="e2", timestamp=T0.format(3), data={"activityId": "a", "status": "completed", "toolUses": 3}),
        j(type="custom", customType="pi-remote:jev-model-choice", id="c", timestamp=T0.format(4), data={"activityId": "a", "outcome": "jev", "model": "m", "thinking": "low", "confidence": 0.5}),
        j(type="user", id="q", timestamp=T0.format(5), content="<task-notification><task-id>t9</task-id><status>completed</status><summary>ok</summary></task-notification>"),
    ]
    messages, events, session = parse_file(lines, "2026_s1")
    assert session.visibility == "attached" and [m["id"] for m in messages] == ["s1:m1", "s1:c"]
    assert messages[0]["prose"] == "" and messages[0]["tool_results"][0] == {"id": "t", "name": "Read", "content": "body", "is_error": False}
    assert messages[1]["prose"] == "Jev model choice: Jev selected m at low effort; Jev confidence: 50%; activity id: a"
    assert [(e["kind"], e["activity_id"]) for e in events] == [("started", "a"), ("terminal", "a"), ("task-notification", "t9")]


def test_rollout_envelope():
    say = lambda n, role, text: j(type="response_item", timestamp=T0.format(n), payload={"type": "message", "role": role, "content": [{"type": "input_text", "text": text}]})
    lines = [
        j(type="session_meta", payload={"id": "r1", "cwd": "/w"}),
        say(1, "user", "<ctx>## My request for Codex: fix it"),
        j(type="event_msg", timestamp=T0.format(1), payload={"type": "user_message", "message": "fix it"}),
        j(type="event_msg", timestamp=T0.format(2), payload={"type": "agent_message", "message": "done"}),
        say(2, "assistant", "done"),
        say(3, "assistant", "again"),
        say(4, "assistant", "again"),
        say(5, "developer", "secret rules"),
        j(type="response_item", timestamp=T0.format(6), payload={"type": "function_call", "call_id": "c1", "name": "shell", "arguments": '{"a":1}'}),
        j(type="response_item", timestamp=T0.format(7), payload={"type": "function_call_output", "call_id": "c1", "output": "boom", "status": "failed"}),
        j(type="turn_context", id="x", timestamp=T0.format(8), payload={"text": "no"}),
        j(type="response_item", payload={"type": "message", "role": "user", "content": "no time"}),
    ]
    messages, _, session = parse_file(lines, "rollout-1")
    assert session.session_id == "r1" and session.cwd == "/w"
    assert [m["prose"] for m in messages] == ["fix it", "done", "again", "again", "", ""]
    assert messages[4]["content"] == '[tool: shell] {"a":1}' and messages[5]["tool_results"][0]["is_error"] and messages[0]["id"].startswith("codex-")


def test_session_matches():
    assert session_matches("x_id", "id") and session_matches("x-id", "id") and session_matches("id", "id") and not session_matches("xid", "id")


def test_snapshot_refresh(spark, tmp_path):
    root, store = tmp_path / "t", Store(spark, str(tmp_path / "s"))
    root.mkdir()
    use = {"type": "tool_use", "id": "tool-1", "name": "Bash", "input": {"c": 1}}
    out = {"type": "tool_result", "tool_use_id": "tool-1", "content": "ok"}
    (root / "a.jsonl").write_text("\n".join([plain(1, "m1", [use]), plain(3, "m2", [out]), plain(4, "m1", "same id")]))
    (root / "b.jsonl.zst").write_bytes(zstandard.compress(plain(5, "m1", "deployed", session="a").encode()))
    stats = store.refresh([str(root), str(tmp_path / "missing")], 1_000_000)
    assert (stats.files, stats.messages) == (2, 4)
    ids = sorted(r.id for r in store.table("messages").collect())
    assert len(set(ids)) == 4 and "session-a:m1" in ids and "a:m1" in ids
    assert {r.invocation_id for r in store.table("tool_results").collect()} == {store.table("tool_invocations").first().invocation_id}
    assert store.refresh([str(root)], 1_000_001, force=False).skipped is False
    assert store.refresh([str(root)], 1_000_002).skipped and not store.check()
    # a later call in another file of the session takes the result over
    (root / "c.jsonl").write_text(plain(2, "m9", [use]))
    assert store.refresh([str(root)], 2_000_000).files == 1
    calls = {r.ts_ms: r.invocation_id for r in store.table("tool_invocations").collect()}
    assert store.table("tool_results").first().invocation_id == calls[max(calls)]
    # the packed twin is replaced by the plain file
    (root / "b.jsonl").write_text(plain(5, "m7", "new", session="a"))
    store.refresh([str(root)], 3_000_000)
    assert {r.source_path.split("/")[-1] for r in store.table("sessions").collect()} == {"a.jsonl", "b.jsonl", "c.jsonl"}
    assert store.table("messages").where("session_id = 'a'").count() == 1
    from skein.operators.retrieve import Corpus, Scope, SearchOptions, search

    c = Corpus(spark, store.current(), stemming=True)
    assert [r.content for r in search(c, SearchOptions("same", scope=Scope())).collect()] == ["same id"]


def test_long_line_fails_the_file(spark, tmp_path, monkeypatch):
    import skein.sources.transcripts as t

    monkeypatch.setitem(t.LINE_LIMITS, ".jsonl", 10)
    (tmp_path / "a.jsonl").write_text("x" * 50)
    with pytest.raises(ValueError):
        list(t.read_lines("a.jsonl", (tmp_path / "a.jsonl").read_bytes()))
    assert issubclass(ParseError, RuntimeError)
