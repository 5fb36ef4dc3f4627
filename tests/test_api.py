"""Budgets, responses, command line and HTTP over one small snapshot."""

import io
import json
import os
import threading
import urllib.error
import urllib.request

import pytest
from hypothesis import given
from hypothesis import strategies as st

from skein import api, cli, server
from skein.session import materialize, temporary
from skein.functions.render import json_line, text
from skein.functions.shape import plan, render, response, water_fill, within_budget

NOW = 1_790_000_000_000


@given(st.lists(st.integers(0, 500), min_size=1, max_size=30), st.integers(1, 3000))
def test_water_fill(natural, budget):
    got = water_fill(natural, budget)
    assert sum(got) <= budget and all(0 <= g <= n for g, n in zip(got, natural))
    if sum(natural) <= budget:
        assert got == natural


def test_plan():
    assert plan([40, 40, 40], 90) == [40, 40] and plan([200] * 10, 1000) == [100] * 10 and plan([4, 500], 204) == [4, 200]
    assert plan([50, 60], 100, full=True) == [50] and plan([500], 100, full=True) == [100] and plan([1, 2], 0) == [1, 2] and plan([], 5) == []
    assert render("abcdef", 4, 6, 6, False) == "abc…" and render("abcdef", 4, 6, 6, True) == "abcd"


def test_within_budget(spark):
    df = spark.createDataFrame([(1, 60), (2, 30), (3, 30), (4, 1)], "r int, n bigint")
    assert [(x.r, x.allowance) for x in within_budget(df, "r", "n", 95).orderBy("r").collect()] == [(1, 60), (2, 30)]
    assert [(x.r, x.allowance) for x in within_budget(df, "r", "n", 50).collect()] == [(1, 50)]


def test_rendering():
    assert json_line({"a": "<b>&"}) == '{"a":"\\u003cb\\u003e\\u0026"}'
    out = text(response([{"id": "m\x1b1", "content": "c", "prose": "p\x07q", "ts_ms": 0, "session_id": "s"}], truncated=True))
    assert "m\\u001b1" in out and "p\\u0007q" in out and "more results" in out


def test_current_session():
    assert api.current_session({"PI_SESSION_ID": "x"}) == "x" and api.current_session({"PI_SESSION_FILE": "/a/2026_b-c.jsonl"}) == "b-c" and api.current_session({}) == ""


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    root, store = tmp_path_factory.mktemp("roots"), tmp_path_factory.mktemp("store")
    line = lambda n, kind, content: json.dumps({"type": kind, "uuid": f"m{n}", "sessionId": "s-1", "cwd": "/w", "timestamp": f"2026-08-25T00:00:{n:02}Z", "message": {"content": content}})
    use = [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "docker compose up"}}]
    res = [{"type": "tool_result", "tool_use_id": "t1", "content": "no such table: messages"}]
    lines = [line(1, "user", "please look at the needle"), line(2, "assistant", use), line(3, "user", res), line(4, "assistant", "the needle was deployed"), line(5, "user", "password = hunter2hunter2 thanks")]
    (root / "s-1.jsonl").write_text("\n".join(lines))
    s = api.Service(spark, str(store), [str(root)])
    s.refresh(NOW)
    return s


def test_service(service):
    hit = service.search(api.Params(pattern="deploy"), NOW)
    assert [r["id"] for r in hit["results"]] == ["m4"] and hit["results"][0]["timestamp"] == "2026-08-25T00:00:04Z"
    assert service.search(api.Params(pattern="needle docker"), NOW)["relaxed"]
    assert [r["id"] for r in service.last(api.Params(limit=2), NOW)["results"]] == ["m5", "m4"]
    assert [r["id"] for r in service.read(api.Params(id="m4", before=1, after=1))["results"]] == ["m1", "m4", "m5"]
    near = service.context(api.Params(pattern="deployed", before=1, after=0, all=True), NOW)
    assert [r["id"] for r in near["results"]] == ["m3", "m4"] and near["hits"][0]["id"] == "m4"
    cmd = service.commands(api.Params(pattern="docker table", output=True), NOW)["commands"]
    assert cmd[0]["arguments"] == {"command": "docker compose up"} and cmd[0]["output"].startswith("no such")
    assert service.sessions(api.Params(pattern="needle"))["sessions"][0]["messageCount"] == 5
    info, doctor = service.info(api.Params(sources=True)), service.doctor(api.Params(), NOW)
    assert info["messageCount"] == 5 and info["indexHealthy"] and info["lockHealthy"] and info["sources"][0]["sessionCount"] == 1 and doctor["ok"] and [c["name"] for c in doctor["checks"]] == ["index", "lock", "roots", "freshness"]
    wide = service.last(api.Params(hours=10**6, budget=80), NOW)
    assert len(wide["results"]) == 2 and wide["budget"]["dropped"] == 1 and wide["truncated"]
    assert service.redact(api.Params(since_hours=0), NOW)["matches"] == 1 and service.redact(api.Params(), NOW)["matches"] == 0  # the last 48 hours
    assert near["query"] == "deployed" and near["totalHits"] == 1
    raw = service.search(api.Params(pattern="needle NOT docker", raw=True), NOW)["results"]
    assert all("needle" in r["preview"] for r in raw)


def test_temporary_keeps_nothing(spark):
    kept = materialize(spark.range(3), "kept")
    with temporary():
        gone = materialize(spark.range(4), "gone")
        assert gone.count() == 4
    path = gone.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 3 and not os.path.exists(path)


def test_command_line(service, spark, monkeypatch):
    monkeypatch.delenv("PI_SESSION_ID", raising=False)
    common = ["--store", service.store.root, "--root", service.roots[0]]

    def run(*argv):
        out, err = io.StringIO(), io.StringIO()
        return cli.run([*argv, *common], out, err, spark, NOW), out.getvalue(), err.getvalue()

    code, out, _ = run("search", "needle", "--limit", "1")
    assert code == 0 and json.loads(out)["truncated"] is True
    assert run("search", "a.b", "--raw")[0] == 2 and run("search")[0] == 2 and run("last", "--hours", "-1")[0] == 2
    assert run("search", "x", "--raw", "--any")[0] == 2 and run("last", "--hours", "1", "--window-hours", "2")[0] == 2 and run("read", "nothing")[0] == 1
    assert "id: m5" in run("last", "1", "--text")[1] and run("last", "1", "--format", "text")[1] == run("last", "1", "--text")[1]
    monkeypatch.setenv("PI_SESSION_ID", "s-1")
    assert json.loads(run("search", "needle")[1])["total"] == 0 and json.loads(run("search", "needle", "--include-current", "--preview-length", "6")[1])["results"][0]["preview"] == "needle"
    assert json.loads(run("context", "needle", "--include-current", "--hits", "1")[1])["totalHits"] == 1
    assert cli.refresher("a", ["b"])[2:5] == ["skein.cli", "refresh", "--background"] and json.loads(run("refresh", "--background")[1])["skipped"]


def test_http(service):
    s = server.make_server(service)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"

    def get(path):
        try:
            with urllib.request.urlopen(base + path, timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert get("/v1/health")[1]["ok"] and get("/v1/search?q=needle&n=5")[1]["total"] == 2 and get("/openapi.json")[1]["openapi"]
    assert get("/v1/search")[0] == 400 and get("/v1/read?id=nothing")[0] == 404 and get("/v1/read?id=m")[0] == 409 and get("/v1/last?limit=-1")[0] == 400 and get("/nowhere")[0] == 404
    s.shutdown()
    with pytest.raises(api.BadRequest):
        server.make_server(service, "0.0.0.0")
