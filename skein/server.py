"""HTTP on the loopback interface: GET /v1/<query>, POST /v1/refresh and /v1/rebuild, /v1/health and /openapi.json."""

from __future__ import annotations

import ipaddress
import json
import threading
import time
from dataclasses import fields
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from skein import __version__, api

GET = ("last", "search", "read", "sessions", "activities", "activity", "context", "commands", "info", "doctor")
POST = ("refresh", "rebuild")
TIMED = ("last", "search", "context", "commands", "doctor")
ALIASES = {"n": "limit", "q": "pattern", "query": "pattern", "windowHours": "hours", "sessionId": "session", "preview": "length"}


def is_loopback(host: str) -> bool:
    try:
        return host == "localhost" or ipaddress.ip_address(host).is_loopback
    except ValueError:
        return False


def params(query: str) -> api.Params:
    """Parameters of a query string; unknown names, bad numbers and aliases that disagree are refused."""
    known, given = {f.name: f.type for f in fields(api.Params)}, {}
    for name, values in parse_qs(query, keep_blank_values=True).items():
        name = ALIASES.get(name, "".join("_" + c.lower() if c.isupper() else c for c in name).replace("-", "_"))
        if name not in known or name in ("apply", "secrets", "secret_files"):
            raise api.BadRequest(f"unknown parameter {name}")
        v = values[-1]
        if known[name] == "int":
            if not v.isdigit():
                raise api.BadRequest(f"{name} must be a number, not negative")
            v = int(v)
        elif known[name] == "bool":
            if v.lower() not in ("1", "0", "true", "false", ""):
                raise api.BadRequest(f"{name} must be true or false")
            v = v.lower() in ("1", "true", "")
        if name in given and given[name] != v:
            raise api.BadRequest(f"{name} is given twice")
        given[name] = v
    return api.Params(**given)


def openapi() -> dict:
    """A description of the routes."""
    shapes = [{"name": f.name, "in": "query", "schema": {"type": {"int": "integer", "bool": "boolean"}.get(str(f.type), "string")}} for f in fields(api.Params)]
    paths = {f"/v1/{g}": {"get": {"parameters": shapes, "responses": {"200": {"description": "ok"}}}} for g in GET}
    paths |= {f"/v1/{p}": {"post": {"responses": {"200": {"description": "ok"}}}} for p in POST}
    return {"openapi": "3.1.0", "info": {"title": "skein", "version": __version__}, "paths": paths}


class Handler(BaseHTTPRequestHandler):
    service: api.Service
    writing = threading.Lock()

    def log_message(self, *args) -> None:
        pass

    def send(self, status: int, value: dict) -> None:
        raw = json.dumps(value, ensure_ascii=False).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def answer(self, make) -> None:
        try:
            self.send(200, make())
        except Exception as e:  # noqa: BLE001 - every failure becomes a document
            code, status = next(((c, s) for kind, c, s in api.ERRORS if isinstance(e, kind)), ("internal", 500))
            self.send(status, {"version": 1, "error": str(e).splitlines()[0] if str(e) else type(e).__name__, "code": code})

    def do_GET(self) -> None:  # noqa: N802
        url = urlsplit(self.path)
        name, now = url.path.removeprefix("/v1/"), int(time.time() * 1000)
        if url.path == "/openapi.json":
            return self.send(200, openapi())
        if url.path == "/v1/health":
            return self.answer(lambda: {"ok": self.service.store.current() is not None, "version": __version__})
        if name not in GET or not url.path.startswith("/v1/"):
            return self.send(404, {"version": 1, "error": "no such route", "code": "not_found"})

        def make():
            p = params(url.query)
            if name in ("search", "context") and not p.pattern:
                raise api.BadRequest("pattern is missing")
            call = getattr(self.service, name)
            return call(p, now) if name in TIMED else call(p)

        self.answer(make)
        if self.service.store.freshness(self.service.roots).stale(now):
            self.refresh_behind(now)

    def do_POST(self) -> None:  # noqa: N802
        url = urlsplit(self.path)
        name, now = url.path.removeprefix("/v1/"), int(time.time() * 1000)
        if name not in POST or not url.path.startswith("/v1/"):
            return self.send(404, {"version": 1, "error": "no such route", "code": "not_found"})

        def make():
            with self.writing:
                return self.service.refresh(now) if name == "refresh" else self.service.rebuild(now, params(url.query).session)

        self.answer(make)

    def refresh_behind(self, now: int) -> None:
        """One refresh at a time, after the answer; failures are kept in the freshness note."""

        def work() -> None:
            if self.writing.acquire(blocking=False):
                try:
                    self.service.refresh(now, force=False, background=True)
                except Exception:  # noqa: BLE001, S110
                    pass
                finally:
                    self.writing.release()

        threading.Thread(target=work, daemon=True).start()


def make_server(service: api.Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    if not is_loopback(host):
        raise api.BadRequest("only loopback addresses are served")
    return ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"service": service, "writing": threading.Lock()}))


def serve(service: api.Service, host: str, port: int) -> None:
    make_server(service, host, port).serve_forever()
