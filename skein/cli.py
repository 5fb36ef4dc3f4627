"""Command line: python -m skein.cli COMMAND [PATTERN or ID] [flags]. Exit codes: 0 done, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
import time
from dataclasses import fields

from skein import api
from skein.functions.render import json_line, text

COMMANDS = ("last", "search", "read", "sessions", "activities", "activity", "context", "commands", "info", "doctor", "redact", "refresh", "rebuild", "serve")
NEEDS_PATTERN, NEEDS_ID, MAY_HAVE_PATTERN = ("search", "context"), ("read", "activity"), ("sessions", "commands", "last")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("subject", nargs="?", default="", help="pattern, id or number")
    p.add_argument("--store", default=os.path.expanduser("~/.cache/skein"))
    p.add_argument("--root", action="append", help="folder with transcripts; may be repeated")
    p.add_argument("--text", action="store_true", help="for people instead of JSON")
    p.add_argument("--format", choices=("json", "text"), default="json")
    p.add_argument("--include-current", action="store_true", help="also find what the session that asks has said")
    p.add_argument("--hits", type=int, default=None, help="hits that context expands")
    p.add_argument("--include-output", action="store_true", help="outputs of the commands found")
    p.add_argument("--preview-length", type=int, default=None)
    p.add_argument("--background", action="store_true", help="refresh only if that is due and no one else writes")
    p.add_argument("--refresh", action="store_true", help="bring the snapshot up to date first")
    p.add_argument("--window-hours", type=int, default=None)
    p.add_argument("--port", type=int, default=8377)
    p.add_argument("--host", default="127.0.0.1")
    for f in fields(api.Params):
        if f.name in ("pattern", "id"):
            continue
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            p.add_argument(flag, action="store_true")
        elif f.type == "int":
            p.add_argument(flag, type=int, default=None if f.name == "since_hours" else f.default)
        elif f.name == "secret_files":
            p.add_argument("--secret-file", dest="secret_files", action="append", default=[])
        else:
            p.add_argument(flag, default=f.default)
    return p


def params(a: argparse.Namespace) -> api.Params:
    """Checked parameters, before anything is opened."""
    given = {f.name: getattr(a, f.name) for f in fields(api.Params) if hasattr(a, f.name)}
    given["since_hours"] = next(h for h in (given["since_hours"], a.hours if a.command in ("redact", "doctor") and a.hours else None, api.Params.since_hours) if h is not None)
    if a.command in ("redact", "doctor"):
        given["hours"] = 0
    if a.hits is not None:
        given["limit"] = a.hits
    if a.preview_length is not None:
        given["length"] = a.preview_length
    given["output"] = given["output"] or a.include_output
    for name in ("limit", "before", "after"):
        if given[name] < -1:
            raise api.BadRequest(f"{name} must not be negative")
    if a.window_hours is not None:
        if a.hours and a.hours != a.window_hours:
            raise api.BadRequest("--hours and --window-hours disagree")
        given["hours"] = a.window_hours
    if a.command in NEEDS_PATTERN + NEEDS_ID and not a.subject:
        raise api.BadRequest(f"{a.command} needs a pattern or id")
    if a.command == "last" and a.subject:
        if not a.subject.isdigit():
            raise api.BadRequest("last takes a number")
        given["limit"] = int(a.subject)
    elif a.command in NEEDS_ID:
        given["id"] = a.subject
    else:
        given["pattern"] = a.subject
    if a.command in ("search", "context", "commands", "sessions") and not a.include_current and not given["exclude_session"] and not given["session"]:
        given["exclude_session"] = api.current_session()
    return api.Params(**given)


#: Commands that answer from the snapshot as it is and have it brought up to date behind the answer.
ANSWERS = ("last", "search", "read", "sessions", "activities", "activity", "context", "commands")


def refresher(store: str, roots: list[str]) -> list[str]:
    """The command that refreshes a store on its own, unless it is fresh or another one writes."""
    return [sys.executable, "-m", "skein.cli", "refresh", "--background", "--store", os.path.abspath(store), *(x for r in roots for x in ("--root", os.path.abspath(r)))]


def run(argv: list[str], out=sys.stdout, err=sys.stderr, spark=None, now_ms: int | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        p = params(a)
    except api.BadRequest as e:
        print(f"skein: {e}", file=err)
        return 2
    now, own = int(time.time() * 1000) if now_ms is None else now_ms, spark is None
    try:
        if own:
            from skein.session import local_session

            spark = local_session("skein-cli")
        service = api.Service(spark, a.store, a.root)
        if a.command == "serve":
            from skein.server import serve

            serve(service, a.host, a.port)
            return 0
        if a.refresh or (a.command not in ("refresh", "rebuild", "doctor") and service.store.current() is None):
            service.refresh(now, force=a.refresh)
        timed = {"last", "search", "context", "commands", "doctor", "redact"}
        call = getattr(service, a.command)
        value = call(now, session=p.session) if a.command == "rebuild" else call(now, force=not a.background, background=a.background) if a.command == "refresh" else call(p, now) if a.command in timed else call(p)
        out.write(text(value) if a.text or a.format == "text" else json_line(value) + "\n")
        if own and a.command in ANSWERS and service.store.freshness(service.roots).stale(now):
            out.flush()
            subprocess.Popen(refresher(a.store, service.roots), stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
        return 0
    except api.ERRORS[1][0] as e:
        print(f"skein: bad query: {e}", file=err)
        return 2
    except Exception as e:  # noqa: BLE001 - reported to the caller
        print(f"skein: {type(e).__name__}: {e}".splitlines()[0], file=err)
        return 1


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
