"""Responses as JSON lines or as text for people."""

from __future__ import annotations

import json
from typing import Any

from skein.functions.text import sanitize


def json_line(value: Any) -> str:
    """One line of JSON in which <, > and & are written as escapes."""
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")


def text(value: dict[str, Any]) -> str:
    """A response as lines of labels and values; bodies are indented and keep their layout, control characters are shown."""
    out: list[str] = []

    def put(label: str, v: Any) -> None:
        if v not in (None, "", [], {}):
            out.append(f"{label}: {sanitize(', '.join(map(str, v)) if isinstance(v, list) else str(v))}")

    for name in ("hits", "results", "sessions", "activities", "commands", "sources"):
        for i, item in enumerate(value.get(name) or [], 1):
            out.append(f"[{name[:-1] if name != 'activities' else 'activity'} {i}]")
            for k, v in item.items():
                if k in ("content", "output", "preview") and v:
                    out.append(f"{k}:")
                    out.extend("  " + line for line in sanitize(str(v), True).split("\n"))
                else:
                    put(k, v)
            out.append("")
    for k, v in value.items():
        if not isinstance(v, (list, dict)):
            put(k, v)
    if value.get("relaxed"):
        out.append("note: no message has all terms; these have any of them")
    if value.get("truncated"):
        out.append("note: there are more results")
    if (value.get("budget") or {}).get("hit"):
        b = value["budget"]
        out.append(f"note: the budget of {b['limit']} characters dropped {b['dropped']} and shortened {b['shrunk']} results")
    return "\n".join(out).rstrip() + "\n"
