"""Fitting results into a budget of characters, and response documents."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import clip, preview_text

#: Fields that a result only has where they say something, with their columns.
LINKS = (("activityId", "activity_id"), ("activityRole", "activity_role"), ("parentActivityId", "parent_activity_id"), ("parentSessionId", "parent_session_id"), ("childSessionId", "child_session_id"), ("hitIds", "hit_ids"))
MIN_PREVIEW, DEFAULT_BUDGET, COMPACT = 40, 60_000, 512


@dataclass(frozen=True)
class Budget:
    """What a budget did to a page."""

    limit: int = 0
    dropped: int = 0
    shrunk: int = 0

    @property
    def hit(self) -> bool:
        return bool(self.dropped or self.shrunk)


def water_fill(natural: list[int], budget: int) -> list[int]:
    """Shares of a budget: everyone gets what they need up to one level, the highest that the budget allows; what is over
    after that goes to the last ones above the level, one each."""
    low, high = 0, max(natural, default=0)
    while low < high:
        level = (low + high + 1) // 2
        low, high = (level, high) if sum(min(n, level) for n in natural) <= budget else (low, level - 1)
    out = [min(n, low) for n in natural]
    over = budget - sum(out)
    above = sorted((i for i, n in enumerate(natural) if n > low), key=lambda i: natural[i])
    for i in above[len(above) - min(over, len(above)) :] if over > 0 else ():
        out[i] += 1
    return out


def plan(natural: list[int], budget: int, full: bool = False) -> list[int]:
    """The allowance of each result that is kept, in order.

    Previews: as many as get MIN_PREVIEW each (one at least), filled like water. Full bodies: whole ones in order
    while they fit; the first is cut rather than dropped. A budget of 0 or less is none.
    """
    if budget <= 0 or not natural:
        return list(natural)
    if not full:
        keep = max(1, min(len(natural), budget // MIN_PREVIEW))
        return water_fill(natural[:keep], budget)
    kept, spent = [], 0
    for n in natural:
        if spent + n > budget:
            break
        kept.append(n)
        spent += n
    return kept or [budget]


def most_rows(budget: int, full: bool) -> int:
    """More results than this never fit into a budget; 0 where there is none."""
    return 0 if budget <= 0 else budget + 1 if full else budget // MIN_PREVIEW + 1


def render(body: str, allowance: int, natural: int, length: int, full: bool) -> str:
    """A body within its allowance; shrinking leaves room for the …"""
    if allowance >= natural:
        return body if full else preview_text(body, length)
    return clip(body, allowance) if full else preview_text(body, max(2, allowance) - 1)


def within_budget(page: DataFrame, rank: str, size: str, budget: int) -> DataFrame:
    """The rows of a bounded page whose bodies fit in order, as plan() keeps them with full bodies, with a column allowance."""
    spent = F.sum(size).over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.row_number().over(Window.orderBy(rank)) == 1
    return page.withColumns({"__spent": spent, "__first": first}).where((F.col("__spent") <= budget) | F.col("__first")).withColumn("allowance", F.least(F.col(size), F.lit(budget))).drop("__spent", "__first")


def stamp(ms: int | None) -> str:
    return datetime.fromtimestamp((ms or 0) / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def response(rows: list[dict[str, Any]], length: int = 200, budget: int = DEFAULT_BUDGET, full: bool = False, prose: bool = True, truncated: bool = False, relaxed: bool = False, unread: int = 0) -> dict[str, Any]:
    """The document for a page of messages (dicts of message columns, best first). unread: further ones that can't fit into the budget."""

    def body(r: dict[str, Any]) -> str:
        said, whole = r.get("prose") or "", r.get("content") or ""
        if not full and r.get("preview"):
            return r["preview"]
        return said if prose and said else whole

    bodies = [body(r) for r in rows]
    natural = [len(b) if full else len(preview_text(b, length)) for b in bodies]
    allowed = plan(natural, budget, full)
    results, shrunk = [], 0
    for r, b, n, a in zip(rows, bodies, natural, allowed):
        shrunk += a < n
        out = {"id": r["id"], "sessionId": r.get("session_id") or "", "timestamp": stamp(r.get("ts_ms")), "type": r.get("type") or "", "content" if full else "preview": render(b, a, n, length, full), "charCount": r.get("prose_char_count" if prose else "char_count") or 0}
        results.append(out | {k: r[c] for k, c in LINKS if r.get(c)})
    used = Budget(budget, len(rows) - len(allowed) + unread, shrunk)
    return {"results": results, "total": len(results), "truncated": truncated or used.dropped > 0, "relaxed": relaxed, "budget": {"limit": budget, "dropped": used.dropped, "shrunk": used.shrunk, "hit": used.hit}}
