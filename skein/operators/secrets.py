"""Secrets in texts and transcript files: finding, counting and rewriting them.

Over tables the eight patterns run inside the JVM, each on what the one before left. Over files the JSON tree of
every record is walked in Python, a file a task.

Defined results: null and empty texts have no matches and stay as they are; what was replaced before isn't counted again.
"""

from __future__ import annotations

import io
import json
import os
import re
import stat
import tempfile
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources.lines import millis

MARK, KEY_MARK = "<REDACTED>", "<REDACTED_PRIVATE_KEY>"
MIN_SECRET = 8

# The patterns in the order they are applied, and whether what already ends in a mark is passed over.
PATTERNS = (
    ("private_key", r"(?s)-----BEGIN [^-\r\n]*PRIVATE KEY-----.*?-----END [^-\r\n]*PRIVATE KEY-----", KEY_MARK, False),
    ("bearer", r"(?i)(\b(?:bearer\s+|authorization\s*:\s*bearer\s+))[A-Za-z0-9._~+/=-]{12,}", "$1" + MARK, False),
    ("basic_auth_url", r"(\b(?:https?|postgres(?:ql)?|mysql|redis|rediss)://[^\s/:@]+:)[^\s@]+@", "$1" + MARK + "@", False),
    ("known_token", r"(?i)(?:sk-ant-[A-Za-z0-9_-]{16,}|sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[baprs]-[A-Za-z0-9-]{20,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{30,})", MARK, False),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", MARK, False),
    ("secret_header", r"(?i)(\b(?:cf-access-client-secret|x-api-key|api-key|authorization)\s*:\s*)[^\s,;]+", "$1" + MARK, True),
    ("secret_assignment", r"""(?i)(\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?token|client[_-]?secret)\s*[=:]\s*["']?)[A-Za-z0-9._~+/=-]{8,}""", "$1" + MARK, False),
    ("secret_query", r"""(?i)(\b(?:access_token|api_key|token|password|secret)=)[^&\s"']{8,}""", "$1" + MARK, True),
)
#: What a text must hold, in lower case, for a pattern to match at all; looked for before the pattern runs.
HINTS = {
    "private_key": ("private key",),
    "bearer": ("bearer",),
    "basic_auth_url": ("://",),
    "known_token": ("sk-", "ghp_", "github_pat_", "glpat-", "xox", "akia", "aiza"),
    "jwt": ("eyj",),
    "secret_header": ("cf-access-client-secret", "api-key", "authorization"),
    "secret_assignment": ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey"),
    "secret_query": ("token=", "secret=", "password=", "api_key="),
}
# What names a secret, dotenv lines, keys and types whose values stay, and values that are no secrets.
SECRET_KEY = re.compile(r"(?i)token|secret|password|passwd|api[_-]?key|access[_-]?key|credential|private[_-]?key|signing[_-]?key|client[_-]?secret|auth[_-]?token")
ENV_LINE = re.compile(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$")
SKIPPED_KEYS = frozenset(("thinkingSignature", "encrypted_content", "signature"))
OPAQUE_TYPES, OPAQUE_KEYS = frozenset(("image", "audio", "file", "binary")), frozenset(("data", "content"))
PLACEHOLDERS = frozenset(("changeme", "placeholder", "redacted", "example", "your-token", "your_token", "xxxxxxxx"))


# --- over columns ------------------------------------------------------------------------------------------------


def _steps(values: Iterable[str]) -> list[tuple[str, str, str]]:
    """(name, Java pattern, replacement) of all steps; the exact values are one step, the longer before the shorter.

    Where marks are passed over, the last repetition is possessive and a mark must not stand before the match's end.
    """
    exact = "|".join("\\Q" + v.replace("\\E", "\\E\\\\E\\Q") + "\\E" for v in values)
    out = [("exact", exact, MARK)] if exact else []
    for name, pattern, new, pass_over in PATTERNS:
        out.append((name, f"{pattern}+(?<!{re.escape(MARK)})(?<!{re.escape(KEY_MARK)})" if pass_over else pattern, new))
    return out


def scrub(df: DataFrame, text: str, values: Iterable[str] = (), clean: str = "clean", matches: str = "matches") -> DataFrame:
    """df with the redacted text and the number of matches. values: exact secrets, longest first.

    Every step is a projection of its own over the text that the one before left, so the plan grows in proportion to
    the patterns; Spark doesn't fold projections whose costly columns are used more than once. A condition on the number
    of matches would be pushed below all of them with every step written out; a sum that isn't deterministic keeps it above.
    """
    low = F.lower(F.col(text))
    out = df.withColumn("__low", low).withColumns({"__t": F.col(text), "__n": F.lit(0), **{f"__{k}": v for k, v in hinted(F.col("__low")).items()}}).drop("__low")
    for name, java, new in _steps(values):
        may = F.col(f"__{name}") if name in HINTS else F.lit(True)
        n = F.when(may, F.coalesce(F.regexp_count("__t", F.lit(java)), F.lit(0))).otherwise(0)
        out = out.withColumns({"__t": F.when(may, F.regexp_replace("__t", java, new)).otherwise(F.col("__t")), "__n": F.col("__n") + n})
    return out.withColumns({clean: F.col("__t"), matches: (F.col("__n") + F.spark_partition_id() * 0).cast("bigint")}).drop("__t", "__n", *[f"__{k}" for k in HINTS])


def hinted(low: Column) -> dict[str, Column]:
    """For each pattern whether a text, given in lower case, holds one of its hints."""
    out = {}
    for name, words in HINTS.items():
        out[name] = low.contains(words[0])
        for w in words[1:]:
            out[name] = out[name] | low.contains(w)
    return out


def count_matches(df: DataFrame, text: str, keys: list[str], values: Iterable[str] = ()) -> DataFrame:
    """(keys, matches) summed over all patterns; only rows with matches."""
    found = scrub(df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text")), "__text", list(values), "__clean", "__matches")
    return found.select(*keys, F.col("__matches").alias("matches")).where(F.col("matches") > 0)


# --- over records and files -------------------------------------------------------------------------------------------


@dataclass
class Report:
    """What a scan found; no secret is kept."""

    files: int = 0
    records: int = 0
    matches: int = 0
    findings: list[dict[str, Any]] = field(default_factory=list)


def normalize(values: Iterable[str]) -> list[str]:
    """Secrets worth looking for: long enough, no placeholders, once each, longest first."""
    good = {v for v in values if len(v.encode()) >= MIN_SECRET and not _placeholder(v)}
    return sorted(good, key=lambda v: (-len(v), v))


def _placeholder(value: str) -> bool:
    low = value.lower()
    return low in PLACEHOLDERS or (low.startswith("<") and low.endswith(">")) or (low.startswith("${") and low.endswith("}"))


def values_from_environment(environment: Mapping[str, str] | None = None) -> list[str]:
    env = os.environ if environment is None else environment
    return normalize(v.strip() for k, v in env.items() if SECRET_KEY.search(k))


def values_from_files(paths: Iterable[str]) -> list[str]:
    """Values of secret-named keys in dotenv files."""
    found = []
    for path in paths:
        with open(path, encoding="utf-8", errors="replace") as f:
            for line in f:
                m = ENV_LINE.match(line.rstrip("\n"))
                if m and SECRET_KEY.search(m[1]):
                    v = m[2]
                    found.append(v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v)
    return normalize(found)


_COMPILED = [(name, re.compile(p), new.replace("$1", r"\1"), over) for name, p, new, over in PATTERNS]


def scrub_text(text: str, values: list[str]) -> tuple[str, int]:
    """(the redacted text, matches)."""
    total = 0
    for v in values:
        total += text.count(v)
        text = text.replace(v, MARK)
    for _, pattern, new, pass_over in _COMPILED:
        n = 0

        def put(m: re.Match, new=new, pass_over=pass_over) -> str:
            nonlocal n
            if pass_over and m[0].endswith((MARK, KEY_MARK)):
                return m[0]
            n += 1
            return m.expand(new)

        text = pattern.sub(put, text)
        total += n
    return text, total


def scrub_value(value: Any, values: list[str]) -> tuple[Any, int]:
    """(the redacted JSON value, matches): strings under secret-named keys go whole, opaque data and signatures stay."""
    if isinstance(value, str):
        return scrub_text(value, values)
    if isinstance(value, list):
        pairs = [scrub_value(v, values) for v in value]
        return [p[0] for p in pairs], sum(p[1] for p in pairs)
    if not isinstance(value, dict):
        return value, 0
    kind = value.get("type")
    opaque = isinstance(kind, str) and kind.lower() in OPAQUE_TYPES
    out, total = {}, 0
    for k, v in value.items():
        if k in SKIPPED_KEYS or (opaque and k in OPAQUE_KEYS):
            out[k] = v
        elif isinstance(v, str) and SECRET_KEY.search(k) and len(v.encode()) >= MIN_SECRET:
            out[k], total = MARK, total + (v != MARK)
        else:
            out[k], n = scrub_value(v, values)
            total += n
    return out, total


def record_time(record: Any) -> int | None:
    """A record's time, its own or its message's."""
    if not isinstance(record, dict):
        return None
    inner = record.get("message")
    stamp = record.get("timestamp") or (inner.get("timestamp") if isinstance(inner, dict) else None)
    return millis(stamp) if isinstance(stamp, str) else None


def scrub_lines(lines: Iterable[str], since_ms: int, values: list[str]) -> tuple[list[str], int, int]:
    """(lines, records looked at, matches); malformed, older and untimed records stay as they are."""
    out, records, total = [], 0, 0
    for line in lines:
        try:
            rec = json.loads(line)
            at = record_time(rec)
        except (ValueError, RecursionError):
            at = None
        if at is None or at < since_ms:
            out.append(line)
            continue
        records += 1
        new, n = scrub_value(rec, values)
        total += n
        out.append(json.dumps(new, ensure_ascii=False, separators=(",", ":")) if n else line)
    return out, records, total


def redact_file(path: str, since_ms: int = 0, values: Iterable[str] = (), apply: bool = False) -> Report:
    """Scan one file and, with apply, put a redacted one in its place at once, with the same mode and representation."""
    packed = path.endswith(".zst")
    with open(path, "rb") as f:
        data = f.read()
    text = (zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() if packed else data).decode("utf-8", "surrogateescape")
    lines, records, n = scrub_lines(text.split("\n"), since_ms, normalize(values))
    if n and apply:
        raw = "\n".join(lines).encode("utf-8", "surrogateescape")
        fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".redact-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(zstandard.compress(raw) if packed else raw)
                f.flush()
                os.fsync(f.fileno())
            os.chmod(temp, stat.S_IMODE(os.stat(path).st_mode))
            os.replace(temp, path)
        except BaseException:
            os.unlink(temp)
            raise
    return Report(1, records, n, [{"path": path, "matches": n}] if n else [])


def scan(files: DataFrame, since_ms: int = 0, values: Iterable[str] = (), apply: bool = False) -> DataFrame:
    """(path, records, matches) of every file of a listing (column path); files are handled where the tasks run, on shared storage."""
    secrets = normalize(values)

    def run(batches):
        import pandas as pd

        for b in batches:
            reports = [redact_file(p, since_ms, secrets, apply) for p in b["path"]]
            yield pd.DataFrame({"path": b["path"], "records": [r.records for r in reports], "matches": [r.matches for r in reports]})

    return files.select("path").mapInPandas(run, "path string, records bigint, matches bigint")
