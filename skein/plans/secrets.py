"""Secret counting over tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import secrets
from skein.sources.tables import table


def document_secrets(spark, directory):
    """(doc_id, matches): likely secrets in documents."""
    return secrets.count_matches(table(spark, directory, "documents", "doc_id", "text"), "text", ["doc_id"])


def message_secrets(spark, directory):
    """(type, matches): likely secrets in messages, by their type."""
    m = secrets.count_matches(table(spark, directory, "messages", "type", "content"), "content", ["type"])
    return m.groupBy("type").agg(F.sum("matches").alias("matches"))


QUERIES = {"document_secrets": document_secrets, "message_secrets": message_secrets}


def _count(col: str) -> str:
    """Matches of all patterns, each on what the ones before left, as nested SQL."""
    text, parts = f"coalesce({col}, '')", []
    for _, pattern, new, over in secrets.PATTERNS:
        hits = f"regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}')"
        marks = f"len(list_filter({hits}, lambda x: NOT ends_with(x, '{secrets.MARK}')))" if over else f"len({hits})"
        parts.append(marks)
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    return " + ".join(parts)


SQL = {
    "document_secrets": f"SELECT * FROM (SELECT doc_id, ({_count('text')})::BIGINT AS matches FROM documents) WHERE matches > 0",
    "message_secrets": f"SELECT type, sum(n)::BIGINT AS matches FROM (SELECT type, {_count('content')} AS n FROM messages) WHERE n > 0 GROUP BY 1",
}
