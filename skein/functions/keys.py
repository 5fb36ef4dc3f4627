"""Normal forms of identifiers, paths and roles, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as white space around an identifier.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"

#: Ways of writing the two roles that speak (compared trimmed, in lower case).
USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "ai", "model", "agent", "bot")

SUFFIX = ".zst"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def norm_id(col: Column | str) -> Column:
    """Trimmed and in lower case; null if nothing is left (an empty identifier is no identifier)."""
    return F.nullif(F.lower(F.btrim(_c(col), F.lit(WHITE))), F.lit(""))


def norm_path(col: Column | str) -> Column:
    """A source path without surrounding white space and without the compression suffix; null if empty."""
    bare = F.btrim(_c(col), F.lit(WHITE))
    return F.nullif(F.when(bare.endswith(SUFFIX), F.substring(bare, F.lit(1), F.length(bare) - len(SUFFIX))).otherwise(bare), F.lit(""))


def is_blank(col: Column | str) -> Column:
    """True where the text is null or holds no visible character."""
    return F.coalesce(~_c(col).rlike(r"[^\s\p{Z}\p{C}]"), F.lit(True))


def norm_role(col: Column | str) -> Column:
    """'user', 'assistant', any other role trimmed and in lower case, null if missing."""
    role = norm_id(col)
    return F.when(role.isin(*USER_ROLES), "user").when(role.isin(*ASSISTANT_ROLES), "assistant").otherwise(role)


def session_of_path(sessions: DataFrame) -> DataFrame:
    """(path, path_session): the session of each source file, one row a file; the smallest id if rows disagree."""
    return (
        sessions.select(norm_path("source_path").alias("path"), norm_id("session_id").alias("path_session"))
        .where(F.col("path").isNotNull() & F.col("path_session").isNotNull())
        .groupBy("path")
        .agg(F.min("path_session").alias("path_session"))
    )


def with_session(messages: DataFrame, sessions: DataFrame, out: str = "session") -> DataFrame:
    """Add the session key of each message: its own id, else that of its source file, else null.

    Only the rows that lack an id go through the join, so that the bulk of the table isn't shuffled and null
    keys don't pile up in one partition.
    """
    known = messages.withColumn(out, norm_id("session_id"))
    lacking = known.where(F.col(out).isNull()).withColumn("__path", norm_path("source_path"))
    owners = session_of_path(sessions).select(F.col("path").alias("__path"), F.col("path_session").alias("__owner"))
    found = lacking.join(owners, "__path", "left").withColumn(out, F.col("__owner")).drop("__path", "__owner")
    return known.where(F.col(out).isNotNull()).unionByName(found.select(known.columns))
