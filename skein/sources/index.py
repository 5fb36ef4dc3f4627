"""The inverted index of a corpus: token columns beside the messages, postings by word, and corpus statistics.

    messages.parquet   with content_tokens and prose_tokens, sorted by session and time
    postings.parquet   (p, token, seq), p being the token's first two characters and the partition
    corpus.parquet     (n, words): documents and words
    source_projections.parquet, command_documents.parquet: see write_projections

A query reads only the partitions of its words, and only candidate documents are looked at token by token. A hot
word's postings are spread over many files, as they are written sorted by (p, token, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import plain_tokens, stem_tokens
from skein.session import materialize
from skein.sources.tables import table

HEAD = 2
OTHERS = ("sessions", "activities", "tool_invocations", "tool_results")


def head(token: Column | str) -> Column:
    return F.substring(token, 1, HEAD)


def postings(messages: DataFrame) -> DataFrame:
    """(p, token, seq) of every word of a message, once, from its token columns."""
    words = F.array_distinct(F.concat("content_tokens", "prose_tokens"))
    return messages.select("seq", F.explode(words).alias("token")).select(head("token").alias("p"), "token", "seq")


def write_index(messages: DataFrame, out: str) -> None:
    """postings.parquet and corpus.parquet of messages with token columns."""
    sized = messages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("content_tokens") + F.size("prose_tokens")), F.lit(0)).alias("words"))
    sized.write.mode("overwrite").parquet(f"{out}/corpus.parquet")
    p = postings(messages)
    p.repartitionByRange("p", "token", "seq").sortWithinPartitions("p", "token", "seq").write.mode("overwrite").partitionBy("p").parquet(f"{out}/postings.parquet")


def write_projections(spark: SparkSession, directory: str, out: str, stemming: bool = True) -> None:
    """source_projections.parquet, what listings show of each source, and command_documents.parquet, the calls with their
    outputs and the words of both, so that queries neither aggregate messages nor gather outputs."""
    from skein.operators.retrieve import command_docs, source_projection  # that module reads the postings through this one

    tokens = stem_tokens if stemming else plain_tokens
    source_projection(table(spark, directory, "messages")).write.mode("overwrite").parquet(f"{out}/source_projections.parquet")
    docs = command_docs(table(spark, directory, "tool_invocations"), table(spark, directory, "tool_results", "invocation_id", "content", "ts_ms", "result_id"))
    docs.withColumns({"arguments_text_tokens": tokens("arguments_text"), "output_tokens": tokens("output")}).write.mode("overwrite").parquet(f"{out}/command_documents.parquet")


def build_index(spark: SparkSession, directory: str, out: str, stemming: bool = True) -> None:
    """An indexed copy of a directory of derived tables."""
    tokens = stem_tokens if stemming else plain_tokens
    m = table(spark, directory, "messages").withColumns({"content_tokens": tokens("content"), "prose_tokens": tokens("prose")})
    m = materialize(m, "tokens")
    m.repartitionByRange("session_id", "ts_ms").sortWithinPartitions("session_id", "ts_ms").write.mode("overwrite").parquet(f"{out}/messages.parquet")
    write_index(m, out)
    for name in OTHERS:
        table(spark, directory, name).write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    write_projections(spark, directory, out, stemming)


def candidates(index: DataFrame, words: list[tuple[str, bool]]) -> DataFrame:
    """(seq): messages that hold any of the words, or a word that begins so. index: the postings."""
    test = F.lit(False)
    for w, is_prefix in words:
        p, t = F.col("p"), F.col("token")
        here = (p == w[:HEAD]) if len(w) >= HEAD or not is_prefix else p.startswith(w)
        test = test | (here & (t.startswith(w) if is_prefix else t == F.lit(w)))
    return index.where(test).select("seq").distinct()
