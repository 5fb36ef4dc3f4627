"""Evaluation texts leaking into training text: a prefix-filtered set join.

An item leaks into a document if the document holds at least `span` consecutive words of the item. Every
window of `span` words is a set of word shingles, all of which must be in the document, so any one of them is a
necessary token: the prefix is the window's rarest shingle, by the number of documents that hold it.

1. One pass over the documents finds the places of all shingles that occur in any item (hashes; the items'
   shingles are a bounded set, the items go through in blocks of at most MAX_SHINGLES).
2. The documents' counts of these shingles, over the whole corpus, order each window's shingles by rarity.
3. The places of prefix shingles are joined with the windows they stand for; length and position bounds drop
   windows that would begin before the document or end after it.
4. Exact containment: every position of the window must hold the item's shingle there. The shingles overlap and
   cover the window; they are compared by the 64-bit hashes of their words.

Words are the longest runs of letters and digits; letter case and accents don't matter.

Defined results: null texts have no words; items with fewer than `span` words leak nowhere; repeated rows give
one result; empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize

SPAN = 12
SHINGLE = 5
#: Shingles of one block of items; the block's table is broadcast and takes 16 bytes a shingle.
MAX_SHINGLES = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_B = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    bare = unicodedata.normalize("NFKD", text.casefold())
    return unicodedata.normalize("NFC", "".join(c for c in bare if not unicodedata.combining(c)))


def words(text: str | None) -> list[str]:
    return _WORD.findall(fold(text)) if text else []


def word_ids(ws: list[str], known: dict[str, int]) -> np.ndarray:
    """Hash of each word that any item holds, 0 for all others."""
    get = known.get
    return np.fromiter((get(w, 0) for w in ws), np.uint64, len(ws))


def hash_word(w: str) -> int:
    return xxhash.xxh64_intdigest(w) | 1


def shingles(ids: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of the k words from each position on; 0 where a word is unknown."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for i in range(k):
            part = ids[i : i + n]
            ok &= part != 0
            h = (h ^ part) * _B
            h ^= h >> np.uint64(29)
    h[h == 0] = 1
    return np.where(ok, h, np.uint64(0))


def item_windows(items: pd.DataFrame, span: int = SPAN, k: int = SHINGLE) -> tuple[dict[str, int], pd.DataFrame]:
    """The items' words, and a row (item_id, offset, shingle) for each shingle place."""
    known, rows = {}, []
    for item, text in zip(items["item_id"], items["text"]):
        ws = words(text)
        if len(ws) < span:
            continue
        for w in ws:
            known.setdefault(w, hash_word(w))
        rows.append(pd.DataFrame({"item_id": item, "offset": np.arange(len(ws) - k + 1), "shingle": shingles(word_ids(ws, known), k).astype(np.int64)}))
    return known, pd.concat(rows) if rows else pd.DataFrame({"item_id": [], "offset": [], "shingle": []}).astype("int64")


def _blocks(items: DataFrame, span: int, k: int, most: int) -> Iterator[tuple[dict[str, int], pd.DataFrame]]:
    """The items in blocks of bounded size."""
    batch: list = []
    size = 0
    for row in items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct().toLocalIterator():
        batch.append((row.item_id, row.text))
        size += len(row.text) // 2 + 1
        if size >= most:
            yield item_windows(pd.DataFrame(batch, columns=["item_id", "text"]), span, k)
            batch, size = [], 0
    if batch:
        yield item_windows(pd.DataFrame(batch, columns=["item_id", "text"]), span, k)


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, k: int = SHINGLE, most: int = MAX_SHINGLES) -> DataFrame:
    """(item_id, doc_id, first_word, n_windows): the documents that hold at least span consecutive words of an item.

    documents: doc_id, text. items: item_id, text. first_word is the document's word at which the first shared window begins.
    """
    out = None
    for known, places in _blocks(items, span, k, most):
        part = _leaks_of_block(documents, known, places, span, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = documents.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, first_word int, n_windows bigint")
    return out


def _leaks_of_block(documents: DataFrame, known: dict[str, int], places: pd.DataFrame, span: int, k: int) -> DataFrame:
    spark = documents.sparkSession
    wanted = np.unique(places["shingle"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast((known, wanted))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, want = shared.value
        for b in batches:
            ids, at, hs, total = [], [], [], []
            for doc, text in zip(b.column(0).to_numpy(zero_copy_only=False), b.column(1)):
                ws = words(text.as_py())
                if len(ws) < span or len(want) == 0:
                    continue
                s = shingles(word_ids(ws, table), k)
                live = np.flatnonzero(s)
                if not len(live):
                    continue
                v = s[live].astype(np.int64)
                p = np.searchsorted(want, v)
                p[p == len(want)] = 0
                hit = want[p] == v
                live, v = live[hit], v[hit]
                if len(live):
                    ids.append(np.full(len(live), doc, np.int64))
                    at.append(live)
                    hs.append(v)
                    total.append(np.full(len(live), len(ws)))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(hs)), pa.array(np.concatenate(total).astype(np.int32))], ["doc_id", "at", "shingle", "n_words"])

    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    hits = materialize(texts.mapInArrow(find, "doc_id bigint, at int, shingle bigint, n_words int"), "shingles")
    rarity = hits.groupBy("shingle").agg(F.count_distinct("doc_id").alias("n_docs"))
    place = spark.createDataFrame(places) if len(places) else spark.createDataFrame([], "item_id bigint, offset bigint, shingle bigint")
    place = place.select("item_id", F.col("offset").cast("int").alias("offset"), "shingle").join(rarity, "shingle", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    # A window from `first` holds the shingles at first .. first + span - k; the rarest is its prefix.
    width = span - k
    last = place.groupBy("item_id").agg(F.max("offset").alias("__last"))
    of_window = place.join(last, "item_id").select("item_id", "shingle", "offset", "n_docs", F.explode(F.sequence(F.greatest(F.lit(0), F.col("offset") - width), F.least("offset", F.col("__last") - width))).alias("first"))
    windows = of_window.groupBy("item_id", "first").agg(
        F.min(F.struct("n_docs", "shingle", "offset")).alias("prefix"),
        F.transform(F.array_sort(F.collect_list(F.struct("offset", "shingle"))), lambda x: x["shingle"]).alias("must"),
    )
    prefixes = windows.where(F.col("prefix.n_docs") > 0).select("item_id", "first", "must", F.col("prefix.shingle").alias("shingle"), (F.col("prefix.offset") - F.col("first")).alias("inside"))
    # length and position bounds: the window must fit into the document
    candidates = (
        hits.join(prefixes, "shingle")
        .where((F.col("at") >= F.col("inside")) & (F.col("at") - F.col("inside") + span <= F.col("n_words")))
        .select("doc_id", "item_id", "first", (F.col("at") - F.col("inside")).alias("begin"), "must")
    )
    # exact containment: the document's shingles at begin .. begin + width must be the window's
    need = candidates.select("doc_id", "item_id", "first", "begin", F.posexplode("must").alias("i", "shingle"))
    there = hits.select("doc_id", F.col("at").alias("__at"), "shingle").distinct()
    held = need.join(there.withColumnRenamed("__at", "place"), (need.doc_id == there.doc_id) & (need.shingle == there.shingle) & (need.begin + need.i == F.col("place"))).select(need.doc_id, "item_id", "first", "begin", "i")
    full = held.groupBy("doc_id", "item_id", "first", "begin").agg(F.count("*").alias("n")).where(F.col("n") == width + 1)
    return full.groupBy("item_id", "doc_id").agg(F.min("begin").alias("first_word"), F.count("*").alias("n_windows"))
