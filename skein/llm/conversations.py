"""Rebuilding conversations from message rows by assembling overlapping export fragments.

1. A fragment is what one batch delivered of a session from one source file, in order of time. Fragments are read
   by a scan over range-partitioned rows, so one of any length spreads over many tasks, each of which reports its
   part's length and hash.
2. A message's hash is that of its entry id, or of its role and spoken words where it has no id (of its role and
   time where nothing is said). Rolling hashes over them give every fragment's suffixes and prefixes. Fragments are named by the hash of their whole sequence, so exact
   copies are one fragment.
3. A fragment that lies wholly inside another is laid on its place there. Of the others, a proper suffix of one that
   equals a proper prefix of another is an overlap; all are found by one aggregation on (session, hash), without
   emitting pairs. The overlap graph keeps, for each fragment, its longest overlap, if it is the same from both ends
   and names one partner only; its unambiguous paths are merged by pointer doubling, which also sums up the offsets.
4. Rows without entry id that lie on the same place of the same path are one message: the first delivery stays. Rows
   with an entry id are one entry wherever they lie, as ids decide where there are any; that exact check comes last.
   What stays apart because its overlap is ambiguous counts as delivered twice, and so breaks its conversation.
5. Conversations are checked in order of time. Turns are range-partitioned by (session, time), so a hot session
   is spread over many tasks; every task sums up its runs of turns, and a session's few summaries are joined.

Defined results: a row without session id belongs to its source file's session, and to none if that is unknown
(it is then left out); an overlap of a single message without id counts only at the same time; of the fragments that
hold another one, the longest takes it; equal times are ordered by delivery;
sessions without messages are empty and thus dropped; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.keys import is_blank, norm_id, norm_path, norm_role, with_session
from skein.session import materialize

#: What a row is to its conversation.
NOTHING, USER, ASSISTANT, BROKEN = 0, 1, 2, 3

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 4096


def _table(base: int) -> np.ndarray:
    out = [1]
    for _ in range(_STEP - 1):
        out.append(out[-1] * base % (1 << 64))
    return np.array(out, np.uint64)


_TABLES = {_BASE: _table(_BASE), _INVERSE: _table(_INVERSE)}


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base to each exponent modulo 2^64, for exponents of any size."""
    high, low = np.divmod(exponents.astype(np.int64), _STEP)
    steps, at = np.unique(high, return_inverse=True)
    jumps = np.array([pow(base, int(k) * _STEP, 1 << 64) for k in steps], np.uint64)
    with np.errstate(over="ignore"):
        return jumps[at] * _TABLES[base][low]


def terms(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What each message adds to its sequence's sum at its place."""
    with np.errstate(over="ignore"):
        return (h.view(np.uint64) | np.uint64(1)) * powers(_BASE, place)


def stretch_hash(total: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of a stretch from its share of the sum, where it starts and its length; equal wherever the stretch stands."""
    with np.errstate(over="ignore"):
        return (total * powers(_INVERSE, start) * np.uint64(_BASE)) ^ length.astype(np.uint64)


def message_rows(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, export, h, named, seq, at, code): the narrow rows that assembly works on; no text."""
    m = with_session(messages.select("seq", "session_id", "entry_id", "source_path", "ts_ms", "type", "prose", "batch_no"), sessions)
    said, role = ~is_blank("prose"), norm_role("type")
    code = (
        F.when(said & (role.isNull() | F.col("ts_ms").isNull()), BROKEN)
        .when(said & (role == "user"), USER)
        .when(said & (role == "assistant"), ASSISTANT)
        .otherwise(NOTHING)
    )
    entry = norm_id("entry_id")
    h = F.when(entry.isNotNull(), F.xxhash64(F.lit("entry"), entry)).otherwise(
        F.when(said, F.xxhash64(F.lit("words"), role, "prose")).otherwise(F.xxhash64(F.lit("silent"), role, "ts_ms"))
    )
    export = F.xxhash64(norm_path("source_path"), F.col("batch_no"))
    return m.where(F.col("session").isNotNull()).select("session", export.alias("export"), h.alias("h"), entry.isNotNull().alias("named"), "seq", F.col("ts_ms").alias("at"), code.alias("code"))


_READ = "session string, export bigint, h bigint, named boolean, seq bigint, at bigint, code int, place bigint, sum bigint, pid int"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with their place and running sum in their task's part of their fragment."""
    pid, key, count, total = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        n, session, export = b.num_rows, b.column(0).dictionary_encode(), b.column(1).to_numpy()
        codes = session.indices.to_numpy()
        new = np.r_[True, (codes[1:] != codes[:-1]) | (export[1:] != export[:-1])]
        first = (session[0].as_py(), int(export[0]))
        if first != key:
            count, total = 0, 0
        starts = np.flatnonzero(new)
        start = starts[np.cumsum(new) - 1]
        lead = np.where(start == 0, count, 0)  # of a fragment that goes on from the batch before
        place = np.arange(n) - start + lead
        with np.errstate(over="ignore"):
            run = np.cumsum(terms(b.column(2).to_numpy(), place), dtype=np.uint64)
            before = np.where(start > 0, run[np.maximum(start, 1) - 1], np.uint64(0))
            sums = run - before + np.where(start == 0, np.uint64(total), np.uint64(0))
        key, count, total = (session[n - 1].as_py(), int(export[-1])), int(place[-1]) + 1, int(sums[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(sums.view(np.int64)), pa.array(np.full(n, pid, np.int32))], [*b.schema.names, "place", "sum", "pid"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and hashes in whole fragments, from those in the tasks' parts. parts: (pid, n, sum) of a fragment, in order."""
    for b in batches:
        if not b.num_rows:
            continue
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        place, sums, pid = (col[c].to_numpy() for c in ("place", "sum", "pid"))
        sums = sums.view(np.uint64)
        offsets = col["parts"].offsets.to_numpy() - col["parts"].offsets[0].as_py()
        part = col["parts"].flatten()
        p_pid, p_n, p_sum = (part.field(i).to_numpy() for i in range(3))
        p_sum = p_sum.view(np.uint64)
        size, whole = p_n[offsets[:-1]].copy(), p_sum[offsets[:-1]].copy()
        shift, carried = np.zeros(len(place), np.int64), np.zeros(len(place), np.uint64)
        with np.errstate(over="ignore"):
            for i in np.flatnonzero(np.diff(offsets) > 1):  # fragments that several tasks read
                n, s = 0, 0
                for k in range(offsets[i], offsets[i + 1]):
                    if p_pid[k] == pid[i]:
                        shift[i], carried[i] = n, s
                    s = (s + int(p_sum[k]) * pow(_BASE, n, 1 << 64)) % (1 << 64)
                    n += int(p_n[k])
                size[i], whole[i] = n, s
            sums = carried + sums * powers(_BASE, shift)
            place = place + shift
            before = sums - terms(col["h"].to_numpy(), place)
            zero = np.zeros(len(place), np.int64)
            prefix, suffix, name = stretch_hash(sums, zero, place + 1), stretch_hash(whole - before, place, size - place), stretch_hash(whole, zero, size)
        as_int = lambda x: pa.array(x.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*(col[c] for c in ("session", "seq", "h", "named", "at", "code")), as_int(name), pa.array(place), pa.array(size), as_int(prefix), as_int(suffix), as_int(sums)],
            ["session", "seq", "h", "named", "at", "code", "fragment", "place", "size", "prefix", "suffix", "sum"],
        )


def place_in_fragments(rows: DataFrame) -> DataFrame:
    """Each row with its fragment, its place there and the hashes of the fragment's prefix up to it and suffix from it."""
    by = ["session", "export", "at", "h", "seq"]
    read = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("session", "export", "h", "named", "seq", "at", "code").mapInArrow(_read, _READ), "read")
    parts = (
        read.groupBy("session", "export", "pid").agg(F.max(F.struct("place", "sum")).alias("e"))
        .groupBy("session", "export").agg(F.array_sort(F.collect_list(F.struct("pid", (F.col("e.place") + 1).alias("n"), F.col("e.sum").alias("sum")))).alias("parts"))
    )
    # at most a row a task in parts; a hot export has one row on that side, so its rows may be split
    return read.join(parts, ["session", "export"]).mapInArrow(_finish, "session string, seq bigint, h bigint, named boolean, at bigint, code int, fragment bigint, place bigint, size bigint, prefix bigint, suffix bigint, sum bigint")


@F.pandas_udf(T.LongType())
def _stretch(start: pd.Series, h: pd.Series, before: pd.Series, end: pd.Series, length: pd.Series) -> pd.Series:
    """The name of the stretch from place start on, between two running sums."""
    a, z = (x.to_numpy(np.int64).view(np.uint64) for x in (before, end))
    at = start.to_numpy(np.int64)
    with np.errstate(over="ignore"):
        share = z - (a - terms(h.to_numpy(np.int64), at))
    return pd.Series(stretch_hash(share, at, length.to_numpy(np.int64)).view(np.int64))


def contained(placed: DataFrame) -> DataFrame:
    """(session, fragment, holder, at_place): the fragments that are a stretch of a longer one, on their last place in the longest.

    All messages of such a fragment lie on several places, so only those that do are looked at. Each fragment is tried
    wherever its rarest message lies, once for all fragments of the same length with that message on the same place."""
    once = materialize(placed.groupBy("session", "fragment", "place").agg(*(F.first(c).alias(c) for c in ("size", "h", "named", "sum"))), "once")  # copies are one fragment
    shared = materialize(once.join(once.groupBy("session", "h").agg(F.count("*").alias("n")).where("n > 1"), ["session", "h"]), "shared")
    asked = shared.where("size > 1 or named").groupBy("session", "fragment").agg(F.first("size").alias("length"), F.count("*").alias("rows"), F.min(F.struct("n", "place", "h")).alias("rare"))
    asked = materialize(asked.where("rows = length").select("session", "fragment", "length", F.col("rare.h").alias("h"), F.col("rare.place").alias("lead")), "asked")
    holder = F.col("fragment").alias("holder")
    tried = shared.select("session", "h", holder, "size", "place").join(asked.select("session", "h", "length", "lead").distinct(), ["session", "h"])
    tried = tried.where("size > length and place >= lead and place - lead + length <= size").select("session", "holder", "size", "length", F.expr("place - lead").alias("at_place"), F.expr("place - lead + length - 1").alias("last"))
    left = shared.select("session", holder, F.col("place").alias("at_place"), "h", F.col("sum").alias("before"))
    right = shared.select("session", holder, F.col("place").alias("last"), F.col("sum").alias("end"))
    both = tried.join(left, ["session", "holder", "at_place"]).join(right, ["session", "holder", "last"])
    names = both.select("session", _stretch("at_place", "h", "before", "end", "length").alias("fragment"), "length", F.struct("size", "holder", "at_place").alias("in"))
    held = names.join(asked.select("session", "fragment", "length"), ["session", "fragment", "length"], "left_semi").groupBy("session", "fragment").agg(F.max("in").alias("in"))
    held = materialize(held.select("session", "fragment", "in.holder", "in.at_place"), "held")
    # a single message without id lies where it was said at the same time, and there wherever that fragment lies
    alone = placed.where("size = 1 and not named").select("session", "fragment", "h", "at").distinct()
    said = placed.where("size > 1 and not named").groupBy("session", "h", "at").agg(F.max(F.struct("size", "fragment", "place")).alias("in"))
    same = (alone["session"] == said["session"]) & (alone["h"] == said["h"]) & alone["at"].eqNullSafe(said["at"])
    alone = alone.join(said, same).groupBy(alone["session"], alone["fragment"]).agg(F.max("in").alias("in")).select("session", "fragment", F.col("in.fragment").alias("inner"), F.col("in.place").alias("place"))
    outer = held.select("session", F.col("fragment").alias("inner"), "holder", "at_place")
    alone = alone.join(outer, ["session", "inner"], "left").select("session", "fragment", F.coalesce("holder", "inner").alias("holder"), (F.coalesce("at_place", F.lit(0)) + F.col("place")).alias("at_place"))
    return held.unionByName(alone)


def overlaps(placed: DataFrame) -> DataFrame:
    """(session, a, b, length, shift): fragment b begins with the last messages of fragment a, shift places behind a's
    beginning; unambiguous and longest from both ends. Fragments inside others must have been taken out."""
    none = F.lit(None).cast("bigint")
    lone = lambda sig, length: F.when((F.col(length) == 1) & ~F.col("named"), F.xxhash64(sig, "at")).otherwise(F.col(sig))
    ends = placed.where(F.col("place") > 0).withColumn("length", F.col("size") - F.col("place")).select("session", lone("suffix", "length").alias("sig"), F.col("fragment").alias("a"), none.alias("b"), "length", F.col("place").alias("shift"))
    begins = placed.where(F.col("place") + 1 < F.col("size")).withColumn("length", F.col("place") + 1).select("session", lone("prefix", "length").alias("sig"), none.alias("a"), F.col("fragment").alias("b"), "length", none.alias("shift"))
    # smallest and largest partner tell one partner from several
    met = ends.unionByName(begins).groupBy("session", "sig", "length").agg(F.min("a").alias("a"), F.max("a").alias("a2"), F.min("b").alias("b"), F.max("b").alias("b2"), F.max("shift").alias("shift"))
    clear = met.where((F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")) & (F.col("a") != F.col("b"))).select("session", "a", "b", "length", "shift")
    clear = materialize(clear, "overlaps")
    forward = clear.groupBy("session", "a").agg(F.max(F.struct("length", "b", "shift")).alias("best")).select("session", "a", F.col("best.b").alias("b"), F.col("best.length").alias("length"), F.col("best.shift").alias("shift"))
    backward = clear.groupBy("session", "b").agg(F.max(F.struct("length", "a")).alias("best")).select("session", F.col("best.a").alias("a"), "b")
    return forward.join(backward, ["session", "a", "b"])


def merge_paths(edges: DataFrame) -> DataFrame:
    """(session, fragment, path, step, offset): the merged path of each fragment that overlaps another, named by its
    first fragment. Every fragment has one edge to and one from it at most. What runs in circles stays apart."""
    backs = edges.select("session", F.col("b").alias("fragment"), F.col("a").alias("pointer"), F.lit(1).cast("bigint").alias("step"), F.col("shift").alias("offset"), F.lit(False).alias("done"))
    tops = edges.select("session", F.col("a").alias("fragment")).join(backs, ["session", "fragment"], "left_anti").distinct()
    done = tops.select("session", "fragment", F.col("fragment").alias("pointer"), F.lit(0).cast("bigint").alias("step"), F.lit(0).cast("bigint").alias("offset"), F.lit(True).alias("done"))
    state = materialize(done.unionByName(backs), "walk")
    left, before = state.where("not done").count(), -1
    while left and left != before:
        target = state.select("session", F.col("fragment").alias("pointer"), F.col("pointer").alias("__next"), F.col("step").alias("__step"), F.col("offset").alias("__offset"), F.col("done").alias("__done"))
        walked = state.where("not done").join(target, ["session", "pointer"]).select("session", "fragment", F.col("__next").alias("pointer"), (F.col("step") + F.col("__step")).alias("step"), (F.col("offset") + F.col("__offset")).alias("offset"), F.col("__done").alias("done"))
        state = materialize(state.where("done").unionByName(walked), "walk")
        left, before = state.where("not done").count(), left
    return state.where("done").select("session", "fragment", F.col("pointer").alias("path"), "step", "offset")


def layout(placed: DataFrame) -> DataFrame:
    """(session, fragment, path, step, offset): where each fragment lies that overlaps another or lies in one."""
    inside = materialize(contained(placed), "contained")
    outer = placed.join(inside, ["session", "fragment"], "left_anti")
    paths = materialize(merge_paths(materialize(overlaps(outer), "edges")), "paths")
    on = paths.select("session", F.col("fragment").alias("holder"), "path", "step", "offset")
    laid = inside.join(on, ["session", "holder"], "left").select("session", "fragment", F.coalesce("path", "holder").alias("path"), F.coalesce("step", F.lit(0)).alias("step"), (F.coalesce("offset", F.lit(0)) + F.col("at_place")).alias("offset"))
    return paths.unionByName(laid)


def assemble(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, seq, at, code, path, step, place): every message once, as first delivered, with its place on its path."""
    placed = materialize(place_in_fragments(message_rows(messages, sessions)), "placed")
    laid = placed.select("session", "seq", "h", "named", "at", "code", "fragment", "place").join(layout(placed), ["session", "fragment"], "left")
    laid = laid.select("session", "seq", "h", "named", "at", "code", F.coalesce("path", "fragment").alias("path"), F.coalesce("step", F.lit(0)).alias("step"), (F.col("place") + F.coalesce("offset", F.lit(0))).alias("place"))
    one = F.when(F.col("named"), F.struct(F.lit(None).cast("bigint").alias("path"), F.col("h").alias("at"))).otherwise(F.struct("path", F.col("place").alias("at")))
    return laid.groupBy("session", one.alias("one")).agg(F.min(F.struct("seq", "at", "code", "path", "step", "place")).alias("r")).select("session", "r.*")


def verdicts(entries: DataFrame) -> DataFrame:
    """(session, turns, kept): whether each session with messages is a whole conversation."""
    entries = materialize(entries.select("session", "seq", "at", "code").where(F.col("code") != NOTHING), "turns")
    ordered = entries.where(F.col("code") != BROKEN).repartitionByRange("session", "at", "seq").sortWithinPartitions("session", "at", "seq")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each session of each batch: its first and last turn, and whether a user turn follows a user turn."""
        for b in batches:
            if not b.num_rows:
                continue
            code, session = b.column(3).to_numpy(), b.column(0)
            coded = session.dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, coded[1:] != coded[:-1]])
            ends = np.r_[starts[1:], len(coded)] - 1
            twice = np.r_[False, (code[1:] == USER) & (code[:-1] == USER) & (coded[1:] == coded[:-1])]
            bad = np.add.reduceat(twice.astype(np.int64), starts) > 0
            yield pa.RecordBatch.from_arrays(
                [session.take(pa.array(starts)), b.column(2).take(pa.array(starts)), b.column(1).take(pa.array(starts)), pa.array(code[starts]), pa.array(code[ends]), pa.array(bad), pa.array((ends - starts + 1).astype(np.int64))],
                ["session", "at", "seq", "first", "last", "bad", "n"],
            )

    chunks = ordered.mapInArrow(runs, "session string, at bigint, seq bigint, first int, last int, bad boolean, n bigint")
    parts = chunks.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "first", "last"))).alias("p"), F.bool_or("bad").alias("bad"), F.sum("n").alias("turns"))
    seam = F.exists(F.sequence(F.lit(2), F.size("p")), lambda i: (F.element_at("p", i)["first"] == USER) & (F.element_at("p", i - 1)["last"] == USER))
    whole = ~F.col("bad") & (F.element_at("p", 1)["first"] == USER) & (F.element_at("p", -1)["last"] == ASSISTANT) & F.when(F.size("p") > 1, ~seam).otherwise(True)
    broken = entries.where(F.col("code") == BROKEN).select("session").distinct().withColumn("broken", F.lit(True))
    return parts.select("session", "turns", whole.alias("whole")).join(broken, "session", "full").select("session", F.coalesce("turns", F.lit(0)).alias("turns"), (F.coalesce("whole", F.lit(False)) & F.col("broken").isNull()).alias("kept"))


def dropped_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id): the sessions, of all in either table, that are empty, broken or lack a reply."""
    kept = verdicts(assemble(messages, sessions)).where("kept").select("session")
    every = sessions.select(norm_id("session_id").alias("session")).unionByName(messages.select(norm_id("session_id").alias("session"))).where(F.col("session").isNotNull()).distinct()
    return every.join(kept, "session", "left_anti").select(F.col("session").alias("session_id"))


def conversations(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, at, seq, speaker, words, path, step): the turns of the conversations that are kept.

    Ordered by (session, at, seq) when read back sorted; the words are the message's content as delivered.
    """
    entries = materialize(assemble(messages, sessions), "entries")
    kept = verdicts(entries).where("kept").select("session")
    turns = entries.where(F.col("code").isin(USER, ASSISTANT)).join(kept, "session", "left_semi")
    return turns.join(messages.select("seq", "content"), "seq").select("session", "at", "seq", F.when(F.col("code") == USER, "user").otherwise("assistant").alias("speaker"), F.col("content").alias("words"), "path", "step")
