"""Nearest calls and conversations, against brute force."""

import random

import numpy as np

from skein.llm import conversations as C
from skein.llm.nearest_time import nearest_in_time

M_SCHEMA = "seq bigint, session_id string, entry_id string, source_path string, ts_ms bigint, type string, prose string, content string, batch_no int"


def test_nearest_against_brute_force(spark):
    rng = random.Random(5)
    ent = lambda: rng.choice(["hot", "hot", "a", "b", None])
    left = [(ent(), rng.randrange(0, 90_000) if rng.random() < 0.95 else None, 10_000 + i, "x") for i in range(500)]
    right = [(ent(), rng.randrange(0, 90_000) if rng.random() < 0.95 else None, i, "x") for i in range(120)] + [("hot", 7_000, 900, "x"), ("hot", 7_000, 899, "x"), ("hot", 9_000, 3, "x")]
    want = set()
    for e, t, i, _ in left:
        near = [(abs(t - u), k) for f, u, k, _ in right if e is not None and t is not None and f == e and u is not None and abs(t - u) <= 5000]
        if near:
            want.add((i, min(near)[1], min(near)[0]))
    L = spark.createDataFrame(left, "entity string, at bigint, left_id bigint, right_id_x string").withColumnRenamed("right_id_x", "inside")
    R = spark.createDataFrame(right, "entity string, at bigint, right_id bigint, tick string")
    for tick in (1000, 700, 5000):
        got = [tuple(r) for r in nearest_in_time(L, R, 5000, tick).collect()]
        assert set(got) == want and len(got) == len(want)
    assert nearest_in_time(L.limit(0), R, 5000).count() == 0 and nearest_in_time(L, R.limit(0), 5000).count() == 0


def hashes(h):
    """(prefix, suffix) hashes of one sequence."""
    h, n = np.array(h, np.int64), len(h)
    at = np.arange(n)
    with np.errstate(over="ignore"):
        x = C.terms(h, at)
        s = np.cumsum(x, dtype=np.uint64)
        return C.stretch_hash(s, at * 0, at + 1), C.stretch_hash(s[-1] - (s - x), at, n - at)


def test_sequence_hashes():
    p, s = hashes([5, 7, 11, 5, 7])
    assert s[3] == p[1] and s[0] == p[4] and len(set(p.tolist())) == 5 and s[4] != p[0]
    long, cut = list(range(10_000)), 7_123
    assert hashes(long)[1][cut] == hashes(long[cut:])[0][-1]  # beyond the table of powers


def sessions_of(spark, *ids):
    return spark.createDataFrame([(f"/{i}.jsonl", i) for i in ids], "source_path string, session_id string")


def talk(spark, rows):
    out = [(i, s, e, f"/{(s or 'a').strip().lower()}.jsonl" if p is None else p, t, kind, prose, prose, b) for i, (s, e, p, t, kind, prose, b) in enumerate(rows)]
    return spark.createDataFrame(out, M_SCHEMA)


def test_conversations(spark):
    rows = [
        ("a", "1", None, 10, "User", "hi", 0), ("A ", "2", None, 20, "ai", "yo", 0), ("", "3", "/a.jsonl.zst", 30, "human", "more", 0), ("a", "4", None, 40, "model", "ok", 1), ("a", "1", None, 99, "user", "hi", 2), ("a", "5", None, 35, "assistant", " ", 1),
        ("b", "1", None, 10, "user", "hi", 0), ("b", "2", None, 11, "user", "hi again", 0), ("b", "3", None, 12, "assistant", "yo", 0),
        ("c", "1", None, 10, "assistant", "yo", 0), ("c", "2", None, 11, "user", "hi", 0), ("c", "3", None, 12, "assistant", "yo", 0),
        ("d", "1", None, 10, "user", "hi", 0), ("d", "2", None, 11, "assistant", "yo", 0), ("d", "3", None, None, "user", "lost", 0),
        ("e", "1", None, 10, "user", "hi", 0), ("e", "2", None, 11, "assistant", "yo", 0), ("e", "3", None, 12, None, "who", 0),
        ("f", None, None, 10, "user", "hi", 0), ("f", None, None, 11, "assistant", "yo", 0), ("f", None, None, 12, "toolResult", "", 0), ("f", None, None, 13, "assistant", "yo", 0),
        ("g", "1", None, 10, "user", None, 0), (None, "1", "/nowhere", 10, "user", "hi", 0), ("h", "1", None, 10, "user", "hi", 0),
    ]
    m, s = talk(spark, rows), sessions_of(spark, "a", "b", "c", "d", "e", "f", "g", "z")
    assert {r.session_id for r in C.dropped_sessions(m, s).collect()} == {"b", "c", "d", "e", "g", "h", "z"}
    words = [(r.session, r.speaker, r.words) for r in C.conversations(m, s).orderBy("session", "at", "seq").collect()]
    assert words == [("a", "user", "hi"), ("a", "assistant", "yo"), ("a", "user", "more"), ("a", "assistant", "ok"), ("f", "user", "hi"), ("f", "assistant", "yo"), ("f", "assistant", "yo")]
    assert C.dropped_sessions(m.limit(0), s.limit(0)).count() == 0 and C.dropped_sessions(m.limit(0), s).count() == 8


def export(batch, numbers, session="a", named=True, by=2):
    return [(session, f"e{n}" if named else None, None, n * 10, "user" if n % by else "assistant", f"w{n}", batch) for n in numbers]


def test_overlapping_exports_are_merged(spark):
    """Three exports of one session that overlap at their ends, delivered out of order, and one that is ambiguous."""
    rows = export(0, range(7, 13)) + export(1, range(1, 5)) + export(2, range(3, 9)) + export(3, range(1, 5)) + export(0, [1, 2], "b") + export(1, [2, 3], "b") + export(2, [2, 4], "b")
    m, s = talk(spark, rows), sessions_of(spark, "a", "b")
    placed = C.place_in_fragments(C.message_rows(m, s))
    edges = C.overlaps(placed).collect()
    assert [(r.session, r.length) for r in sorted(edges, key=lambda r: r.length)] == [("a", 2), ("a", 2)]
    got = C.assemble(m, s).where("session = 'a'").collect()
    assert len(got) == 12 and len({r.path for r in got}) == 1 and {r.step for r in got} == {0, 1, 2}
    assert [r.place for r in sorted(got, key=lambda r: r.at)] == list(range(12))
    assert C.dropped_sessions(m, s).count() == 0  # both are whole


def test_the_overlap_graph_decides_where_there_are_no_ids(spark, monkeypatch):
    """Exports without entry ids: overlapping, contained and copied ones are whole only through the graph; an ambiguous one is broken."""
    rows = (
        export(0, range(1, 7), "a", False) + export(1, range(5, 11), "a", False) + export(2, range(9, 13), "a", False)  # overlap at their ends
        + export(0, range(1, 9), "b", False) + export(1, range(3, 7), "b", False) + export(2, [5], "b", False)  # one inside another
        + export(0, range(1, 5), "c", False) + export(1, range(1, 5), "c", False)  # a copy
        + export(0, [1, 2, 3], "d", False) + export(1, [3, 4, 5, 6], "d", False) + export(2, [3, 4, 7, 8], "d", False)  # two go on
        + export(0, range(1, 5), "e", True)
    )
    want = None
    for first in (0, 4090):  # wherever the order of delivery begins
        m, s = talk(spark, rows), sessions_of(spark, *"abcde")
        m = m.withColumn("seq", m.seq + first)
        got = C.conversations(m, s).collect()
        assert want in (None, sorted(r.words for r in got)) and {r.session for r in got} == set("abce")
        want = sorted(r.words for r in got)
        assert sorted(int(r.words[1:]) for r in got if r.session == "a") == list(range(1, 13)) and len({r.path for r in got if r.session == "a"}) == 1
        assert sorted(int(r.words[1:]) for r in got if r.session == "b") == list(range(1, 9))
    real = C.layout
    monkeypatch.setattr(C, "layout", lambda placed: real(placed).where("false"))
    assert {r.session_id for r in C.dropped_sessions(m, s).collect()} == {"a", "b", "d"}


def laid_inside(spark, rows, *ids):
    """The rows in fragments, and (session, fragment) -> (holder, at_place) as found."""
    m, s = talk(spark, rows), sessions_of(spark, *ids)
    placed = C.place_in_fragments(C.message_rows(m, s))
    found = C.contained(placed).collect()
    assert len({(r.session, r.fragment) for r in found}) == len(found)
    return placed.collect(), {(r.session, r.fragment): (r.holder, r.at_place) for r in found}


def plain(batch, words, session, start):
    """An export without entry ids, one message a second; speakers go by the word."""
    return [(session, None, None, start + i * 1000, "assistant" if w.startswith("y") else "user", w, batch) for i, w in enumerate(words)]


def test_every_place_that_could_hold_a_fragment_is_tried(spark):
    """The longest fragment with a first message, and the last place in it, don't hold what a shorter one or an earlier place does."""
    rows = (
        plain(0, ["go", "y1", "b", "y2", "c", "y3"], "a", 1000) + plain(1, ["d", "y4", "go", "y5", "e", "y6", "f", "y7"], "a", 9000) + plain(2, ["go", "y1", "b"], "a", 1000)  # in the shorter one
        + plain(0, ["go", "y1", "b", "y2", "go", "y3", "c", "y4"], "b", 1000) + plain(1, ["go", "y1", "b"], "b", 1000)  # at its first place
        + plain(0, ["go", "y1", "go", "y2"], "c", 1000) + plain(1, ["d", "y3", "go", "y4", "e", "y5"], "c", 9000) + plain(2, ["go"], "c", 3000)  # at the same time only
        + plain(0, ["go", "y1"], "d", 1000) + plain(1, ["c", "y2", "go", "y1", "d", "y3"], "d", 5000) + plain(2, ["go"], "d", 1000)  # in what lies inside another
    )
    m, s = talk(spark, rows), sessions_of(spark, *"abcd")
    got = C.conversations(m, s).collect()
    assert {x: sum(r.session == x for r in got) for x in "abcd"} == {"a": 14, "b": 8, "c": 10, "d": 6}


def test_contained_fragments_against_brute_force(spark):
    rng, rows = random.Random(12), []
    for session in "abcdef":
        named, kinds = session in "ef", 2 if session in "ab" else 4
        for batch in range(40):
            start = rng.randrange(3)
            for k in range(rng.choice([1, 1, 2, 2, 3, 4, 5, 7, 12, 30])):
                w = rng.randrange(kinds)
                rows.append((session, f"e{w}" if named else None, None, (start + k) * 10, "user", f"w{w}", batch))
    placed, found = laid_inside(spark, rows, *"abcdef")
    words, times, named = {}, {}, {}
    for r in placed:
        words.setdefault((r.session, r.fragment), {})[r.place] = r.h
        times.setdefault((r.session, r.fragment, r.place), set()).add(r["at"])
        named[r.session, r.fragment] = r.named
    words = {k: [x[i] for i in range(len(x))] for k, x in words.items()}
    lone = {k for k, x in words.items() if len(x) == 1 and not named[k]}
    want = {}
    for (s, f), x in words.items():
        n = len(x)
        for (t, g), y in words.items():
            if s == t and len(y) > n:
                places = [p for p in range(len(y) - n + 1) if y[p : p + n] == x and ((s, f) not in lone or times[s, f, 0] & times[t, g, p])]
                want[s, f] = max([want.get((s, f), (0, 0, 0)), *((len(y), g, p) for p in places)])
    want = {k: x[1:] for k, x in want.items() if x[0]}
    assert found.keys() == want.keys() and len(want) > 50 and len(lone) > 5
    assert {k: x for k, x in found.items() if k not in lone} == {k: x for k, x in want.items() if k not in lone}
    assert all((s, h) not in found and words[s, h][p] == words[s, f][0] for (s, f), (h, p) in found.items())  # what holds others lies in none


def test_fragments_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    rows = [("hot", None if rng.random() < 0.3 else f"e{rng.randrange(500)}", "/x", rng.randrange(3000), "user", f"w{i}", 0) for i in range(1500)] + export(1, range(20))
    m, s = talk(spark, rows), sessions_of(spark, "hot", "a")
    want = None
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = sorted(map(tuple, C.place_in_fragments(C.message_rows(m, s)).drop("at", "code").collect()), key=str)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert want is None or got == want
        want = got
    assert {r[5] for r in want if r[0] == "hot"} == set(range(1500)) and len({r[4] for r in want}) == 2


def test_overlaps_that_prove_nothing(spark):
    """One equal message without id at another time, and a sequence that ends as it begins."""
    rows = [("a", None, None, 10, "user", "go", 0), ("a", None, None, 20, "assistant", "ok", 0), ("a", None, None, 30, "user", "go", 1), ("a", None, None, 40, "assistant", "ok", 1), ("b", None, None, 10, "user", "x", 0), ("b", None, None, 20, "assistant", "y", 0), ("b", None, None, 30, "user", "x", 0), ("b", None, None, 40, "assistant", "z", 0)]
    m, s = talk(spark, rows), sessions_of(spark, "a", "b")
    assert C.assemble(m, s).where("session = 'b'").count() == 4 and C.dropped_sessions(m, s).count() == 0
    assert C.assemble(m.limit(0), s).count() == 0
