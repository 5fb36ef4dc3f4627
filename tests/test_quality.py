"""Hierarchies, redelivered messages, dangling references, as-of scans: against brute force, and odd input."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import redelivery as D
from skein.operators.asof import fill_forward
from skein.operators.hierarchy import ancestor_pairs, clean_links, hierarchy
from skein.operators.linking import fold_activities, link_messages, pair_by_id, pair_greedily
from skein.operators.references import report, resolve
from skein.functions.keys import is_blank, norm_id, norm_path, norm_role


def forest(spark, rows):
    df = spark.createDataFrame(rows, "node string, parent string, extra string") if rows and len(rows[0]) == 3 else spark.createDataFrame(rows, "node string, parent string")
    return df.select("node"), clean_links(df, df)


def test_keys(spark):
    rows = [(" Ab\t", "/x.jsonl.zst ", "Human"), ("", " ", None), (None, None, "ai"), (" C ", "/y", "  ")]
    got = spark.createDataFrame(rows, "i string, p string, r string").select(norm_id("i"), norm_path("p"), norm_role("r"), is_blank("i")).collect()
    assert [tuple(r) for r in got] == [("ab", "/x.jsonl", "user", False), (None, None, None, True), (None, None, "assistant", True), ("c", "/y", None, False)]


def test_hierarchy(spark):
    rows = [("a", None, "x"), ("b", "a", "x"), ("c", "b", "x"), ("c", "b", "x"), ("d", "ghost", "x"), ("e", "f", "x"), ("f", "e", "x"), ("g", "e", "x"), ("s", "s", "x"), (None, "a", "x"), ("h", "", "x")]
    nodes, links = forest(spark, rows)
    got = {r.node: (r.parent, r.root, r.depth, r.path, r.state) for r in hierarchy(nodes, links).collect()}
    assert got["c"] == ("b", "a", 2, "a/b/c", "tree") and got["d"] == (None, "d", 0, "d", "tree") and got["h"][4] == "tree"
    assert got["e"] == ("f", None, None, None, "on_cycle") and got["s"][4] == "on_cycle" and got["g"][4] == "leads_to_cycle" and len(got) == 9
    pairs = {(r.node, r.ancestor, r.distance) for r in ancestor_pairs(links).collect()}
    assert pairs == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2), ("e", "f", 1), ("f", "e", 1), ("e", "e", 2), ("f", "f", 2), ("g", "e", 1), ("g", "f", 2), ("s", "s", 1)}


def test_hierarchy_deep_chain_and_empty(spark):
    nodes, links = forest(spark, [(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(70)])
    top = hierarchy(nodes, links).orderBy(F.desc("depth")).first()
    assert top.depth == 69 and top.root == "n000" and top.path.count("/") == 69
    assert ancestor_pairs(links).count() == 69 * 70 // 2
    empty = spark.createDataFrame([], "node string, parent string")
    assert hierarchy(empty, clean_links(empty, empty)).count() == 0 and ancestor_pairs(clean_links(empty, empty)).count() == 0


def test_long_circle_with_a_tail(spark):
    """A circle of 11 with a tail of 3 into it, beside a tree that is resolved in one round."""
    rows = [(f"c{i}", f"c{(i + 1) % 11}") for i in range(11)] + [("t0", "c4"), ("t1", "t0"), ("t2", "t1"), ("a", "b"), ("b", None)]
    _, links = forest(spark, rows)
    up, want = dict(rows), set()
    for n, _ in rows:
        at, k, met = up.get(n), 1, set()
        while at and at not in met:
            met.add(at)
            want.add((n, at, k))
            at, k = up.get(at), k + 1
    assert {(r.node, r.ancestor, r.distance) for r in ancestor_pairs(links).collect()} == want


def test_several_parents(spark):
    _, links = forest(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", None)])
    assert {(r.node, r.ancestor) for r in ancestor_pairs(links).collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("c", "d")}


@pytest.mark.parametrize("slice_rows,recent", [(1 << 20, 1 << 16), (50, 4)])
def test_redelivered(spark, slice_rows, recent):
    """Also with filters so small that nearly everything passes them, many slices and a cache that forgets."""
    rng = random.Random(1)
    rows = [(i, f"s{rng.randrange(5)}", f"e{rng.randrange(150)}" if rng.random() < 0.9 else None, 1_700_000_000 + rng.randrange(10**6), "x") for i in range(600)]
    rows += [(600 + i, "hot", "one", 1_700_000_000 + i * 3000 if i % 3 else None, "x") for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq bigint, s string, e string, at bigint, h string").withColumn("at", F.timestamp_seconds("at"))
    want, seen = set(), set()
    for seq, s, e, *_ in sorted(rows):
        if e is not None:
            want |= {seq} if (s, e) in seen else set()
            seen.add((s, e))
    got = [r.seq for r in D.redelivered(df, ["s", "e"], "seq", "at", slice_rows, recent, D.DENSITY if slice_rows > 100 else 0).collect()]
    assert set(got) == want and len(got) == len(want)
    if slice_rows > 100:
        assert D.keep_first(df, ["s", "e"], "seq", "at").count() == len(rows) - len(want)
        assert D.redelivered(df.limit(0), ["s", "e"], "seq", "at").count() == 0


def test_set_aside_and_screen():
    """A hot identifier sends few rows to its slice; the share that passes the filters doesn't grow with the rows."""
    rng = np.random.default_rng(2)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(1000, 7)), pa.array(rng.integers(0, 3, 1000).astype(np.int32)), pa.array(range(k * 1000, k * 1000 + 1000))], ["h", "bucket", "__order"]) for k in range(5)]
    how = np.concatenate([b.column(3).to_numpy() for b in D._set_aside(64)(iter(batches))])
    assert (how == D.NEW).sum() <= 6 and (how == D.TWICE).sum() <= 6 and (how == D.ASIDE).sum() >= 4990
    for n in (2_000, 200_000):
        b = pa.RecordBatch.from_arrays([pa.array(rng.integers(-(1 << 62), 1 << 62, n)), pa.array(rng.integers(0, 32, n).astype(np.int32)), pa.array(range(n)), pa.array(np.zeros(n, np.int8))], ["h", "bucket", "__order", "how"])
        assert sum(x.num_rows for x in D._screen(D.DENSITY)(iter([b]))) < 0.02 * n


def test_references(spark):
    ts = "timestamp '2025-0{}-01 00:00:00'"
    refs = spark.createDataFrame([("f", "r1", "k1", 5), ("f", "r2", "k2", 5), ("f", "r3", "k3", 5), ("f", "r4", "k4", 5), ("f", "r5", None, 5), ("g", "r6", "k1", None), ("f", "r7", "k4", None)], "ref_field string, row_key string, key string, m int").withColumn("ref_at", F.when(F.col("m").isNotNull(), F.expr(ts.format(5))))
    owners = spark.createDataFrame([("f", "k1", 1, None), ("f", "k2", 1, 2), ("f", "k2", 1, None), ("f", "k3", 1, 2), ("f", "k4", 7, None), ("f", None, 1, None)], "ref_field string, key string, a int, b int")
    day = lambda c: F.when(F.col(c).isNotNull(), F.make_timestamp(F.lit(2025), F.col(c), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    owners = owners.select("ref_field", "key", day("a").alias("valid_from"), day("b").alias("valid_to"))
    out = resolve(refs, owners)
    assert {r.row_key: r.status for r in out.collect()} == {"r1": "present", "r2": "present", "r3": "deleted", "r4": "late", "r5": "missing", "r6": "missing", "r7": "present"}
    assert {(r.ref_field, r.period, r.status): r.n for r in report(out).collect()}[("f", "2025-05", "present")] == 2
    assert {r.status for r in resolve(refs, owners.limit(0)).collect()} == {"missing"} and resolve(refs.limit(0), owners).count() == 0


def test_fill_forward_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.randrange(400), rng.randrange(10**6) if rng.random() < 0.05 else None, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint, row bigint").repartition(7)
    want, last = {}, {}
    for k, o, v, r in sorted((r for r in rows if r[0] is not None), key=lambda x: (x[0], x[1], x[3])):
        last[k] = v if v is not None else last.get(k)
        want[r] = last[k]
    got = {r.row: r.filled for r in fill_forward(df, "k", ["o", "row"], "v", "row").collect()}
    assert got == want
    assert fill_forward(df.limit(0), "k", ["o"], "v", "row").count() == 0


def calls(spark, rows):
    return spark.createDataFrame(rows, "invocation_id bigint, session_id string, tool_id string, tool_name string, ts_ms bigint")


def results(spark, rows):
    return spark.createDataFrame(rows, "result_id bigint, session_id string, tool_id string, tool_name string, ts_ms bigint")


def test_pairs(spark):
    c = calls(spark, [(1, "s", "t", "A", 10), (2, "s", "t", "A", 20), (3, "x", "t", "A", 15), (4, "s", "", "Bash", 30), (5, "s", None, "", 31), (6, "s", "", "Read", 32), (7, "s", "t", "A", None), (8, None, "t", "A", 1)])
    r = results(spark, [(100, "s", "t", "", 15), (101, "s", "t", "", 20), (102, "x", "t", "", 14), (103, "s", "", "bash", 40), (104, "s", "", "bash", 41), (105, "s", "", "bash", 42), (106, "s", "", "Read", 29), (107, "s", "", "", 43), (108, None, "t", "", 50)])
    assert {(x.result_id, x.invocation_id) for x in pair_by_id(c, r).collect()} == {(100, 1), (101, 2)}
    assert {(x.result_id, x.invocation_id) for x in pair_greedily(c, r).collect()} == {(103, 5), (104, 4), (107, 6)}
    assert {(x.result_id, x.invocation_id) for x in pair_greedily(c, r, look_back=1).collect()} == {(107, 6)}
    assert pair_by_id(c.limit(0), r).count() == 0 and pair_greedily(c, r.limit(0)).count() == 0


def test_activities(spark):
    from skein import schema as S

    cols = [f.name for f in S.parse(S.EVENTS).fields]
    base = {"source_path": "/p", "session_id": "s", "ts_ms": 1, "started_at": 0, "completed_at": 0, "tool_uses": 0}
    events = [
        {"ord": 1, "kind": "started", "entry_id": "e1", "parent_id": "m", "activity_id": "a", "title": "T", "status": "running", "started_at": 5},
        {"ord": 2, "kind": "linked", "entry_id": "e2", "activity_id": "a", "session_file": "/child"},
        {"ord": 3, "kind": "terminal", "entry_id": "e3", "parent_id": "m", "activity_id": "a", "status": "completed", "completed_at": 9, "tool_uses": 4, "result_summary": "R"},
        {"ord": 4, "kind": "task-notification", "entry_id": "e4", "activity_id": "b", "status": "running", "started_at": 7, "title": "B"},
        {"ord": 5, "kind": "task-notification", "entry_id": "e5", "activity_id": "b", "status": "done", "started_at": 8, "completed_at": 8, "title": ""},
    ]
    df = spark.createDataFrame([tuple({**{c: "" for c in cols}, **base, **e}[c] for c in cols) for e in events], S.EVENTS)
    got = {r.activity_id: r for r in fold_activities(df).collect()}
    a, b = got["a"], got["b"]
    assert (a.title, a.status, a.started_at, a.completed_at, a.tool_uses, a.child_session_path, a.start_entry_id, a.terminal_entry_id) == ("T", "completed", 5, 9, 4, "/child", "e1", "e3")
    assert (b.title, b.status, b.started_at, b.completed_at, b.tool_uses) == ("B", "done", 7, 8, None)
    m = spark.createDataFrame([("/p", "m", 1, "", ""), ("/p", "m", 2, "", ""), ("/p", "n", 3, "", "")], "source_path string, entry_id string, seq bigint, activity_id string, activity_role string")
    assert {r.seq: (r.activity_id, r.activity_role) for r in link_messages(m, df).collect()} == {1: ("", ""), 2: ("a", "start"), 3: ("", "")}
