"""Stems, expressions and ranks against SQLite's full-text engine; previews and excerpts."""

import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.functions.text import excerpt, preview_text, sanitize, stem, stems
from skein.operators import retrieve as R
from skein.plans import match as M

WORDS = "deployment deployed deploy caching strategies relational conditional rational valency digitizer conformably radically differently vileness analogously vietnamization predication operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize electricity electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologous communism activate angularity effective bowdlerize probate rate cease controlling rolling happy sky agreed plastered motoring sing hissing fizzed failing filing caresses ponies ties cats feed archaeology possibly generally".split()

DOCS = [
    ("alpha beta gamma deployed it cleanly", "alpha beta"),
    ("CARGO_TARGET_DIR is set for 192.168.1.112 in display.cpp", "Café déployé"),
    ("beta gamma alpha alpha alpha", ""),
    ("the deployment finished; we deploy caching strategies twice", "we deploy caching strategies"),
    ("gamma one two three four five six seven eight nine ten eleven twelve beta", "gamma"),
    ("display the cpp file", "display"),
    ("", "beta alpha"),
    ("alpha-beta alphabet", "alphabet soup"),
]


@pytest.fixture(scope="module")
def oracle():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(content, prose, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, content, prose) VALUES (?, ?, ?)", [(i, *d) for i, d in enumerate(DOCS)])
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    return con


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    rows = [(i, f"m{i}", "s", 1000 + i, "user", c, p, [*stems(c)], [*stems(p)]) for i, (c, p) in enumerate(DOCS)]
    spark.createDataFrame(rows, "seq bigint, id string, session_id string, ts_ms bigint, type string, content string, prose string, content_tokens array<string>, prose_tokens array<string>").write.parquet(f"{path}/messages.parquet")
    return R.Corpus(spark, str(path), stemming=True)


def test_stems_like_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(c, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'row')")
    for w in WORDS:
        con.execute("DELETE FROM f")
        con.execute("INSERT INTO f VALUES (?)", (w,))
        assert [r[0] for r in con.execute("SELECT term FROM v")] == [stem(w)], w


def test_words_like_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(c, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    for text in ("Café CARGO_TARGET_DIR 192.168.1.112", "naïve Ünïcode façade", "日本語 テスト 中文", "a-b_c d.e", "Ελληνικά русский"):
        con.execute("DELETE FROM f")
        con.execute("INSERT INTO f VALUES (?)", (text,))
        assert [r[0] for r in con.execute("SELECT term FROM v ORDER BY offset")] == stems(text), text


@pytest.mark.parametrize("expression", [
    "alpha", "alpha beta", "alpha AND gamma", "alpha OR display", "beta NOT gamma", '"alpha beta"', '"beta gam"*', "alph*", "prose : alpha", "{content prose} : beta", "- prose : beta",
    "^alpha", "NEAR(gamma beta, 3)", "NEAR(gamma beta, 20)", "NEAR(gamma beta)", "(alpha OR display) AND beta", "alpha OR beta NOT gamma", "deploy", "strategy caching", '"display cpp"', "alpha + beta", "content : (alpha OR display) NOT prose : alphabet", "alpha beta OR cpp",
])
def test_raw_expressions_and_ranks(oracle, docs, expression):
    want = [(r[0], round(r[1], 6)) for r in oracle.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ? ORDER BY 2, rowid DESC", (expression,))]
    got = [(r.seq, round(r.score, 6)) for r in R.search(docs, R.SearchOptions(expression, 0, raw=True, scope=R.Scope())).collect()]
    assert dict(got).keys() == dict(want).keys()
    # SQLite leaves out instances in a branch that NOT makes void, and outside the range of NEAR or ^
    if not any(x in expression for x in ("NEAR", "^", "OR beta NOT")):
        assert dict(got) == pytest.approx(dict(want), abs=2e-6)


@pytest.mark.parametrize("bad", ["display.cpp", "alpha AND", "(alpha", "NOT alpha", '"open', "nocol : x", "alpha)", "NEAR(a b, x)", "AND"])
def test_bad_expressions(oracle, bad):
    with pytest.raises(sqlite3.OperationalError):
        oracle.execute("SELECT rowid FROM f WHERE f MATCH ?", (bad,)).fetchall()
    with pytest.raises(M.BadQuery):
        M.raw(bad)


@pytest.mark.parametrize("pattern,any_", [("display.cpp", False), ("alpha gamma", False), ("alpha display", True), ("caching strategy", False), ("192.168.1.112", False), ("cafe", False), ("... alpha", False)])
def test_literal_patterns(oracle, docs, pattern, any_):
    terms = ['"' + t.replace('"', '""') + '"*' for t in pattern.split()]
    want = {r[0] for r in oracle.execute("SELECT rowid FROM f WHERE f MATCH ?", ((" OR " if any_ else " ").join(terms),))}
    assert {r.seq for r in R.search(docs, R.SearchOptions(pattern, 0, any=any_, scope=R.Scope())).collect()} == want


def test_no_words_no_hits_and_relaxation(docs):
    assert R.search(docs, R.SearchOptions("...", 5)).count() == 0 and M.raw("  ") is None
    page, relaxed = R.search_relaxed(docs, R.SearchOptions("soup display", 5))
    assert relaxed and {r.seq for r in page.collect()} == {5, 7}
    assert R.search_relaxed(docs, R.SearchOptions("nothing nowhere", 5))[1] is False


def test_necessary_words():
    assert M.necessary(M.literal("alpha beta")) == [("alpha", True)]
    assert M.necessary(M.raw("a OR bc")) == [("a", False), ("bc", False)]
    assert M.necessary(M.raw("abc NOT d")) == [("abc", False)]


def test_excerpts():
    text = "x" * 300 + " this is not good.  The  needle is here, and " + "y " * 300
    a = text.index("needle")
    out = excerpt(text, [(a, a + 6)], 60)
    assert "needle" in out and len(out) <= 60 and out.startswith("… ") and out.endswith("…")
    assert excerpt("short needle text", [(6, 12)], 60) == "short needle text" and excerpt("x", [], 10) == ""


def test_excerpt_shows_most_terms():
    text = "alpha " + "w " * 100 + "alpha beta gamma " + "w " * 100 + "beta"
    hits = [(m.start(), m.end(), m[0]) for m in re.finditer("alpha|beta|gamma", text)]
    assert "alpha beta gamma" in excerpt(text, hits, 50) and len(excerpt(text, hits, 50)) <= 50
    assert excerpt(text, hits[:1], 20).startswith("alpha w") and excerpt("x" * 100 + "needle" + "x" * 100, [(100, 106)], 20).startswith("… needle")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab éß\n", max_size=120), st.integers(1, 40))
def test_excerpt_limits(text, n):
    hits = [(i, i + 1) for i, c in enumerate(text) if c == "b"]
    out = excerpt(text, hits, n)
    assert len(out) <= n and (not hits or "b" in out or n < 4)


def test_previews():
    assert preview_text(" a \n b ", 10) == "a b" and preview_text("abcdef", 3) == "abc…"
    assert sanitize("a\x1b[0m\nb\t") == "a\\u001b[0m\\nb\\t" and sanitize("a\nb", True) == "a\nb"


@pytest.mark.parametrize("pattern,raw", [("alpha beta", False), ("display.cpp", False), ("deploy", False), ("a", False), ("alpha OR beta NOT gamma", True), ('"alpha beta" OR NEAR(gamma beta, 3)', True), ("zzz", False)])
def test_index_gives_the_same(spark, docs, tmp_path, pattern, raw):
    import shutil

    from skein.sources.index import write_index

    shutil.copytree(f"{docs.directory}/messages.parquet", tmp_path / "messages.parquet")
    write_index(spark.read.parquet(f"{tmp_path}/messages.parquet"), str(tmp_path))
    indexed = R.Corpus(spark, str(tmp_path), stemming=True)
    o = R.SearchOptions(pattern, 0, raw=raw, scope=R.Scope())
    rows = lambda c: [(r.seq, round(r.score, 9)) for r in R.search(c, o).collect()]
    assert indexed.index is not None and rows(indexed) == rows(docs)
