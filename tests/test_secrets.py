"""Secret patterns, tree walk and rewriting."""

import json

import zstandard

from skein.operators import secrets as R

SAMPLES = {
    "private_key": "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
    "bearer": "Bearer abcdefghijklmnop",
    "basic_auth_url": "postgres://user:pa55word@host/db",
    "known_token": "ghp_" + "a" * 24,
    "jwt": "eyJhbGciOiJ9.eyJzdWIiOiIx.abcdefgh12",
    "secret_header": "x-api-key: abc",
    "secret_assignment": "password = 'hunter2hunter2'",
    "secret_query": "https://x/?token=%2F%2F%2F%2F&keep=yes",
}


def test_each_pattern_in_python_and_jvm(spark):
    df = spark.createDataFrame([(k, v) for k, v in SAMPLES.items()] + [("none", "nothing here"), ("null", None), ("twice", "a token=abcdefgh1 b token=abcdefgh2")], "k string, t string")
    rows = {r.k: r for r in R.scrub(df, "t", matches="n").collect()}
    for k, v in SAMPLES.items():
        clean, n = R.scrub_text(v, [])
        assert n >= 1 and (rows[k].clean, rows[k].n) == (clean, n), k
        assert "REDACTED" in clean
    counted = {r.k: r.matches for r in R.count_matches(df, "t", ["k"]).collect()}
    assert counted == {k: r.n for k, r in rows.items() if r.n}
    assert rows["none"].n == 0 and rows["null"].clean is None and rows["null"].n == 0 and rows["twice"].n == 2


def test_query_secret_is_idempotent():
    once, n = R.scrub_text(SAMPLES["secret_query"], [])
    assert n == 1 and once.endswith("&keep=yes") and R.scrub_text(once, []) == (once, 0)


def test_tree_walk():
    rec = {"type": "image", "data": "token=abcdefghij", "apiKey": "abcdefgh", "signature": "Bearer abcdefghijklmnop", "list": ["Bearer abcdefghijklmnop", 1, None]}
    out, n = R.scrub_value(rec, [])
    assert n == 2 and out["data"] == rec["data"] and out["apiKey"] == R.MARK and out["signature"] == rec["signature"]
    assert R.scrub_value(out, [])[1] == 0


def test_exact_values(tmp_path):
    env = tmp_path / ".env"
    env.write_text("export MY_TOKEN='s3cr3t-value'\nNAME=abcdefghij\nPASSWORD=changeme\n")
    assert R.values_from_files([str(env)]) == ["s3cr3t-value"]
    assert R.values_from_environment({"A_SECRET": "longer-value-1", "PATH": "/bin/something"}) == ["longer-value-1"]
    assert R.scrub_text("x s3cr3t-value y", ["s3cr3t-value"]) == (f"x {R.MARK} y", 1)


def test_files(spark, tmp_path):
    old = json.dumps({"timestamp": "2020-01-01T00:00:00Z", "t": "Bearer abcdefghijklmnop"})
    new = json.dumps({"timestamp": "2026-01-01T00:00:00Z", "t": "Bearer abcdefghijklmnop"})
    body = "\n".join([old, new, "{broken Bearer abcdefghijklmnop", ""])
    (tmp_path / "a.jsonl").write_text(body)
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.compress(body.encode()))
    (tmp_path / "a.jsonl").chmod(0o640)
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.jsonl", "b.jsonl.zst")], "path string")
    since = 1_700_000_000_000
    assert [(r.records, r.matches) for r in R.scan(files, since).collect()] == [(1, 1)] * 2
    assert (tmp_path / "a.jsonl").read_text() == body
    R.scan(files, since, apply=True).collect()
    lines = (tmp_path / "a.jsonl").read_text().split("\n")
    assert lines[0] == old and R.MARK in lines[1] and lines[2].startswith("{broken") and (tmp_path / "a.jsonl").stat().st_mode & 0o777 == 0o640
    assert sum(r.matches for r in R.scan(files, since).collect()) == 0


def test_many_exact_values(spark):
    """Fifty values are one step; quotes of regular expressions inside them mean nothing."""
    values = R.normalize([f"val.{i}*\\E(x" for i in range(50)] + ["val.1*\\E(xyz", "$1plain$0"])
    texts = [f"a {v} b {v}c" for v in values] + ["none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = {r.k: (r.clean, r.matches) for r in R.scrub(df, "t", values).collect()}
    assert got[51] == (f"a {R.MARK} b {R.MARK}c", 2) and all(got[i] == R.scrub_text(t, values) for i, t in enumerate(texts) if t) and got[53] == (None, 0)
    for out in (R.scrub(df, "t", values), R.count_matches(df, "t", ["k"], values)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") <= 2 * len(R.PATTERNS) + 2
