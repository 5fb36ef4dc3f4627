"""The driver's contract."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 38
    assert {f"p{n}_found" for n in (5, 6, 7)} <= set(queries)


def test_core_does_not_load_the_optional_part():
    code = "import sys; sys.modules['skein.llm'] = None; import __spark_entry__ as e; assert 'p1_found' not in e.queries() and 'p5_found' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rpartition("/")[0], capture_output=True).returncode == 0


def test_entry(spark, small):
    assert entry.entry(spark).columns == ["rank", "seq", "score"]
    assert entry.queries()["table_counts"](spark, small).count() == 4
