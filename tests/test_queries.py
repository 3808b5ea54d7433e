"""Every registered query runs over the smallest tables and gives the rows of its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entries

FOLDER = "/root/testdata/sf0.001"
#: Long loops of jobs; scenes and sequences have tests of their own.
SLOW = {"reconstruct_simple", "recover_feature_init", "icp_colored_v1", "pipeline"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{t}'")
    return con


def table(rows, columns):
    show = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in entries.queries() if n not in SLOW])
def test_query(spark, con, name):
    got = entries.queries()[name](spark, FOLDER)
    rows, sql = got.collect(), entries.oracle_sql().get(name)
    if sql:
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert table(rows, got.columns) == table(want.fetchall(), columns)
    else:
        assert len(got.columns) == len(set(got.columns)) and rows is not None


def test_entry(spark):
    assert entries.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",), ()])
def test_text_operators_can_be_left_out(tmp_path, gone):
    """In a copy without the text operators the other queries are all there, and nothing else imports them."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/fieldscan", tmp_path / "fieldscan", ignore=shutil.ignore_patterns("__pycache__", *gone))
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - set(gone):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    code = "import sys, fieldscan.plans.queries, fieldscan.streaming.capture; assert not [m for m in sys.modules if m.startswith('fieldscan.llm')]; "
    code += "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    names, sql = (line.split() for line in out.stdout.strip().splitlines()[-2:])
    text = {n for n in names if n.startswith("op") or n == "pipeline"}
    assert set(names) - text == {n for n in entries.queries() if not n.startswith("op") and n != "pipeline"}
    assert set(sql) <= set(names) and not (gone and text)
