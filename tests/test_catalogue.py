import os

import duckdb
import pytest

from driftlog.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(repr([float(f"{x:.10g}") if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, oracle, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    cur = oracle.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    assert normal(got) == normal(want)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_equality_reaches_the_scan(spark, sf):
    plan = catalogue.QUERIES["where_eq_and"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan


def test_projection_prunes_the_scan(spark, sf):
    plan = catalogue.QUERIES["range_from"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "struct<event_id:bigint,value:double>" in plan


def test_missing_subpackage_leaves_the_other_queries(tmp_path):
    """From a copy without the training-data folders and corpus_pipeline.py."""
    import shutil
    import subprocess
    import sys

    root, copy = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=copy, env=env)
    assert out.stdout.split() == [str(len(catalogue.QUERIES)), "False", "True"], out.stderr
