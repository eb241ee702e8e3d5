"""Every registered query of the engine against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT, SMALL, same_rows

from quarrylight.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """Both folders and the pipeline gone: all other queries are listed."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    env = os.environ | {"PYTHONPATH": str(copy)}
    for gone in ("none", "corpus_pipeline.py"):
        (copy / gone).unlink(missing_ok=True)
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
        assert said.stdout.split() == [str(len(QUERIES)), "False"], said.stderr
