import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import SMALL

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql_fit():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 31


def test_entry_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "gradeloom", tmp_path / "gradeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [x for x in q if x.startswith(('op', 'pipeline'))]; assert set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
