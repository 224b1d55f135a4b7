"""The registry with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT
from tallyspark.plans.catalog import QUERIES


def _names(root, cwd):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); e.oracle_sql()"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=cwd, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": str(root)}, check=True)
    return set(got.stdout.split())


def _copy(to, *without):
    shutil.copytree(ROOT, to, ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__") or os.path.relpath(f"{d}/{n}", ROOT) in without])
    return to


def test_core_alone(tmp_path):
    """Without the subpackage the other queries stay, whether the pipeline's file is there or not."""
    for k, gone in enumerate([("tallyspark/llm", "tests/llm"),
                              ("tallyspark/llm", "tests/llm", "corpus_pipeline.py")]):
        assert _names(_copy(tmp_path / str(k), *gone), tmp_path) == set(QUERIES)


def test_core_queries_in_registry():
    assert set(QUERIES) <= _names(ROOT, ROOT)
