"""The driver contract with and without the corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"


def _names(where):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": ":".join(p for p in os.environ.get("PYTHONPATH", "").split(":") if p and Path(p).resolve() != ROOT)})
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=where, env=env, capture_output=True, text=True, check=True).stdout.splitlines()
    return [set(eval(line)) for line in out[-2:]]


def test_entry_stands_without_the_corpus_subpackage(tmp_path):
    from quadweave.plans import catalogue

    for remove_pipeline in (False, True):
        where = tmp_path / str(remove_pipeline)
        shutil.copytree(ROOT, where, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *["corpus_pipeline.py"] * remove_pipeline))
        queries, sql = _names(where)
        assert queries == set(catalogue.queries()) and sql == set(catalogue.oracle_sql())
