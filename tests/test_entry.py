"""The entry module in copies of the repository that lack the training-text parts."""

import os
import shutil
import subprocess
import sys

import pytest

from checks import MODULES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PLAIN = sum(len(m.QUERIES) for m in MODULES)


@pytest.mark.parametrize("away", [
    ["keystrata/llm", "tests/llm", "corpus_pipeline.py"], ["keystrata/llm", "tests/llm"], ["keystrata/llm/queries.py"],
])
def test_without_training_text(tmp_path, away):
    skip = {os.path.join(ROOT, x) for x in away} | {os.path.join(ROOT, ".git")}
    copy = shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda at, names: [n for n in names if os.path.join(at, n) in skip or n == "__pycache__"])
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(set(e.oracle_sql()) - set(q)), any(n.startswith('op') for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.stdout.split() == [str(PLAIN), "[]", "False"], done.stderr
