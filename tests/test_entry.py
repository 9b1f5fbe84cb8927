"""The entry point with and without the optional operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), sorted(q for q in e.queries() if q.startswith('op') or q == 'pipeline'))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_optional_operators(tmp_path, pipeline):
    left_out = ["llm", "__pycache__", ".git", *([] if pipeline else ["corpus_pipeline.py"])]
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(*left_out))
    said = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert said.returncode == 0, said.stderr
    number, names = said.stdout.split(" ", 1)
    assert int(number) > 190 and names.strip() == "[]"
