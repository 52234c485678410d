"""The library without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), len(e.queries()) > 100, len(e.oracle_sql()) > 100)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_imports_on_a_copy_without_the_folder(tmp_path, pipeline):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    done = subprocess.run([sys.executable, "-c", NAMES], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["0", "True", "True"], done.stderr
