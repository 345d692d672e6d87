"""The entry without the training-text operators: a copy of the repository with the two folders left out."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LEFT_OUT = shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache", "spark-warehouse")
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert "checks_passed" in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names), names
assert "pipeline" not in names and set(e.oracle_sql()) <= names
print(len(names))
"""


def _run(folder):
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120)


def test_entry_without_the_llm_package(tmp_path):
    copy = tmp_path / "with_pipeline"
    shutil.copytree(ROOT, copy, ignore=LEFT_OUT)
    done = _run(copy)
    assert done.returncode == 0, done.stderr
    without = tmp_path / "without_pipeline"
    shutil.copytree(copy, without, ignore=shutil.ignore_patterns("corpus_pipeline.py"))
    assert _run(without).stdout == done.stdout
