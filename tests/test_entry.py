"""The entry without the operators for training data."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import __spark_entry__ as entry
from filewright.session import build_session
names = set(entry.queries())
assert "category_counts" in names and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names), names
assert set(entry.oracle_sql()) <= names
spark = build_session("entry", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
print("rows", entry.entry(spark).count())
"""


def run_without(tmp_path, *left_out):
    def skip(folder, names):
        return [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(folder, n), REPO) in left_out]

    shutil.copytree(REPO, tmp_path / "copy", ignore=skip)
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "copy"), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=300)


def test_entry_without_the_folders(tmp_path):
    done = run_without(tmp_path, "filewright/llm", "tests/llm", "corpus_pipeline.py")
    assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]


def test_entry_where_only_the_folders_are_gone(tmp_path):
    done = run_without(tmp_path, "filewright/llm", "tests/llm")
    assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]
