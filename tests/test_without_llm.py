"""The library without the training-data operators: a copy without their folders still gives all other queries."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout
    return [line.split() for line in out.splitlines()[-2:]]


def test_the_rest_stands_alone(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    queries, sql = names(copy)
    assert len(queries) > 150 and set(sql) <= set(queries) and not [q for q in queries if q == "pipeline" or q[:2] == "op"]
    for folder, _, files in os.walk(copy / "kbspark"):
        assert not [f for f in files if f.endswith(".py") and "kbspark.llm" in open(os.path.join(folder, f)).read()]
