"""The library without its corpus operators."""

import os
import shutil
import subprocess
import sys

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(HOME, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.txt", "spark-warehouse"))
    for gone in ("marginalia/llm", "tests/llm"):
        shutil.rmtree(copy / gone, ignore_errors=True)
    for pipeline_too in (False, True):
        if pipeline_too and (copy / "corpus_pipeline.py").exists():
            os.remove(copy / "corpus_pipeline.py")
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q if n[2:3].isdigit() or n == 'pipeline')"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=False)
        assert done.returncode == 0, done.stderr
