"""The engine stands without the folders of the training-data operators, corpus_pipeline.py left where it is."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
IMPORTS = """
import __spark_entry__ as e
try:
    import corpus_pipeline
    raise SystemExit("it should not import")
except ModuleNotFoundError as x:
    assert x.name.startswith("tidemark.llm"), x.name
print(len(e.queries()), len(e.oracle_sql()), sum(n == "pipeline" or n[:2] == "op" and n[2].isdigit() for n in e.queries()))
"""


def test_entry_and_tests_without_the_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "spark-warehouse"))
    clean = {"cwd": tmp_path / "repo", "capture_output": True, "text": True, "env": {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}}
    said = subprocess.run([sys.executable, "-B", "-c", IMPORTS], **clean)
    n, m, ops = map(int, said.stdout.split())
    assert n == m >= 50 and ops == 0
    ran = subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests/test_pure.py", "tests/test_queries.py", "-k", "not stream"], **clean)
    assert ran.returncode == 0, ran.stdout[-2000:]
