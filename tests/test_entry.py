"""The driver's contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from ledgerline.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship_query(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.queries()) <= set(entry.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    shutil.copytree(f"{ROOT}/ledgerline", tmp_path / "ledgerline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert 'log_page_bytes' in n and not any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in n); print(len(n))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) == len(catalogue.queries()), done.stderr
