"""The entry module's contract, also when the subpackage for training text has been deleted."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def names(where):
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=where, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(where)}, check=True).stdout
    found = {line.split()[0]: line.split()[1:] for line in out.splitlines() if line.startswith(("NAMES", "SQL"))}
    return found["NAMES"], found["SQL"]


def test_sql_belongs_to_queries():
    queries, sql = names(ROOT)
    assert set(sql) <= set(queries) and "vector_topk" in sql


def test_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "corpusloom"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "corpusloom/llm", ignore_errors=True)
    queries, sql = names(tmp_path)
    assert not [q for q in queries if q == "pipeline" or q.startswith("op")] and "vector_topk" in queries and set(sql) <= set(queries)


def test_nothing_else_imports_it():
    for path in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_workers_get_the_package_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from corpusloom.shipping import ship
from corpusloom.sources.files import parsed
ship(spark)
rows = parsed(spark.createDataFrame([("a.py", "def f(): pass", "Python", 1)], "path string, content string, lang string, loc long")).collect()
print("FOUND", rows[0]["functions"][0]["name"])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert "FOUND f" in subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=env, check=True).stdout
