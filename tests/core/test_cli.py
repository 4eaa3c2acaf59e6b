from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import os
from pyspark.sql import SparkSession
from plumbline.sources.traces import TraceStore
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
store = TraceStore(spark)
slow = os.environ.get("SLOW") == "1"
for k in range(6):
    store.record("filter", 20000, "float64", contiguous=0 if slow else 1, selected_kernel="numpy_fallback" if slow else "avx2", runtime_ns=1e6 * (3 if slow else 1) + k)
store.flush()
"""


def run(tmp_path, *args, **more):
    env = {**os.environ, "PYTHONPATH": str(ROOT), "PLUMBLINE_TRACES": str(tmp_path / "traces"), **more}
    return subprocess.run([sys.executable, "-m", "plumbline.cli", *args], capture_output=True, text=True, env=env, timeout=300)


def test_baseline_and_check(tmp_path):
    script = tmp_path / "work.py"
    script.write_text(SCRIPT)
    done = run(tmp_path, "baseline", "--name", "v1", "--script", str(script), "--runs", "1")
    assert done.returncode == 0 and "filter/float64/20000  6" in done.stdout and "1 of 1 runs" in done.stdout and "cpu_model" in done.stdout
    done = run(tmp_path, "check", "--baseline", "v1", "--script", str(script), "--runs", "1", "--min-pairs", "5")
    assert done.returncode == 0 and "within_noise" in done.stdout and "1 comparisons" in done.stdout
    done = run(tmp_path, "check", "--baseline", "v1", "--script", str(script), "--runs", "1", "--min-pairs", "5", SLOW="1")
    assert done.returncode == 1 and "regression" in done.stdout and "work.py" in done.stdout and "copying takes" in done.stdout and "+200.0%" in done.stdout
    done = run(tmp_path, "check", "--baseline", "v1", "--script", str(script), "--runs", "1", SLOW="1")
    assert done.returncode == 0 and "insufficient_data" in done.stdout and "6+6" in done.stdout
    done = run(tmp_path, "profile", "--script", str(script), "--runs", "1")
    assert done.returncode == 0 and "100.0%" in done.stdout and "cpu_model" in done.stdout


@pytest.mark.parametrize("args", [("baseline", "--name", "x"), ("check", "--baseline", "x"), ("profile",)])
def test_missing_script(tmp_path, args):
    assert run(tmp_path, *args, "--script", str(tmp_path / "none.py")).returncode == 1


def test_entry_without_corpus_operators(tmp_path):
    """The rest works when the corpus operators are removed."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline_factor' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
