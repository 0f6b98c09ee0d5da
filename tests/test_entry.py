"""The driver's entry file works with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'pipeline' in q, set(o) <= set(q))"


@pytest.mark.parametrize("gone", [("barloom/llm",), ("barloom/llm", "corpus_pipeline.py")])
def test_queries_without_text_operators(tmp_path, gone):
    skipped = shutil.ignore_patterns(".git", "__pycache__", "*.json")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda d, names: skipped(d, names) | {n for n in names if str((Path(d) / n).relative_to(ROOT)) in gone})
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-800:]
    n, with_sql, pipeline, known = out.stdout.split()
    assert int(n) >= 218 and int(with_sql) >= 209 and (pipeline, known) == ("False", "True")
