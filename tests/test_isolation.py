"""Without the text operators and their tests the rest imports and registers its queries."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sorted(k for k in q if k.startswith('op') or k == 'pipeline'))"


@pytest.mark.parametrize("gone", [("quillspark/llm", "tests/llm"), ("quillspark/llm", "tests/llm", "corpus_pipeline.py")])
def test_rest_stands_alone(tmp_path, gone):
    there = tmp_path / "copy"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for name in gone:
        path = there / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    said = subprocess.run([sys.executable, "-c", SAY], cwd=there, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.rstrip().endswith("[]") and int(said.stdout.split()[0]) > 50
