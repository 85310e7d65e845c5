"""The engine stands without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder: Path) -> set[str]:
    told = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"], cwd=folder, capture_output=True, text=True, check=True)
    return set(told.stdout.split())


def test_without_the_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    left = names(copy)
    assert "metrics_by_fold" in left and not any(n.startswith("op") or n == "pipeline" for n in left)
    (copy / "foldspark" / "llm" / "__pycache__").mkdir(parents=True)
    assert names(copy) == left


def test_nothing_else_imports_them():
    for path in ROOT.glob("foldspark/**/*.py"):
        if "llm" not in path.parts:
            assert "foldspark.llm" not in path.read_text(), path
