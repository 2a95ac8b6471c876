"""The library without its training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sorted(n for n in q if n.startswith('op') or n == 'pipeline'))"


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, also):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *also))
    ran = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if "site-packages" in p)})
    assert (ran.returncode, ran.stdout.strip()) == (0, "[]"), ran.stderr


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "manyfold").rglob("*.py"):
        assert "llm" in f.relative_to(ROOT).parts or "manyfold.llm" not in f.read_text(), f
