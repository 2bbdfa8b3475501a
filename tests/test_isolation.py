"""The library without its training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LLM = ("planloom/llm", "tests/llm", "corpus_pipeline.py")
SCRIPT = """
import __spark_entry__ as contract
from planloom.operators import CATALOGUE
assert set(contract.queries()) == set(CATALOGUE), set(contract.queries()) ^ set(CATALOGUE)
assert set(contract.oracle_sql()) <= set(CATALOGUE)
"""


def runs_without(folder, *missing):
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet"))
    for name in missing:
        place = folder / name
        shutil.rmtree(place) if place.is_dir() else place.unlink()
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr


def test_entry_without_the_subpackage_and_the_pipeline(tmp_path):
    runs_without(tmp_path / "copy", *LLM)


def test_entry_without_the_subpackage_alone(tmp_path):
    runs_without(tmp_path / "copy", *LLM[:2])


def test_nothing_else_imports_the_subpackage():
    allowed = {ROOT / "__spark_entry__.py", ROOT / "corpus_pipeline.py"}
    for path in ROOT.rglob("*.py"):
        inside = path.is_relative_to(ROOT / "planloom/llm") or path.is_relative_to(ROOT / "tests/llm")
        if path not in allowed and not inside and path.name != "test_isolation.py":
            assert "planloom.llm" not in path.read_text(), path
