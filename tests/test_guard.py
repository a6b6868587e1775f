"""Without lontar.llm, its tests and corpus_pipeline everything else still imports."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100; assert not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"


def test_the_rest_stands_alone(tmp_path):
    for name in ("lontar", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    got = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr


def test_nothing_else_imports_the_subpackage():
    for file in (ROOT / "lontar").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT / "lontar").parts:
            assert "lontar.llm" not in file.read_text() and "import llm" not in file.read_text(), file
