"""The driver contract holds without the optional folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(q) == sorted(set(q)), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


def _copy(folder, *without):
    skip = {os.path.join(ROOT, name) for name in without}
    shutil.copytree(ROOT, folder, ignore=lambda at, names: [n for n in names if n in (".git", "__pycache__") or os.path.join(at, n) in skip])
    return folder


def _said(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_without_the_operators(tmp_path):
    said = _said(_copy(tmp_path / "bare", "stratalog/llm", "tests/llm"))
    assert int(said[0]) >= 240 and said[1:] == ["True", "False", "True"]
    assert _said(_copy(tmp_path / "barer", "stratalog/llm", "tests/llm", "corpus_pipeline.py")) == said
