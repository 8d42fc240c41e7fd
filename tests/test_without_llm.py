"""The library and its entry module without the corpus operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/graphspark", tmp_path / "graphspark", ignore=lambda _, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'dead_symbols' in q, any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, *rest = said.stdout.split()
    assert int(n) > 60 and rest == ["True", "False", "True"]


def test_nothing_else_names_the_corpus_operators():
    for folder, _, files in os.walk(f"{ROOT}/graphspark"):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py") and "llm" not in os.path.relpath(folder, ROOT).split(os.sep):
                with open(os.path.join(folder, name)) as f:
                    assert "graphspark.llm" not in f.read(), name
