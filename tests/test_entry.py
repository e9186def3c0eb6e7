"""The driver's entry points, with and without the corpus subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"


@pytest.mark.parametrize("gone", [[], ["tessera/llm"], ["tessera/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_without_the_corpus_folders(tmp_path, gone):
    for name in ("tessera", "__spark_entry__.py", "corpus_pipeline.py"):
        source, target = os.path.join(ROOT, name), tmp_path / name
        if os.path.isdir(source):
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, target)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, pipeline, corpus = out.stdout.split()
    llm, top = (tmp_path / "tessera/llm").exists(), (tmp_path / "corpus_pipeline.py").exists()
    assert int(n) > 100 and corpus == str(llm) and pipeline == str(llm and top)
