"""The registry stays whole when the corpus operators are gone or can't be imported."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), set(s) <= set(q), any(n.startswith('op') and n[2].isdigit() for n in q) or 'pipeline' in q)"


def count(folder: Path) -> str:
    return subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()


def test_queries_without_the_corpus_operators(tmp_path):
    for name in ("binsift", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    corpus = tmp_path / "binsift" / "llm"
    for p in corpus.glob("*.py"):
        p.unlink()
    (corpus / "__pycache__").mkdir(parents=True, exist_ok=True)  # what deleting sources leaves
    n, known, has = count(tmp_path).split()
    assert int(n) > 200 and known == "True" and has == "False"
    shutil.rmtree(corpus)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert count(tmp_path).split() == [n, "True", "False"]
