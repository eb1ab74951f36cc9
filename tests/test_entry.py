"""The entry module: names, the flagship query, and the library without its optional part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 50


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["paper_id", "bib_key", "cand_id", "score", "rank"]
    assert rows.where("rank = 1").count() == 200


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_operators(tmp_path, pipeline):
    shutil.copytree(ROOT / "refweave", tmp_path / "refweave", ignore=shutil.ignore_patterns("llm"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        shutil.copy(ROOT / name, tmp_path)
    (tmp_path / "refweave" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 50 and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
