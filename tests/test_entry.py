"""The registered queries outlive the removal of the training-data part."""

from __future__ import annotations

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

import __spark_entry__ as entry


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_training_data_part(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "tilequery", tmp_path / "tilequery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (with_pipeline and (ROOT / "corpus_pipeline.py").exists())]:
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    names, sql = (set(line.split()) for line in run.stdout.splitlines()[-2:])
    core = {n for n in entry.queries() if not n.startswith("op") or not n[2].isdigit()} - {"pipeline"}
    assert names == core and sql == set(entry.oracle_sql()) & core
