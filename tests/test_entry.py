import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_flagship(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 1 and row[0]["rows_in_both_diff"] > row[0]["rows_in_both_diff_post_tolerance"] > 0


def test_sql_belongs_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert {"summary_core", "diff_rows", "verify_except"} <= entry.oracle_sql().keys()


@pytest.mark.parametrize("gone", [["rowparity/llm", "corpus_pipeline.py"], ["rowparity/llm"], ["corpus_pipeline.py"]])
def test_the_rest_works_without_the_subpackage(tmp_path, gone):
    shutil.copytree(ROOT / "rowparity", tmp_path / "rowparity")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        at = tmp_path / name
        shutil.rmtree(at, ignore_errors=True) if at.is_dir() else at.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) >= 40


def test_nothing_else_imports_the_subpackage():
    others = [p for p in (ROOT / "rowparity").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert others and not any("llm" in p.read_text() for p in others)
