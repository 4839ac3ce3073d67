import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]
TABLES = Path("/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_engine_stands_without_the_other_folders(tmp_path):
    for name in ("__spark_entry__.py", "lodestrata"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "lodestrata" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'child_windows' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_flagship_and_a_few_queries_run(spark):
    if not TABLES.exists():
        return
    assert e.entry(spark).count() > 0
    for name in ("change_counts", "children", "release_gate", "answers"):
        assert e.queries()[name](spark, str(TABLES)).count() > 0
