"""The entry points hold with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_rest_stands_alone(tmp_path, pipeline):
    """Without the subpackage, whether or not the pipeline's file went with it."""
    shutil.copytree(ROOT / "sonorel", tmp_path / "sonorel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if pipeline else [])):
        shutil.copy(ROOT / name, tmp_path)
    code = (
        "import bench, __spark_entry__ as e; q = e.queries(); assert 'verdicts' in q; "
        "assert not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    )
    done = subprocess.run(
        [sys.executable, "-c", code],
        cwd=tmp_path,
        env=os.environ | {"PYTHONPATH": str(tmp_path)},
        capture_output=True,
        text=True,
    )
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "sonorel").rglob("*.py"):
        if "llm" not in path.parts:
            assert "sonorel.llm" not in path.read_text()
