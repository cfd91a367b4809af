"""The entry module works with and without the corpus subpackage."""

import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_subpackage(tmp_path, pipeline):
    """With and without corpus_pipeline.py, which cannot be imported then."""
    for name in ("ripplecast", "__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "ripplecast/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
