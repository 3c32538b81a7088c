"""The entry point, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["event_id", "frame", "tri", "x", "y", "z"] and df.count() > 0


def test_without_training_data_operators(tmp_path):
    for name in ("isoline", "__spark_entry__.py"):
        src = REPO / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), [k for k in q if k.startswith('op') or k == 'pipeline'])"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"}, check=False)
    n, _, left = said.stdout.strip().partition(" ")
    assert int(n) > 50 and left == "[]", said.stderr
