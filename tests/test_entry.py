"""The entry module without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [["pagewright/llm", "corpus_pipeline.py"], ["pagewright/llm"], ["pagewright/llm/queries.py"]])
def test_the_rest_imports_without_the_training_data_operators(tmp_path, gone):
    for name in ("pagewright", "__spark_entry__.py", "corpus_pipeline.py"):
        source, target = os.path.join(ROOT, name), tmp_path / name
        if os.path.isdir(source):
            shutil.copytree(source, target)
        elif os.path.exists(source):
            shutil.copy(source, target)
    for name in gone:
        held = tmp_path / name
        if held.is_dir():
            shutil.rmtree(held)
        elif held.exists():
            held.unlink()
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    n, llm, pipeline, sql = run.stdout.split()
    assert int(n) > 90 and int(sql) > 80 and (llm, pipeline) == ("False", "False")
