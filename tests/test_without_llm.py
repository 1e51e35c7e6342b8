"""The library without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2:3].isdigit()] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"


def test_entry_point_without_the_subpackage(tmp_path):
    for name in ("larkspur", "__spark_entry__.py", "bench.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    made = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert made.returncode == 0, made.stderr


def test_nothing_else_imports_the_subpackage():
    for where, _, names in os.walk(os.path.join(ROOT, "larkspur")):
        if "llm" not in where.split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(where, name)) as f:
                        assert "larkspur.llm" not in f.read(), name
