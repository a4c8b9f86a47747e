"""The entry points work without the optional part."""

import os
import shutil
import subprocess
import sys

from .conftest import ROOT


def test_entry_without_the_optional_part(tmp_path):
    copy = tmp_path / "copy"
    unwanted = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, copy, ignore=unwanted)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and set(e.oracle_sql()) <= set(q); print(sorted(q)[:3])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_optional_part():
    found = []
    for folder, _, names in os.walk(os.path.join(ROOT, "veridra")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name), encoding="utf-8").read()
                found += [name for line in text.splitlines() if "import" in line and ".llm" in line]
    assert not found
