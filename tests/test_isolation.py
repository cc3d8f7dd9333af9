"""The core without the language-data operators: what is left when their folders are deleted."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline'], set(o) <= set(q))"


@pytest.mark.parametrize("left", ["nothing", "corpus_pipeline.py", "an empty folder"])
def test_entry_without_the_folders(tmp_path, left):
    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    shutil.copytree(ROOT / "triplewright", copy / "triplewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if left != "nothing" and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", copy)
    if left == "an empty folder":
        (copy / "triplewright" / "llm" / "__pycache__").mkdir(parents=True)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=copy, env=environment, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    number, rest = done.stdout.split(maxsplit=1)
    assert int(number) > 100 and rest.split() == ["[]", "True"]
