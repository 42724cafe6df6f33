"""The entry works without the optional folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_folders(tmp_path):
    copy = tmp_path / "copy"
    copy.mkdir()
    shutil.copytree(f"{ROOT}/sextant", copy / "sextant", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", copy / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    env = {**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    count, pipeline = done.stdout.split()
    assert int(count) > 80 and pipeline == "False"
