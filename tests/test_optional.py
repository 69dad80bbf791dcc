"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_without_the_optional_folders(tmp_path):
    shutil.copytree(f"{ROOT}/sessionloom", tmp_path / "sessionloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); print(len(n), sum(k.startswith('op') or k == 'pipeline' for k in n))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    total, optional = map(int, done.stdout.split())
    assert total > 50 and optional == 0
