"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True).stdout.splitlines()
    return [set(x.split()) for x in out[-2:]]


def test_entry_works_without_the_subpackage(tmp_path):
    from tidemark import catalog

    for pipeline in (True, False):
        root = str(tmp_path / f"copy-{pipeline}")
        shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
        assert not os.path.exists(f"{root}/tidemark/llm")
        assert names(root) == [set(catalog.queries()), set(catalog.oracle_sql())]
