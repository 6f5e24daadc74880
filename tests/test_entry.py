"""``__spark_entry__`` without the training-data folder, with remains of it, and without its packages."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()), len(e.oracle_sql()))"


def copied(tmp_path, *left_out):
    """The repository's code without some folders."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out:
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "threadloom"), tmp_path / "threadloom", ignore=lambda folder, names: [
        n for n in names if n in left_out or n == "__pycache__"])
    return tmp_path


def loaded(root, code=COUNT):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [int(n) for n in done.stdout.split()]


@pytest.fixture(scope="module")
def others():
    from threadloom.catalogue.queries import QUERIES

    return len(QUERIES)


def test_folder_gone(tmp_path, others):
    assert loaded(copied(tmp_path, "llm", "corpus_pipeline.py")) == [others, 0, others]


def test_pipeline_gone(tmp_path, others):
    assert loaded(copied(tmp_path, "corpus_pipeline.py")) == [others, 0, others]


def test_only_compiled_files_left(tmp_path, others):
    root = copied(tmp_path, "llm")
    (root / "threadloom/llm/__pycache__").mkdir(parents=True)
    (root / "threadloom/llm/__pycache__/common.cpython-313.pyc").write_bytes(b"")
    assert loaded(root) == [others, 0, others]


def test_package_absent(tmp_path, others):
    assert loaded(copied(tmp_path), "import sys; sys.modules['regex'] = None; " + COUNT) == [others, 0, others]
