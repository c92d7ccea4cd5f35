"""The library without its subpackage for training data, and without a library that only this subpackage needs."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
BLOCK = "import sys; sys.modules['public_tokenizers'] = None; "


def run(args, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, *args], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


@pytest.fixture(scope="module")
def stripped(tmp_path_factory):
    copy = tmp_path_factory.mktemp("copy") / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")])
    return copy


def test_entry_without_subpackage(stripped):
    done = run(["-c", NAMES], stripped)
    assert done.returncode == 0, done.stderr
    assert "exact_topk" in done.stdout and "op1_" not in done.stdout and "pipeline" not in done.stdout


def test_tests_collect_without_subpackage(stripped):
    done = run(["-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], stripped)
    assert done.returncode == 0, done.stdout + done.stderr


def test_entry_without_tokenizer_files():
    done = run(["-c", BLOCK + NAMES], ROOT)
    assert done.returncode == 0, done.stderr
    assert "exact_topk" in done.stdout and "pipeline" not in done.stdout


def test_nothing_else_imports_the_subpackage():
    folders = [os.path.join(ROOT, "passageway", n) for n in ("operators", "sources", "functions", "plans", "streaming")]
    files = [os.path.join(d, f) for folder in folders for d, _, fs in os.walk(folder) for f in fs if f.endswith(".py")]
    assert files and not [f for f in files if "passageway.llm" in open(f, encoding="utf-8").read()]
