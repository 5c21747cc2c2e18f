"""The entry with and without the corpus part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TOLD = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"


def imported(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", TOLD], cwd=folder, env=env, capture_output=True, text=True, timeout=120)


def test_without_the_corpus_part(tmp_path):
    """Without its folder and its pipeline, all else is there; a corpus part that misses a module is an error and no silence."""
    shutil.copytree(f"{ROOT}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    n, ops, pipeline, same = imported(tmp_path).stdout.split()
    assert int(n) > 150 and (ops, pipeline, same) == ("0", "False", "True")
    (tmp_path / "tessera/llm/__pycache__").mkdir(parents=True)
    assert imported(tmp_path).stdout.split()[1] == "0"
    (tmp_path / "corpus_pipeline.py").write_text("from tessera.llm import common\n")
    assert imported(tmp_path).stdout.split()[1:3] == ["0", "False"]
    (tmp_path / "tessera/llm/registry.py").write_text("import a_module_that_is_not_there\n")
    assert "a_module_that_is_not_there" in imported(tmp_path).stderr
