"""The driver entry: what it imports, with all of the repository and with parts of it."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"


def run(code: str, folder: Path = ROOT) -> list[str]:
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return done.stdout.split()


def test_import_reads_no_jar():
    away = "import pyspark, zipfile; pyspark.__file__ = '/nowhere/pyspark/__init__.py'; zipfile.ZipFile = None; "
    assert run(away + SHOW) == run(SHOW)


def test_import_without_the_operators_for_training_data(tmp_path):
    for name in ("__spark_entry__.py", "weftline"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "weftline" / "llm", ignore_errors=True)
    n, n_sql, any_op = run(SHOW, tmp_path)
    assert int(n) >= 49 and int(n_sql) >= 49 and any_op == "False"


def test_import_without_a_package_that_only_they_need():
    n, _, any_op = run("import sys; sys.modules['xxhash'] = None; " + SHOW)
    assert int(n) >= 49 and any_op == "False"


def test_nothing_else_imports_the_operators_for_training_data():
    for file in (ROOT / "weftline").rglob("*.py"):
        if "llm" not in file.parts:
            assert "llm" not in file.read_text(), file
