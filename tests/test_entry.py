import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.queries() if not re.match(r"p\d+_", n)])
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("state", ["absent", "broken"])
def test_core_stands_alone(tmp_path, state):
    """Without the training-data subpackage, or with one that does not import, everything else still works."""
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tamiza", tmp_path / "tamiza", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if state == "broken":
        (tmp_path / "tamiza" / "llm").mkdir()
        (tmp_path / "tamiza" / "llm" / "__init__.py").write_text("")
        (tmp_path / "tamiza" / "llm" / "queries.py").write_text("import no_such_module_at_all\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('p1_') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    core = [n for n in entry.queries() if not re.match(r"p([1235-9]|10)_", n)]
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[-3:] == [str(len(core)), str(len([n for n in entry.oracle_sql() if n in core])), "False"]
