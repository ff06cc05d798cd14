from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from orrery.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    if name not in ORACLE_SQL:
        assert got.count()
        return
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    columns = sorted(got.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {listed} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want))


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["src", "dst", "rel", "protocol", "contract_key", "confidence"]


@pytest.mark.parametrize("left", [(), ("orrery/llm/__pycache__",)])
def test_entry_without_the_optional_parts(tmp_path, left):
    top = Path(__file__).resolve().parent.parent
    shutil.copytree(top / "orrery", tmp_path / "orrery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    for folder in left:
        (tmp_path / folder).mkdir(parents=True)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted({**e.queries(), **e.oracle_sql()}), any(q.startswith(('op', 'pipeline')) for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": ""}, capture_output=True, text=True)
    assert out.stdout.split() == ["True", "False"], out.stderr
