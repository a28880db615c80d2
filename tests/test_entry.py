"""The driver's entry points, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["path", "seq", "src", "dst", "line", "country", "cost", "length", "speed", "electrified", "start_km", "end_km"]
    assert got.count() > 0


def test_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "trackwise", tmp_path / "trackwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'graph_stats' in q and not any(n.startswith('op1_') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([value(r[i]) for i in order]) for r in rows)


NETWORK = sorted(set(entry.catalog.oracle_sql()) - {"pareto_front"})


@pytest.mark.parametrize("name", NETWORK)
def test_network_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert _plain(rows, got.columns) == _plain(want.fetchall(), columns)
