"""The contract queries against their DuckDB forms."""

from pathlib import Path

import duckdb
import pytest

pytest.importorskip("trackwise.llm")
from trackwise.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    plain = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.fetchall())
