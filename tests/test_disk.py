"""Files that must not outlive what reads them."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trackwise.plans import rawdata, search
from trackwise.plans.derive import Derived
from trackwise.sources import files


def _tables(spark) -> set[str]:
    return {n for n in os.listdir(files.shared_folder(spark).removeprefix("file://")) if n.startswith("table-")}


def test_a_build_keeps_what_is_asked_for(spark):
    """Raw results and data sets go once no later stage reads them, tables with their stage; what stays is compressed."""
    before = _tables(spark)
    found = rawdata.built(Derived(spark, "/root/testdata/sf0.001"), "OperationalPoints;SectionsOfLines;OpInfos;Graph", kept=("Graph",))
    at = Path(found.folder.removeprefix("file://"))
    assert sorted(p.name for p in at.iterdir()) == ["Graph.json", "stages"] and not found.edges().isEmpty()
    assert all(p.suffix == ".gz" for p in (at / "Graph.json").glob("part-*")) and _tables(spark) == before


def test_raw_results_are_compressed(spark, tmp_path):
    """A document of rows that repeat their prefixes takes a small part of its text, and is read as before."""
    rows = spark.range(20_000).select((F.col("id") % 2).alias("page"), rawdata.uri("http://example.org/", F.col("id")).alias("k"))
    rawdata.write(rows, f"file://{tmp_path}/raw")
    texts = rows.select(F.to_json(F.struct("k")).alias("v")).agg(F.sum(F.length("v"))).first()[0]
    assert sum(p.stat().st_size for p in (tmp_path / "raw").rglob("part-*") if p.is_file()) < texts / 4
    assert files.read_bindings(spark, f"file://{tmp_path}/raw").select(F.col("b")["k"]["value"]).distinct().count() == 20_000


def test_tables_go_with_their_scope(spark):
    before = _tables(spark)
    with files.scratch(spark) as outer:
        with files.scratch(spark) as keep:
            files.cut(spark.range(3))
            held = keep(files.cut(spark.range(4)))
        assert len(_tables(spark) - before) == 1 and held.count() == 4
        outer(held)
    assert held.count() == 4
    files.drop_cut(held)
    with pytest.raises(ValueError), files.scratch(spark):
        files.cut(spark.range(3))
        raise ValueError
    assert _tables(spark) == before


def test_a_search_leaves_its_result_alone(spark):
    """Of all tables of a search one stays."""
    edges = spark.createDataFrame([(f"N{i}", f"N{i + 1}", 1) for i in range(9)], "src string, dst string, cost long")
    before = _tables(spark)
    found = search.shortest_costs(edges, spark.createDataFrame([("N0",)], "source string"))
    assert len(_tables(spark) - before) == 1 and found.count() == 10
