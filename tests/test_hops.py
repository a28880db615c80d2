"""Fronts of two costs and the number of hops."""

import random

import brute
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackwise.plans import derive, hops, search

ARC = "tail string, head string, costs array<long>"


def test_pareto_dim3_writes_less_than_a_table_a_hop(spark, monkeypatch):
    """A chain of 40 hops: rounds leave their labels together, not each by itself."""
    chain = spark.createDataFrame([(f"DE{i:05}", f"DE{i + 1:05}", i % 5, 60 + i) for i in range(1, 41)], "src string, dst string, cost long, speed int")
    monkeypatch.setattr(derive.Derived, "edges", lambda d: chain)
    monkeypatch.setattr(derive.Derived, "ops", lambda d: spark.range(1, 42).select(F.concat(F.lit("DE"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("uopid")))
    written, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: written.append(1) or parquet(self, *a, **k))
    got = {r.target: r for r in entry.queries()["pareto_dim3"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 41 and len(written) < 20
    assert all(r.costs == [sum(i % 5 for i in range(1, n)), n - 1, sum(60 + i for i in range(1, n))] and r.nodes == [f"DE{i:05}" for i in range(1, n + 1)] for n in range(1, 42) for r in [got[f"DE{n:05}"]])


@pytest.mark.parametrize("arcs_of_part, candidates, rounds", [(9, 7, 2), (30, 1000, 3), (1000, 1000, 16)])
def test_parts_change_no_fronts(spark, monkeypatch, arcs_of_part, candidates, rounds):
    """Parts of a few arcs or one part; several sources, free and parallel arcs, names of several lengths, unknown ends, ends that are null."""
    for name, value in (("PART_ARCS", arcs_of_part), ("FEW_ARCS", 1000), ("CANDIDATES", candidates), ("ROUNDS", rounds), ("ROUTE_BYTES", 64)):
        monkeypatch.setattr(hops, name, value)
    rng = random.Random(arcs_of_part)
    names = [f"{'ä' * (i % 3)}n{i}" for i in range(16)] + [""]
    graph = {a: [(b, (rng.randrange(9), rng.randrange(9))) for b in names if b != a and rng.random() < 0.3 for _ in range(rng.randint(1, 2))] for a in names}
    rows = [(a, b, list(c)) for a, heads in graph.items() for b, c in heads]
    arcs = spark.createDataFrame([*rows, (None, names[0], [0, 0]), (names[0], None, [0, 0])], ARC)
    sources = [names[0], names[4], names[-1], "nowhere"]
    asked = [(s, t) for s in sources for t in [*names, "nowhere"]] + [(None, names[1]), (names[1], None)]
    asked = spark.createDataFrame(asked, "source string, target string")
    got = hops.pareto_by_hops(arcs, asked).collect()
    wide = {a: [(b, (c[0], 1, c[1])) for b, c in heads] for a, heads in graph.items()}
    want = sorted((s, t, i, c) for s in sources for t, f in brute.fronts(wide, s).items() for i, c in enumerate(sorted(f), 1))
    assert sorted((r.source, r.target, r.sol, tuple(r.costs)) for r in got) == want and len({len(r.nodes) for r in got}) > 3
    # the routes are those of the general search
    wider = spark.createDataFrame([(a, b, [c[0], 1, c[1]]) for a, b, c in rows], ARC)
    general = search.pareto_solutions(wider, asked).collect()
    assert sorted((r.source, r.target, r.sol, r.nodes) for r in general) == sorted((r.source, r.target, r.sol, r.nodes) for r in got)


def test_odd_costs(spark):
    asked = spark.createDataFrame([("a", "b")], "source string, target string")
    for cost in (-1, None, 1 << 44):
        with pytest.raises(Exception, match="a cost is negative, null"):
            hops.pareto_by_hops(spark.createDataFrame([("a", "b", [0, cost])], ARC), asked)
    with pytest.raises(Exception, match="a sum of costs"):
        hops.pareto_by_hops(spark.createDataFrame([("a", "b", [0, 1 << 43]), ("b", "c", [0, 1 << 43])], ARC), asked)
    none = hops.pareto_by_hops(spark.createDataFrame([("a", "b", [0, 1])], ARC), asked.where("false"))
    assert none.collect() == [] and none.columns == ["source", "target", "sol", "costs", "nodes"]
    alone = hops.pareto_by_hops(spark.createDataFrame([], ARC), spark.createDataFrame([("a", "a"), ("a", "b")], "source string, target string")).collect()
    assert [tuple(r) for r in alone] == [("a", "a", 1, [0, 0, 0], ["a"])]


def test_parts_stay_where_they_are(spark):
    """What a part knows isn't shuffled: tables dealt by part are put side by side."""
    rdd = spark.sparkContext.parallelize([(i, i) for i in range(6)])
    a, b = (rdd.partitionBy(3, hops._own) for _ in range(2))
    both = a.union(b.mapPartitions(iter, preservesPartitioning=True))
    assert both.getNumPartitions() == 3 and [sorted(p) for p in both.glom().collect()] == [[(i, i)] * 2 + [(i + 3, i + 3)] * 2 for i in range(3)]
