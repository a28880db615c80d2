"""Solutions put together from rides, and sums for which no route is listed."""

import random

import pytest
from pyspark.sql import functions as F

from trackwise import catalog
from trackwise.plans import search

EDGE = "src string, dst string, country string, line string, cost long"


@pytest.mark.parametrize("most", [None, 2])
def test_lists_and_sums_agree(spark, monkeypatch, most):
    """Sums are those of the routes, whose costs are those of their arcs; they hold where costs along the nodes are the solution's, and only there."""
    rng = random.Random(5)
    rows = [(f"N{a:02}", f"N{b:02}", "DEU", f"L{rng.randrange(6)}", rng.choice((0, 1, 7, 20))) for a in range(12) for b in range(12) if a != b and rng.random() < 0.5]
    edges = spark.createDataFrame(rows + rows[:20], EDGE)
    asked = spark.createDataFrame([(s, f"N{n:02}") for s in ("N00", "N05") for n in range(12)] + [("N00", "away")], "source string, target string")
    arcs = {}
    for r in search.expand(edges).collect():
        arcs.setdefault((r.tail, r.head), []).append([r.line_cost, r.distance_cost])
    routes = search.pareto_routes(edges, asked, most).collect()
    for r in routes:
        assert r.nodes[0] == r.source and r.nodes[-1] == r.target and r.trail[0] == [0, 0] and r.trail[-1] == r.costs and len(r.nodes) == len(r.trail)
        for a, b, x, y in zip(r.nodes, r.nodes[1:], r.trail, r.trail[1:]):
            assert [q - p for p, q in zip(x, y)] == min(arcs[a, b])
    sums = search.pareto_sums(edges, asked, most).collect()
    assert sorted((r.source, r.target, r.sol, *r.costs) for r in sums) == sorted((r.source, r.target, r.sol, *r.costs) for r in routes)
    assert all(r.adds_up for r in sums) and max(r.sol for r in routes) > 1
    ridden = search._ridden
    monkeypatch.setattr(search, "_ridden", lambda *a, **k: ridden(*a, **k).withColumn("total", F.col("total") + 1))
    assert all(r.adds_up == (r.costs[0] == 0) for r in search.pareto_sums(edges, asked, most).collect())


def test_first_two_lists_no_routes(spark, monkeypatch):
    """What is asked of the first two solutions is whether they add up: that needs no list of their nodes."""
    ridden = search._ridden

    def unlisted(edges, asked, listed):
        assert not listed
        return ridden(edges, asked, listed)

    monkeypatch.setattr(search, "_ridden", unlisted)
    monkeypatch.setattr(search, "on_lines", None)
    got = catalog.queries()["pareto_first_two"](spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.adds_up for r in got)


def test_solutions_are_put_together_from_lists(spark):
    """The nodes of solutions aren't rows of a sort of their own: no window is run over them."""
    edges = spark.createDataFrame([("A", "B", "DEU", "L1", 3), ("B", "C", "DEU", "L1", 4)], EDGE)
    found = search.pareto_routes(edges, spark.createDataFrame([("A", "C")], "source string, target string"))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.first().nodes == ["A", "A/DEU/L1", "B/DEU/L1", "C/DEU/L1", "C"]
