"""Searches that go through cells of a graph."""

import random
from collections import Counter

from trackwise.plans import search

EDGE = "src string, dst string, line string, country string, cost long, length double, speed int, electrified boolean, start_km double, end_km double"


def edge(a, b, cost):
    return (a, b, "L", "DEU", cost, float(cost), 100, True, 0.0, 1.0)


def least(arcs, source):
    """(cost, hops) of each node by rounds over all arcs."""
    best, changed = {source: (0, 0)}, True
    while changed:
        changed = False
        for a, b, c in arcs:
            if a in best and (n := (best[a][0] + c, best[a][1] + 1)) < best.get(b, (1 << 60, 0)):
                best[b], changed = n, True
    return best


def test_rounds_are_fewer_than_hops(spark, monkeypatch):
    """A chain of 120 hops takes a few tables, not one or more for each hop."""
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", i % 7) for i in range(120)], "src string, dst string, cost long")
    written, cut = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df: written.append(1) or cut(df))
    got = {r.node: r.cost for r in search.shortest_costs(chain, spark.createDataFrame([("n000",)], "source string")).collect()}
    assert got == {f"n{i:03}": sum(k % 7 for k in range(i)) for i in range(121)}
    assert len(written) < 30


def test_cells_change_no_costs(spark, monkeypatch):
    """Cells of a few arcs, costs of 0, nodes without arcs out of them, parts that aren't connected, an unknown source, an end that is null."""
    monkeypatch.setattr(search, "CELL_ARCS", 12)
    rng = random.Random(3)
    arcs = [(f"{g}{rng.randrange(12)}", f"{g}{rng.randrange(12)}", rng.randrange(4)) for g in "abc" for _ in range(30)]
    arcs += [("a1", "b1", 5), ("b2", "a2", 1), ("c1", "sink", 2), ("a3", "sink", 9)]
    least_of = {}
    for a, b, c in arcs:
        least_of[a, b] = min(c, least_of.get((a, b), c))
    table = spark.createDataFrame([(a, b, c) for (a, b), c in least_of.items()] + [(None, "a1", 0), ("a1", None, 0)], "src string, dst string, cost long")
    sources = ["a0", "a1", "b3", "c1", "nowhere"]
    found = search._least_costs(table, spark.createDataFrame([(s,) for s in sources], "source string")).collect()
    want = {(s, n, *v) for s in sources for n, v in least(arcs, s).items()}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_cells_are_bounded(spark, monkeypatch):
    """Every node has one cell, whose nodes and arcs are as many as a cell may have; cells are few."""
    monkeypatch.setattr(search, "CELL_ARCS", 100)
    arcs = [(f"{g}{i}", f"{g}{j}") for g in "abcdef" for i in range(6) for j in range(6) if i != j] + [("a0", "b0"), ("b1", "c1"), ("c2", "d2")] + [(f"leaf{i}", "a0") for i in range(150)]
    table = spark.createDataFrame(arcs, "src string, dst string")
    nodes = table.selectExpr("src as node").union(table.selectExpr("dst")).distinct()
    found = search._cells(table, nodes).collect()
    cells, weight = {r.node: r.cell for r in found}, Counter(r.cell for r in found)
    assert len(found) == len(cells) == nodes.count()
    weight.update(cells[a] for a, _ in arcs)
    assert max(weight.values()) <= 100 and len(weight) < len(found) / 3


def test_path_costs(spark):
    edges = spark.createDataFrame([edge("S", "A", 3), edge("S", "A", 2), edge("A", "B", 4), edge("B", "A", 1), edge("X", "S", 1)], EDGE)
    asked = [("p", ["S", "A", "B"]), ("round", ["A", "B", "A"]), ("no way", ["B", "S"]), ("half", ["S", "B", "X"]), ("unknown", ["S", "Q"]), ("same", ["A", "A"]), ("one", ["A"])]
    q = spark.createDataFrame(asked, "path string, waypoints array<string>")
    sums = {}
    for r in search.shortest_paths(edges, q).collect():
        sums[r.path] = sums.get(r.path, 0) + r.cost
    assert {r.path: r.cost for r in search.path_costs(edges, q).collect()} == sums == {"p": 6, "round": 5, "half": 6}
