"""Queries and operators that must do their whole job: no cap, sample or part of the network."""

import random
from collections import defaultdict

import brute
import pytest

import __spark_entry__ as entry
from trackwise.operators import network
from trackwise.plans import derive, search
from trackwise.sources import files

SF = "/root/testdata/sf0.001"
EDGE = "src string, dst string, country string, line string, cost long"


@pytest.fixture(scope="module")
def derived(spark):
    return derive.Derived(spark, SF)


def test_pareto_front_of_many_runs(spark):
    """A chain of twenty lines beats one dear direct line only after twenty runs; random networks against the labels of the expanded graph."""
    chain = [(f"N{i:02}", f"N{i + 1:02}", "DEU", f"C{i:02}", 1) for i in range(20)] + [("N00", "N20", "DEU", "DIRECT", 100)]
    got = search.pareto_front(spark.createDataFrame(chain, EDGE), spark.createDataFrame([("N00",)], "source string")).collect()
    assert sorted((r.runs, r.cost) for r in got if r.node == "N20") == [(1, 100), (20, 20)]
    rng = random.Random(5)
    rows = [(f"N{a}", f"N{b}", "DEU", f"L{rng.randrange(8)}", rng.randint(1, 40)) for a in range(12) for b in range(12) if a != b and rng.random() < 0.5]
    sources = ["N0", "N7"]
    got = search.pareto_front(spark.createDataFrame(rows, EDGE), spark.createDataFrame([(s,) for s in sources], "source string")).collect()
    graph = defaultdict(set)
    for src, dst, _, line, cost in rows:
        for tail, head, c in ((src, (src, line), (10, 0)), ((src, line), (dst, line), (0, cost)), ((dst, line), dst, (10, 0))):
            graph[tail].add((head, c))
    want = {(s, f"N{n}", c[0] // 20, c[1]) for s in sources for n in range(12) for c in brute.fronts(graph, s).get(f"N{n}", ())}
    assert len(got) == len(want) and {(r.source, r.node, r.runs, r.cost) for r in got} == want


def test_pareto_front_ends_at_the_cheapest(spark):
    """The last point of each node's front is its cheapest route."""
    got = defaultdict(list)
    for r in entry.queries()["pareto_front"](spark, "/root/testdata/sf0.01").collect():
        got[r.node].append((r.runs, r.cost))
    cheapest = {r.node: r.cost for r in entry.queries()["shortest_cost_all"](spark, "/root/testdata/sf0.01").collect()}
    assert {n: max(f)[1] for n, f in got.items()} == cheapest and all(min(f)[1] >= max(f)[1] for f in got.values())


def test_pareto_solutions_of_all_targets(spark, derived):
    """Each operational point is asked, over all lines, and has its whole front."""
    points = {r.uopid for r in derived.ops().collect()}
    got, front = defaultdict(list), defaultdict(list)
    for r in entry.queries()["pareto_solutions"](spark, SF).collect():
        got[r.target].append(tuple(r.costs))
    for r in entry.queries()["pareto_front"](spark, SF).collect():
        front[r.node].append((20 * r.runs, r.cost))
    assert set(got) == points and {t: sorted(c) for t, c in got.items()} == {t: sorted(c) for t, c in front.items()}


def test_pareto_dim3_of_all_edges(spark, derived):
    """Against fronts of vectors that grow by every edge of every line until nothing changes."""
    edges = {(r.src, r.dst, r.cost, r.speed) for r in derived.edges().collect()}
    want = {"DE00001": [(0, 0, 0)]}
    while True:
        more = {n: set(f) for n, f in want.items()}
        for src, dst, cost, speed in edges:
            more.setdefault(dst, set()).update((a + cost, b + 1, c + speed) for a, b, c in want.get(src, ()))
        more = {n: brute.front(f) for n, f in more.items() if f}
        if more == want:
            break
        want = more
    got = defaultdict(list)
    for r in sorted(entry.queries()["pareto_dim3"](spark, SF).collect(), key=lambda r: r.sol):
        got[r.target].append(tuple(r.costs))
    assert got == want


def test_components_of_all_lines(spark, derived, monkeypatch):
    """Against union-find over every line, on a network where some points are joined by other lines than L01 and L02 only."""
    part = files.cut(derived.locations().where("line not in ('L01', 'L02') or k <= 3"))
    monkeypatch.setattr(derive.Derived, "locations", lambda d: part)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in derived.forward().collect():
        a, b = sorted((root(r.src), root(r.dst)))
        up[b] = a
    got = entry.queries()["components"](spark, SF).collect()
    rounds = network.components(network.undirected(derived.forward()), task_nodes=1).collect()
    assert sorted((r.node, r.component) for r in rounds) == sorted((r.node, r.component) for r in got)
    assert len(up) > 3 and len(got) == len(up) and {r.node: r.component for r in got} == {n: root(n) for n in up}


def _own_graphs(edges):
    """Edges of each line by themselves."""
    out = defaultdict(lambda: defaultdict(list))
    for e in edges:
        out[e.line][e.src].append((e.dst, (e.cost,)))
    return out


def test_paths_of_all_lines(spark, derived):
    """The routes through the points of every line, one pair after another on the line's own edges."""
    edges = derived.edges().collect()
    graphs, cheapest = _own_graphs(edges), {}
    for e in edges:
        cheapest[e.line, e.src, e.dst] = min(e.cost, cheapest.get((e.line, e.src, e.dst), e.cost))
    want = []
    for line in network.line_infos(derived.edges(), derived.ops()).collect():
        hops = [h for a, b in zip(line.uopids[:-1], line.uopids[1:], strict=True) for h in (lambda n: zip(n[:-1], n[1:], strict=True))(search.dijkstra(graphs[line.line], a, b))]
        want += [(line.line, i, a, b, cheapest[line.line, a, b]) for i, (a, b) in enumerate(hops, 1)]
    got = entry.queries()["paths_of_lines"](spark, SF).collect()
    assert sorted((r.path, r.seq, r.src, r.dst, r.cost) for r in got) == sorted(want) and len(want) > 300


def test_speed_profile(spark):
    """A compacted route is searched again on its line, and cut where the speed changes."""
    edge = "src string, dst string, country string, line string, cost long, length double, speed int, electrified boolean, start_km double, end_km double"
    rows = [("A", "B", "DEU", "1", 5, 1.0, 100, True, 0.0, 1.0), ("B", "C", "DEU", "1", 5, 1.0, 100, True, 1.0, 2.0), ("C", "D", "DEU", "1", 5, 1.0, 80, True, 2.0, 3.0), ("D", "E", "DEU", "2", 5, 1.0, 80, True, 0.0, 1.0), ("A", "C", "DEU", "1", 7, 1.5, 60, False, 0.0, 2.0)]
    edges = spark.createDataFrame(rows, edge)
    path = edges.where("dst <> 'C' or src = 'B'").selectExpr("'p' as path", "ascii(src) as seq", "*")
    got = [(r.seq, r.src, r.dst, r.line, r.cost, r.speed, r.electrified) for r in search.speed_profile(path, edges).orderBy("seq").collect()]
    assert got == [(1, "A", "C", "1", 7, 60, False), (2, "C", "D", "1", 5, 80, True), (3, "D", "E", "2", 5, 80, True)]
