"""Work and memory that must not grow faster than what is asked for."""

import json
import random

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackwise import catalog
from trackwise.functions import decode
from trackwise.functions.geometry import centroid
from trackwise.plans import commands, rawdata, search
from trackwise.plans import mapdata as md
from trackwise.plans.derive import Derived
from trackwise.sources import files

EDGE = "src string, dst string, country string, line string, cost long"


def test_dense_arcs_makes_its_arcs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    arcs = spark.createDataFrame([(f"N{i}", f"N{(i * 7 + 1) % 40}", 10, i) for i in range(40)], "tail string, head string, line_cost long, distance_cost long")
    got = search.dense_arcs(arcs.mapInArrow(counted, arcs.schema)).collect()
    assert sorted(r.arc_id for r in got) == list(range(40)) and made.value == 40


def _network(seed, points=12, lines=6):
    rng = random.Random(seed)
    return [(f"N{a:02}", f"N{b:02}", "DEU", f"L{rng.randrange(lines)}", rng.randint(1, 40)) for a in range(points) for b in range(points) if a != b and rng.random() < 0.5]


def test_costs_and_rides_follow_no_routes(spark, monkeypatch):
    """Costs and rides of all Pareto-optimal routes are those of the routes themselves, and don't list the nodes between."""
    edges = spark.createDataFrame(_network(3), EDGE).withColumns({"length": F.lit(1.0), "speed": F.lit(100), "electrified": F.lit(True), "start_km": F.lit(0.0), "end_km": F.lit(1.0)})
    asked = spark.createDataFrame([(s, f"N{n:02}") for s in ("N00", "N05") for n in range(12)], "source string, target string")
    routes = search.pareto_routes(edges, asked).collect()
    ridden = search.route_legs(search.pareto_routes(edges, asked), edges).collect()
    monkeypatch.setattr(search, "on_lines", None)
    assert sorted((r.source, r.target, r.sol, *r.costs) for r in search.pareto_costs(edges, asked).collect()) == sorted((r.source, r.target, r.sol, *r.costs) for r in routes)
    want, got = {}, {}
    for r in sorted(ridden, key=lambda r: r.seq):
        want.setdefault((r.source, r.target, r.sol), []).append((r.line, r.src, r.dst, r.cost))
    for r in sorted(search.pareto_legs(edges, asked).collect(), key=lambda r: r.seq):
        got.setdefault((r.source, r.target, r.sol), []).append((r.line, r.src, r.dst, r.cost))
    assert got == want and max(map(len, got.values())) > 1


@pytest.mark.parametrize("seed", range(8))
def test_one_search_for_all_targets_of_a_line(seed):
    """The pointers of one search are those of a search for each target, also with costs of 0 and parallel arcs."""
    rng = random.Random(seed)
    arcs = [(f"N{rng.randrange(15)}", f"N{rng.randrange(15)}", rng.choice((0, 0, 1, 2, 5))) for _ in range(60)]
    line = search._Line(pa.array([{"src": a, "dst": b, "cost": c} for a, b, c in arcs], pa.struct([("src", pa.string()), ("dst", pa.string()), ("cost", pa.int64())])))
    names, graph = line.names.to_pylist(), {}
    for a, b, c in arcs:
        graph.setdefault(a, []).append((b, (c,)))
    start = arcs[0][0]
    found = line.search(names.index(start), set(range(len(names))))
    best, _ = brute.cheapest(arcs, start)
    for n, name in enumerate(names):
        trail = [n] if n in found else []
        while trail and found[trail[-1]] is not None:
            trail.append(found[trail[-1]])
        assert [names[i] for i in trail[::-1]] == search.dijkstra(graph, start, name)
    starts = pa.array([{"cost": 3, "node": start}, {"cost": 3, "node": arcs[1][0]}], pa.struct([("cost", pa.int64()), ("node", pa.string())]))
    other, _ = brute.cheapest(arcs, arcs[1][0])
    reach = {n: min((3 + of[n][0], s) for of, s in ((best, start), (other, arcs[1][0])) if n in of) for n in names if n in best or n in other}
    nodes, costs, boarded = (c.to_pylist() for c in line.ride(starts))
    assert dict(zip(nodes, zip(costs, boarded, strict=True), strict=True)) == reach


def test_routes_of_one_item_are_not_compared(spark):
    """Rows of routes with one item leave the join as they are; those of several items, or of articles of one title, come once."""
    key, rows = md.KEY, []
    for s, items in (("r1", ["Q1"]), ("r2", ["Q1", "Q2"]), ("r3", []), ("r4", ["Q9"])):
        rows += [(s, key + "type", "route"), (s, key + "route", "tracks"), (s, key + "ref", "A"), (s, key + "ref", "B"), *[(s, md.WIKIDATA, i) for i in items]]
    answers = [("Q1", md.SITE + "wiki/X"), ("Q1", md.SITE + "wiki/X"), ("Q2", md.SITE + "wiki/X"), ("Q2", md.SITE + "wiki/Y")]
    found = md.routes_by_items(spark.createDataFrame(rows, "s string, p string, o string"), lambda keys: spark.createDataFrame(answers, md.ANSWER).join(keys, "item", "left_semi"))
    assert sorted(map(tuple, found.collect())) == sorted((s, r, f"de:{t}") for s, t in (("r1", "X"), ("r2", "X"), ("r2", "Y")) for r in "AB")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Union") < plan.find("Aggregate")


def test_centroids_are_dealt_to_tasks(spark):
    """One small file isn't one task, and the first point of a text isn't looked for at each of its points."""
    found = catalog.queries()["osm_centroids"](spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()
    looked_for = spark.range(1).select(centroid(F.concat(F.lit("POINT(1 "), "id", F.lit(")"))))._jdf.queryExecution().analyzed().toString()
    assert looked_for.count("flatten(namedlambda") <= 1 < looked_for.count("namedlambda")


def test_written_tables_are_dealt_to_tasks_by_size(spark):
    """A shuffle of some tens of MB isn't sorted and written by one task; settings are as before afterwards."""
    keys = ("spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k) for k in keys]
    rows = files.cut(spark.range(4_000_000).select(F.xxhash64("id").alias("h")).repartition("h"))
    assert len(rows.inputFiles()) > 1 and [spark.conf.get(k) for k in keys] == before
    files.drop_cut(rows)


def test_points_parse_their_documents_once(spark, tmp_path):
    term = lambda v, kind="literal": {"type": kind, "value": v}
    rows = [{"uopid": term("A"), "opName": term("a"), "opType": term(decode.TYPE_PREFIXES[0] + "rinf/10", "uri"), "country": term(decode.COUNTRY_PREFIXES[0] + "DEU", "uri"), "wkt": term("POINT(8 50)"), "lineId": term(line)} for line in ("L1", "L2")]
    (tmp_path / "points.json").write_text(json.dumps({"head": {"vars": []}, "results": {"bindings": rows}}))
    for found in commands.load_operational_points(spark, f"file://{tmp_path}/points.json"):
        assert "json" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_a_build_writes_what_its_stages_read(spark):
    """Raw results that no stage named reads aren't written."""
    folder = rawdata.built(Derived(spark, "/root/testdata/sf0.001"), "OperationalPoints;Metadata", countries="").folder
    assert [files.exists(spark, f"{folder}/sparql-{name}.json") for name in rawdata.RESULTS] == [name == "operationalPoints" for name in rawdata.RESULTS]
