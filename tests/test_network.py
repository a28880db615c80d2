"""Network operators on a hand-made network with values worked out by hand."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from trackwise.functions import decode
from trackwise.functions import measures as m
from trackwise.operators import ingest, matching, network, paths
from trackwise.plans import search
from trackwise.sources import files

KM = [("100", "A", 0.0), ("100", "B", 10.0), ("100", "C", 30.0), ("200", "B", 0.0), ("200", "D", 12.0), ("300", "C", 0.0), ("300", "D", 4.0), ("300", "E", 9.0), ("400", "A", 0.0), ("400", "E", 70.0)]
TRACK = "struct<id:string,speed:int,radius:int,contact:string,categories:array<int>>"


@pytest.fixture(scope="module")
def locations(spark):
    return spark.createDataFrame([("DEU", *x) for x in KM], "country string, line string, op string, km double")


@pytest.fixture(scope="module")
def sections(spark):
    t = lambda speed: ("t", speed, None, "AC", [])
    rows = [("s1", "DEU", "100", "A", "B", 10.0, [t(160), t(120)]), ("s2", "DEU", "100", "B", "C", 20.004, [t(200)]), ("s3", "DEU", "300", "D", "C", 4.0, [t(90)]), ("s4", "DEU", "400", "A", "E", 70.0, [t(None)])]
    return spark.createDataFrame(rows, f"section string, country string, line string, start_op string, end_op string, length double, tracks array<{TRACK}>")


@pytest.fixture(scope="module")
def edges(locations, sections):
    return network.both_directions(network.graph_by_locations(locations, sections)).cache()


def test_graph(edges):
    got = {(r.src, r.dst): (r.line, r.length, r.speed, r.cost) for r in edges.where("start_km < end_km").collect()}
    assert got == {
        ("A", "B"): ("100", 10.0, 160, 625), ("B", "C"): ("100", 20.0, 200, 1000), ("B", "D"): ("200", 12.0, 120, 1000),
        ("C", "D"): ("300", 4.0, 120, 333), ("D", "E"): ("300", 5.0, 120, 416), ("A", "E"): ("400", 70.0, 100, 7000),
    }
    assert edges.count() == 12


def test_shortest_paths(spark, edges):
    q = spark.createDataFrame([("p", ["A", "E"]), ("q", ["A", "E", "A"]), ("r", ["A", "Z"]), ("s", ["A"])], "path string, waypoints array<string>")
    got = search.shortest_paths(edges, q).collect()
    assert sum(r.cost for r in got if r.path == "p") == 2041
    assert [r.dst for r in sorted(got, key=lambda r: r.seq) if r.path == "p"] == ["B", "D", "E"]
    assert sum(r.cost for r in got if r.path == "q") == 4082 and {r.leg for r in got if r.path == "q"} == {0, 1}
    assert {r.path for r in got} == {"p", "q"}
    start = spark.createDataFrame([("A",)], "source string")
    far = {r.node: r.cost for r in search.shortest_costs(edges, start).collect()}
    assert far == {"A": 0, "B": 625, "C": 1625, "D": 1625, "E": 2041}
    # on random networks with ties and free arcs, from points that repeat or are unknown
    rng = random.Random(9)
    rows = [(f"N{a}", f"N{b}", rng.randint(0, 3)) for a in range(30) for b in range(30) if a != b and rng.random() < 0.15]
    some = spark.createDataFrame(rows, "src string, dst string, cost long")
    start = spark.createDataFrame([("N0",), ("N0",), ("N7",), ("Z",)], "source string")
    want = set()
    for source in ("N0", "N7", "Z"):
        best, before = brute.cheapest(rows, source)
        want |= {(source, n, c, before.get(n)) for n, (c, _) in best.items()}
    assert {tuple(r) for r in search.shortest_costs(some, start).collect()} == want and len(want) > 30
    with pytest.raises(Exception, match="negative"):
        search.shortest_costs(some.withColumn("cost", -F.col("cost")), start).collect()


def test_free_circle(spark):
    """An arc of cost 5 into a circle of cost 0: pointers don't go round."""
    rows = [("S", "A", "L", "DEU", 5, 1.0), ("A", "B", "L", "DEU", 0, 1.0), ("B", "A", "L", "DEU", 0, 1.0)]
    edges = spark.createDataFrame(rows, "src string, dst string, line string, country string, cost long, length double")
    q = spark.createDataFrame([("p", ["S", "B", "A"])], "path string, waypoints array<string>")
    assert [(r.leg, r.src, r.dst) for r in sorted(search.shortest_paths(edges, q).collect(), key=lambda r: r.seq)] == [(0, "S", "A"), (0, "A", "B"), (1, "B", "A")]


def test_routes_of_random_networks(spark, edges):
    """Routes with ties, free arcs and many waypoints, against pointers followed one by one."""
    rng = random.Random(4)
    rows = [(f"N{a}", f"N{b}", f"L{rng.randrange(3)}", "DEU", rng.randint(0, 3), 1.0) for a in range(14) for b in range(14) if a != b and rng.random() < 0.3]
    rows += [(f"C{i}", f"C{i + 1}", "L", "DEU", 1, 1.0) for i in range(40)]
    e, points = spark.createDataFrame(rows, "src string, dst string, line string, country string, cost long, length double"), [f"N{i}" for i in range(14)]
    asked = [(f"p{i}", rng.choices(points, k=rng.randint(1, 4))) for i in range(12)] + [("z", [points[0], "Z", points[1]]), ("c", ["C0", "C40"])]
    got = sorted((r.path, r.leg, r.seq, r.src, r.dst, r.cost) for r in search.shortest_paths(e, spark.createDataFrame(asked, "path string, waypoints array<string>")).collect())
    arcs, want = [(a, b, c) for a, b, _, _, c, _ in rows], []
    graph = {a: [(h, (c,)) for t, h, c in arcs if t == a] for a, _, _ in arcs}
    for path, stops in asked:
        seq = 0
        for leg, (a, b) in enumerate(zip(stops, stops[1:], strict=False)):
            best, before = brute.cheapest(arcs, a)
            hops = []
            while path != "z" and b in best and b != a:
                hops.append((before[b], b, best[b][0] - best[before[b]][0]))
                b = before[b]
            assert path == "z" or search.dijkstra(graph, a, stops[leg + 1]) == ([a, *(h[1] for h in hops[::-1])] if stops[leg + 1] in best else [])
            for hop in hops[::-1]:
                seq += 1
                want.append((path, leg, seq, *hop))
    assert got == sorted(want) and sum(r[0] == "c" for r in got) == 40


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_pareto_labels(spark, width):
    """Fronts of all nodes and, with bounds and fewer labels, of two targets; free and parallel arcs; trails add up."""
    rng = random.Random(width)
    graph = {a: [(b, tuple(rng.randint(0, 9) for _ in range(width))) for b in range(14) if b != a and rng.random() < 0.25 for _ in range(rng.randint(1, 2))] for a in range(14)}
    arcs = spark.createDataFrame([(f"{a}", f"{b}", list(c)) for a, heads in graph.items() for b, c in heads], "tail string, head string, costs array<int>")
    want, every, few = brute.fronts(graph, 0), {}, {}
    asked = spark.createDataFrame([("0", str(t)) for t in range(14)] + [("0", "Z")], "source string, target string")
    got = search.pareto_solutions(arcs, asked, counters=every).collect()
    assert sorted((int(r.target), r.sol, tuple(r.costs)) for r in got) == sorted((t, i, c) for t, f in want.items() for i, c in enumerate(sorted(f), 1))
    for r in got:
        assert r.nodes[0] == "0" and r.nodes[-1] == r.target and not any(r.trail[0]) and r.trail[-1] == r.costs
        steps = zip(r.nodes, r.nodes[1:], r.trail, r.trail[1:], strict=False)
        assert all((int(b), tuple(y - x for x, y in zip(c, d, strict=True))) in graph[int(a)] for a, b, c, d in steps)
    two = search.pareto_solutions(arcs, asked.where("target in ('5', '9')"), most=2, counters=few).collect()
    assert sorted((int(r.target), r.sol, tuple(r.costs)) for r in two) == sorted((t, i, c) for t in (5, 9) for i, c in enumerate(sorted(want.get(t, []))[:2], 1))
    assert few["kept"] <= every["kept"] == sum(map(len, want.values())) and few["labels"] <= every["labels"] and few["beyond bounds"] > 0 == every["beyond bounds"]


def test_pareto(spark, edges):
    want = [(20, 7000), (40, 2374), (60, 2041)]
    arcs = search.expand(edges).select("tail", "head", F.array("line_cost", "distance_cost").alias("costs"))
    q = spark.createDataFrame([("A", "E"), ("A", "A"), ("A", "Z")], "source string, target string")
    got = search.pareto_solutions(arcs, q).collect()
    assert [tuple(r.costs) for r in sorted((r for r in got if r.target == "E"), key=lambda r: r.sol)] == want
    assert [tuple(r.costs) for r in got if r.target == "A"] == [(0, 0)] and not [r for r in got if r.target == "Z"]
    by_runs = search.pareto_routes(edges, q).collect()
    assert sorted((r.target, r.sol, tuple(r.costs)) for r in by_runs) == sorted((r.target, r.sol, tuple(r.costs)) for r in got)
    legal = {(r.tail, r.head, tuple(r.costs)) for r in arcs.collect()}
    for r in by_runs:
        assert (r.nodes[0], r.nodes[-1], r.trail[-1]) == (r.source, r.target, r.costs)
        assert all((a, b, tuple(y - x for x, y in zip(c, d, strict=True))) in legal for a, b, c, d in zip(r.nodes, r.nodes[1:], r.trail, r.trail[1:], strict=False))
    front = search.pareto_front(edges, spark.createDataFrame([("A",)], "source string")).where("node = 'E'").collect()
    assert sorted((20 * r.runs, r.cost) for r in front) == want
    s = spark.createDataFrame([("q", i + 1, c) for i, (_, c) in enumerate(want)], "question string, sol int, cost long")
    assert {p: search.choose_solution(s, p).first().cost for p in (0, 20, 100)} == {0: 2041, 20: 2374, 100: 7000}


def test_compaction(spark):
    rows = [("p", i, s, d, line, "DEU", 10, 1.0, v, True, float(i), float(i + 1)) for i, (s, d, line, v) in enumerate([("A", "B", "1", 100), ("B", "C", "1", 120), ("C", "A", "1", 120), ("A", "D", "1", 90), ("D", "E", "2", 90)])]
    path = spark.createDataFrame(rows, "path string, seq int, src string, dst string, line string, country string, cost long, length double, speed int, electrified boolean, start_km double, end_km double")
    got = [(r.src, r.dst, r.line, r.cost, r.speed) for r in paths.compact(path).orderBy("seq").collect()]
    assert got == [("A", "C", "1", 20, 120), ("C", "D", "1", 20, 120), ("D", "E", "2", 10, 90)]
    fast = [(r.src, r.dst) for r in paths.compact(path, by_speed=True).orderBy("seq").collect()]
    assert fast == [("A", "B"), ("B", "A"), ("A", "D"), ("D", "E")]
    ring = spark.createDataFrame([("q", i, s, d, "1", "DEU", 10, 1.0, 100, True, float(i), float(i + 1)) for i, (s, d) in enumerate(["AB", "BC", "CA", "AB", "BC"])], path.schema)
    assert [(r.src, r.dst, r.cost, r.start_km, r.end_km) for r in paths.compact(ring).orderBy("seq").collect()] == [("A", "C", 20, 0.0, 2.0), ("C", "B", 20, 2.0, 4.0), ("B", "C", 10, 4.0, 5.0)]
    assert paths.running_totals(path).agg(F.max("total_cost")).first()[0] == 50
    walked = path.withColumn("line", F.when(F.col("seq") == 2, "991").otherwise(F.col("line")))
    assert sorted((r.seq, r.segment) for r in paths.split_walking(walked).collect()) == [(0, 0), (1, 0), (3, 1), (4, 1)]


def test_decoders(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(decode.uri_tail(F.lit(decode.OP_PREFIXES[0] + "DE%20BL"), decode.OP_PREFIXES)) == "DE BL"
    with pytest.raises(Exception, match="unknown uri"):
        one(decode.uri_tail(F.lit("http://x/"), decode.OP_PREFIXES))
    assert one(decode.uri_tail(F.lit("http://x/"), decode.OP_PREFIXES, strict=False)) is None
    assert tuple(one(decode.wkt_point(F.lit("POINT(9.74 52.37)")))) == (9.74, 52.37)
    assert tuple(one(decode.wkt_point(F.lit("POINT(-9.74 52.37)")))) == (-9.74, 52.37)
    assert one(decode.wkt_point(F.lit("POINT(-9.74 52.37)"), strict=True)) is None
    assert one(decode.wkt_line(F.lit("LINESTRING (1 2, 3 4, 5 6)"))) is None
    assert one(decode.kilometre(F.lit(12.0), F.lit(345))) == pytest.approx(12.345)
    for code, want in (("BL", ["DE000BL"]), ("KB G", ["DEKB  G"]), ("X;BL", ["DE0000X", "DE000BL"]), ("ABCDEF", ["DEABCDEF"])):
        assert one(decode.station_uopids(F.lit(code))) == want
    assert one(decode.route_ref(F.lit("FRA"), F.lit("574000-1"), F.lit("574 000"))) and not one(decode.route_ref(F.lit("DEU"), F.lit("574000-1"), F.lit("574 000")))
    assert one(m.half_even(F.lit(0.125), 2)) == 0.12
    assert one(m.mo_node_parts(F.lit("a/b/c/d"))) is None
    assert [one(F.lit(x).rlike(m.search_pattern("lod"))) for x in ("Łódź LOD", "łód", "x")] == [True, True, False]
    assert one(F.lit("a(b").rlike(m.search_pattern("a(b")))
    assert one(m.route_url(F.array().cast("array<struct<lat:double,lon:double>>"))) == ""


def test_folds(spark):
    rows = spark.createDataFrame([(0, "U", "n", 10, "DEU", 1.0, 2.0, "1", 5.0), (1, "U", "other", 10, "DEU", 1.0, 2.0, "1", 5.0), (2, "U", "n", 10, "DEU", 1.0, 2.0, "1", 7.0)], "idx int, uopid string, name string, rinf_type int, country string, lat double, lon double, line string, km double")
    op = ingest.fold_operational_points(rows).first()
    assert op.name == "n" and [tuple(x) for x in op.locations] == [("1", 7.0), ("1", 5.0)]
    assert ingest.kilometre_of_line(rows).first().km == 7.0
    tracks = spark.createDataFrame([(0, "s", "t", 80, None, None, 70), (1, "s", "t", 90, None, None, 50), (2, "s", "u", None, None, None, None)], "idx int, section string, track string, speed int, radius int, contact string, category int")
    got = ingest.fold_tracks(tracks).first().tracks
    assert [(t.speed, t.categories) for t in got] == [(80, [50, 70]), (100, [])]
    cats = spark.createDataFrame([([("t", 1, 1, "x", c)],) for c in ([], [70], [70, 50])], f"tracks array<{TRACK}>")
    assert [r[0] for r in cats.select(m.is_passenger(F.col("tracks"))).collect()] == [True, False, True]


def test_graph_text(spark, edges, tmp_path):
    arcs = search.dense_arcs(search.expand(edges))
    files.write_gr(arcs, str(tmp_path / "g"))
    back = files.read_gr(spark, str(tmp_path / "g"))
    key = lambda df: sorted((r.tail, r.head, tuple(r.costs)) for r in df.collect())
    assert key(back) == key(arcs)
    for lines in (["p sp 2 9", "a 0 1 1 1"], ["p sp 2 1", "a 0 1 1 1 1 1"], ["p sp 1 1", "a 0 1 1 1"]):
        bad = tmp_path / str(abs(hash(tuple(lines))))
        bad.write_text("\n".join(lines))
        with pytest.raises(Exception):  # noqa: B017
            files.read_gr(spark, str(bad)).collect()
    three = tmp_path / "three"
    three.write_text("p sp 2 1\na 0 1 1 2 3")
    assert files.read_gr(spark, str(three)).first().costs == [1, 2, 3]


def test_files(spark, tmp_path):
    (tmp_path / "OpTypes.json").write_text('[{"Label":"station","Definition":"d","Value":10},\n{"Label":"stop","Definition":"d","Value":70}]')
    assert files.read_dataset(spark, str(tmp_path), "OpTypes").count() == 2
    (tmp_path / "r.json").write_text('{"head":{"vars":["a"]},"results":{"bindings":[{"a":{"type":"literal","value":"1"}},{"a":{"type":"uri","value":"u"}}]}}')
    got = files.read_bindings(spark, str(tmp_path / "r.json")).select("binding_idx", F.col("b")["a"]["value"].alias("v")).collect()
    assert [tuple(r) for r in got] == [(0, "1"), (1, "u")]
    calls = []
    load = lambda: calls.append(1) or spark.range(3)
    for use in (True, True, False):
        assert files.cached(spark, str(tmp_path / "c"), load, use).count() == 3
    assert len(calls) == 2
    assert files.metadata(spark, "e", "o", "r", ["DEU"]).first().Countries == ["DEU"]


def test_station_match(spark):
    ops = spark.createDataFrame([("DE000BL", 10, 52.0, 13.0), ("DEKB  G", 70, 50.0, 7.0), ("DE00XXX", 10, 0.0, 0.0)], "uopid string, rinf_type int, lat double, lon double")
    st = spark.createDataFrame([("u1", "halt", "railway", "X;BL", 52.0, 13.0), ("u2", "station", "railway", "BL", 52.01, 13.0), ("u3", "station", "railway", "BL", 53.0, 13.0), ("u4", "stop", "railway", "KB G", 50.0, 7.01)], "url string, railway string, prefix string, code string, lat double, lon double")
    got = {r.uopid: (r.url, r.distance) for r in matching.match_stations(ops, st).collect()}
    assert got == {"DE000BL": ("u2", 1.112), "DEKB  G": ("u4", 0.715), "DE00XXX": (None, None)}


def test_section_checks(spark):
    ops = spark.createDataFrame([("a", 50.0, 7.0), ("b", 50.0, 7.1)], "uopid string, lat double, lon double")
    matches = spark.createDataFrame([("a", 50.0, 7.07)], "uopid string, lat double, lon double")
    s = spark.createDataFrame([("s", "1", "a", "b", 2.0, [("t", 1, None, None, [])]), ("r", "1", "a", "b", 2.05, [("t", 1, None, None, [])])], f"section string, line string, start_op string, end_op string, length double, tracks array<{TRACK}>")
    rows = {r.section: r for r in matching.section_check(s, ops, matches).collect()}
    # the forced validity of tight curves and long sections holds both back
    assert rows["s"].valid and rows["s"].changed_op is None
    wide = s.withColumn("tracks", F.transform("tracks", lambda t: F.struct(t["id"].alias("id"), t["speed"].alias("speed"), F.lit(2000).alias("radius"), t["contact"].alias("contact"), t["categories"].alias("categories"))))
    rows = {r.section: r for r in matching.section_check(wide, ops, matches).collect()}
    assert not rows["s"].valid and rows["s"].changed_op == "a" and rows["s"].moved == pytest.approx(5.003, abs=0.01)
    changed = matching.sequential_check(wide, ops, matches).collect()
    assert [(r.section, r.changed_op) for r in changed] == [("s", "a")]  # the second sees the mended place


def test_sequential_check_over_lines(spark):
    """Against one pass over the whole network; points lie on several lines, and order decides."""
    rng = random.Random(12)
    ops = [(f"o{i}", 50 + rng.random() / 20, 7 + rng.random() / 20) for i in range(40)]
    matches = [(o, lat + rng.choice([0, 0.02]) * rng.random(), lon + rng.choice([0, 0.03]) * rng.random()) for o, lat, lon in ops if rng.random() < 0.7] + [("o1x", None, None)]
    rows = [(f"s{i:03}", f"L{rng.randrange(5)}", *(o[0] for o in rng.sample(ops, 2)), round(rng.uniform(0.3, 4.5), 2), [("t", 1, rng.choice([500, 2000, None]), None, [])]) for i in range(300)]
    place, found, want = {o: (a, b) for o, a, b in ops}, {o: (a, b) for o, a, b in matches if a is not None}, []
    for s, line, a, b, length, tracks in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        radius = tracks[0][2] or 0
        target = a if a in found else b if b in found else None
        if target is None or matching._fits(length, matching._far(*place[a], *place[b]), radius):
            continue
        other = b if target == a else a
        after = matching._far(*found[target], *place[other])
        if matching._fits(length, after, radius) and abs(length - after) * 100 / length < 20 and matching._far(*place[target], *found[target]) > 0.2:
            want.append((line, s, target))
            place[target] = found[target]
    got = matching.sequential_check(
        spark.createDataFrame(rows, f"section string, line string, start_op string, end_op string, length double, tracks array<{TRACK}>"),
        spark.createDataFrame(ops, "uopid string, lat double, lon double"), spark.createDataFrame(matches, "uopid string, lat double, lon double"),
    )
    assert sorted((r.line, r.section, r.changed_op) for r in got.collect()) == sorted(want) and len(want) > 3


def test_points_settle(spark):
    """Points move to their matches, round after round, until a further check moves none; each change has its distance and percent."""
    ops = spark.createDataFrame([("DE0000A", "a", 50.0, 7.0), ("DE0000B", "b", 50.0, 7.02), ("DE0000C", "c", 50.0, 7.04)], "uopid string, name string, lat double, lon double").withColumn("rinf_type", F.lit(10))
    rows = [("s1", "1", "DE0000A", "DE0000B", 2.2, [("t", 1, 3000, None, [])]), ("s2", "1", "DE0000B", "DE0000C", 1.43, [("t", 1, 3000, None, [])])]
    sections = spark.createDataFrame(rows, f"section string, line string, start_op string, end_op string, length double, tracks array<{TRACK}>")
    stations = spark.createDataFrame([("node/1", "station", "railway", "A", 50.0, 6.99)], "url string, railway string, prefix string, code string, lat double, lon double")
    changes = matching.op_info_changes(sections, ops, matching.match_stations(ops, stations)).collect()
    assert [(r.uopid, r.new_lon, r.percent) for r in changes] == [("DE0000A", 6.99, 35.0)] and abs(changes[0].distance - 0.715) < 0.001
    settled, log = matching.settled_points(sections, ops, stations)
    assert log == [1, 0] and {r.uopid: r.lon for r in settled.collect()} == {"DE0000A": 6.99, "DE0000B": 7.02, "DE0000C": 7.04}
    assert settled.columns == ops.columns


def test_kilometres_of_points(spark, sections):
    """A point with two kilometres on a line doubles no section; the one seen last counts."""
    places = spark.createDataFrame([("DEU", "100", "A", 0.0, 0), ("DEU", "100", "A", 7.0, 1), ("DEU", "100", "B", 10.0, 2)], "country string, line string, op string, km double, idx int")
    got = network.graph_by_sections(sections, places).collect()
    assert [(r.src, r.dst, r.start_km) for r in got] == [("A", "B", 7.0)]
    assert network.sections_of_line(sections.where("section = 's1'"), places, "DEU", "100").first().start_km == 7.0


def test_pages(spark, tmp_path):
    for page in (10, 2, 1):
        (tmp_path / f"sparql-{page}.json").write_text('{"head":{"vars":[]},"results":{"bindings":[{"a":{"type":"literal","value":"%d"}},{"a":{"type":"literal","value":"x"}}]}}' % page)
    got = files.read_bindings(spark, f"{tmp_path}/sparql-*.json").orderBy("page", "file", "binding_idx").select(F.col("b")["a"]["value"].alias("v")).collect()
    assert [r.v for r in got] == ["1", "x", "2", "x", "10", "x"]
    pages = [spark.createDataFrame([(i, f"{p}{i}") for i in range(n)], "binding_idx int, v string") for p, n in (("a", 2), ("b", 3), ("c", 1))]
    assert [(r.binding_idx, r.v) for r in files.union_pages(pages).orderBy("binding_idx").collect()] == list(enumerate(["a0", "a1", "b0", "b1", "b2", "c0"]))
    one = spark.range(1).select(decode.wkt_point(F.lit("POINT(9.7  \t52.3)")).alias("p"), decode.wkt_line(F.lit("LINESTRING (1  2,  3   4)")).alias("l")).first()
    assert tuple(one.p) == (9.7, 52.3) and tuple(one.l) == (1, 2, 3, 4)
    assert files.checked_countries("DEU;FRA") == ["DEU", "FRA"] and files.countries(spark).count() == 26
    with pytest.raises(ValueError, match="XXX"):
        files.checked_countries("DEU;XXX")


def test_statistics(spark, edges):
    pairs = network.undirected(edges.where("start_km < end_km"))
    assert {r.degree: r.nodes for r in network.degree_histogram(pairs).collect()} == {2: 3, 3: 2}
    stats = {r.line: (r.edges, r.nodes, r.connected, r.is_path) for r in network.line_statistics(pairs).collect()}
    assert stats["300"] == (2, 3, True, True)
    split = spark.createDataFrame([("a", "b", "x"), ("c", "d", "x"), ("d", "e", "x")], "a string, b string, line string")
    assert dict(network.components(split).select("node", "component").collect()) == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c"}


def test_validity(spark):
    rows = spark.createDataFrame([(i,) for i in range(4)], "k int")
    periods = spark.createDataFrame([(1, "2020-01-01", "2020-12-31"), (2, "2021-01-01", "2021-12-31"), (3, "2020-06-01", "2020-06-01")], "k int, begin string, end string")
    got = ingest.currently_valid(rows, periods, "k", F.lit("2020-06-01"))
    assert sorted(r.k for r in got.collect()) == [0, 1, 3]
