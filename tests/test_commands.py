"""Commands from raw query results to routes, on the hand-made network of test_network."""

import json
import shutil

import pytest
from test_network import KM

from trackwise.__main__ import typed
from trackwise.functions import decode
from trackwise.plans.build import STAGES, build_all, version
from trackwise.plans.commands import Folder, load_rows_of_routes

XSD = "http://www.w3.org/2001/XMLSchema#"


def _lit(v):
    return {"type": "literal", "value": v}


def _num(v):
    return {"type": "literal", "datatype": XSD + ("integer" if isinstance(v, int) else "double"), "value": str(v)}


def _uri(v):
    return {"type": "uri", "value": v}


def _save(folder, name, rows):
    (folder / f"sparql-{name}.json").write_text(json.dumps({"head": {"vars": []}, "results": {"bindings": rows}}))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("data")
    country, section = _uri(decode.COUNTRY_PREFIXES[0] + "DEU"), lambda s: _uri(decode.SECTION_PREFIXES[0] + s)
    kind = _uri(decode.TYPE_PREFIXES[0] + "rinf/10")
    ops = [{"opName": _lit("n" + op), "uopid": _lit(op), "opType": kind, "country": country, "lat": _num(50.0), "lon": _num(9.0), "lineId": _lit(line), "kilometer": _num(km), "offset": _num(0.0)} for line, op, km in KM]
    ops[0] = {k: v for k, v in ops[0].items() if k not in ("lat", "lon")} | {"wkt": _lit("POINT(9.0 50.0)")}
    _save(at, "operationalPoints", ops)
    sols = [("s1", "100", "A", "B", 10.0), ("s2", "100", "B", "C", 20.004), ("s3", "300", "D", "C", 4.0), ("s4", "400", "A", "E", 70.0), ("s5", "300", "D", "E", 99.0)]
    _save(at, "sectionsOfLine", [{"sectionOfLine": section(s), "country": country, "lineId": _lit(line), "startUopid": _lit(a), "endUopid": _lit(b), "length": _num(km)} for s, line, a, b, km in sols])
    tracks = [("s1", "1", 160, None), ("s1", "2", 120, None), ("s2", "1", 200, None), ("s3", "1", 90, None), ("s4", "1", None, None), ("s5", "1", 90, "70")]  # s5 is no passenger line
    rows = []
    for s, t, speed, category in tracks:
        row = {"sectionOfLine": section(s), "track": _uri(decode.TRACK_PREFIXES[0] + s + t), "label": _lit(t)}
        row |= {"maximumPermittedSpeed": _num(speed)} if speed else {}
        rows.append(row | ({"lineCategory": _uri(decode.CATEGORY_PREFIXES[0] + category)} if category else {}))
    _save(at, "tracks", rows)
    tunnel = {"tunnelIdentification": _lit("T"), "country": country, "lineId": _lit("100"), "length": _num(1500.0), "startsAtKilometer": _num(1.0), "startsAtOffset": _num(500.0), "endsAtKilometer": _num(3.0), "endsAtOffset": _num(0.0)}
    _save(at, "tunnel", [tunnel | {"wkt": _lit("POINT(1 2)")}, tunnel | {"wkt": _lit("LINESTRING(9.1 50.1, 9.2 50.2)")}])
    build_all(spark, str(at))
    return Folder(spark, str(at))


def test_build(folder):
    got = {(r.src, r.dst): (r.line, r.length, r.speed, r.cost) for r in folder.edges().where("start_km < end_km").collect()}
    assert got[("A", "B")] == ("100", 10.0, 160, 625) and got[("D", "E")] == ("300", 5.0, 120, 416) and len(got) == 6
    assert folder.edges().count() == 12 and folder.ops().count() == 5
    line = folder.read("LineInfos").where("Line = '100'").first()
    assert (line.Name, line.Length, line.UOPIDs, line.Tunnels, line.Wikipedia) == ("nA - nC", 30.0, ["A", "B", "C"], ["T"], None)
    tunnel = folder.read("TunnelInfos").first()
    assert (tunnel.Length, tunnel.StartKm, tunnel.EndLat) == (1.5, 1.5, 50.2)


def test_questions(folder):
    assert [(r.src, r.dst, r.line, r.cost) for r in folder.route("A;E").collect()] == [("A", "B", "100", 625), ("B", "D", "200", 1000), ("D", "E", "300", 416)]
    assert folder.route("A").count() == 0
    pareto = folder.pareto_routes("A", "E").collect()
    assert sorted({(r.total_line_cost, r.total_cost) for r in pareto}) == [(20, 7000), (40, 2374), (60, 2041)]
    assert [(r.src, r.dst, r.line, r.cost, r.length) for r in pareto if r.total_line_cost == 40] == [("A", "C", "100", 1625, 30.0), ("C", "E", "300", 749, 9.0)]
    assert [r.op for r in folder.ops_of_line("DEU", "100").collect()] == ["A", "B", "C"]
    assert [r.section for r in folder.sections_of_line("DEU", "100").collect()] == ["s1", "s2"]
    assert folder.check_locations().count() == 0
    assert folder.path_of_line("DEU", "100").collect()[-1].total_length == 30.0
    folder.write_multi_criteria_graph()


def test_more_sets(spark, folder):
    """Data sets besides the graph, and commands over them."""
    assert folder.read("Tunnels").first().Length == 1500.0 and folder.read("Metadata").first().CountriesPrefLabel == ["Germany"]
    arcs = sum(len(r.Edges) for r in folder.read("MoGraph").collect())
    assert arcs == 12 + 2 * 10 and folder.pareto_gr(0, 0).count() == 1
    assert [(r.path, r.src, r.dst) for r in folder.path_view("A", "E", 20.0).collect()] == [(2, "A", "C"), (2, "C", "E")]
    assert [r.src for r in folder.line_view("DEU", "100").collect()] == ["A", "B"]
    assert [r.total_length for r in folder.tunnels_of_line("DEU", "100").collect()] == [1.5]
    assert "A" in folder.places_url("DEU", "100").first().url and folder.printed_route("A;E").count() == 3
    assert [r.from_name for r in folder.route_elements("A;B").collect()] == ["nA"]
    assert [(r.src, r.dst, r.speed) for r in folder.route("A;C", True).collect()] == [("A", "B", 160), ("B", "C", 200)]
    assert folder.graph_stats().count() == 4 and folder.degrees().count() == 2


def test_map_data(spark, tmp_path_factory):
    """Raw results of countries, types, map stations and routes; a network of one country; the report."""
    at = tmp_path_factory.mktemp("map")
    country = lambda c: _uri(decode.COUNTRY_PREFIXES[0] + c)
    point = lambda op, c, km: {"opName": _lit("n" + op), "uopid": _lit(op), "opType": _uri(decode.TYPE_PREFIXES[0] + "rinf/10"), "country": country(c), "lat": _num(50.0 + km / 100), "lon": _num(9.0), "lineId": _lit("100"), "kilometer": _num(km), "offset": _num(0.0)}
    _save(at, "operationalPoints", [point("DE0000A", "DEU", 0.0), point("DE0000B", "DEU", 5.0), point("DE0000C", "DEU", 9.0), point("FR0000X", "FRA", 1.0)])
    _save(at, "sectionsOfLine", [])
    _save(at, "tracks", [])
    _save(at, "tunnel", [])
    _save(at, "countries", [{"country": country("DEU"), "label": _lit("Germany")}])
    _save(at, "opTypes", [{"n": _lit("10"), "l": _lit("station"), "d": _lit("large")}])
    osm = lambda v: _uri("https://www.openstreetmap.org/" + v)
    _save(at, "osm", [{"id": osm("node/1"), "name": _lit("a"), "railway": _lit("station"), "railway_ref": _lit("A"), "lat": _num(50.0), "lng": _num(9.0), "type": osm("node")}])
    _save(at, "osmWikidata", [{"id": _uri("r1"), "ref": _lit("100"), "wikipedia": _uri("https://de.wikipedia.org/wiki/Line 100")}])
    (at / "rows.json").write_text(json.dumps({"query": "q", "res": [["u", "7", "de:x"]]}))
    build_all(spark, str(at), "DEU")
    f = Folder(spark, str(at))
    assert [r.Wikipedia for r in f.read("LineInfos").collect()] == ["de:Line 100"] and f.ops().count() == 3
    assert f.read("OsmRoutes").count() == f.read("Countries").count() == f.read("OpTypes").count() == f.read("OsmEntries").count() == 1
    assert sorted((r.UOPID, r.OsmUrl) for r in f.osm_matchings().collect()) == [("DE0000A", "node/1"), ("DE0000B", None), ("DE0000C", None)]
    assert [r.uopid for r in f.osm_report().collect()] == ["DE0000B", "DE0000C"] and f.check_sections().count() == 0
    assert f.op_info_changes("", True).count() == 0 and f.read("OpInfoChanges").count() == 0 and f.op_info_changes("none").columns == f.read("OpInfoChanges").columns
    assert [tuple(r) for r in load_rows_of_routes(spark, str(at / "rows.json")).collect()] == [("u", "7", "de:x")]
    with pytest.raises(ValueError, match="ABC"):
        build_all(spark, str(at), "DEU;ABC")


def test_arguments():
    assert typed(Folder.route, ["A;B", "False"]) == ["A;B", False] and typed(Folder.pareto_routes, ["A", "B", "7"]) == ["A", "B", 7]
    assert typed(Folder.path_view, ["A", "B", "20"]) == ["A", "B", 20.0] and typed(build_all, ["DEU", "false"]) == ["DEU", False]


def test_stages(spark, folder, tmp_path):
    """A second build keeps what is unchanged; changed inputs, options and lost stages are made again, and what reads them."""
    at = str(tmp_path)
    for name in ("operationalPoints", "sectionsOfLine", "tracks", "tunnel"):
        shutil.copy(f"{folder.folder}/sparql-{name}.json", at)
    first = build_all(spark, at, use_cache=True)
    absent = {"Countries", "OpTypes", "OsmEntries", "OsmRoutes"}
    assert first == {n: "absent" if n in absent else "built" for n in STAGES}
    graph, before = Folder(spark, at).edges().count(), version(spark, f"{at}/Graph.json")
    assert set(build_all(spark, at, use_cache=True).values()) == {"absent", "kept"} and version(spark, f"{at}/Graph.json") == before
    # another tunnel: nothing but tunnels and lines
    tunnels = json.loads((tmp_path / "sparql-tunnel.json").read_text())
    tunnels["results"]["bindings"].append(tunnels["results"]["bindings"][-1] | {"tunnelIdentification": _lit("U")})
    (tmp_path / "sparql-tunnel.json").write_text(json.dumps(tunnels))
    assert {n for n, what in build_all(spark, at, use_cache=True).items() if what == "built"} == {"Tunnels", "TunnelInfos", "LineInfos"}
    assert [r.Tunnels for r in Folder(spark, at).read("LineInfos").where("Line = '100'").collect()] == [["T", "U"]]
    # a stage that was lost before its note, then another form of the graph
    (tmp_path / "stages" / "MoGraph.json").unlink()
    assert build_all(spark, at, use_cache=True, only="MoGraph;Graph") == {"Graph": "kept", "MoGraph": "built"}
    assert build_all(spark, at, "", False, True, only="Graph") == {"Graph": "built"} and Folder(spark, at).edges().count() < graph
    _save(tmp_path, "osmWikidata", [{"id": _uri("r1"), "ref": _lit("100"), "wikipedia": _uri("https://de.wikipedia.org/wiki/Line 100")}])
    assert build_all(spark, at, skip_osm=True, only="OsmRoutes") == {"OsmRoutes": "skipped"}
    assert build_all(spark, at, only="OsmRoutes") == {"OsmRoutes": "built"}
    with pytest.raises(ValueError, match="Grph"):
        build_all(spark, at, only="Grph")
