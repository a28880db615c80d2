"""Centres of geometries, and stations and routes from raw map statements."""

import pytest
from pyspark.sql import functions as F

from trackwise.functions.geometry import centroid
from trackwise.plans import mapdata as md

NODE, REL = "https://www.openstreetmap.org/node/", "https://www.openstreetmap.org/relation/"

SHAPES = {
    "POINT(9.5 -50.25)": (9.5, -50.25),
    "point (1e1 5)": (10.0, 5.0),
    "MULTIPOINT((0 0), (2 4))": (1.0, 2.0),
    "MULTIPOINT(0 0, 2 4)": (1.0, 2.0),
    "LINESTRING(0 0, 3 0, 3 1)": (1.875, 0.125),
    "LINESTRING(2 2, 2 2)": (2.0, 2.0),
    "MULTILINESTRING((0 0, 2 0), (0 4, 6 4))": (2.5, 3.0),
    "POLYGON((0 0, 4 0, 4 2, 0 2, 0 0))": (2.0, 1.0),
    "POLYGON((0 0, 0 2, 4 2, 4 0, 0 0))": (2.0, 1.0),
    "POLYGON((0 0, 4 0, 4 2, 0 2, 0 0), (1 0.5, 1 1, 2 1, 2 0.5, 1 0.5))": (15.25 / 7.5, 7.625 / 7.5),
    "POLYGON((0 0, 4 0, 4 2, 0 2, 0 0), (1 0.5, 2 0.5, 2 1, 1 1, 1 0.5))": (15.25 / 7.5, 7.625 / 7.5),
    "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 1, 0 0)), ((3 0, 5 0, 5 2, 3 2, 3 0)))": (3.3, 0.9),
    "POLYGON((1 1, 3 1, 1 1))": (2.0, 1.0),
    '"POLYGON((0 0, 4 0, 4 2, 0 2, 0 0))"^^<http://www.opengis.net/ont/geosparql#wktLiteral>': (2.0, 1.0),
    "POINT EMPTY": None,
    "POLYGON((0 0, x 1, 1 1, 0 0))": None,
    "GEOMETRYCOLLECTION(POINT(1 2))": None,
    "": None,
    "nothing": None,
}


def test_centroid(spark):
    rows = spark.createDataFrame([(k,) for k in SHAPES] + [(None,)], "wkt string")
    got = {r.wkt: r.c for r in rows.select("wkt", centroid(F.col("wkt")).alias("c")).collect()}
    assert got.pop(None) is None
    for text, want in SHAPES.items():
        assert (got[text] is None) == (want is None), text
        if want:
            assert tuple(got[text]) == pytest.approx(want), text


def _facts(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


def test_centroid_is_exact_far_from_zero(spark):
    """Small shapes far from the origin of coordinates keep their digits."""
    text = "POLYGON((170.000001 60.000001, 170.000003 60.000001, 170.000003 60.000002, 170.000001 60.000002, 170.000001 60.000001))"
    c = spark.range(1).select(centroid(F.lit(text)).alias("c")).first().c
    assert (c.lon, c.lat) == pytest.approx((170.000002, 60.0000015), abs=1e-11)


@pytest.fixture(scope="module")
def contains(spark):
    rows = [(md.GERMANY, NODE + "1"), (md.SWITZERLAND, NODE + "1"), (md.SWITZERLAND, NODE + "2"), (REL + "9", NODE + "3"), (md.GERMANY, NODE + "4"), (md.GERMANY, REL + "r1"), (md.GERMANY, REL + "r2")]
    return spark.createDataFrame(rows, "area string, s string")


def test_stations(spark, contains):
    k = md.KEY

    def station(n, *more):
        s = NODE + str(n)
        return [(s, md.TYPE, "https://www.openstreetmap.org/node"), (s, md.HAS_GEOMETRY, f"g{n}"), (f"g{n}", md.AS_WKT, f"POINT({n} 50)"), *[(s, k + p, o) for p, o in more]]

    facts = [
        *station(1, ("name", "a"), ("disused:name", "b"), ("railway", "station"), ("historic:railway", "halt"), ("railway:ref", "A"), ("uic_ref", "80")),
        *station(2, ("name", "c"), ("public_transport", "stop_area"), ("railway:ref:DBAG", "C"), ("operator", "x")),
        *station(3, ("name", "outside"), ("railway", "station"), ("railway:ref", "D")),
        *station(4, ("name", "no area"), ("public_transport", "platform"), ("railway:ref", "E")),
        *station(4, ("name", "no area")),
    ]
    got = md.stations(_facts(spark, facts), contains)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    a = [("node/1", n, r, prefix, "A", "80", None, 50.0, 1.0, "node") for n in "ab" for r, prefix in (("halt", "historic"), ("station", None))]
    assert rows == sorted([*a, ("node/2", "c", "stop_area", None, "C", None, "x", 50.0, 2.0, "node")], key=repr)
    assert got.columns == ["Url", "Name", "Railway", "RailwayPrefix", "RailwayRef", "UicRef", "Operator", "Latitude", "Longitude", "OsmType"]
    assert md.stations(_facts(spark, []), contains).count() == 0


def _route(s, *more):
    return [(REL + s, md.KEY + "type", "route"), (REL + s, md.KEY + "route", "railway"), (REL + s, md.KEY + "ref", "7"), *[(REL + s, p, o) for p, o in more]]


def test_routes(spark, contains):
    facts = _facts(spark, [
        *_route("r1", (md.KEY + "wikipedia", "de:One"), (md.WIKIDATA, "Q1")), *_route("r2", (md.WIKIDATA, "Q2"), (md.KEY + "ref", "8")), *_route("r3", (md.KEY + "wikipedia", "de:Far")), *_route("r4", (md.WIKIDATA, "Q4")),
        (REL + "r5", md.KEY + "ref", "9"), (REL + "r5", md.WIKIDATA, "Q2"),
    ])
    second = _facts(spark, [(md.SITE + f"wiki/{n}", p, o) for n, item, site in (("One", "Q1", md.SITE), ("Two", "Q2", md.SITE), ("Four", "Q4", "https://fr.wikipedia.org/")) for p, o in ((md.ABOUT, item), (md.PART_OF, site))])
    sent = []

    def service(keys):
        sent.extend(r.item for r in keys.collect())
        return md.articles_of(second)(keys)

    rows = [(r.idx.source, r.Url[len(REL) :], r.Ref, r.Wikipedia) for r in md.routes(facts, contains, service).orderBy("idx").collect()]
    assert rows == [(0, "r1", "7", "de:One"), (1, "r2", "7", "de:Two"), (1, "r2", "8", "de:Two")]
    assert sorted(sent) == ["Q2", "Q4"]
    assert md.routes(facts, contains, service, most=1).count() == 2


def test_second_source_fails(spark, contains, tmp_path):
    """Its failure, when it is asked or while it answers, leaves the first source's rows."""
    facts = _facts(spark, [*_route("r1", (md.KEY + "wikipedia", "de:One")), *_route("r2", (md.WIKIDATA, "Q2"))])
    missing = lambda keys: spark.read.schema("item string, article string").parquet(str(tmp_path / "none"))
    broken = lambda keys: keys.select("item", F.raise_error(F.lit("gone")).cast("string").alias("article"))
    for service in (missing, broken):
        assert [(r.Ref, r.Wikipedia) for r in md.routes(facts, contains, service).collect()] == [("7", "de:One")]
    with pytest.raises(ZeroDivisionError):
        md.routes(facts, contains, lambda keys: 1 / 0)
