"""Centres of geometry texts (columns in, columns out), planar in longitude and latitude."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: dimension of each kind of geometry that has a centre here
DIMENSIONS = {"POINT": 0, "MULTIPOINT": 0, "LINESTRING": 1, "MULTILINESTRING": 1, "POLYGON": 2, "MULTIPOLYGON": 2}
#: area, length and count, each with its first moments in x and y
MOMENTS = ("a", "ax", "ay", "l", "lx", "ly", "n", "nx", "ny")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _points(text: Column) -> Column:
    """Coordinates of a list "x y, x y": numbers that can't be read are null."""

    def one(p: Column) -> Column:
        parts = F.split(F.trim(p), r"\s+")
        return F.struct(F.try_element_at(parts, F.lit(1)).try_cast("double").alias("x"), F.try_element_at(parts, F.lit(2)).try_cast("double").alias("y"))

    return F.transform(F.split(text, ","), one)


def _step(p: Column, q: Column, origin: Column) -> Column:
    """Moments of a point and of the way from it to the next."""
    x0, y0, x1, y1 = p["x"] - origin["x"], p["y"] - origin["y"], q["x"] - origin["x"], q["y"] - origin["y"]
    cross, length = x0 * y1 - x1 * y0, F.hypot(x1 - x0, y1 - y0)
    values = (cross / 2, (x0 + x1) * cross / 6, (y0 + y1) * cross / 6, length, (x0 + x1) * length / 2, (y0 + y1) * length / 2, F.lit(1.0), x0, y0)
    return F.struct(*[v.alias(name) for name, v in zip(MOMENTS, values, strict=True)])


def _sum(moments: Column) -> Column:
    zero = F.struct(*[F.lit(0.0).alias(name) for name in MOMENTS])
    return F.aggregate(moments, zero, lambda s, m: F.struct(*[(s[name] + m[name]).alias(name) for name in MOMENTS]))


def _ring(points: Column, closed: Column, hole: Column, origin: Column) -> Column:
    """Moments of one list of points; a closed one has a positive area, a hole's is negative, whatever its sense of rotation."""
    none = F.slice(points, 1, 0)
    following = F.concat(F.slice(points, 2, F.size(points)), F.when(closed, F.slice(points, 1, 1)).otherwise(none))
    whole = _sum(F.zip_with(points, following, lambda p, q: _step(p, F.coalesce(q, p), origin)))
    sign = lambda m: F.when(m["a"] < 0, -1.0).otherwise(1.0) * F.when(hole, -1.0).otherwise(1.0)
    return _let(whole, lambda m: F.struct(*[(m[name] * sign(m) if name.startswith("a") else m[name]).alias(name) for name in MOMENTS]))


def centroid(wkt: Column) -> Column:
    """struct(lon, lat) of points, lines and polygons, single or multiple, with or without a datatype around them.

    Polygons weigh by area (less that of their holes), lines by length, points by number; polygons without an area count
    as lines, lines without a length as points. Null for null, empty or other geometries and for texts that can't be read.
    """
    kind = F.upper(F.regexp_extract(wkt, r"([A-Za-z]+)\s*\(", 1))
    dimension = F.try_element_at(F.create_map(*[x for k, d in DIMENSIONS.items() for x in (F.lit(k), F.lit(d))]), kind)
    parts = F.split(F.regexp_extract(wkt, r"\(.*\)", 0), r"\)\s*\)\s*,\s*\(\s*\(")
    lists = F.transform(parts, lambda part: F.transform(F.regexp_extract_all(part, F.lit(r"[^()]*[0-9][^()]*"), F.lit(0)), _points))

    def centre(shape: Column) -> Column:
        rings = F.flatten(F.transform(shape["lists"], lambda part: F.transform(part, lambda ring, i: _ring(ring, shape["d"] == 2, i > 0, shape["origin"]))))

        def at(m: Column) -> Column:
            by = lambda w: F.struct((shape["origin"]["x"] + m[w + "x"] / m[w]).alias("lon"), (shape["origin"]["y"] + m[w + "y"] / m[w]).alias("lat"))
            found = F.when((shape["d"] == 2) & (m["a"] > 0), by("a")).when((shape["d"] >= 1) & (m["l"] > 0), by("l")).when(m["n"] > 0, by("n"))
            return _let(found, lambda f: F.when(f["lon"].isNotNull() & f["lat"].isNotNull(), f))

        return _let(_sum(rings), at)

    # the first point is found once for a text, not again for each of its points
    first = lambda of: F.struct(of.alias("lists"), F.try_element_at(F.flatten(of), F.lit(1))[0].alias("origin"), dimension.alias("d"))
    return F.when(dimension.isNotNull(), _let(_let(lists, first), centre))
