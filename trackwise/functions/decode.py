"""Decoders of query-result terms (columns in, columns out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URI prefixes of the vocabulary.
OP_PREFIXES = ("http://data.europa.eu/949/operationalPoint/", "http://data.europa.eu/949/functionalInfrastructure/operationalPoints/")
TYPE_PREFIXES = ("http://data.europa.eu/949/concepts/op-types/",)
COUNTRY_PREFIXES = ("http://publications.europa.eu/resource/authority/country/",)
SECTION_PREFIXES = ("http://data.europa.eu/949/sectionOfLine/", "http://data.europa.eu/949/functionalInfrastructure/sectionsOfLine/")
TRACK_PREFIXES = ("http://data.europa.eu/949/track/", "http://data.europa.eu/949/functionalInfrastructure/tracks/")
CATEGORY_PREFIXES = ("http://data.europa.eu/949/concepts/line-category/",)
OSM_PREFIXES = ("https://www.openstreetmap.org/",)
# Datatypes.
XSD = "http://www.w3.org/2001/XMLSchema#"
WKT = "http://www.opengis.net/ont/geosparql#wktLiteral"


def _fail(strict: bool, message: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(value.cast("string"), F.lit("null")))) if strict else F.lit(None).cast("string")


def uri_tail(value: Column, prefixes: tuple[str, ...], strict: bool = True) -> Column:
    """The part after the first prefix that matches, URL-decoded; otherwise an error (null if not strict)."""
    cases = F.lit(None).cast("string")
    for prefix in reversed(prefixes):
        cases = F.when(value.startswith(prefix), F.url_decode(F.substring(value, F.lit(len(prefix) + 1), F.length(value)))).otherwise(cases)
    known = F.lit(False)
    for prefix in prefixes:
        known = known | value.startswith(prefix)
    return F.when(known, cases).otherwise(_fail(strict, "unknown uri", value))


def literal(kind: Column, value: Column, strict: bool = True) -> Column:
    return F.when(kind == "literal", value).otherwise(_fail(strict, "no literal", value))


def wkt_literal(kind: Column, datatype: Column, value: Column, strict: bool = True) -> Column:
    return F.when((kind == "literal") & (datatype == WKT), value).otherwise(_fail(strict, "no wkt literal", value))


def typed_int(kind: Column, datatype: Column, value: Column, strict: bool = True) -> Column:
    return F.when((kind == "literal") & (datatype == XSD + "integer"), value).otherwise(_fail(strict, "no integer", value)).cast("int")


def typed_double(kind: Column, datatype: Column, value: Column, strict: bool = True) -> Column:
    ok = (kind == "literal") & datatype.isin(XSD + "double", XSD + "decimal")
    return F.when(ok, value).otherwise(_fail(strict, "no number", value)).cast("double")


def line_category(value: Column, strict: bool = True) -> Column:
    tail = uri_tail(value, CATEGORY_PREFIXES, strict)
    return tail.cast("int") if strict else tail.try_cast("int")


def type_number(notation: Column) -> Column:
    """Trailing integer of an operational-point type notation."""
    return F.regexp_extract(notation, "([0-9]+)$", 1).try_cast("int")


def kilometre(km: Column, offset_m: Column) -> Column:
    return km + F.lit(0.001) * offset_m


def _number(strict: bool) -> str:
    return "([0-9.]+)" if strict else "(-?[0-9.]+)"


def wkt_point(value: Column, strict: bool = False) -> Column:
    """struct(lon, lat) of POINT(lon lat), null if it doesn't match; strict takes no minus sign."""
    n = _number(strict)
    pattern = rf"POINT\s*\({n}\s+{n}\)"
    part = lambda i: F.regexp_extract(value, pattern, i).try_cast("double")
    return F.when(value.rlike(pattern), F.struct(part(1).alias("lon"), part(2).alias("lat")))


def wkt_line(value: Column, strict: bool = False) -> Column:
    """struct of both ends of a LINESTRING of exactly two points, else null."""
    n = _number(strict)
    pattern = rf"LINESTRING\s*\({n}\s+{n},\s*{n}\s+{n}\)"
    part = lambda i, name: F.regexp_extract(value, pattern, i).try_cast("double").alias(name)
    return F.when(value.rlike(pattern), F.struct(part(1, "start_lon"), part(2, "start_lat"), part(3, "end_lon"), part(4, "end_lat")))


# Fixed value: pattern of a track code.
TRACK_CODE = "([0-9]{4})_([0-9A-Z]{7})_.*_([0-9A-Z]{7})"


def tunnel_track(value: Column) -> Column:
    """struct(line, start_op, end_op) of a track code."""
    return F.when(value.rlike(TRACK_CODE), F.struct(*[F.regexp_extract(value, TRACK_CODE, i).alias(n) for i, n in enumerate(("line", "start_op", "end_op"), 1)]))


def station_uopids(code: Column, prefix: str = "DE") -> Column:
    """Keys that a station code may stand for: split at ';', a blank of a 4-character code doubled, padded to 5 on the left with zeros."""

    def one(c: Column) -> Column:
        c = F.when((F.length(c) == 4) & c.contains(" "), F.replace(c, F.lit(" "), F.lit("  "))).otherwise(c)
        return F.concat(F.lit(prefix), F.when(F.length(c) < 5, F.lpad(c, 5, "0")).otherwise(c))

    return F.transform(F.split(code, ";"), one)


def route_ref(country: Column, line: Column, ref: Column) -> Column:
    """Whether a map route's reference is a line's: equal, or for French lines "574000-1" and "574 000"."""
    french = (country == "FRA") & line.endswith("-1") & (F.length(ref) == 7) & (F.substring(line, 1, 3) == F.substring(ref, 1, 3))
    return (line == ref) | french


def wikipedia_title(value: Column) -> Column:
    return F.replace(value, F.lit("https://de.wikipedia.org/wiki/"), F.lit("de:"))
