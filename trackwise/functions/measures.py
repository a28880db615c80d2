"""Distances, costs, rules and link texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
GAP_SPEED, DEFAULT_SPEED, ZERO_SPEED, PASSENGER_CATEGORY = 120, 100, 80, 60
OP_TYPES = {"station": 10, "small station": 20, "passenger terminal": 30, "freight terminal": 40, "depot or workshop": 50, "train technical services": 60, "passenger stop": 70, "junction": 80, "border point": 90, "shunting yard": 100, "technical change": 110, "switch": 120, "private siding": 130, "domestic border point": 140}
EARTH_KM = 6371.0


def half_even(value: Column, digits: int) -> Column:
    """Rounding to even at ties."""
    return F.rint(value * F.lit(10.0**digits)) / F.lit(10.0**digits)


def travel_time(length: Column, speed: Column) -> Column:
    return length / F.when(speed == 0, F.lit(ZERO_SPEED)).otherwise(speed)


def travel_cost(length: Column, speed: Column) -> Column:
    """10000 times the travel time, truncated, at least 1."""
    return F.greatest(F.floor(F.lit(10000.0) * travel_time(length, speed)).cast("long"), F.lit(1).cast("long"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def max_speed(tracks: Column) -> Column:
    """Of tracks array<struct<speed..>>: a missing speed, or no track, counts 100."""
    return F.coalesce(F.array_max(F.transform(tracks, lambda t: F.coalesce(t["speed"], F.lit(DEFAULT_SPEED)))), F.lit(DEFAULT_SPEED))


def min_radius(tracks: Column) -> Column:
    return F.coalesce(F.array_min(F.filter(F.transform(tracks, lambda t: t["radius"]), lambda r: r.isNotNull())), F.lit(0))


def is_passenger(tracks: Column) -> Column:
    """Any track without categories or with one of at most 60."""
    return F.exists(tracks, lambda t: (F.size(t["categories"]) == 0) | F.exists(t["categories"], lambda c: c <= PASSENGER_CATEGORY))


def is_electrified(tracks: Column, mode: str = "loader") -> Column:
    """All known contact systems are electric; true without any. mode: 'loader' compares, 'tool' searches."""
    known = F.filter(F.transform(tracks, lambda t: t["contact"]), lambda c: c.isNotNull())
    return F.forall(known, (lambda c: c != "Not electrified") if mode == "loader" else (lambda c: ~c.contains("not electrified")))


def is_walking(line: Column) -> Column:
    return line.startswith("99")


def station_rank(railway: Column) -> Column:
    return F.when(railway == "station", 0).when(railway == "halt", 1).when(railway == "stop", 2).otherwise(3)


def distance_rule(length: Column, distance: Column, radius: Column) -> Column:
    """Whether the distance of a section's ends fits its length."""
    percent = F.abs(length - distance) * 100 / length
    fits = (length > 4) | ((length < 1.5) & (percent < 16)) | (percent < 10)
    return fits | ~((radius > 1000) | (length < 1))


def valid_increase(percent: Column) -> Column:
    return percent < 20


def mo_node_name(op: Column, country: Column, line: Column) -> Column:
    return F.concat_ws("/", op, country, line)


def mo_node_parts(name: Column) -> Column:
    parts = F.split(name, "/")
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("op"), parts[1].alias("country"), parts[2].alias("line")))


def search_pattern(text: str) -> str:
    """Case-insensitive pattern in which lower-case l and o also find their Polish forms; quoted if it is no pattern."""
    import re

    wide = text.replace("l", "[lł]").replace("o", "[oó]")
    try:
        re.compile(wide)
    except re.error:
        wide = re.escape(text)
    return f"(?iu){wide}"


def route_url(points: Column) -> Column:
    """Planner link through ordered points array<struct<lat, lon>>; the map is centred on the middle one."""
    middle = F.try_element_at(points, (F.floor(F.size(points) / 2) + 1).cast("int"))
    stops = F.array_join(F.transform(points, lambda p: F.format_string("%.6f,%.6f", p["lon"], p["lat"])), ";")
    link = F.concat(F.lit("https://brouter.de/brouter-web/#map=10/"), F.format_string("%.6f/%.6f", middle["lat"], middle["lon"]), F.lit("/osm-mapnik-german_style&lonlats="), stops, F.lit("&profile=rail"))
    return F.when(F.size(points) > 0, link).otherwise("")


def poi_url(points: Column) -> Column:
    """As route_url with named points; blanks of names become %20."""
    middle = F.try_element_at(points, (F.floor(F.size(points) / 2) + 1).cast("int"))
    named = F.array_join(F.transform(points, lambda p: F.concat(F.format_string("%.6f,%.6f,", p["lon"], p["lat"]), F.replace(p["name"], F.lit(" "), F.lit("%20")))), ";")
    link = F.concat(F.lit("https://brouter.de/brouter-web/#map=10/"), F.format_string("%.6f/%.6f", middle["lat"], middle["lon"]), F.lit("/osm-mapnik-german_style&pois="), named, F.lit("&profile=rail"))
    return F.when(F.size(points) > 0, link).otherwise("")


def zoom(length_km: Column, near: bool = False) -> Column:
    """Map zoom for the length of a stretch; near: closer below 1 km."""
    wide = F.when(length_km < 5, 12).when(length_km < 20, 11).when(length_km < 50, 10).when(length_km < 100, 9).otherwise(8)
    return F.when(length_km < 1, 14).otherwise(wide) if near else wide


def center(low: Column, high: Column) -> Column:
    least = F.least(low, high)
    return F.abs(least + (F.greatest(low, high) - least) / 2)


# Addresses of map services, with {places} for numbers and texts.
PLACE_URL = "https://brouter.de/brouter-web/#map=13/{lat}/{lon}/osm-mapnik-german_style&pois={lon},{lat},{info}"
STRETCH_URL = "https://brouter.de/brouter-web/#map={zoom}/{mid_lat}/{mid_lon}/osm-mapnik-german_style&pois={lon},{lat};{lon2},{lat2}&profile=rail"
RAILWAY_MAP_URL = "https://www.openrailwaymap.org/?lang=en&lat={lat}&lon={lon}&zoom=14&style=standard"
OVERPASS_URL = 'https://overpass-turbo.eu/?Q=nw[railway~"stop|halt|station|signal_box"](around:1000,{lat},{lon});(._;>;);out;'
MAP_URL = "https://www.openstreetmap.org/#map=17/{lat}/{lon}"
GRAPH_URL = "https://graph.data.era.europa.eu/resource?uri={uri}&role=object"
TAG_URL = "https://taginfo.openstreetmap.org/tags/{tag}={value}"


def filled(address: str, **places: Column) -> Column:
    """An address with its places filled by columns."""
    import re

    parts = re.split(r"\{(\w+)\}", address)
    return F.concat(*[places[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def stretch(address: str, lat: Column, lon: Column, lat2: Column, lon2: Column, length_km: Column, near: bool = False, **more: Column) -> Column:
    """An address of a stretch between two places, centred between them."""
    return filled(address, lat=lat, lon=lon, lat2=lat2, lon2=lon2, mid_lat=center(lat, lat2), mid_lon=center(lon, lon2), zoom=zoom(length_km, near), **more)


def graph_url(uopid: Column) -> Column:
    """Address of an operational point in the knowledge graph; blanks are %20."""
    return filled(GRAPH_URL, uri=F.replace(F.url_encode(F.concat(F.lit("http://data.europa.eu/949/operationalPoint/"), uopid)), F.lit("+"), F.lit("%20")))
