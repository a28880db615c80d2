"""Matching of operational points to map stations, and geometry checks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decode
from ..functions import measures as m
from ..sources.files import cut
from .network import components

MATCH_KM, VALID_KM, MOVED_KM = 4.0, 1.0, 0.2


def match_stations(ops: DataFrame, stations: DataFrame) -> DataFrame:
    """The best station of each point: equal code and closer than 4 km, by rank of its kind, then its url. Points without one stay."""
    coded = stations.withColumn("uopid", F.explode(F.array_distinct(decode.station_uopids(F.col("code")))))
    near = ops.select("uopid", F.col("lat").alias("op_lat"), F.col("lon").alias("op_lon")).join(coded, "uopid")
    near = near.withColumn("distance", m.haversine(F.col("op_lat"), F.col("op_lon"), F.col("lat"), F.col("lon"))).where(F.col("distance") < MATCH_KM)
    best = near.groupBy("uopid").agg(F.min_by(F.struct("url", "railway", "prefix", m.half_even(F.col("distance"), 3).alias("distance"), "lat", "lon"), F.struct(m.station_rank(F.col("railway")), "url")).alias("s"))
    return ops.select("uopid", "rinf_type").join(best, "uopid", "left").select("uopid", "rinf_type", F.col("s.url").alias("url"), F.col("s.railway").alias("railway"), F.col("s.prefix").alias("prefix"), F.col("s.distance").alias("distance"), F.col("s.lat").alias("lat"), F.col("s.lon").alias("lon"))


def with_edges(ops: DataFrame, edges: DataFrame) -> DataFrame:
    return ops.join(edges.select(F.col("src").alias("uopid")).distinct(), "uopid", "left_semi")


def match_summary(matches: DataFrame) -> DataFrame:
    """total, found, not found and valid matches."""
    found = F.col("url").isNotNull()
    return matches.agg(F.count("*").alias("total"), F.count_if(found).alias("found"), F.count_if(~found).alias("not_found"), F.count_if(found & (F.col("distance") < VALID_KM)).alias("valid"))


def tag_usage(matches: DataFrame) -> DataFrame:
    return matches.where("url is not null").groupBy("railway", "prefix").agg(F.count("*").alias("n"))


def counts_by_type(matches: DataFrame) -> DataFrame:
    return matches.groupBy("rinf_type").agg(F.count("*").alias("n"), F.count_if(F.col("url").isNull()).alias("not_found"))


def counts_by_tag(matches: DataFrame, stations: DataFrame) -> DataFrame:
    """Matched points by kind of map element and railway tag, with subtotals (null tag)."""
    kinds = stations.groupBy("url").agg(F.min("osm_type").alias("osm_type"))
    return matches.where("url is not null").join(kinds, "url").rollup("osm_type", "railway").agg(F.count("*").alias("n")).where("osm_type is not null")


def section_check(sections: DataFrame, ops: DataFrame, matches: DataFrame) -> DataFrame:
    """Sections whose ends lie too far apart or too close, and the change of an end to its match that would mend it.

    The start is tried if it has a match, else the end; a change counts if the point
    moves more than 0.2 km and the new distance fits, off by less than 20 percent.
    """
    side = lambda p: ops.select(F.col("uopid").alias(f"{p}_op"), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    new = lambda p: matches.where("lat is not null").select(F.col("uopid").alias(f"{p}_op"), F.col("lat").alias(f"{p}_mlat"), F.col("lon").alias(f"{p}_mlon"))
    s = sections.join(side("start"), "start_op").join(side("end"), "end_op").join(new("start"), "start_op", "left").join(new("end"), "end_op", "left")
    c = F.col
    s = s.withColumn("distance", m.haversine(c("start_lat"), c("start_lon"), c("end_lat"), c("end_lon")))
    s = s.withColumn("valid", m.distance_rule(c("length"), c("distance"), m.min_radius(c("tracks"))))
    at_start = c("start_mlat").isNotNull()
    moved = F.when(at_start, m.haversine(c("start_lat"), c("start_lon"), c("start_mlat"), c("start_mlon"))).when(c("end_mlat").isNotNull(), m.haversine(c("end_lat"), c("end_lon"), c("end_mlat"), c("end_mlon")))
    after = F.when(at_start, m.haversine(c("start_mlat"), c("start_mlon"), c("end_lat"), c("end_lon"))).when(c("end_mlat").isNotNull(), m.haversine(c("start_lat"), c("start_lon"), c("end_mlat"), c("end_mlon")))
    fits = m.distance_rule(c("length"), after, m.min_radius(c("tracks")))
    s = s.withColumns({"moved": moved, "fits": fits, "percent": F.abs(c("length") - after) * 100 / c("length"), "changed_op": F.when(at_start, c("start_op")).when(c("end_mlat").isNotNull(), c("end_op"))})
    change = ~c("valid") & c("fits") & (c("moved") > MOVED_KM) & m.valid_increase(c("percent"))
    return s.select("section", "length", m.half_even(c("distance"), 3).alias("distance"), "valid", F.when(change, c("changed_op")).alias("changed_op"), F.when(change, m.half_even(c("moved"), 3)).alias("moved"))


def _far(a: float, b: float, c: float, d: float) -> float:
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * m.EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def _fits(length: float, distance: float, radius: float) -> bool:
    off = abs(length - distance) * 100 / length
    return length > 4 or (length < 1.5 and off < 16) or off < 10 or not (radius > 1000 or length < 1)


def _mended(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sections in order of line, length and name; a point that was moved stays where it was moved to."""
    place: dict[str, tuple[float, float]] = {}
    out = []
    for r in pdf.sort_values(["line", "length", "section"]).itertuples():
        ends = {p: place.get(getattr(r, f"{p}_op"), (getattr(r, f"{p}_lat"), getattr(r, f"{p}_lon"))) for p in ("start", "end")}
        new, other = (r.new_lat, r.new_lon), ends["end" if r.side == "start" else "start"]
        after, moved = _far(*new, *other), _far(*ends[r.side], *new)
        percent, before = abs(r.length - after) * 100 / r.length, _far(*ends["start"], *ends["end"])
        if not _fits(r.length, before, r.radius) and _fits(r.length, after, r.radius) and percent < 20 and moved > MOVED_KM:
            place[r.target] = new
            out.append((r.line, r.section, r.target, round(moved, 3), float(round(abs(r.length - before) * 100 / r.length))))
    return pd.DataFrame(out, columns=["line", "section", "changed_op", "moved", "percent"])


def sequential_check(sections: DataFrame, ops: DataFrame, matches: DataFrame) -> DataFrame:
    """As section_check over the whole network in order of line, length and name, where a changed point keeps its new place for all that follow.

    A point can move once only, to its match. So only sections whose point to change (the start if it has a match, else the
    end) has a match more than 0.2 km away can change anything, and such sections depend on each other only through points
    that can move: each component of these is checked in order by one task. percent: how far the section was off before.
    """
    side = lambda p: ops.select(F.col("uopid").alias(f"{p}_op"), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    found = matches.where("lat is not null and lon is not null").select("uopid", F.col("lat").alias("new_lat"), F.col("lon").alias("new_lon"))
    new = lambda p: found.select(F.col("uopid").alias(f"{p}_op"), F.lit(True).alias(f"{p}_found"))
    rows = sections.withColumn("radius", m.min_radius(F.col("tracks"))).select("line", "section", "length", "radius", "start_op", "end_op")
    rows = rows.join(side("start"), "start_op").join(side("end"), "end_op").join(new("start"), "start_op", "left").join(new("end"), "end_op", "left")
    rows = rows.withColumn("side", F.when(F.col("start_found"), "start").when(F.col("end_found"), "end")).where("side is not null").drop("start_found", "end_found")
    rows = rows.withColumn("target", F.when(F.col("side") == "start", F.col("start_op")).otherwise(F.col("end_op"))).join(found.withColumnRenamed("uopid", "target"), "target")
    at = lambda c: F.when(F.col("side") == "start", F.col(f"start_{c}")).otherwise(F.col(f"end_{c}"))
    rows = cut(rows.where(m.haversine(at("lat"), at("lon"), F.col("new_lat"), F.col("new_lon")) > MOVED_KM))
    movable = rows.select("target").distinct()
    end = lambda p: movable.select(F.col("target").alias(f"{p}_op"))
    together = rows.join(end("start"), "start_op", "left_semi").join(end("end"), "end_op", "left_semi").select(F.col("start_op").alias("a"), F.col("end_op").alias("b"))
    groups = components(together).select(F.col("node").alias("target"), "component")
    rows = rows.join(groups, "target", "left").withColumn("component", F.coalesce("component", "target"))
    return rows.groupBy("component").applyInPandas(_mended, "line string, section string, changed_op string, moved double, percent double")


def op_info_changes(sections: DataFrame, ops: DataFrame, matches: DataFrame) -> DataFrame:
    """(uopid, name, lat, lon, new_lat, new_lon, distance, percent) of the points that sequential_check moves to their match; each moves once."""
    moved = sequential_check(sections, ops, matches).select(F.col("changed_op").alias("uopid"), F.col("moved").alias("distance"), "percent")
    place = matches.select("uopid", F.col("lat").alias("new_lat"), F.col("lon").alias("new_lon"))
    return ops.select("uopid", "name", "lat", "lon").join(moved, "uopid").join(place, "uopid").select("uopid", "name", "lat", "lon", "new_lat", "new_lon", "distance", "percent")


def with_changes(ops: DataFrame, changes: DataFrame) -> DataFrame:
    """ops with the new places of changed points."""
    out = ops.join(changes.select("uopid", "new_lat", "new_lon"), "uopid", "left")
    return out.withColumns({"lat": F.coalesce("new_lat", "lat"), "lon": F.coalesce("new_lon", "lon")}).select(*ops.columns)


def settled_points(sections: DataFrame, ops: DataFrame, stations: DataFrame, most_rounds: int = 20) -> tuple[DataFrame, list[int]]:
    """ops after rounds of matching, checking and moving points until none moves, and how many moved in each round.

    It is an error if points still move after ``most_rounds``.
    """
    ops, log = cut(ops), []
    while True:
        changes = cut(op_info_changes(sections, ops, match_stations(ops, stations)))
        log.append(changes.count())
        if not log[-1]:
            return ops, log
        if len(log) > most_rounds:
            raise RuntimeError(f"points still move after {most_rounds} rounds: {log}")
        ops = cut(with_changes(ops, changes))


def search_locations(ops: DataFrame, name: str = "", uopid: str = "") -> DataFrame:
    """By both (parts of each), by name (accent-tolerant pattern), by key (equal), or all."""
    if name and uopid:
        return ops.where(F.col("name").contains(name) & F.col("uopid").contains(uopid))
    if name:
        return ops.where(F.col("name").rlike(m.search_pattern(name)))
    return ops.where(F.col("uopid") == uopid) if uopid else ops


def same_location(ops: DataFrame) -> DataFrame:
    """Pairs of points with exactly the same coordinates."""
    other = ops.select(F.col("uopid").alias("other"), "lat", "lon")
    return ops.select("uopid", "lat", "lon").join(other, ["lat", "lon"]).where("uopid <> other").select("uopid", "other")


def named_matches(matches: DataFrame, ops: DataFrame, types: DataFrame) -> DataFrame:
    """Matches with the names of points and types; nothing if no row has a url."""
    listed = matches.join(ops.select("uopid", "name"), "uopid", "left").join(F.broadcast(types), "rinf_type", "left")
    any_url = matches.agg(F.count("url").alias("_n")).where("_n > 0").drop("_n").withColumn("_some", F.lit(1))
    return listed.crossJoin(F.broadcast(any_url)).drop("_some")


def top_ranked(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")
