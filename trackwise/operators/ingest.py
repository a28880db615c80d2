"""Query-result rows folded into records, and the local forms of the extraction queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as m


def fold_operational_points(rows: DataFrame) -> DataFrame:
    """rows (idx, uopid, name, rinf_type, country, lat, lon, line, km): the first row's scalars; distinct locations, the one first seen last in front."""
    first = rows.groupBy("uopid").agg(F.min_by(F.struct("name", "rinf_type", "country", "lat", "lon"), "idx").alias("first"))
    seen = rows.groupBy("uopid", "line", "km").agg(F.min("idx").alias("idx"))
    places = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("idx", "line", "km")))), lambda x: F.struct(x["line"].alias("line"), x["km"].alias("km")))
    return first.join(seen.groupBy("uopid").agg(places.alias("locations")), "uopid").select("uopid", "first.*", "locations")


def kilometre_of_line(rows: DataFrame) -> DataFrame:
    """km of each operational point on a line: of several, the one first seen last."""
    seen = rows.groupBy("uopid", "line", "km").agg(F.min("idx").alias("idx"))
    return seen.groupBy("uopid", "line").agg(F.max_by("km", "idx").alias("km"))


def fold_tracks(rows: DataFrame) -> DataFrame:
    """rows (idx, section, track, speed, radius, contact, category): tracks per section; categories are merged, the rest is the first row's."""
    tracks = rows.groupBy("section", "track").agg(
        F.min_by(F.struct(F.coalesce("speed", F.lit(m.DEFAULT_SPEED)).alias("speed"), "radius", "contact"), "idx").alias("first"),
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.min("idx").alias("idx"),
    )
    track = F.struct(F.col("track").alias("id"), F.col("first.speed").alias("speed"), F.col("first.radius").alias("radius"), F.col("first.contact").alias("contact"), "categories")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", track.alias("t")))), lambda x: x["t"])
    return tracks.groupBy("section").agg(ordered.alias("tracks"))


def fold_tunnels(rows: DataFrame, parsed: Column) -> DataFrame:
    """The first row of each tunnel name whose geometry can be parsed."""
    others = [c for c in rows.columns if c not in ("idx", "tunnel")]
    usable = rows.withColumn("geometry", parsed).where("geometry is not null")
    return usable.groupBy("tunnel").agg(F.min_by(F.struct("geometry", *others), "idx").alias("first")).select("tunnel", "first.*")


def sections_with_tracks(sections: DataFrame, tracks: DataFrame, passenger_only: bool = True) -> DataFrame:
    """Sections (idx, section, line, start, end, ...) that have tracks; of repeated ones the first; passenger lines only."""
    cols = [c for c in sections.columns if c not in ("idx", "section")]
    first = sections.groupBy("section").agg(F.min_by(F.struct(*cols), "idx").alias("s")).select("section", "s.*")
    out = first.join(tracks, "section")
    return out.where(m.is_passenger(F.col("tracks"))) if passenger_only else out


def currently_valid(rows: DataFrame, validity: DataFrame, key: str, now: Column) -> DataFrame:
    """Rows without a validity period, or inside one (both ends count)."""
    periods = validity.select(key, F.col("begin").alias("_begin"), F.col("end").alias("_end"))
    return rows.join(periods, key, "left").where(F.col("_begin").isNull() | now.between(F.col("_begin"), F.col("_end"))).drop("_begin", "_end").distinct()


def pattern(triples: DataFrame, predicate: str, name: str, subject: str = "s") -> DataFrame:
    """(subject, name): objects of a predicate."""
    return triples.where(F.col("p") == predicate).select(F.col("s").alias(subject), F.col("o").alias(name))


def basic_graph(triples: DataFrame, subject: str, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """A basic graph pattern around one subject, with OPTIONAL parts: inner and left joins of predicates, distinct."""
    out = None
    for name, predicate in required.items():
        part = pattern(triples, predicate, name, subject)
        out = part if out is None else out.join(part, subject)
    for name, predicate in (optional or {}).items():
        out = out.join(pattern(triples, predicate, name, subject), subject, "left")
    return out.distinct()


def minus(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(other, keys, "left_anti")


def tagged_union(parts: dict[str, DataFrame], column: str) -> DataFrame:
    """UNION of branches, each bound to its own tag."""
    out = None
    for tag, part in parts.items():
        part = part.withColumn(column, F.lit(tag))
        out = part if out is None else out.unionByName(part)
    return out.distinct()
