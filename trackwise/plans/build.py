"""The data sets of a folder as stages that can be asked for one by one and are skipped while nothing they read has changed.

A stage reads raw results or data sets of the folder and writes one data set. Beside it, stages/NAME.json says which
options and which versions of its inputs it was made from; the version of an input is its files' names, sizes and times.
The note is removed before a data set is written and made after, so a stage that was lost on its way is made again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network
from ..sources import files
from . import commands, search

_EDGE = "'Line', e.line, 'Country', e.country, 'MaxSpeed', e.speed, 'Electrified', e.electrified, 'StartKm', e.start_km, 'EndKm', e.end_km, 'Length', e.length"
ROUTES = ("osmWikipedia", "osmWikidata")


@dataclass(frozen=True)
class Job:
    """A folder and the options of its build."""

    spark: SparkSession
    folder: str
    countries: tuple[str, ...] | None = None
    by_locations: bool = True
    codec: str | None = None

    @property
    def codes(self) -> list[str] | None:
        return None if self.countries is None else list(self.countries)

    @property
    def sets(self) -> commands.Folder:
        return commands.Folder(self.spark, self.folder)

    def raw(self, name: str) -> str:
        return f"{self.folder}/sparql-{name}.json"

    def has(self, path: str) -> bool:
        return files.exists(self.spark, path)


@dataclass(frozen=True)
class Stage:
    """How a data set is made, from which raw results and data sets, and which options matter. ``needs``: inputs without which there is none."""

    make: Callable[[Job], DataFrame]
    raw: tuple[str, ...] = ()
    sets: tuple[str, ...] = ()
    options: tuple[str, ...] = ()
    needs: Callable[[Job], bool] = field(default=lambda job: True)
    after: Callable[[Job], None] = field(default=lambda job: None)

    def inputs(self, job: Job) -> list[str]:
        return [job.raw(r) for r in self.raw] + [f"{job.folder}/{s}.json" for s in self.sets]


def operational_points(job: Job) -> DataFrame:
    ops, places = commands.load_operational_points(job.spark, job.raw("operationalPoints"), job.codes)
    listed = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("idx", "line", "km")))), lambda x: F.struct(x["line"].alias("NationalIdentNum"), x["km"].alias("Kilometer")))
    near = places.groupBy(F.col("op").alias("uopid")).agg(listed.alias("RailwayLocations"))
    return ops.join(near, "uopid", "left").selectExpr("name as Name", "cast(rinf_type as string) as Type", "country as Country", "uopid as UOPID", "lat as Latitude", "lon as Longitude", "RailwayLocations")


def sections(job: Job) -> DataFrame:
    found = commands.load_sections(job.spark, job.raw("sectionsOfLine"), commands.load_tracks(job.spark, job.raw("tracks")), job.codes)
    tracks = "transform(tracks, t -> named_struct('id', t.id, 'sectionOfLine', section, 'maximumPermittedSpeed', t.speed, 'minimumHorizontalRadius', t.radius, 'contactLineSystem', t.contact, 'lineCategories', t.categories)) as Tracks"
    return found.selectExpr("section as Name", "country as Country", "length as Length", "line as LineIdentification", "start_op as StartOP", "end_op as EndOP", tracks)


def tunnels(job: Job) -> DataFrame:
    found = commands.load_tunnels(job.spark, job.raw("tunnel"), job.codes)
    return found.selectExpr("tunnel as Name", "country as Country", "length as Length", "line as LineIdentification", "start_lat as StartLatitude", "start_lon as StartLongitude", "start_km as StartKm", "end_lat as EndLatitude", "end_lon as EndLongitude", "end_km as EndKm")


def op_infos(job: Job) -> DataFrame:
    return job.sets.read("OperationalPoints").selectExpr("UOPID", "Name", "cast(Type as int) as RinfType", "Latitude", "Longitude")


def tunnel_infos(job: Job) -> DataFrame:
    found = network.tunnel_infos(job.sets.read("Tunnels").withColumnRenamed("Length", "length"))
    return found.selectExpr("Name as Tunnel", "length as Length", "StartLongitude as StartLong", "StartLatitude as StartLat", "StartKm", "EndLongitude as EndLong", "EndLatitude as EndLat", "EndKm", "LineIdentification as Line", "Country")


def graph(job: Job) -> DataFrame:
    edges = commands.graph(job.sets.places(), job.sets.sections(), job.by_locations)
    return network.adjacency(edges).selectExpr("node as Node", f"transform(edges, e -> named_struct('Node', e.dst, 'Cost', e.cost, {_EDGE})) as Edges")


def multi_criteria_graph(job: Job) -> DataFrame:
    return search.mo_graph(job.sets.edges()).selectExpr("node as Node", f"transform(edges, e -> named_struct('Node', e.head, 'LineCost', e.line_cost, 'DistanceCost', e.distance_cost, {_EDGE})) as Edges")


def line_infos(job: Job) -> DataFrame:
    """Lines with their tunnels and articles: of raw routes in their order, else of the data set by url and article."""
    lines = network.line_tunnels(network.line_infos(job.sets.edges(), job.sets.ops()), job.sets.tunnels())
    known = None
    if _has_routes(job):
        known = commands.load_osm_routes(job.spark, [job.raw(r) for r in ROUTES]).select("idx", F.col("Ref").alias("ref"), F.col("Wikipedia").alias("wikipedia"))
    elif job.has(f"{job.folder}/OsmRoutes.json"):
        known = job.sets.read("OsmRoutes").select(F.struct("Url", "Wikipedia").alias("idx"), F.col("Ref").alias("ref"), F.col("Wikipedia").alias("wikipedia"))
    lines = lines.withColumn("wikipedia", F.lit(None).cast("string")) if known is None else network.line_wikipedia(lines, known)
    return lines.selectExpr("line as Line", "country as Country", "name as Name", "length as Length", "start_km as StartKm", "end_km as EndKm", "uopids as UOPIDs", "tunnels as Tunnels", "wikipedia as Wikipedia")


def metadata(job: Job) -> DataFrame:
    """The countries asked for, or those of the points (a row each)."""
    seen = job.codes if job.codes is not None else sorted(r[0] for r in job.sets.read("OperationalPoints").where("Country is not null").select("Country").distinct().collect())
    return files.metadata(job.spark, commands.ENDPOINT, commands.ONTOLOGY, commands.REVISION, seen)


def _titled(load: Callable[[SparkSession, str], DataFrame], raw: str, job: Job) -> DataFrame:
    found = load(job.spark, job.raw(raw))
    return found.toDF(*[c[0].upper() + c[1:] for c in found.columns])


def _has_routes(job: Job) -> bool:
    return any(job.has(job.raw(r)) for r in ROUTES)


def _optional(raw: str, load: Callable[[SparkSession, str], DataFrame]) -> Stage:
    return Stage(partial(_titled, load, raw), raw=(raw,), needs=lambda job: job.has(job.raw(raw)))


#: data sets in an order in which each comes after what it reads
STAGES = {
    "Countries": _optional("countries", commands.load_countries),
    "OpTypes": _optional("opTypes", commands.load_op_types),
    "OsmEntries": _optional("osm", commands.load_osm_entries),
    "OsmRoutes": Stage(lambda job: commands.load_osm_routes(job.spark, [job.raw(r) for r in ROUTES]).select("Url", "Ref", "Wikipedia"), raw=ROUTES, needs=_has_routes),
    "OperationalPoints": Stage(operational_points, raw=("operationalPoints",), options=("countries",)),
    "SectionsOfLines": Stage(sections, raw=("sectionsOfLine", "tracks"), options=("countries",)),
    "Tunnels": Stage(tunnels, raw=("tunnel",), options=("countries",)),
    "Metadata": Stage(metadata, sets=("OperationalPoints",), options=("countries",)),
    "OpInfos": Stage(op_infos, sets=("OperationalPoints",)),
    "TunnelInfos": Stage(tunnel_infos, sets=("Tunnels",)),
    "Graph": Stage(graph, sets=("OperationalPoints", "SectionsOfLines"), options=("by_locations",)),
    "LineInfos": Stage(line_infos, raw=ROUTES, sets=("Graph", "OpInfos", "TunnelInfos", "OsmRoutes")),
    "MoGraph": Stage(multi_criteria_graph, sets=("Graph",), after=lambda job: job.sets.write_multi_criteria_graph()),
}
#: data sets of map data
MAP_DATA = ("OsmEntries", "OsmRoutes")


def version(spark: SparkSession, path: str) -> str | None:
    """Of a file or folder: a digest of its files' names, sizes and times; null if there is none."""
    system, at = files.file_system(spark, path)
    if not system.exists(at):
        return None
    listed, found = system.listFiles(at, True), []
    while listed.hasNext():
        f = listed.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def _note(job: Job, name: str) -> str:
    return f"{job.folder}/stages/{name}.json"


def _wanted(job: Job, name: str) -> dict:
    """What a stage's note says if it is made now."""
    stage = STAGES[name]
    return {"options": {o: getattr(job, o) for o in stage.options}, "inputs": {path: version(job.spark, path) for path in stage.inputs(job)}}


def _current(job: Job, name: str, wanted: dict) -> bool:
    if not (job.has(_note(job, name)) and job.has(f"{job.folder}/{name}.json/_SUCCESS")):
        return False
    text = job.spark.read.option("wholetext", True).text(_note(job, name)).first()
    return text is not None and json.loads(text[0]) == json.loads(json.dumps(wanted))


def _write_note(job: Job, name: str, wanted: dict) -> None:
    system, at = files.file_system(job.spark, _note(job, name))
    out = system.create(at, True)
    out.write(bytearray(json.dumps(wanted).encode()))
    out.close()


def build_all(spark: SparkSession, folder: str, countries: str = "", by_locations: bool = True, use_cache: bool = False, skip_osm: bool = False, only: str = "", codec: str | None = None) -> dict[str, str]:
    """Data sets of a folder, from its raw results sparql-{operationalPoints,tracks,sectionsOfLine,tunnel}.json; what became of each.

    countries: codes joined by semicolons; all if empty. Where there are raw results of map stations (osm), map routes
    (osmWikipedia, osmWikidata), countries or types of points, their data sets are made as well ("absent" otherwise).
    use_cache: stages whose inputs and options haven't changed are "kept". skip_osm: stations and routes of the map stay as they are.
    only: names of stages joined by semicolons; they read the data sets as they are.
    codec: how files of data sets are compressed (gzip), not at all without.
    """
    codes = files.checked_countries(countries) if countries else None
    names = only.split(";") if only else list(STAGES)
    if unknown := [n for n in names if n not in STAGES]:
        raise ValueError(f"unknown stages {unknown}, there are {list(STAGES)}")
    job = Job(spark, folder, None if codes is None else tuple(codes), by_locations, codec)
    out = {}
    for name in (n for n in STAGES if n in names):
        stage = STAGES[name]
        if skip_osm and name in MAP_DATA:
            out[name] = "skipped"
        elif not stage.needs(job):
            out[name] = "absent"
        else:
            wanted = _wanted(job, name)
            if use_cache and _current(job, name, wanted):
                out[name] = "kept"
                continue
            files.remove(spark, _note(job, name))
            # the tables of a stage aren't needed once its data set is there
            with files.scratch(spark):
                files.write_dataset(stage.make(job), folder, name, codec)
                stage.after(job)
            _write_note(job, name, wanted)
            out[name] = "built"
    return out
