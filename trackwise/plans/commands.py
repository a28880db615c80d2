"""The engine's commands: raw query results -> records -> network tables, and questions over a folder of data sets.

A folder holds JSON data sets, either one array in a file or a folder of JSON lines as this engine writes them.
Each command takes and returns DataFrames; ``python -m trackwise`` shows the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decode
from ..functions import measures as m
from ..operators import ingest, matching, network, paths
from ..sources import files
from . import search

# Where the data come from.
ENDPOINT, ONTOLOGY, REVISION = "https://data-interop.era.europa.eu/endpoint", "https://data-interop.era.europa.eu/era-vocabulary", "v3.2.0"
#: types that listings of places leave out: private sidings and depots
EXCLUDED = (m.OP_TYPES["private siding"], m.OP_TYPES["depot or workshop"])


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """Bindings with idx, their place in the input."""
    return files.read_bindings(spark, path).select(F.struct("page", "file", "binding_idx").alias("idx"), "b")


def _term(name: str, part: str = "value") -> Column:
    return F.try_element_at("b", F.lit(name))[part]


def _text(name: str) -> Column:
    return decode.literal(_term(name, "type"), _term(name))


def _int(name: str) -> Column:
    """Null where the variable isn't bound."""
    return F.when(_term(name).isNotNull(), decode.typed_int(_term(name, "type"), _term(name, "datatype"), _term(name)))


def _double(name: str) -> Column:
    return F.when(_term(name).isNotNull(), decode.typed_double(_term(name, "type"), _term(name, "datatype"), _term(name)))


def _country() -> Column:
    return decode.uri_tail(_term("country"), decode.COUNTRY_PREFIXES)


def _in(rows: DataFrame, countries: list[str] | None) -> DataFrame:
    """Rows of the countries; all without a list."""
    return rows if countries is None else rows.where(F.col("country").isin(countries))


def load_countries(spark: SparkSession, path: str) -> DataFrame:
    """(code, label) of raw results."""
    return _rows(spark, path).select(_country().alias("code"), _text("label").alias("label")).distinct()


def load_op_types(spark: SparkSession, path: str) -> DataFrame:
    """(label, definition, value) of raw results, in the order of the numbers as texts."""
    rows = _rows(spark, path).select(_text("l").alias("label"), _text("d").alias("definition"), _text("n").alias("n")).distinct()
    return rows.orderBy("n").select("label", "definition", F.col("n").cast("int").alias("value"))


def load_osm_entries(spark: SparkSession, path: str) -> DataFrame:
    """Map stations of raw results, with the columns of OsmEntries."""
    optional = lambda name: F.when(_term(name).isNotNull(), _text(name))
    return _rows(spark, path).select(
        decode.uri_tail(_term("id"), decode.OSM_PREFIXES).alias("Url"), _text("name").alias("Name"), _text("railway").alias("Railway"), optional("railway_prefix").alias("RailwayPrefix"), _text("railway_ref").alias("RailwayRef"),
        optional("uic_ref").alias("UicRef"), optional("operator").alias("Operator"), _double("lat").alias("Latitude"), _double("lng").alias("Longitude"), decode.uri_tail(_term("type"), decode.OSM_PREFIXES).alias("OsmType"),
    )


def load_osm_routes(spark: SparkSession, paths_: list[str]) -> DataFrame:
    """(idx, Url, Ref, Wikipedia) of the raw results that exist, one source after the other."""
    out = spark.createDataFrame([], "idx struct<source: int, page: bigint, file: string, binding_idx: int>, Url string, Ref string, Wikipedia string")
    for i, path in enumerate(paths_):
        if files.exists(spark, path):
            rows = files.read_bindings(spark, path)
            out = out.union(rows.select(F.struct(F.lit(i), "page", "file", "binding_idx"), _term("id"), _term("ref"), decode.wikipedia_title(_term("wikipedia"))))
    return out


def load_rows_of_routes(spark: SparkSession, path: str) -> DataFrame:
    """(Url, Ref, Wikipedia) of a document {"query": text, "res": [[url, ref, wikipedia], ...]}."""
    raw = spark.read.schema("query string, res array<array<string>>").option("multiLine", True).json(path).select(F.explode("res").alias("r"))
    return raw.select(F.col("r")[0].alias("Url"), F.col("r")[1].alias("Ref"), F.col("r")[2].alias("Wikipedia"))


def load_operational_points(spark: SparkSession, path: str, countries: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(operational points, their locations with idx) of raw results; coordinates fall back to the point geometry and must exist.

    The rows are written once: points and locations would each parse the documents for several aggregates.
    """
    point = decode.wkt_point(_term("wkt"))
    need = lambda c: F.coalesce(c, F.raise_error(F.lit("no coordinates")).cast("double"))
    rows = _rows(spark, path).select(
        "idx", _text("uopid").alias("uopid"), _text("opName").alias("name"), decode.type_number(decode.uri_tail(_term("opType"), decode.TYPE_PREFIXES)).alias("rinf_type"), _country().alias("country"),
        need(F.coalesce(_double("lat"), point["lat"])).alias("lat"), need(F.coalesce(_double("lon"), point["lon"])).alias("lon"), _text("lineId").alias("line"), decode.kilometre(_double("kilometer"), _double("offset")).alias("km"),
    )
    ops = ingest.fold_operational_points(files.cut(_in(rows, countries)))
    places = ops.select("country", F.col("uopid").alias("op"), F.posexplode("locations").alias("at", "l"))
    return ops.drop("locations"), places.select("country", "l.line", "op", "l.km", (-F.col("at")).alias("idx"))


def load_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(section, tracks) of raw results."""
    category = F.when(_term("lineCategory").isNotNull(), decode.line_category(_term("lineCategory")))
    contact = F.when(_term("contactLineSystemTypeLabel").isNotNull(), _text("contactLineSystemTypeLabel"))
    rows = _rows(spark, path).select(
        "idx", decode.uri_tail(_term("sectionOfLine"), decode.SECTION_PREFIXES).alias("section"), decode.uri_tail(_term("track"), decode.TRACK_PREFIXES).alias("track"),
        _int("maximumPermittedSpeed").alias("speed"), _int("minimumHorizontalRadius").alias("radius"), contact.alias("contact"), category.alias("category"),
    )
    return ingest.fold_tracks(rows)


def load_sections(spark: SparkSession, path: str, tracks: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """Sections of passenger lines with their tracks."""
    rows = _rows(spark, path).select(
        "idx", decode.uri_tail(_term("sectionOfLine"), decode.SECTION_PREFIXES).alias("section"), _country().alias("country"), _text("lineId").alias("line"),
        _text("startUopid").alias("start_op"), _text("endUopid").alias("end_op"), _double("length").alias("length"),
    )
    return ingest.sections_with_tracks(_in(rows, countries), tracks)


def load_tunnels(spark: SparkSession, path: str, countries: list[str] | None = None) -> DataFrame:
    """Tunnels by name, lengths in m, of the first row whose geometry can be parsed."""
    rows = _rows(spark, path).select(
        "idx", _text("tunnelIdentification").alias("tunnel"), _country().alias("country"), _text("lineId").alias("line"), _double("length").alias("length"),
        decode.kilometre(_double("startsAtKilometer"), _double("startsAtOffset")).alias("start_km"), decode.kilometre(_double("endsAtKilometer"), _double("endsAtOffset")).alias("end_km"), _term("wkt").alias("wkt"),
    )
    return ingest.fold_tunnels(_in(rows, countries), decode.wkt_line(F.col("wkt"))).drop("wkt").select("*", "geometry.*").drop("geometry")


def graph(places: DataFrame, sections: DataFrame, by_locations: bool = True) -> DataFrame:
    """Edges in both directions, by neighbours on lines or by sections."""
    return network.both_directions(network.graph_by_locations(places, sections) if by_locations else network.graph_by_sections(sections, places))


class Folder:
    """Questions over the data sets of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return files.read_dataset(self.spark, self.folder, name)

    def ops(self) -> DataFrame:
        return self.read("OpInfos").selectExpr("UOPID as uopid", "Name as name", "RinfType as rinf_type", "Latitude as lat", "Longitude as lon")

    def places(self) -> DataFrame:
        return self.read("OperationalPoints").selectExpr("Country as country", "UOPID as op", "posexplode(RailwayLocations) as (at, l)").selectExpr("country", "l.NationalIdentNum as line", "op", "l.Kilometer as km", "-at as idx")

    def sections(self) -> DataFrame:
        tracks = "transform(Tracks, t -> named_struct('id', t.id, 'speed', t.maximumPermittedSpeed, 'radius', t.minimumHorizontalRadius, 'contact', t.contactLineSystem, 'categories', t.lineCategories)) as tracks"
        return self.read("SectionsOfLines").selectExpr("Name as section", "Country as country", "LineIdentification as line", "StartOP as start_op", "EndOP as end_op", "Length as length", tracks)

    def edges(self) -> DataFrame:
        flat = self.read("Graph").selectExpr("Node as src", "inline(Edges)")
        return flat.selectExpr("src", "Node as dst", "Line as line", "Country as country", "cast(Cost as bigint) as cost", "Length as length", "MaxSpeed as speed", "Electrified as electrified", "StartKm as start_km", "EndKm as end_km")

    def ops_of_line(self, country: str, line: str) -> DataFrame:
        return network.ops_of_line(self.places(), self.ops(), country, line).orderBy("km", "op")

    def sections_of_line(self, country: str, line: str) -> DataFrame:
        return network.sections_of_line(self.sections(), self.places(), country, line).orderBy("start_km", "section")

    def electrified(self) -> DataFrame:
        return network.electrified_length(self.sections())

    def check_locations(self) -> DataFrame:
        return network.consistency(self.places(), self.edges())

    def lines(self) -> DataFrame:
        return self.read("LineInfos").selectExpr("Line as line", "Country as country", "Name as name", "StartKm as start_km", "EndKm as end_km", "UOPIDs as uopids", "Tunnels as tunnels", "Wikipedia as wikipedia")

    def tunnels(self) -> DataFrame:
        return self.read("TunnelInfos").selectExpr("Tunnel as tunnel", "Country as country", "Line as line", "Length as length", "StartKm as start_km", "EndKm as end_km")

    def path_of_line(self, country: str, line: str) -> DataFrame:
        """The route through the points of a line, on its own edges, with running totals."""
        own = self.lines().where((F.col("country") == country) & (F.col("line") == line))
        return paths.running_totals(search.paths_of_lines(network.sub_graph(self.edges(), country, line), own)).orderBy("seq")

    def line_view(self, country: str, line: str) -> DataFrame:
        """path_of_line with rows for gaps."""
        own = self.lines().where((F.col("country") == country) & (F.col("line") == line))
        return paths.gap_rows(search.paths_of_lines(network.sub_graph(self.edges(), country, line), own)).orderBy("seq")

    def tunnels_of_line(self, country: str, line: str) -> DataFrame:
        """Tunnels by start kilometre, with the running total of their lengths."""
        return network.tunnels_of_line(self.tunnels(), country, line).withColumn("total_length", F.sum("length").over(Window.partitionBy("line").orderBy("start_km", "tunnel"))).orderBy("start_km", "tunnel")

    def places_url(self, country: str, line: str) -> DataFrame:
        """A planner link to the points of a line."""
        points = F.transform(F.array_sort(F.collect_list(F.struct("km", "op", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), p["op"].alias("name")))
        return network.ops_of_line(self.places(), self.ops(), country, line).agg(m.poi_url(points).alias("url"))

    def route(self, waypoints: str, max_speed: bool = False) -> DataFrame:
        """The compacted route by way of the points A;B;C, with running totals; with the speeds on its lines, if asked."""
        found = self._route(waypoints)
        return paths.running_totals(search.speed_profile(found, self.edges()) if max_speed else paths.compact(found)).orderBy("seq")

    def printed_route(self, waypoints: str) -> DataFrame:
        return paths.printed(self._route(waypoints)).orderBy("seq")

    def route_elements(self, waypoints: str) -> DataFrame:
        """The route with the names of points and lines."""
        return paths.path_elements(self._route(waypoints), self.ops(), self.lines()).orderBy("seq")

    def route_urls(self, waypoints: str) -> DataFrame:
        return paths.route_urls(paths.locations(self._route(waypoints), self.ops(), EXCLUDED))

    def path_view(self, source: str, target: str, percent: float = 0.0) -> DataFrame:
        """Of the routes that are best in changes of line or cost, the one for a tolerance, compacted with running totals."""
        legs = files.cut(self.pareto_routes(source, target, None))
        front = legs.select(F.lit("q").alias("question"), "sol", F.col("total_cost").alias("cost")).distinct()
        chosen = search.choose_solution(front, percent).select("sol")
        return paths.running_totals(legs.join(chosen, "sol").withColumn("path", F.col("sol"))).orderBy("seq")

    def graph_stats(self) -> DataFrame:
        """Edges, nodes, connection, form and highest degree of each line."""
        return network.line_statistics(network.undirected(self.edges().where("start_km < end_km"))).orderBy("line")

    def degrees(self) -> DataFrame:
        return network.degree_histogram(network.undirected(self.edges().where("start_km < end_km"))).orderBy("degree")

    def _route(self, waypoints: str) -> DataFrame:
        ask = self.spark.range(1).select(F.lit("route").alias("path"), F.split(F.lit(waypoints), ";").alias("waypoints"))
        return search.shortest_paths(self.edges(), ask)

    def pareto_routes(self, source: str, target: str, most: int | None = 5) -> DataFrame:
        """(sol, line_cost, cost, seq, ...): compacted routes, none worse than another in changes of line and in cost; the first ``most`` of them, or all (None)."""
        edges = self.edges()
        found = files.cut(search.pareto_routes(edges, self.spark.range(1).select(F.lit(source).alias("source"), F.lit(target).alias("target")), most))
        legs = search.route_legs(found, edges).drop("source", "target")
        return legs.join(found.select("sol", F.col("costs")[0].alias("total_line_cost"), F.col("costs")[1].alias("total_cost")), "sol").orderBy("sol", "seq")

    def osm_compare(self, country_prefix: str = "DE", types: tuple[int, ...] = (m.OP_TYPES["station"], m.OP_TYPES["passenger stop"])) -> DataFrame:
        """Stations and stops of a country that have edges, with the map stations that match them."""
        ops = matching.with_edges(self.ops().where(F.col("uopid").startswith(country_prefix) & F.col("rinf_type").isin(*types)), self.edges())
        stations = self.read("OsmEntries").selectExpr("Url as url", "Railway as railway", "RailwayPrefix as prefix", "RailwayRef as code", "Latitude as lat", "Longitude as lon")
        return matching.match_stations(ops, stations).orderBy("uopid")

    def osm_matchings(self) -> DataFrame:
        """osm_compare with the columns of RInfOsmMatchings; written to the folder."""
        found = files.cut(self.osm_compare().selectExpr("uopid as UOPID", "url as OsmUrl", "railway as OsmRailwayTag", "prefix as OsmRailwayTagPrefix", "distance as Distance", "lat as Latitude", "lon as Longitude"))
        files.write_dataset(found, self.folder, "RInfOsmMatchings")
        return found

    def osm_report(self) -> DataFrame:
        """Points without a valid match, by name, with links and others in the same place."""
        matches = self.osm_compare()
        valid = matches.where(F.col("distance") < matching.VALID_KM).select("uopid")
        lone = self.ops().join(matches.select("uopid"), "uopid", "left_semi").join(valid, "uopid", "left_anti")
        same = matching.same_location(self.ops()).groupBy("uopid").agg(F.min("other").alias("same_location"))
        lat, lon = F.col("lat"), F.col("lon")
        urls = {"graph_url": m.graph_url(F.col("uopid")), "place_url": m.filled(m.PLACE_URL, lat=lat, lon=lon, info=F.col("uopid")), "railway_url": m.filled(m.RAILWAY_MAP_URL, lat=lat, lon=lon), "map_url": m.filled(m.MAP_URL, lat=lat, lon=lon), "overpass_url": m.filled(m.OVERPASS_URL, lat=lat, lon=lon)}
        return lone.join(same, "uopid", "left").withColumns(urls).orderBy("name", "uopid")

    def check_sections(self) -> DataFrame:
        """Points whose place is moved to their match so that sections fit."""
        matches = self.read("RInfOsmMatchings").selectExpr("UOPID as uopid", "Latitude as lat", "Longitude as lon")
        return matching.sequential_check(self.sections(), self.ops(), matches).orderBy("line", "section")

    def op_info_changes(self, line: str = "", change: bool = False) -> DataFrame:
        """Moved points of all sections, or of a line's, by name; written to OpInfoChanges. With ``change`` OpInfos takes them and stations are matched again."""
        sections = self.sections().where(F.col("line") == line) if line else self.sections()
        ops, matches = self.ops(), self.read("RInfOsmMatchings").selectExpr("UOPID as uopid", "Latitude as lat", "Longitude as lon")
        found = files.cut(matching.op_info_changes(sections, ops, matches))
        renamed = found.orderBy("name", "uopid").selectExpr("uopid as UOPID", "lat as Latitude", "lon as Longitude", "new_lat as NewLatitude", "new_lon as NewLongitude", "distance as Distance", "percent as Percent")
        files.write_dataset(renamed, self.folder, "OpInfoChanges")
        if change and not found.isEmpty():
            moved = files.cut(matching.with_changes(ops, found))
            files.write_dataset(moved.selectExpr("uopid as UOPID", "name as Name", "rinf_type as RinfType", "lat as Latitude", "lon as Longitude"), self.folder, "OpInfos")
            self.osm_matchings()
        return renamed

    def search(self, name: str = "", uopid: str = "") -> DataFrame:
        return matching.search_locations(self.ops(), name, uopid).orderBy("name", "uopid")

    def write_multi_criteria_graph(self) -> None:
        """MoGraph.gr: the line-change arcs as a graph text."""
        files.write_gr(search.dense_arcs(search.expand(self.edges())), f"{self.folder}/MoGraph.gr")

    def pareto_gr(self, source: int, target: int, most: int | None = 1000) -> DataFrame:
        """The first ``most`` solutions (None: all) between two nodes of MoGraph.gr."""
        return search.search_gr(self.spark, f"{self.folder}/MoGraph.gr", source, target, most).orderBy("sol", "seq")
