"""Stations and routes from raw map data: statements (s, p, o) and which area contains what (area, s).

Each question reads the statements it needs once and groups them by subject; alternatives (UNION) are sets of one
subject's values, so nothing is joined with itself but the two steps to a geometry.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode
from ..functions.geometry import centroid
from ..operators import ingest
from ..sources import files

# Predicates of map data and of the second source.
KEY = "https://www.openstreetmap.org/wiki/Key:"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
HAS_GEOMETRY, AS_WKT = "http://www.opengis.net/ont/geosparql#hasGeometry", "http://www.opengis.net/ont/geosparql#asWKT"
WIKIDATA = "https://www.openstreetmap.org/wikidata"
ABOUT, PART_OF = "http://schema.org/about", "http://schema.org/isPartOf"
SITE = "https://de.wikipedia.org/"
# The areas of Germany and Switzerland.
GERMANY, SWITZERLAND = "https://www.openstreetmap.org/relation/51477", "https://www.openstreetmap.org/relation/51701"
# States of a railway that a key may start with.
STATES = ("disused", "proposed", "historic", "abandoned")

#: what a second source answers
ANSWER = "item string, article string"


def _inside(contains: DataFrame, areas: tuple[str, ...]) -> DataFrame:
    return contains.where(F.col("area").isin(*areas)).select("s").distinct()


def _values(*keys: str) -> Column:
    return F.collect_set(F.when(F.col("p").isin(*[KEY + k for k in keys]), F.col("o")))


def stations(triples: DataFrame, contains: DataFrame, areas: tuple[str, ...] = (GERMANY, SWITZERLAND)) -> DataFrame:
    """Rows of OsmEntries: each combination of a subject's names, railway values, codes, types and optional values, once.

    A subject needs a name, a type, a railway value (or one of a former or future railway, or a stop area), a code and a
    geometry; one whose centre can't be read has null coordinates.
    """
    p, o = F.col("p"), F.col("o")
    railway = F.when(p == KEY + "railway", F.struct(F.lit(None).cast("string").alias("prefix"), o.alias("value")))
    for state in STATES:
        railway = railway.when(p == f"{KEY}{state}:railway", F.struct(F.lit(state).alias("prefix"), o.alias("value")))
    railway = railway.when((p == KEY + "public_transport") & (o == "stop_area"), F.struct(F.lit(None).cast("string").alias("prefix"), o.alias("value")))
    shapes = ingest.pattern(triples, HAS_GEOMETRY, "g").join(ingest.pattern(triples, AS_WKT, "o", "g"), "g").select("s", F.lit(AS_WKT).alias("p"), "o")
    rows = triples.where((p == TYPE) | p.startswith(KEY)).select("s", "p", "o").unionByName(shapes).join(_inside(contains, areas), "s", "left_semi")
    found = rows.groupBy("s").agg(
        _values("name", "disused:name").alias("names"), F.collect_set(F.when(p == TYPE, o)).alias("types"), F.collect_set(railway).alias("railways"),
        _values("railway:ref", "railway:ref:DBAG", "disused:railway:ref").alias("codes"), _values("uic_ref").alias("uics"), _values("operator").alias("operators"), F.collect_set(F.when(p == AS_WKT, o)).alias("shapes"),
    )
    found = found.withColumn("centres", F.array_distinct(F.transform("shapes", centroid)))
    for one, many in (("name", "names"), ("type", "types"), ("r", "railways"), ("code", "codes"), ("at", "centres")):
        found = found.withColumn(one, F.explode(many))
    for one, many in (("uic", "uics"), ("operator", "operators")):
        found = found.withColumn(one, F.explode_outer(many))
    return found.select(
        decode.uri_tail(F.col("s"), decode.OSM_PREFIXES).alias("Url"), F.col("name").alias("Name"), F.col("r.value").alias("Railway"), F.col("r.prefix").alias("RailwayPrefix"), F.col("code").alias("RailwayRef"),
        F.col("uic").alias("UicRef"), F.col("operator").alias("Operator"), F.col("at.lat").alias("Latitude"), F.col("at.lon").alias("Longitude"), decode.uri_tail(F.col("type"), decode.OSM_PREFIXES).alias("OsmType"),
    )


def _track_routes(triples: DataFrame) -> DataFrame:
    """(s, refs, articles, items) of the routes over tracks that have a reference."""
    p, o = F.col("p"), F.col("o")
    keys = [KEY + k for k in ("type", "route", "ref", "wikipedia")]
    found = triples.where(p.isin(*keys, WIKIDATA)).groupBy("s").agg(
        F.bool_or((p == KEY + "type") & (o == "route")).alias("is_route"), F.bool_or((p == KEY + "route") & o.isin("tracks", "railway")).alias("on_tracks"),
        _values("ref").alias("refs"), _values("wikipedia").alias("articles"), F.collect_set(F.when(p == WIKIDATA, o)).alias("items"),
    )
    return found.where(F.col("is_route") & F.col("on_tracks") & (F.size("refs") > 0))


def routes_with_articles(triples: DataFrame, contains: DataFrame, areas: tuple[str, ...] = (GERMANY,)) -> DataFrame:
    """(Url, Ref, Wikipedia) of the routes inside the areas that name an article."""
    found = _track_routes(triples).join(_inside(contains, areas), "s", "left_semi")
    found = found.select(F.col("s").alias("Url"), "articles", F.explode("refs").alias("Ref")).withColumn("article", F.explode("articles"))
    return found.select("Url", "Ref", decode.wikipedia_title(F.col("article")).alias("Wikipedia"))


def articles_of(triples: DataFrame, site: str = SITE) -> Callable[[DataFrame], DataFrame]:
    """A second source over its own statements: for the keys (item) it is sent, (item, article) of a site.

    Keys go to the source, not its statements to the keys: the statements are filtered by a semi-join before anything else.
    """

    def ask(keys: DataFrame) -> DataFrame:
        about = ingest.pattern(triples, ABOUT, "item", "article").join(keys.select("item"), "item", "left_semi")
        on_site = triples.where((F.col("p") == PART_OF) & (F.col("o") == site)).select(F.col("s").alias("article"))
        return about.join(on_site, "article", "left_semi").select("item", "article").distinct()

    return ask


def routes_by_items(triples: DataFrame, service: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(Url, Ref, Wikipedia) of the routes that name no article but an item, by way of a second source (see ``articles_of``).

    The source is sent each item once, and its answer is written before it is used; where it fails there are no rows.
    Articles are told apart by title before they meet the routes, so only routes of several items can have one twice: the
    rows of the others, of which there are as many as routes and articles of an item together, aren't held to be compared.
    """
    left = files.cut(_track_routes(triples).where((F.size("articles") == 0) & (F.size("items") > 0)).select("s", "refs", "items"))
    keys = left.select(F.explode("items").alias("item")).distinct()
    answer = available(triples.sparkSession, lambda: service(keys).select("item", "article"), ANSWER)
    titles = answer.select("item", decode.wikipedia_title(F.col("article")).alias("Wikipedia")).distinct()
    by_item = left.select("s", "refs", F.size("items").alias("n"), F.explode("items").alias("item")).join(titles, "item")
    one, many = by_item.where("n = 1").select("s", "refs", "Wikipedia"), by_item.where("n > 1").select("s", "refs", "Wikipedia").distinct()
    return one.unionByName(many).select(F.col("s").alias("Url"), F.explode("refs").alias("Ref"), "Wikipedia")


def available(spark: SparkSession, load: Callable[[], DataFrame], schema: str) -> DataFrame:
    """The written rows of a source; no rows, and a warning, if it fails while it is asked."""
    try:
        return files.cut(load())
    except (PySparkException, Py4JJavaError, OSError) as error:
        logging.getLogger(__name__).warning("a source failed, its rows are missing: %s", str(error).split("\n")[0])
        return spark.createDataFrame([], schema)


def routes(triples: DataFrame, contains: DataFrame, service: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """(idx, Url, Ref, Wikipedia): routes that name an article in front, then those that have one by the second source, if it answers.

    most: rows taken of each, by url, reference and article; None for all.
    """
    out = None
    for number, rows in enumerate((routes_with_articles(triples, contains), routes_by_items(triples, service))):
        if most is not None:
            rows = rows.orderBy("Url", "Ref", "Wikipedia").limit(most)
        rows = rows.select(F.struct(F.lit(number).alias("source"), "Url", "Ref", "Wikipedia").alias("idx"), "Url", "Ref", "Wikipedia")
        out = rows if out is None else out.unionByName(rows)
    return out
