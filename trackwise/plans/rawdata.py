"""Raw query results of two countries, written as documents from the derived tables: what a build reads.

Points, sections and tunnels of the derived network are German; a part of each has a French twin under another key, so
that a build of one country has something to leave out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decode
from ..sources import files
from .build import STAGES, build_all
from .commands import Folder
from .derive import Derived

HOME, ABROAD = "DEU", "FRA"
#: pages of each result
PAGES = 16
#: about how many rows a document of a page has
DOCUMENT_ROWS = 10_000
#: how documents and data sets of a build are compressed: their texts repeat names and prefixes in each row
CODEC = "gzip"


def term(value: Column, kind: str = "literal", datatype: str | None = None) -> Column:
    out = [F.lit(kind).alias("type"), value.cast("string").alias("value")]
    return F.struct(*out, *([F.lit(datatype).alias("datatype")] if datatype else []))


def number(value: Column) -> Column:
    return term(value, datatype=decode.XSD + "double")


def whole(value: Column) -> Column:
    return term(value, datatype=decode.XSD + "integer")


def uri(prefix: str, value: Column) -> Column:
    return term(F.concat(F.lit(prefix), value.cast("string")), "uri")


def _bound(column: str, value: Column) -> Column:
    """Null, so not bound, where the column is null."""
    return F.when(F.col(column).isNotNull(), value)


def _page(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PAGES)).alias("page")


def _with_twins(rows: DataFrame, key: str, twin: Column, when: str) -> DataFrame:
    """rows and, for those of the condition, a twin abroad with another key."""
    return rows.unionByName(rows.where(when).withColumns({key: twin, "country": F.lit(ABROAD)}))


def operational_points(d: Derived) -> DataFrame:
    rows = d.ops().join(d.locations().select("k", "line", "km"), "k")
    rows = _with_twins(rows, "uopid", F.concat(F.lit("FR"), F.substring("uopid", 3, 99)), "k % 4 = 0")
    return rows.select(
        (F.col("k") % PAGES).alias("page"), term(F.col("name")).alias("opName"), term(F.col("uopid")).alias("uopid"), uri(decode.TYPE_PREFIXES[0] + "rinf/", F.col("rinf_type")).alias("opType"),
        uri(decode.COUNTRY_PREFIXES[0], F.col("country")).alias("country"), number(F.col("lat")).alias("lat"), number(F.col("lon")).alias("lon"), term(F.col("line")).alias("lineId"),
        number(F.col("km")).alias("kilometer"), number(F.lit(0.0)).alias("offset"),
    )


def tracks(d: Derived) -> DataFrame:
    return d.track_rows().select(
        _page("section"), uri(decode.SECTION_PREFIXES[1], F.col("section")).alias("sectionOfLine"), uri(decode.TRACK_PREFIXES[0], F.col("track")).alias("track"),
        _bound("speed", whole(F.col("speed"))).alias("maximumPermittedSpeed"), _bound("radius", whole(F.col("radius"))).alias("minimumHorizontalRadius"),
        _bound("contact", term(F.col("contact"))).alias("contactLineSystemTypeLabel"), _bound("category", uri(decode.CATEGORY_PREFIXES[0], F.col("category"))).alias("lineCategory"),
    )


def sections_of_line(d: Derived) -> DataFrame:
    rows = _with_twins(d.raw_sections(), "section", F.concat("section", F.lit("-F")), "a % 4 = 0")
    return rows.select(
        _page("section"), uri(decode.SECTION_PREFIXES[0], F.col("section")).alias("sectionOfLine"), number(F.col("length")).alias("length"), term(F.col("line")).alias("lineId"),
        term(F.col("start_op")).alias("startUopid"), term(F.col("end_op")).alias("endUopid"), uri(decode.COUNTRY_PREFIXES[0], F.col("country")).alias("country"),
    )


def tunnel(d: Derived) -> DataFrame:
    rows = _with_twins(d.tunnels().withColumn("tunnel", F.col("idx").cast("string")), "tunnel", F.concat("tunnel", F.lit("F")), "idx % 4 = 0")
    zero = number(F.lit(0.0))
    return rows.select(
        (F.col("idx") % PAGES).alias("page"), term(F.col("tunnel")).alias("tunnelIdentification"), uri(decode.COUNTRY_PREFIXES[0], F.col("country")).alias("country"), term(F.col("line")).alias("lineId"),
        number(F.col("length")).alias("length"), number(F.col("start_km")).alias("startsAtKilometer"), zero.alias("startsAtOffset"), number(F.col("start_km")).alias("endsAtKilometer"), zero.alias("endsAtOffset"), term(F.col("wkt")).alias("wkt"),
    )


def osm(d: Derived) -> DataFrame:
    place = lambda v: uri(decode.OSM_PREFIXES[0], v)
    return d.stations().select(
        _page("url"), place(F.col("url")).alias("id"), term(F.col("url")).alias("name"), term(F.col("railway")).alias("railway"), term(F.col("prefix")).alias("railway_prefix"), term(F.col("code")).alias("railway_ref"),
        number(F.col("lat")).alias("lat"), number(F.col("lon")).alias("lng"), place(F.lit("node")).alias("type"),
    )


#: raw results of a build
RESULTS = {"operationalPoints": operational_points, "tracks": tracks, "sectionsOfLine": sections_of_line, "tunnel": tunnel, "osm": osm}


def write_documents(texts: DataFrame, path: str, head: str, tail: str, rows: int = DOCUMENT_ROWS) -> None:
    """texts (page, value) as documents, each a list of about ``rows`` values between head and tail, in files of the folder of their page.

    A page has as many documents as its rows need, so a document, which its reader holds whole, doesn't grow with the table.
    They are written line by line and held by no task.
    """
    texts = files.cut(texts)
    sizes = texts.groupBy("page").agg(F.ceil(F.count("*") / rows).alias("parts"))
    dealt = texts.join(F.broadcast(sizes), "page").select("page", F.pmod(F.xxhash64("value"), F.col("parts")).alias("part"), "value")
    place = Window.partitionBy("page", "part").orderBy("value")
    edge = lambda near, text, other: F.when(near(F.lit(1)).over(place).isNull(), F.lit(text)).otherwise(F.lit(other))
    lines = dealt.select("page", "part", F.concat(edge(F.lag, head, ","), "value", edge(F.lead, tail, "")).alias("value"))
    lines.write.partitionBy("page", "part").text(path, compression=CODEC)
    files.drop_cut(texts)


def write(rows: DataFrame, path: str) -> None:
    """Rows of variables (structs of terms, null where unbound), each with its page, as query-result documents."""
    texts = rows.select("page", F.to_json(F.struct(*[c for c in rows.columns if c != "page"])).alias("value"))
    write_documents(texts, path, '{"head":{"vars":[]},"results":{"bindings":[', "]}}")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{files.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def built(d: Derived, only: str, countries: str = HOME, by_locations: bool = True, kept: tuple[str, ...] | None = None) -> Folder:
    """A new folder with the raw results that the stages named read, and these stages.

    kept: the data sets that are asked for; raw results and other data sets are removed once no later stage reads them. Without it all stay.
    """
    folder, names, written = new_folder(d.spark, "built"), only.split(";"), set()
    stages = [n for n in STAGES if n in names]
    with files.scratch(d.spark):
        d = d.settled()
        for i, name in enumerate(stages):
            # raw results are written when a stage reads them, not all at once
            for raw in (r for r in RESULTS if r in STAGES[name].raw and r not in written):
                write(RESULTS[raw](d), f"{folder}/sparql-{raw}.json")
                written.add(raw)
            build_all(d.spark, folder, countries, by_locations, only=name, codec=CODEC)
            if kept is not None:
                later = [STAGES[n] for n in stages[i + 1 :]]
                done = [f"sparql-{r}" for r in STAGES[name].raw if not any(r in s.raw for s in later)]
                done += [n for n in stages[: i + 1] if n not in kept and not any(n in s.sets for s in later)]
                for one in done:
                    files.remove(d.spark, f"{folder}/{one}.json")
    return Folder(d.spark, folder)
