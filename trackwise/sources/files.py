"""Data sets on disk: JSON documents, query results, graph texts, snapshots, written tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Countries by code.
COUNTRIES = {
    "AUT": "Austria", "BEL": "Belgium", "BGR": "Bulgaria", "CHE": "Switzerland", "CZE": "Czechia", "DEU": "Germany", "DNK": "Denmark", "ESP": "Spain", "EST": "Estonia", "FIN": "Finland",
    "FRA": "France", "GRC": "Greece", "HUN": "Hungary", "IRL": "Ireland", "ITA": "Italy", "LTU": "Lithuania", "LUX": "Luxembourg", "LVA": "Latvia", "NLD": "Netherlands", "NOR": "Norway",
    "POL": "Poland", "PRT": "Portugal", "ROU": "Romania", "SVK": "Slovakia", "SVN": "Slovenia", "SWE": "Sweden",
}
# Schemas of the data sets.
TERM = "struct<type: string, datatype: string, `xml:lang`: string, value: string>"
RESULTS = f"head struct<vars: array<string>>, results struct<bindings: array<map<string, {TERM}>>>"
SCHEMAS = {
    "OperationalPoints": "Name string, Type string, Country string, UOPID string, Latitude double, Longitude double, RailwayLocations array<struct<NationalIdentNum: string, Kilometer: double>>",
    "SectionsOfLines": "Name string, Country string, Length double, LineIdentification string, StartOP string, EndOP string, Tracks array<struct<id: string, sectionOfLine: string, label: string, maximumPermittedSpeed: int, minimumHorizontalRadius: int, contactLineSystem: string, lineCategories: array<int>>>",
    "Tunnels": "Name string, Country string, Length double, LineIdentification string, StartLatitude double, StartLongitude double, StartKm double, EndLatitude double, EndLongitude double, EndKm double",
    "OpInfos": "UOPID string, Name string, RinfType int, Latitude double, Longitude double",
    "LineInfos": "Line string, Country string, Name string, Length double, StartKm double, EndKm double, UOPIDs array<string>, Tunnels array<string>, Wikipedia string",
    "TunnelInfos": "Tunnel string, Length double, StartLong double, StartLat double, StartKm double, EndLong double, EndLat double, EndKm double, Line string, Country string",
    "Graph": "Node string, Edges array<struct<Node: string, Cost: int, Line: string, Country: string, MaxSpeed: int, Electrified: boolean, StartKm: double, EndKm: double, Length: double>>",
    "MoGraph": "Node string, Edges array<struct<Node: string, LineCost: int, DistanceCost: int, Line: string, Country: string, MaxSpeed: int, Electrified: boolean, StartKm: double, EndKm: double, Length: double>>",
    "Countries": "Code string, Label string",
    "OpInfoChanges": "UOPID string, Latitude double, Longitude double, NewLatitude double, NewLongitude double, Distance double, Percent double",
    "OsmRoutes": "Url string, Ref string, Wikipedia string",
    "OsmEntries": "Url string, Name string, Railway string, RailwayPrefix string, RailwayRef string, UicRef string, Operator string, Latitude double, Longitude double, OsmType string",
    "RInfOsmMatchings": "UOPID string, OsmUrl string, OsmRailwayTag string, OsmRailwayTagPrefix string, Distance double, Latitude double, Longitude double",
    "OpTypes": "Label string, Definition string, Value int",
    "Metadata": "Endpoint string, Ontology string, Revision string, Program string, Countries array<string>, CountriesPrefLabel array<string>, Date timestamp",
}


def read_dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A JSON document that is one array of records, or a folder of JSON lines as ``write_dataset`` leaves it."""
    path = f"{folder}/{name}.json"
    return spark.read.schema(SCHEMAS[name]).option("multiLine", not exists(spark, f"{path}/_SUCCESS")).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    system, at = file_system(spark, path)
    return system.exists(at)


def write_dataset(df: DataFrame, folder: str, name: str, codec: str | None = None) -> None:
    df.write.mode("overwrite").json(f"{folder}/{name}.json", compression=codec)


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    """(page, file, binding_idx, b) of query-result documents; pages are ordered by the last number in the file's name, then the name."""
    raw = spark.read.schema(RESULTS).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), "results.bindings")
    page = F.coalesce(F.regexp_extract(F.regexp_extract("file", "[^/]*$", 0), "([0-9]+)[^0-9]*$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    return raw.select(page.alias("page"), "file", F.posexplode("bindings").alias("binding_idx", "b"))


def union_pages(pages: list[DataFrame]) -> DataFrame:
    """Pages with a binding_idx each, in order, with a running binding_idx that keeps the first-seen order of records."""
    out = None
    for number, page in enumerate(pages):
        page = page.withColumn("page", F.lit(number))
        out = page if out is None else out.unionByName(page)
    # one row for each page
    sizes = out.groupBy("page").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.join(F.broadcast(sizes.select("page", before.alias("before"))), "page").withColumn("binding_idx", F.col("before") + F.col("binding_idx")).drop("before")


def cached(spark: SparkSession, path: str, load: Callable[[], DataFrame], use_cache: bool = True) -> DataFrame:
    """A written table that is read if it exists, and loaded and written otherwise."""
    if not (use_cache and exists(spark, f"{path}/_SUCCESS")):
        load().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows only in one of two loads, with the side they are on; repeated rows count."""
    cols = before.columns
    return before.exceptAll(after.select(*cols)).withColumn("side", F.lit("before")).unionByName(after.select(*cols).exceptAll(before).withColumn("side", F.lit("after")))


def gr_lines(arcs: DataFrame) -> DataFrame:
    """(rank, value): lines of a graph text of arcs (arc_id, tail, head, costs array): header, then arcs by id."""
    nodes = arcs.select("tail").union(arcs.select("head")).distinct()
    head = arcs.agg(F.count("*").alias("m")).crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n")))).select(F.lit(-1).cast("long").alias("rank"), F.format_string("p sp %d %d", "n", "m").alias("value"))
    body = arcs.select(F.col("arc_id").cast("long").alias("rank"), F.concat(F.format_string("a %d %d ", "tail", "head"), F.array_join(F.col("costs").cast("array<string>"), " ")).alias("value"))
    return head.unionByName(body)


def write_gr(arcs: DataFrame, path: str) -> None:
    """One text file, as readers of the format expect; its lines are sorted by arc id."""
    gr_lines(arcs).repartition(1).sortWithinPartitions("rank").select("value").write.mode("overwrite").text(path)


def parse_gr(lines: DataFrame) -> DataFrame:
    """Arcs (tail, head, costs) of graph-text lines (value): 4 tokens are too few, more than 6 an error; counts must agree."""
    parts = lines.where(F.col("value").startswith("a ")).select(F.split("value", " ").alias("t"))
    parts = parts.where("size(t) > 3")
    checked = F.when(F.size("t") > 6, F.raise_error(F.lit("more than three costs"))).otherwise(F.transform(F.slice("t", 4, 3), lambda x: x.cast("bigint")))
    return parts.select(F.col("t")[1].cast("long").alias("tail"), F.col("t")[2].cast("long").alias("head"), checked.alias("costs"))


def read_gr(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    arcs = parse_gr(lines)
    said = lines.where(F.col("value").startswith("p ")).select(F.split("value", " ").alias("t")).first()
    counts = arcs.agg(F.count("*").alias("m"), F.greatest(F.max("tail"), F.max("head")).alias("top")).first()
    if said is None or int(said["t"][3]) != counts["m"] or (counts["top"] is not None and counts["top"] >= int(said["t"][2])):
        raise ValueError("the counts of the p line don't agree with the arcs")
    return arcs


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COUNTRIES.items()), SCHEMAS["Countries"])


def checked_countries(codes: str | list[str]) -> list[str]:
    """Codes, as a list or joined by semicolons; an error if one isn't known."""
    codes = codes.split(";") if isinstance(codes, str) else list(codes)
    if unknown := [c for c in codes if c not in COUNTRIES]:
        raise ValueError(f"unknown countries {unknown}, there are {sorted(COUNTRIES)}")
    return codes


def metadata(spark: SparkSession, endpoint: str, ontology: str, revision: str, countries: list[str]) -> DataFrame:
    labels = F.array(*[F.lit(COUNTRIES[c]) for c in countries if c in COUNTRIES]).cast("array<string>")
    return spark.range(1).select(labels.alias("CountriesPrefLabel"), F.lit(endpoint).alias("Endpoint"), F.lit(ontology).alias("Ontology"), F.lit(revision).alias("Revision"), F.lit("trackwise").alias("Program"), F.array(*map(F.lit, countries)).cast("array<string>").alias("Countries"), F.current_timestamp().alias("Date"))


#: temporary folders of local sessions, by application
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local session (tests, bench) gets a temporary folder, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _LOCAL:
        made = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="trackwise-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{_LOCAL[context.applicationId]}"


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Spark's own storage layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def remove(spark: SparkSession, path: str) -> None:
    system, at = file_system(spark, path)
    system.delete(at, True)


#: compressed bytes of a shuffle that a task of a written table reads; sorts and joins hold about twenty times that
TASK_BYTES = "8m"


@contextmanager
def sized_partitions(spark: SparkSession) -> Iterator[None]:
    """Shuffles are merged to partitions of ``TASK_BYTES`` rather than to one for each core, for what runs inside: rounds over few rows are few tasks."""
    wanted = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_BYTES}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows that hold long arrays go to Python in batches of about 8 MB, for what runs inside."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: tables cut inside the scopes of a thread, the innermost last
_OPEN = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are cut inside are removed at the end, but those that a table given to ``keep`` reads: they belong to the scope around."""
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    scopes.append([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(p.split("/")[-2] for p in df.inputFiles())
        return df

    try:
        yield keep
    finally:
        for path in scopes.pop():
            if path.rpartition("/")[2] not in kept:
                remove(spark, path)
            elif scopes:
                scopes[-1].append(path)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if scopes := getattr(_OPEN, "scopes", None):
        scopes[-1].append(path)
    with sized_partitions(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the table of a ``cut`` that nothing reads any more."""
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        if path.rpartition("/")[2].startswith("table-"):
            remove(df.sparkSession, path)
