"""Operators over the ordered edges of paths (path, seq, src, dst, line, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as m


def cheapest_edges(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair of nodes: the cheapest, then the smallest line."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(F.min_by(F.struct(*cols), F.struct("cost", "line", "length")).alias("e")).select("src", "dst", "e.*")


def compact(path: DataFrame, by_speed: bool = False) -> DataFrame:
    """Runs of one line (and speed) become one edge; an edge that ends where the piece before it began opens the next piece."""
    order = Window.partitionBy("path").orderBy("seq")
    change = F.lag("line").over(order) != F.col("line")
    if by_speed:
        change = change | (F.lag("speed").over(order) != F.col("speed"))
    runs = path.withColumn("run", F.sum(F.coalesce(change.cast("int"), F.lit(0))).over(order))
    parts = ("seq", "src", "dst", "line", "country", "cost", "length", "speed", "electrified", "start_km", "end_km")
    runs = runs.groupBy("path", "run").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("edges"))
    joined = {"dst": "x.dst", "cost": "z.cost + x.cost", "length": "z.length + x.length", "speed": "greatest(z.speed, x.speed)", "electrified": "z.electrified and x.electrified", "end_km": "x.end_km"}
    merged = ", ".join(f"{joined.get(c, f'z.{c}')} as {c}" for c in parts)
    # the pieces of a run are few; only the last one grows
    step = f"if(element_at(a, -1).src = x.dst, concat(a, array(x)), transform(a, (z, i) -> if(i < size(a) - 1, z, struct({merged}))))"
    pieces = F.expr(f"aggregate(slice(edges, 2, size(edges)), array(edges[0]), (a, x) -> {step})")
    out = runs.select("path", F.inline(pieces))
    return out.withColumn("seq", F.row_number().over(order)).select("path", *parts)


def running_totals(path: DataFrame) -> DataFrame:
    order = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return path.withColumn("total_cost", F.sum("cost").over(order)).withColumn("total_length", F.sum("length").over(order))


def split_walking(path: DataFrame) -> DataFrame:
    """Segments between walking edges, which are dropped."""
    order = Window.partitionBy("path").orderBy("seq")
    walk = m.is_walking(F.col("line"))
    return path.withColumn("segment", F.sum(walk.cast("int")).over(order)).where(~walk)


def locations(path: DataFrame, ops: DataFrame, excluded: tuple[int, ...] = ()) -> DataFrame:
    """Start of each edge unless its type is excluded, and the end of each segment always."""
    parts = split_walking(path)
    last = parts.groupBy("path", "segment").agg(F.max(F.struct("seq", "dst")).alias("z"))
    ends = last.select("path", "segment", (F.col("z.seq") + 1).alias("seq"), F.col("z.dst").alias("uopid"), F.lit(True).alias("last"))
    stops = parts.select("path", "segment", "seq", F.col("src").alias("uopid"), F.lit(False).alias("last")).unionByName(ends)
    known = stops.join(ops.select("uopid", "rinf_type", "lat", "lon"), "uopid")
    return known.where(F.col("last") | ~F.col("rinf_type").isin(*excluded)) if excluded else known


def route_urls(points: DataFrame) -> DataFrame:
    """One planner link for each segment of a path."""
    ordered = points.groupBy("path", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.struct(p["lat"], p["lon"])).alias("points"))
    return ordered.select("path", "segment", m.route_url(F.col("points")).alias("url"))


def first_edge_fix(path: DataFrame) -> DataFrame:
    """A first edge without length that starts at kilometre 0 starts where it ends."""
    first = F.row_number().over(Window.partitionBy("path").orderBy("seq")) == 1
    return path.withColumn("start_km", F.when(first & (F.col("length") == 0) & (F.col("start_km") == 0), F.col("end_km")).otherwise(F.col("start_km")))


def gap_rows(path: DataFrame) -> DataFrame:
    """A row of speed and cost 0 wherever an edge doesn't start where the one before ended."""
    order = Window.partitionBy("path").orderBy("seq")
    before = path.withColumns({"_dst": F.lag("dst").over(order), "_km": F.lag("end_km").over(order)}).where("_dst <> src")
    gaps = before.select("path", (F.col("seq") - 0.5).alias("seq"), F.col("_dst").alias("src"), F.col("src").alias("dst"), "line", F.lit(0).cast("long").alias("cost"), (F.col("start_km") - F.col("_km")).alias("length"), F.lit(0).alias("speed"), F.lit(True).alias("gap"))
    return path.select("path", F.col("seq").cast("double").alias("seq"), "src", "dst", "line", "cost", "length", "speed", F.lit(False).alias("gap")).unionByName(gaps)


def path_elements(path: DataFrame, ops: DataFrame, lines: DataFrame) -> DataFrame:
    """Edges with the names of their ends and of their line (looked up by line only)."""
    side = lambda c, name: ops.select(F.col("uopid").alias(c), F.col("name").alias(name))
    texts = lines.groupBy("line").agg(F.min("name").alias("line_text"))
    return path.join(side("src", "from_name"), "src", "left").join(side("dst", "to_name"), "dst", "left").join(texts, "line", "left")


def printed(path: DataFrame) -> DataFrame:
    """Listing lines with running totals."""
    t = running_totals(path)
    return t.select("path", "seq", F.format_string("%s -> %s line %s length %.3f total %.3f cost %d", "src", "dst", "line", "length", "total_length", "total_cost").alias("text"))
