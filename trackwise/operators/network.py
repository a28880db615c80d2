"""Graphs, line infos, tunnel infos, consistency and statistics of a railway network."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decode
from ..functions import measures as m
from ..sources.files import cut

#: nodes that a task holds at a time while it unites its own edges
TASK_NODES = 200_000

EDGE = ("src", "dst", "line", "country", "cost", "length", "speed", "electrified", "start_km", "end_km")


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, kilometres swapped."""
    back = edges.withColumns({"src": F.col("dst"), "dst": F.col("src"), "start_km": F.col("end_km"), "end_km": F.col("start_km")})
    return edges.unionByName(back)


def _edge(length: Column, speed: Column) -> dict[str, Column]:
    return {"length": length, "speed": speed, "cost": m.travel_cost(length, speed)}


def consecutive(locations: DataFrame) -> DataFrame:
    """locations (country, line, op, km) -> pairs of neighbours on each line, by km."""
    by = Window.partitionBy("country", "line").orderBy("km", "op")
    pairs = locations.select("country", "line", F.col("op").alias("src"), F.lead("op").over(by).alias("dst"), F.col("km").alias("start_km"), F.lead("km").over(by).alias("end_km"))
    return pairs.where("dst is not null")


def graph_by_locations(locations: DataFrame, sections: DataFrame) -> DataFrame:
    """Forward edges between neighbours on a line; a section (line, start_op, end_op, length, tracks) gives length and speed.

    Sections are looked up by line and direction, without the country; a gap takes the kilometres and 120 km/h.
    """
    known = sections.groupBy("line", "start_op", "end_op").agg(F.min_by(F.struct("country", "length", "tracks"), "section").alias("s"))
    known = known.select("line", F.col("start_op").alias("src"), F.col("end_op").alias("dst"), "s")
    pairs = consecutive(locations).join(known, ["line", "src", "dst"], "left")
    length = m.half_even(F.coalesce(F.col("s.length"), F.col("end_km") - F.col("start_km")), 2)
    speed = F.when(F.col("s").isNull(), F.lit(m.GAP_SPEED)).otherwise(m.max_speed(F.col("s.tracks")))
    electrified = F.when(F.col("s").isNull(), F.lit(True)).otherwise(m.is_electrified(F.col("s.tracks")))
    return pairs.withColumns(_edge(length, speed)).withColumns({"electrified": electrified, "country": F.coalesce(F.col("s.country"), F.col("country"))}).select(*EDGE)


def one_place(locations: DataFrame) -> DataFrame:
    """(line, op, km): of several kilometres of a point on a line the one first seen last, by idx if there is one, else the largest."""
    last = F.max_by("km", "idx") if "idx" in locations.columns else F.max("km")
    return locations.groupBy("line", "op").agg(last.alias("km"))


def graph_by_sections(sections: DataFrame, locations: DataFrame) -> DataFrame:
    """Forward edges of sections whose ends both exist; missing kilometres are 0."""
    ops, places = locations.select("op").distinct(), one_place(locations)
    place = lambda op, km: places.select("line", F.col("op").alias(op), F.col("km").alias(km))
    out = sections.join(ops.withColumnRenamed("op", "start_op"), "start_op").join(ops.withColumnRenamed("op", "end_op"), "end_op")
    out = out.join(place("start_op", "start_km"), ["line", "start_op"], "left").join(place("end_op", "end_km"), ["line", "end_op"], "left")
    out = out.withColumns(_edge(m.half_even(F.col("length"), 2), m.max_speed(F.col("tracks")))).withColumns({"electrified": m.is_electrified(F.col("tracks")), "src": F.col("start_op"), "dst": F.col("end_op"), "start_km": F.coalesce("start_km", F.lit(0.0)), "end_km": F.coalesce("end_km", F.lit(0.0))})
    return out.select(*EDGE)


def adjacency(edges: DataFrame) -> DataFrame:
    """Nested form of the edge table, for export."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list(F.struct("dst", "cost", "line", "country", "speed", "electrified", "start_km", "end_km", "length"))).alias("edges"))


def sub_graph(edges: DataFrame, country: str, line: str) -> DataFrame:
    return edges.where((F.col("country") == country) & (F.col("line") == line))


def electrified_length(sections: DataFrame) -> DataFrame:
    flag = m.is_electrified(F.col("tracks"), "tool")
    return sections.groupBy(flag.alias("electrified")).agg(F.sum("length").alias("length"), F.count("*").alias("n"))


def line_infos(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """One row for each line: nodes by kilometre, first and last of them, name and length."""
    forward = edges.where("start_km < end_km")
    stops = forward.select("country", "line", F.col("src").alias("op"), F.col("start_km").alias("km")).unionByName(forward.select("country", "line", F.col("dst").alias("op"), F.col("end_km").alias("km")))
    stops = stops.groupBy("country", "line", "op").agg(F.min("km").alias("km")).join(ops.select(F.col("uopid").alias("op"), "name"), "op")
    per = stops.groupBy("country", "line").agg(F.array_sort(F.collect_list(F.struct("km", "op", "name"))).alias("s"))
    first, last = F.col("s")[0], F.element_at("s", -1)
    return per.select("country", "line", F.concat(first["name"], F.lit(" - "), last["name"]).alias("name"), m.half_even(last["km"] - first["km"], 3).alias("length"), first["km"].alias("start_km"), last["km"].alias("end_km"), F.transform("s", lambda x: x["op"]).alias("uopids"))


def line_tunnels(lines: DataFrame, tunnels: DataFrame) -> DataFrame:
    """Distinct tunnel names of each line, by start kilometre."""
    named = tunnels.groupBy("country", "line").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start_km", "tunnel"))), lambda x: x["tunnel"])).alias("tunnels"))
    return lines.join(named, ["country", "line"], "left").withColumn("tunnels", F.coalesce("tunnels", F.array().cast("array<string>")))


def line_wikipedia(lines: DataFrame, routes: DataFrame) -> DataFrame:
    """The first map route (by idx) that matches a line and is of its country's language; two equi-joins, no nested loop."""
    r = routes.select("idx", "ref", "wikipedia")
    equal = lines.select("country", "line").join(r, F.col("line") == F.col("ref"))
    french = lines.select("country", "line").where("country = 'FRA' and line like '%-1'").join(r.where("length(ref) = 7"), F.substring("line", 1, 3) == F.substring("ref", 1, 3))
    language = ((F.col("country") == "DEU") & F.col("wikipedia").startswith("de:")) | ((F.col("country") == "FRA") & F.col("wikipedia").startswith("fr:"))
    best = equal.unionByName(french).where(decode.route_ref(F.col("country"), F.col("line"), F.col("ref")) & language).groupBy("country", "line").agg(F.min_by("wikipedia", "idx").alias("wikipedia"))
    return lines.join(best, ["country", "line"], "left")


def tunnel_infos(tunnels: DataFrame) -> DataFrame:
    """Lengths in km."""
    return tunnels.withColumn("length", F.col("length") / 1000)


def tunnels_of_line(tunnels: DataFrame, country: str, line: str) -> DataFrame:
    return tunnels.where((F.col("country") == country) & (F.col("line") == line))


def tunnel_kilometres(tunnels: DataFrame, edges: DataFrame, ops: DataFrame) -> DataFrame:
    """(tunnel, start_km, end_km): tunnels (tunnel, start_op, end_op, start_lat, start_lon, length in m) on the edge between two points.

    The start is the edge's kilometre at its first point and the distance from there, the end a tunnel's length further; both
    are rounded to metres, and null where the edge or the point is missing. Of parallel edges the first by line and kilometre counts.
    """
    first = edges.groupBy(F.col("src").alias("start_op"), F.col("dst").alias("end_op")).agg(F.min_by("start_km", F.struct("line", "country", "start_km")).alias("edge_km"))
    places = ops.select(F.col("uopid").alias("start_op"), "lat", "lon")
    on = tunnels.join(first, ["start_op", "end_op"], "left").join(places, "start_op", "left")
    start = F.col("edge_km") + m.haversine(F.col("lat"), F.col("lon"), F.col("start_lat"), F.col("start_lon"))
    return on.select("tunnel", m.half_even(start, 3).alias("start_km"), m.half_even(start + F.col("length") * F.lit(0.001), 3).alias("end_km"))


def consistency(locations: DataFrame, edges: DataFrame) -> DataFrame:
    """Points located on a line without an edge of it, and points of a line's edges without a location on it."""
    on_edges = edges.select("line", F.col("src").alias("op")).union(edges.select("line", "dst")).distinct()
    placed = locations.select("line", "op").distinct()
    missing = placed.join(on_edges, ["line", "op"], "left_anti").withColumn("missing_in", F.lit("graph"))
    return missing.unionByName(on_edges.join(placed, ["line", "op"], "left_anti").withColumn("missing_in", F.lit("locations")))


def ops_of_line(locations: DataFrame, ops: DataFrame, country: str, line: str) -> DataFrame:
    on = locations.where((F.col("country") == country) & (F.col("line") == line)).select("op", "km").distinct()
    return on.join(ops.select(F.col("uopid").alias("op"), "name", "lat", "lon"), "op")


def sections_of_line(sections: DataFrame, locations: DataFrame, country: str, line: str) -> DataFrame:
    """Sections with the kilometres of their ends on the line; a missing kilometre sorts as 0."""
    own = sections.where((F.col("country") == country) & (F.col("line") == line))
    place = one_place(locations.where(F.col("line") == line))
    out = own.join(place.select(F.col("op").alias("start_op"), F.col("km").alias("start_km")), "start_op", "left").join(place.select(F.col("op").alias("end_op"), F.col("km").alias("end_km")), "end_op", "left")
    return out.select("section", "start_op", "end_op", "length", F.coalesce("start_km", F.lit(0.0)).alias("start_km"), "end_km", m.max_speed(F.col("tracks")).alias("speed"), (F.col("start_km").isNull() | F.col("end_km").isNull()).alias("op_missing"))


def legacy_sections_of_line(sections: DataFrame) -> DataFrame:
    """The older listing: length over 1000, the first track's speed, 50 without."""
    return sections.select("section", (F.col("length") / 1000).alias("length"), F.coalesce(F.col("tracks")[0]["speed"], F.lit(50)).alias("speed"))


def graph_counts(edges: DataFrame) -> DataFrame:
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    return edges.agg(F.count("*").alias("edges"), F.sum("cost").alias("cost"), F.max("cost").alias("max_cost")).crossJoin(F.broadcast(nodes.agg(F.count("*").alias("nodes"))))


def undirected(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair and line: the last by source order wins."""
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "line", "cost", F.struct("src", "dst", "start_km", "cost").alias("o"))
    return e.groupBy("a", "b", "line").agg(F.max_by("cost", "o").alias("cost"))


def degree_histogram(pairs: DataFrame) -> DataFrame:
    """degree -> number of nodes, of an undirected multigraph (a, b, line)."""
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("nodes"))


def _own_forest(most: int):
    """(scope, a, b) -> edges (scope, a, b) from nodes to the smallest of their tree, with the same components; ``most`` nodes at a time."""

    def run(batches):
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        def edges():
            return pd.DataFrame([(x[0], root(x)[1], x[1]) for x in up], columns=["scope", "a", "b"])

        for pdf in batches:
            for scope, a, b in zip(pdf["scope"], pdf["a"], pdf["b"], strict=True):
                x, y = sorted((root((scope, a)), root((scope, b))))
                up[y] = x
                if len(up) > most:
                    yield edges()
                    up.clear()
        if up:
            yield edges()

    return run


def components(pairs: DataFrame, scope: str | None = None, task_nodes: int = TASK_NODES) -> DataFrame:
    """(scope, node, component): smallest node reachable; with a scope column, inside each of its values.

    Each task first unites the edges it holds to trees. Then rounds hook nodes to their smallest neighbour, follow the hooks by
    pointer doubling, and contract, until no edge is left; the nodes at least halve each time, so there are about log2 of them.
    """
    edges = pairs.select((F.col(scope) if scope else F.lit("")).alias("scope"), "a", "b")
    shape = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in edges.columns)
    edges = cut(edges.mapInPandas(_own_forest(task_nodes), shape).distinct())
    names = None
    while names is None or not edges.isEmpty():
        both = edges.unionByName(edges.select("scope", F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy("scope", F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
        while True:
            up = hooks.select("scope", F.col("node").alias("root"), F.col("root").alias("up"))
            hooks = cut(hooks.join(up, ["scope", "root"]).select("scope", "node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            done = hooks.where("moved").isEmpty()
            hooks = hooks.drop("moved")
            if done:
                break
        names = hooks if names is None else _renamed(names, hooks)
        side = lambda c: hooks.select("scope", F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        edges = cut(edges.join(side("a"), ["scope", "a"]).join(side("b"), ["scope", "b"]).where("ra <> rb").select("scope", F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return names.select("scope", "node", F.col("root").alias("component"))


def _renamed(names: DataFrame, hooks: DataFrame) -> DataFrame:
    """names whose roots are nodes of hooks take the roots of these."""
    up = hooks.select("scope", F.col("node").alias("root"), F.col("root").alias("up"))
    return cut(names.join(up, ["scope", "root"], "left").select("scope", "node", F.coalesce("up", "root").alias("root")))


def line_statistics(pairs: DataFrame) -> DataFrame:
    """Of each line: edges, nodes, whether it is connected, whether it is a path, its highest degree."""
    pairs = cut(pairs.select("a", "b", "line"))
    ends = pairs.select("line", F.col("a").alias("node")).unionAll(pairs.select("line", "b")).groupBy("line", "node").agg(F.count("*").alias("degree"))
    shape = ends.groupBy("line").agg(F.count("*").alias("nodes"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 1).alias("ends"))
    comps = components(pairs, "line").groupBy(F.col("scope").alias("line")).agg(F.count_distinct("component").alias("components"))
    out = pairs.groupBy("line").agg(F.count("*").alias("edges")).join(shape, "line").join(comps, "line")
    connected = F.col("components") == 1
    return out.select("line", "edges", "nodes", connected.alias("connected"), (connected & (F.col("ends") == 2) & (F.col("max_degree") <= 2)).alias("is_path"), "max_degree")
