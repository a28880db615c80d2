"""A deterministic railway network derived from the star-schema test tables, to exercise the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode
from ..operators import ingest, network
from ..sources import files
from . import mapdata


class Derived:
    """Lazily derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._located: DataFrame | None = None

    def settled(self) -> Derived:
        """The same tables, with the locations written once for all that read them."""
        out = Derived(self.spark, self.sf_dir)
        out._located = files.cut(self.locations())
        return out

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def ops(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            _op(k).alias("uopid"), k.alias("k"), F.col("s_name").alias("name"), F.lit("DEU").alias("country"), (10 * (1 + k % 14)).cast("int").alias("rinf_type"),
            (F.lit(47.0) + (k % 50) * F.lit(0.1)).alias("lat"), (F.lit(6.0) + (k * 7 % 25) * F.lit(0.1)).alias("lon"),
        )

    def locations(self) -> DataFrame:
        if self._located is not None:
            return self._located
        line = F.concat(F.lit("L"), F.lpad((F.col("l_partkey") % 40).cast("string"), 2, "0"))
        rl = self.table("lineitem").groupBy(line.alias("line"), F.col("l_suppkey").alias("k")).agg((F.min("l_orderkey").cast("double") / 10).alias("km"))
        return rl.select(F.lit("DEU").alias("country"), "line", "k", _op(F.col("k")).alias("op"), "km")

    def raw_sections(self) -> DataFrame:
        pairs = network.consecutive(self.locations())
        n = lambda c: F.substring(c, 3, 9).cast("long")
        pairs = pairs.withColumns({"a": n("src"), "b": n("dst")}).where("(a + b) % 3 <> 0")
        name = F.concat_ws("-", "line", "src", "dst")
        return pairs.select(name.alias("section"), "country", "line", F.col("src").alias("start_op"), F.col("dst").alias("end_op"), (F.col("end_km") - F.col("start_km") + F.lit(0.004)).alias("length"), "a", "b")

    def track_rows(self) -> DataFrame:
        """(idx, section, track, speed, radius, contact, category), as bindings would list them."""
        s = self.raw_sections().withColumn("i", F.explode(F.expr("sequence(1L, (a + b) % 3)")))
        s = s.withColumn("category", F.explode(F.expr("if((a + b) % 7 = 0, array(70L), if(i = 1, array(10 * ((a + i) % 9), 20L), array(cast(null as bigint))))")))
        return s.select(
            F.expr("i * 1000 + coalesce(category, 0)").alias("idx"), "section", F.col("i").cast("string").alias("track"), F.expr("if((a * 7 + b * 3 + i) % 5 = 0, null, 60 + 10 * ((a + i) % 10))").alias("speed"),
            F.expr("if((a + i) % 4 = 0, null, 200 + 50 * ((b + i) % 30))").alias("radius"), F.expr("case (a + b + i) % 4 when 0 then 'Not electrified' when 1 then 'AC 15kV' when 2 then null else 'AC 25kV' end").alias("contact"), "category",
        )

    def sections(self, passenger_only: bool = False) -> DataFrame:
        raw = self.raw_sections().drop("a", "b").withColumn("idx", F.lit(0))
        return ingest.sections_with_tracks(raw, ingest.fold_tracks(self.track_rows()), passenger_only)

    def forward(self) -> DataFrame:
        return network.graph_by_locations(self.locations().drop("k"), self.sections())

    def edges(self) -> DataFrame:
        return network.both_directions(self.forward())

    def stations(self) -> DataFrame:
        """Customers as map stations."""
        k = F.col("c_custkey")
        near = k % 50
        return self.table("customer").select(
            F.concat(F.lit("node/"), k).alias("url"), F.when(k % 4 == 0, "station").when(k % 4 == 1, "halt").when(k % 4 == 2, "stop").otherwise("yard").alias("railway"), F.when(k % 3 == 0, "railway").otherwise("disused").alias("prefix"),
            F.when(k % 5 == 0, F.concat(F.lit("X;"), near.cast("string"))).otherwise((k % 120).cast("string")).alias("code"), (F.lit(47.0) + near * F.lit(0.1) + (k % 7) * F.lit(0.004)).alias("lat"), (F.lit(6.0) + (k % 120 * 7 % 25) * F.lit(0.1) + (k % 11) * F.lit(0.003)).alias("lon"),
        )

    def tunnels(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            F.concat(F.lit("T"), k % 500).alias("tunnel"), F.lit("DEU").alias("country"), F.concat(F.lit("L"), F.lpad((k % 40).cast("string"), 2, "0")).alias("line"), F.col("o_totalprice").alias("length"), (k.cast("double") / 10).alias("start_km"), k.alias("idx"),
            F.concat(F.lit("LINESTRING ("), (k % 20).cast("string"), F.lit(".5 48.25, "), (k % 20).cast("string"), F.lit(".75 48.5)")).alias("wkt"),
        )

    def routes(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(k.alias("idx"), F.concat(F.lit("L"), F.lpad((k % 60).cast("string"), 2, "0")).alias("ref"), F.concat(F.when(k % 3 == 0, "fr:").otherwise("de:"), F.col("p_name")).alias("wikipedia"))

    def shapes(self) -> DataFrame:
        """(k, wkt): a geometry for each customer - a point, a bent line, a rectangle with a hole, two squares."""
        k = F.col("c_custkey")
        x, y = F.lit(6.0) + k % 20 * F.lit(0.5), F.lit(47.0) + k % 10 * F.lit(0.25)
        at = lambda dx, dy: F.concat((x + dx).cast("string"), F.lit(" "), (y + dy).cast("string"))
        ring = lambda *p: F.concat(F.lit("("), F.concat_ws(", ", *[at(*q) for q in (*p, p[0])]), F.lit(")"))
        box = lambda dx, dy, w, h: ring((dx, dy), (dx + w, dy), (dx + w, dy + h), (dx, dy + h))
        line = F.concat(F.lit("LINESTRING("), F.concat_ws(", ", at(0, 0), at(3, 0), at(3, 1)), F.lit(")"))
        holed = F.concat(F.lit("POLYGON("), box(0, 0, 4, 2), F.lit(","), box(1, 0.5, 1, 0.5), F.lit(")"))
        squares = F.concat(F.lit("MULTIPOLYGON(("), box(0, 0, 1, 1), F.lit("), ("), box(3, 0, 2, 2), F.lit("))"))
        point = F.concat(F.lit("POINT("), at(0, 0), F.lit(")"))
        return self.table("customer").select(k.alias("k"), F.when(k % 4 == 0, point).when(k % 4 == 1, line).when(k % 4 == 2, holed).otherwise(squares).alias("wkt"))

    def map_facts(self) -> tuple[DataFrame, DataFrame]:
        """Statements about customers as map stations and parts as map routes, and what the areas contain."""
        k, n = F.col("c_custkey"), F.col("p_partkey")
        fact = lambda s, p, o, when: F.when(when, F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o")))
        node, shape, key = F.concat(F.lit(decode.OSM_PREFIXES[0] + "node/"), k), F.concat(F.lit("shape"), k), mapdata.KEY
        railways = ("railway", "disused:railway", "proposed:railway", "historic:railway", "abandoned:railway")
        of_station = [
            fact(node, mapdata.TYPE, F.lit(decode.OSM_PREFIXES[0] + "node"), k >= 0), fact(node, mapdata.HAS_GEOMETRY, shape, k >= 0), fact(shape, mapdata.AS_WKT, F.col("wkt"), k >= 0),
            fact(node, key + "name", F.concat(F.lit("n"), k), k % 2 == 0), fact(node, key + "disused:name", F.concat(F.lit("d"), k), (k % 2 == 1) | (k % 6 == 0)),
            *[fact(node, key + r, F.lit("station"), k % 7 == i) for i, r in enumerate(railways)], fact(node, key + "railway", F.lit("halt"), k % 7 == 4),
            fact(node, key + "public_transport", F.when(k % 14 == 5, "stop_area").otherwise("platform"), k % 7 == 5),
            fact(node, key + "railway:ref", F.concat(F.lit("R"), k), k % 3 == 0), fact(node, key + "railway:ref:DBAG", F.concat(F.lit("B"), k), k % 3 == 1), fact(node, key + "disused:railway:ref", F.concat(F.lit("O"), k), k % 5 == 0),
            fact(node, key + "uic_ref", k, k % 8 == 0), fact(node, key + "operator", F.lit("x"), k % 9 == 0),
        ]
        relation = F.concat(F.lit("r"), n)
        of_route = [
            fact(relation, key + "type", F.when(n % 11 == 0, "site").otherwise("route"), n >= 0), fact(relation, key + "route", F.when(n % 2 == 0, "tracks").when(n % 7 == 0, "bus").otherwise("railway"), n >= 0),
            fact(relation, key + "ref", F.concat(F.lit("L"), n % 60), n % 13 != 0), fact(relation, key + "wikipedia", F.concat(F.lit("de:"), F.col("p_name")), n % 3 == 0), fact(relation, mapdata.WIKIDATA, F.concat(F.lit("Q"), n % 500), n % 5 != 0),
        ]
        stations = self.table("customer").join(self.shapes(), k == F.col("k")).select(F.inline(F.array_compact(F.array(*of_station))))
        triples = stations.unionByName(self.table("part").select(F.inline(F.array_compact(F.array(*of_route)))))
        areas = lambda s, i: F.inline(F.array_compact(F.array(F.when(i % 4 != 3, F.struct(F.lit(mapdata.GERMANY).alias("area"), s.alias("s"))), F.when(i % 4 == 2, F.struct(F.lit(mapdata.SWITZERLAND).alias("area"), s.alias("s"))), F.struct(F.lit("elsewhere").alias("area"), s.alias("s")))))
        return triples, self.table("customer").select(areas(node, k)).unionByName(self.table("part").select(areas(relation, n)))

    def articles(self) -> DataFrame:
        """Statements of a second source: suppliers as articles about items, on two sites."""
        k = F.col("s_suppkey")
        site = F.when(k % 4 == 0, "https://fr.wikipedia.org/").otherwise(mapdata.SITE)
        article = F.concat(site, F.lit("wiki/"), "s_name")
        one = lambda p, o: F.struct(article.alias("s"), F.lit(p).alias("p"), o.alias("o"))
        return self.table("supplier").select(F.inline(F.array(one(mapdata.ABOUT, F.concat(F.lit("Q"), k % 500)), one(mapdata.PART_OF, site))))


def _op(key: Column) -> Column:
    return F.concat(F.lit("DE"), F.when(F.length(key.cast("string")) < 5, F.lpad(key.cast("string"), 5, "0")).otherwise(key.cast("string")))


#: the same tables in DuckDB
SQL = """
op as (select 'DE' || lpad(cast(s_suppkey as varchar), 5, '0') as uopid, s_suppkey as k, s_name as name, 'DEU' as country, cast(10 * (1 + s_suppkey % 14) as integer) as rinf_type, 47e0 + (s_suppkey % 50) * 0.1e0 as lat, 6e0 + (s_suppkey * 7 % 25) * 0.1e0 as lon from supplier),
rl as (select 'DEU' as country, 'L' || lpad(cast(l_partkey % 40 as varchar), 2, '0') as line, l_suppkey as k, 'DE' || lpad(cast(l_suppkey as varchar), 5, '0') as op, cast(min(l_orderkey) as double) / 10e0 as km from lineitem group by 2, 3),
pr as (select country, line, k as a, lead(k) over w as b, op as src, lead(op) over w as dst, km as start_km, lead(km) over w as end_km from rl window w as (partition by country, line order by km, op)),
sol as (select concat_ws('-', line, src, dst) as section, country, line, src as start_op, dst as end_op, end_km - start_km + 0.004e0 as length, start_km, end_km, a, b from pr where dst is not null and (a + b) % 3 <> 0),
tr as (select section, i, case when (a * 7 + b * 3 + i) % 5 = 0 then null else 60 + 10 * ((a + i) % 10) end as speed, case when (a + i) % 4 = 0 then null else 200 + 50 * ((b + i) % 30) end as radius,
  case (a + b + i) % 4 when 0 then 'Not electrified' when 1 then 'AC 15kV' when 2 then null else 'AC 25kV' end as contact,
  case when (a + b) % 7 = 0 then [70] when i = 1 then list_sort(list_distinct([10 * ((a + i) % 9), 20])) else [] end as categories from (select *, unnest(range(1, (a + b) % 3 + 1)) as i from sol)),
ts as (select section, max(coalesce(speed, 100)) as speed, coalesce(min(radius), 0) as radius, bool_and(coalesce(contact, '') <> 'Not electrified') as electrified, bool_or(len(categories) = 0 or list_min(categories) <= 60) as passenger from tr group by section),
ed as (select p.src, p.dst, p.line, p.country, greatest(cast(floor(10000e0 * (len / spd)) as bigint), 1) as cost, len as length, spd as speed, el as electrified, p.start_km, p.end_km from
  (select pr.*, round_even(coalesce(sol.length, pr.end_km - pr.start_km), 2) as len, coalesce(ts.speed, 120) as spd, coalesce(ts.electrified, true) as el from pr left join sol on sol.line = pr.line and sol.start_op = pr.src and sol.end_op = pr.dst left join ts on ts.section = sol.section where pr.dst is not null) p),
eg as (select * from ed union all select dst, src, line, country, cost, length, speed, electrified, end_km, start_km from ed),
st as (select 'node/' || c_custkey as url, case c_custkey % 4 when 0 then 'station' when 1 then 'halt' when 2 then 'stop' else 'yard' end as railway, case when c_custkey % 3 = 0 then 'railway' else 'disused' end as prefix,
  case when c_custkey % 5 = 0 then 'X;' || (c_custkey % 50) else cast(c_custkey % 120 as varchar) end as code, 47e0 + (c_custkey % 50) * 0.1e0 + (c_custkey % 7) * 0.004e0 as lat, 6e0 + (c_custkey % 120 * 7 % 25) * 0.1e0 + (c_custkey % 11) * 0.003e0 as lon from customer),
tn as (select 'T' || (o_orderkey % 500) as tunnel, 'DEU' as country, 'L' || lpad(cast(o_orderkey % 40 as varchar), 2, '0') as line, o_totalprice as length, cast(o_orderkey as double) / 10e0 as start_km, o_orderkey as idx, 'LINESTRING (' || (o_orderkey % 20) || '.5 48.25, ' || (o_orderkey % 20) || '.75 48.5)' as wkt from orders),
rt as (select p_partkey as idx, 'L' || lpad(cast(p_partkey % 60 as varchar), 2, '0') as ref, case when p_partkey % 3 = 0 then 'fr:' else 'de:' end || p_name as wikipedia from part)
"""
