"""Shortest and Pareto-optimal paths, as rounds of joins over tables.

Costs go out from the sources along the arcs. A round joins the rows that the last
one changed with the arcs, keeps what is better than before, and writes only that.
Every ``LAYERS`` rounds what was written is merged. Routes are read from the pointers
that searches leave by doubling: each round doubles the hops that are known, so a
route of h hops takes about 2 log2 h joins. Nothing of a graph comes to the driver.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures as m
from ..operators import paths
from ..sources.files import cut, drop_cut, read_gr, scratch, small_batches

#: rows that a task of a line gives away at a time, parts of the questions about a line
ROWS, PARTS = 20_000, 4
#: rounds after which the rows of rounds are merged to one table
LAYERS = 6
#: arcs of a cell of a graph, which one task searches at a time
CELL_ARCS = 1_000_000


def _cells(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, cell): connected pieces of about ``CELL_ARCS`` arcs (src, dst) at most, with few arcs between them.

    Each round a unit joins the first, by a hash, of itself and the units that it has the most arcs with; what would become
    too large is dealt out by unit and left as it is. A node's arcs stay together, however many. Cells say only what is searched
    together, results don't depend on them.
    """
    if arcs.limit(CELL_ARCS + 1).count() <= CELL_ARCS:
        return nodes.withColumn("cell", F.lit("0"))
    # a node too is weighed
    degree = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
    held = cut(nodes.join(degree, "node", "left").select("node", F.col("node").cast("string").alias("unit"), (F.coalesce("n", F.lit(0)) + 1).alias("weight")))
    a, b = F.col("src").cast("string"), F.col("dst").cast("string")
    links = arcs.where("src <> dst").select(F.inline(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))))
    links, turn = cut(links.groupBy("a", "b").agg(F.count("*").alias("n"))), 0
    while not links.isEmpty():
        turn += 1
        rank = lambda unit: F.struct(F.xxhash64(F.lit(turn), F.col(unit)).alias("h"), F.col(unit).alias("unit"))  # noqa: E731, B023
        strong = links.join(links.groupBy("a").agg(F.max("n").alias("most")), "a").where("2 * n >= most")
        hooks = cut(strong.groupBy(F.col("a").alias("unit")).agg(F.least(F.min(rank("b")), F.first(rank("a")))["unit"].alias("root")))
        while True:
            up = hooks.select(F.col("unit").alias("root"), F.col("root").alias("upper"))
            jumped = cut(hooks.join(up, "root").select("unit", F.col("upper").alias("root"), (F.col("upper") != F.col("root")).alias("moved")))
            drop_cut(hooks)
            hooks = jumped
            if jumped.where("moved").isEmpty():
                break
        weights = held.groupBy("unit").agg(F.sum("weight").alias("weight")).join(hooks.select("unit", "root"), "unit")
        sums = weights.groupBy("root").agg(F.sum("weight").alias("whole"))
        # what is dealt out or more than half of a cell is finished: so a piece, which is closed at half a cell, is a cell at most
        weighed = weights.join(sums, "root").withColumn("deal", F.pmod(F.xxhash64(F.lit("deal"), "unit"), F.ceil(F.col("whole") / CELL_ARCS)))
        before = F.sum("weight").over(Window.partitionBy("root", "deal").orderBy("unit")) - F.col("weight")
        piece = F.when(F.col("whole") > CELL_ARCS, F.concat_ws("/", F.lit(turn), "root", "deal", F.floor(before / (CELL_ARCS / 2))))
        named = cut(weighed.select("unit", F.coalesce(piece, "root").alias("to"), (2 * F.col("whole") <= CELL_ARCS).alias("open")))
        after = cut(held.join(named, "unit", "left").select("node", F.coalesce("to", "unit").alias("unit"), "weight"))
        side = lambda c: named.where("open").select(F.col("unit").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        fewer = cut(links.join(side("a"), "a").join(side("b"), "b").where("a_to <> b_to").groupBy(F.col("a_to").alias("a"), F.col("b_to").alias("b")).agg(F.sum("n").alias("n")))
        for old in (held, links, hooks, named):
            drop_cut(old)
        held, links = after, fewer
    return held.select("node", F.col("unit").alias("cell"))


def _packed_cells(arcs: DataFrame, places: DataFrame) -> DataFrame:
    """(cell, names, begin, head, cost, outer): each cell's nodes in order, their arcs side by side, heads by number: own nodes, then the others of ``outer``."""
    node = arcs.schema["src"].dataType.simpleString()
    own = arcs.join(places.withColumnRenamed("node", "src"), "src").select("cell", "src", "dst", "cost")
    rows = own.unionByName(places.select("cell", F.col("node").alias("src"), F.lit(None).cast(node).alias("dst"), F.lit(None).cast("long").alias("cost")))

    def packed(cell: str, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        names, there = pc.unique(rows["src"]), rows["dst"].is_valid()
        arcs = rows.filter(there)
        mine = pc.index_in(arcs["dst"], names)
        outer = pc.unique(arcs["dst"].filter(mine.is_null()))
        head = pc.coalesce(mine, pc.add(pc.index_in(arcs["dst"], outer), pa.scalar(len(names), pa.int32())))
        # rows come by name, so the arcs of a node are side by side
        tail = pc.index_in(arcs["src"], names).to_numpy(zero_copy_only=False)
        begin = pa.array(np.searchsorted(tail, np.arange(len(names) + 1)), pa.int32())
        whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        return pa.RecordBatch.from_arrays([pa.array([cell]), *[whole(v) for v in (names, begin, head, arcs["cost"], outer)]], ["cell", "names", "begin", "head", "cost", "outer"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts = None, []
        for batch in batches:
            runs = pc.run_end_encode(batch["cell"])
            low = 0
            for c, high in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if c != cell and parts:
                    yield packed(cell, parts)
                    parts = []
                cell = c
                parts.append(batch.slice(low, high - low))
                low = high
        if parts:
            yield packed(cell, parts)

    ordered = rows.repartition("cell").sortWithinPartitions("cell", "src", "dst")
    return cut(ordered.mapInArrow(pack, f"cell string, names array<{node}>, begin array<int>, head array<int>, cost array<long>, outer array<{node}>"))


def _spread(begin: list[int], head: list[int], more: list[int], cost: list, hops: list, starts: list[tuple[int, int, int]]) -> dict[int, tuple[int, int]]:
    """Carries (node, cost, hops) on inside a cell, in place where better; what goes out of it, by number."""
    heap, out, n = [(c, h, at) for at, c, h in starts], {}, len(cost)
    heapq.heapify(heap)
    done = set()
    while heap:
        c, h, at = heapq.heappop(heap)
        if at in done or (cost[at] is not None and (cost[at], hops[at]) <= (c, h)):
            continue
        done.add(at)
        cost[at], hops[at] = c, h
        h += 1
        for i in range(begin[at], begin[at + 1]):
            to, total = head[i], c + more[i]
            if to >= n:
                if to not in out or (total, h) < out[to]:
                    out[to] = (total, h)
            elif cost[to] is None or total < cost[to] or (total == cost[to] and h < hops[to]):
                heapq.heappush(heap, (total, h, to))
    return out


def _least_costs(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, cost, hops): the cheapest cost and the fewest hops of a route of that cost; arcs (src, dst, cost of 0 or more), a row for two nodes.

    A round carries costs on through whole cells of the graph and sends what leaves them to the next ones, so rounds are as
    many as the cells that a route passes, not its hops. A task holds one cell and what is known of it for one source.
    """
    arcs = cut(arcs.where("src is not null and dst is not null").select("src", "dst", F.col("cost").cast("long").alias("cost")))
    sources = cut(sources.select("source").where("source is not null").distinct())
    nodes = arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).union(sources.select("source")).distinct()
    places = cut(_cells(arcs, cut(nodes)))
    cells = _packed_cells(arcs, places)
    node = arcs.schema["src"].dataType.simpleString()
    label = f"array<struct<node: {node}, cost: bigint, hops: int>>"
    part = F.pmod(F.xxhash64("source"), F.lit(arcs.sparkSession.sparkContext.defaultParallelism)).alias("part")
    packed = ("names", "begin", "head", "more", "outer")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = begin = head = more = outer = None
        for batch in batches:
            for i in range(batch.num_rows):
                values = lambda c: _inside(batch[c], i)  # noqa: E731, B023
                if not batch["source"][i].is_valid:
                    # the cell itself comes before what is asked of it
                    names, outer = values("names"), values("outer")
                    begin, head, more = (values(c).to_pylist() for c in ("begin", "head", "more"))
                    continue
                known = batch["cost"][i].is_valid
                cost, hops = (values(c).to_pylist() if known else [None] * len(names) for c in ("cost", "hops"))
                at = values("starts")
                starts = list(zip(pc.index_in(at.field("node"), names).to_pylist(), at.field("cost").to_pylist(), at.field("hops").to_pylist(), strict=True))
                out = _spread(begin, head, more, cost, hops, starts)
                there = outer.take(pa.array([k - len(names) for k in out], pa.int64())).to_pylist()
                sent = [{"node": to, "cost": c, "hops": h} for to, (c, h) in zip(there, out.values(), strict=True)]
                lists = [pa.array([v], pa.list_(t)) for v, t in ((cost, pa.int64()), (hops, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch["source"].slice(i, 1), batch["cell"].slice(i, 1), *lists, pa.array([sent], pa.list_(pa.struct({"node": outer.type, "cost": pa.int64(), "hops": pa.int32()})))], ["source", "cell", "cost", "hops", "sent"])

    def latest() -> DataFrame:
        return reduce(DataFrame.unionByName, layers).groupBy("source", "cell").agg(F.max_by(F.struct("cost", "hops"), "turn").alias("s"), F.max("turn").alias("turn")).select("source", "cell", "s.*", "turn")

    layers: list[DataFrame] = []
    labels, turn = sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(0).alias("hops")), 0
    while True:
        best = labels.groupBy("source", "node").agg(F.min(F.struct("cost", "hops")).alias("b"))
        asked = best.join(places, "node").groupBy("source", "cell").agg(F.collect_list(F.struct("node", "b.cost", "b.hops")).alias("starts"))
        none = [F.lit(None).cast("array<long>").alias("cost"), F.lit(None).cast("array<int>").alias("hops")]
        asked = cut(asked.select("source", "cell", "starts", *none) if not layers else asked.join(latest().drop("turn"), ["source", "cell"], "left").select("source", "cell", "starts", "cost", "hops"))
        if asked.isEmpty():
            break
        wanted = asked.select("cell", part).distinct()
        rows = asked.withColumn("part", part).unionByName(cells.withColumnRenamed("cost", "more").join(wanted, "cell"), allowMissingColumns=True)
        ordered = rows.select("cell", "part", "source", "starts", "cost", "hops", *packed).repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("source").asc_nulls_first())
        found = ordered.mapInArrow(search, f"source {node}, cell string, cost array<long>, hops array<int>, sent {label}")
        with small_batches(arcs.sparkSession):
            layers.append(cut(found.withColumn("turn", F.lit(turn))))
        drop_cut(asked)
        turn += 1
        labels = layers[-1].select("source", F.inline("sent"))
        if len(layers) > LAYERS:
            merged = cut(latest().withColumn("sent", F.lit(None).cast(label)))
            for layer in layers[:-1]:
                drop_cut(layer)
            layers = [merged, layers[-1]]
    if not layers:
        return sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(0).alias("hops"))
    done = latest().join(cells.select("cell", "names"), "cell").select("source", F.inline(F.arrays_zip("names", "cost", "hops")))
    return done.where("cost is not null").select("source", F.col("names").alias("node"), "cost", "hops")


def shortest_costs(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, cost, pred): cheapest cost from each source to every node and the smallest node before it on such a path.

    Costs are 0 or more, else it is an error. A node before another is cheaper or, behind an arc of cost 0, fewer hops away:
    so circles of cost 0 don't make pointers go round.
    """
    with scratch(edges.sparkSession) as keep:
        cost = F.min("cost").cast("long")
        arcs = cut(edges.groupBy("src", "dst").agg(F.when(cost < 0, F.raise_error(F.lit("a cost is negative")).cast("long")).otherwise(cost).alias("cost")))
        best = cut(_least_costs(arcs, sources.select("source").where("source is not null").distinct()))
        up = best.select("source", F.col("node").alias("src"), F.col("cost").alias("so_far"), F.col("hops").alias("before"))
        into = arcs.withColumnRenamed("cost", "more").join(up, "src").join(best.withColumnRenamed("node", "dst"), ["source", "dst"])
        into = into.where("so_far + more = cost and (more > 0 or before < hops)").groupBy("source", F.col("dst").alias("node")).agg(F.min("src").alias("pred"))
        root = F.when(F.col("node") != F.col("source"), F.col("pred"))
        return keep(cut(best.join(into, ["source", "node"], "left").select("source", "node", "cost", root.alias("pred"))))


def trace(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (id, key) and pointers (key, up) -> (id, key, back): all keys from each start to the end of its pointers, by doubling."""
    with scratch(pointers.sparkSession) as keep:
        levels = [cut(pointers.select("key", "up"))]
        while True:
            one = levels[-1]
            two = cut(one.select("key", F.col("up").alias("via")).join(one.select(F.col("key").alias("via"), "up"), "via").select("key", "up"))
            if two.isEmpty():
                break
            levels.append(two)
        found = cut(starts.select("id", "key", F.lit(0).cast("long").alias("back")))
        for k, level in reversed(list(enumerate(levels))):
            further = found.join(level, "key").select("id", F.col("up").alias("key"), (F.col("back") + (1 << k)).alias("back"))
            found = cut(found.unionByName(further))
        return keep(found)


def _legs(edges: DataFrame, questions: DataFrame) -> DataFrame:
    """(path, leg, a, b) of questions (path, waypoints array) whose points are all known."""
    nodes = edges.select(F.col("src").alias("w")).union(edges.select("dst")).distinct()
    asked = questions.select("path", "waypoints")
    unknown = asked.select("path", F.explode("waypoints").alias("w")).join(nodes, "w", "left_anti").select("path").distinct()
    legs = asked.join(unknown, "path", "left_anti").select("path", F.posexplode(F.expr("transform(sequence(1, greatest(size(waypoints) - 1, 1)), i -> struct(waypoints[i - 1] as a, get(waypoints, i) as b))")).alias("leg", "w"))
    return cut(legs.select("path", "leg", "w.*").where("b is not null"))


def shortest_paths(edges: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (path, waypoints array) -> edges of the routes (path, leg, seq, ...), each hop the cheapest parallel edge.

    A leg that can't be travelled has no rows; fewer than two waypoints have no legs; a route by way of an unknown point is
    empty. One search goes out from each distinct start of a leg.
    """
    edges = cut(edges)
    legs = _legs(edges, questions)
    reached = shortest_costs(edges, legs.select(F.col("a").alias("source")))
    key = lambda source, node: F.struct(source.alias("source"), node.alias("node"))
    pointers = reached.where("pred is not null").select(key(F.col("source"), F.col("node")).alias("key"), key(F.col("source"), F.col("pred")).alias("up"))
    # legs with the same ends are one chain
    starts = legs.select(key(F.col("a"), F.col("b")).alias("key")).distinct().select("key", F.col("key").alias("id"))
    chain = trace(pointers, starts)
    hops = chain.join(pointers, "key").select("id", "back", F.col("up.node").alias("src"), F.col("key.node").alias("dst"))
    hops = legs.withColumn("id", key(F.col("a"), F.col("b"))).join(hops, "id")
    hops = hops.select("path", "leg", F.row_number().over(Window.partitionBy("path").orderBy("leg", F.desc("back"))).alias("seq"), "src", "dst")
    return hops.join(paths.cheapest_edges(edges), ["src", "dst"])


def path_costs(edges: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (path, waypoints array) -> (path, cost): the cost of the edges of ``shortest_paths``, for which no route is followed."""
    edges = cut(edges)
    legs = _legs(edges, questions)
    reached = shortest_costs(edges, legs.select(F.col("a").alias("source")))
    # a leg from a point to itself has no edges
    on = legs.where("a <> b").join(reached.select(F.col("source").alias("a"), F.col("node").alias("b"), "cost"), ["a", "b"])
    return on.groupBy("path").agg(F.sum("cost").cast("long").alias("cost"))


def dijkstra(graph: dict, source: str, target: str) -> list[str]:
    """Nodes of a cheapest path in a small graph, going back by the smallest node each time; empty if there is none."""
    best, ways, before, heap = {source: (0, 0)}, defaultdict(list), {}, [(0, 0, source)]
    while heap:
        cost, hops, node = heapq.heappop(heap)
        if node in before:
            continue
        before[node] = min((n for n, c, h in ways[node] if c > 0 or h < hops), default=None)
        if node == target:
            break
        for head, (c, *_) in graph.get(node, ()):
            new, old = (cost + c, hops + 1), best.get(head)
            if head in before:
                continue
            if old is None or new[0] < old[0]:
                ways[head].clear()
            if old is None or new < old:
                best[head] = new
                heapq.heappush(heap, (*new, head))
            if new[0] == best[head][0]:
                ways[head].append((node, c, hops))
    trail = [target] if target in before else []
    while trail and (up := before[trail[-1]]) is not None:
        trail.append(up)
    return trail[::-1]


def _fronts(width: int, among: bool):
    """Of rows sorted by (key, costs, fresh), the fresh ones that no row before them beats; if not ``among``, only the others beat.

    Rows before have no larger first cost, so of two costs the least second one so far decides, of three a staircase of the
    second and third, which is searched by halves; a task holds the staircase of one key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, steps = None, ([], [])

        def beaten(c: list[int]) -> bool:
            if width == 1:
                return bool(steps[0])
            if width > 3:
                return any(all(a <= b for a, b in zip(s, c[1:], strict=True)) for s in steps[0])
            i = bisect_right(steps[0], c[1])
            return i > 0 and (width == 2 or steps[1][i - 1] <= c[2])

        def settle(c: list[int]) -> None:
            second, third = steps
            if width in (1, 2):
                second[:] = [c[-1]]
            elif width > 3:
                second.append(c[1:])
            else:
                i = j = bisect_left(second, c[1])
                while j < len(second) and third[j] >= c[2]:
                    j += 1
                second[i:j], third[i:j] = [c[1]], [c[2]]

        for batch in batches:
            keep = []
            for at, (k, c, fresh) in enumerate(zip(batch["key"].to_pylist(), batch["costs"].to_pylist(), batch["fresh"].to_pylist(), strict=True)):
                if k != key:
                    key, steps = k, ([], [])
                if beaten(c):
                    continue
                if fresh:
                    keep.append(at)
                if among or not fresh:
                    settle(c)
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def _unbeaten(rows: DataFrame, width: int, among: bool = True) -> DataFrame:
    """rows (key, costs, fresh, ...) -> the fresh ones on the front of their key."""
    ordered = rows.repartition("key").sortWithinPartitions("key", "costs", "fresh")
    return ordered.mapInArrow(_fronts(width, among), ordered.schema)


def _bounds(arcs: DataFrame, targets: DataFrame, width: int) -> DataFrame:
    """(target, node, bound): least costs from each node to each target in every dimension by itself; one backward search for each."""
    found = None
    for d in range(width):
        back = cut(arcs.groupBy(F.col("head").alias("src"), F.col("tail").alias("dst")).agg(F.min(F.col("costs")[d]).alias("cost")))
        one = _least_costs(back, targets.select(F.col("target").alias("source"))).select(F.col("source").alias("target"), "node", F.col("cost").alias(f"b{d}"))
        found = one if found is None else found.join(one, ["target", "node"])
    return cut(found.select("target", "node", F.array(*[f"b{d}" for d in range(width)]).alias("bound")))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def pareto_labels(arcs: DataFrame, questions: DataFrame, counters: dict[str, int] | None = None, bounded: int = 8) -> DataFrame:
    """(source, node, costs, before, so_far): all cost vectors that no other beats, at each node reached, with the label before.

    With at most ``bounded`` distinct targets, labels are dropped whose cost and lower bound are beaten at every target asked
    for, which changes no target's front. Costs are 0 or more. counters takes rounds, labels made and labels kept.
    """
    first = arcs.select(F.size("costs").alias("n")).first()
    width = first["n"] if first else 1
    arcs = cut(arcs.select("tail", "head", F.col("costs").cast("array<long>").alias("costs")).distinct())
    asked = cut(questions.select("source", "target").where("source is not null and target is not null").distinct())
    targets = asked.select("target").distinct()
    bounds = cut(asked.join(_bounds(arcs, targets, width), "target")) if first and targets.limit(bounded + 1).count() <= bounded else None
    tally = {"rounds": 0, "labels": 0, "beyond bounds": 0}
    start = F.array(*[F.lit(0).cast("long")] * width)
    none = [F.lit(None).cast("string").alias("before"), F.lit(None).cast("array<long>").alias("so_far")]
    layers = [cut(asked.select("source").distinct().select("source", F.col("source").alias("node"), start.alias("costs"), *none))]
    key = F.struct("source", "node").alias("key")

    def settled() -> DataFrame:
        every = reduce(DataFrame.unionByName, layers)
        return _unbeaten(every.select(key, "costs", F.lit(True).alias("fresh"), "before", "so_far"), width).select("key.*", "costs", "before", "so_far")

    while True:
        front = layers[-1]
        step = front.select("source", F.col("node").alias("tail"), F.col("costs").alias("so_far")).join(arcs, "tail")
        step = step.groupBy("source", F.col("head").alias("node"), _plus(F.col("so_far"), F.col("costs")).alias("costs")).agg(F.min(F.struct(F.col("tail").alias("before"), "so_far")).alias("way"))
        step = cut(step.select("source", "node", "costs", "way.*"))
        tally["labels"] += (made := step.count())
        if bounds is not None and made:
            # the cost to expect at a target is compared with what is known there
            ahead = step.join(bounds, ["source", "node"]).select(F.struct("source", F.col("target").alias("node")).alias("key"), _plus(F.col("costs"), F.col("bound")).alias("costs"), F.lit(True).alias("fresh"), F.struct("node", "costs").alias("label"))
            known = reduce(DataFrame.unionByName, layers).join(asked.select("source", F.col("target").alias("node")), ["source", "node"], "left_semi")
            # a label at its target is as good as what it will be: equal ones are compared by the front there
            known = known.select(key, "costs", F.lit(False).alias("fresh"), F.struct(F.lit(None).cast("string").alias("node"), F.lit(None).cast("array<long>").alias("costs")).alias("label"))
            hopeful = _unbeaten(known.unionByName(ahead), width, among=False).select("key.source", "label.node", "label.costs").distinct()
            step = cut(step.join(hopeful, ["source", "node", "costs"], "left_semi"))
            tally["beyond bounds"] += made - step.count()
        there = reduce(DataFrame.unionByName, layers).join(step.select("source", "node").distinct(), ["source", "node"], "left_semi")
        rows = there.select(key, "costs", F.lit(False).alias("fresh"), *none).unionByName(step.select(key, "costs", F.lit(True).alias("fresh"), "before", "so_far"))
        fresh = cut(_unbeaten(rows, width).select("key.*", "costs", "before", "so_far"))
        tally["rounds"] += 1
        if fresh.isEmpty():
            break
        layers.append(fresh)
        if len(layers) > LAYERS:
            # the last round's labels go on from here, if nothing beats them meanwhile
            merged = cut(settled())
            going = cut(fresh.join(merged.select("source", "node", "costs"), ["source", "node", "costs"], "left_semi"))
            rest = cut(merged.join(going.select("source", "node", "costs"), ["source", "node", "costs"], "left_anti"))
            layers = [rest, going]
    out = cut(settled())
    if counters is not None:
        counters.update(tally, kept=out.count())
    return out


def pareto_solutions(arcs: DataFrame, questions: DataFrame, most: int | None = None, counters: dict[str, int] | None = None) -> DataFrame:
    """arcs (tail, head, costs) and questions (source, target) -> (source, target, sol, costs, nodes, trail), all of the front, or its first ``most``.

    trail has the costs so far at each node; counters takes rounds, labels, kept and solutions.
    """
    labels = pareto_labels(arcs, questions, counters)
    asked = questions.select("source", "target").distinct()
    front = labels.withColumnRenamed("node", "target").join(asked, ["source", "target"])
    front = front.withColumn("sol", F.row_number().over(Window.partitionBy("source", "target").orderBy("costs")))
    front = cut((front if most is None else front.where(F.col("sol") <= most)).select("source", "target", "sol", "costs"))
    if counters is not None:
        counters["solutions"] = front.count()
    here, up = F.struct("source", "node", "costs"), F.struct("source", F.col("before").alias("node"), F.col("so_far").alias("costs"))
    ends = front.select(F.struct("source", "target", "sol").alias("id"), F.struct("source", F.col("target").alias("node"), "costs").alias("key"))
    chain = trace(labels.where("before is not null").select(here.alias("key"), up.alias("up")), ends)
    way = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), F.col("key.node").alias("node"), F.col("key.costs").alias("costs"))))
    chain = chain.groupBy("id").agg(way.alias("w"))
    return chain.select("id.*", F.element_at("w", -1)["costs"].alias("costs"), F.transform("w", lambda x: x["node"]).alias("nodes"), F.transform("w", lambda x: x["costs"]).alias("trail"))


def _inside(lists: pa.ListArray, row: int) -> pa.StructArray:
    """The values of one row's list."""
    return lists.slice(row, 1).flatten()


def on_lines(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (country, line, path, waypoints) -> edges of the routes that stay on a line; lines are searched in parallel, one at a time in memory.

    Legs from one point of a line are one search; what is found leaves the task by and by.
    """
    own = edges.select("country", "line", "src", "dst", "cost").groupBy("country", "line").agg(F.collect_list(F.struct("src", "dst", "cost")).alias("arcs"))
    part = F.pmod(F.xxhash64("path"), F.lit(PARTS))
    questions = asked.groupBy("country", "line", part.alias("part")).agg(F.collect_list(F.struct("path", "waypoints")).alias("asked"))
    dealt = own.join(questions, ["country", "line"]).select("country", "line", "arcs", "asked").repartition(edges.sparkSession.sparkContext.defaultParallelism)
    names = ["country", "line", "path", "seq", "src", "dst"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                line, own = _Line(_inside(batch["arcs"], i)), _inside(batch["asked"], i)
                paths_, ways = own.field("path"), own.field("waypoints")
                ends = ways.value_lengths().to_pylist()
                points, at, legs, wanted = line.number(ways.flatten()), 0, [], defaultdict(set)
                for n in ends:
                    legs.append(list(zip(points[at : at + n][:-1], points[at : at + n][1:], strict=True)))
                    at += n or 0
                for a, b in (leg for of in legs for leg in of if None not in leg):
                    wanted[a].add(b)
                # a question is answered once all its legs' searches are there; those of one leg go by their start
                trees: dict[int, dict] = {}
                rows: list[tuple] = []
                for q in sorted(range(len(legs)), key=lambda q: [a if a is not None else -1 for a, _ in legs[q]][:1]):
                    seq = 0
                    for a, b in legs[q]:
                        if a is None or b is None:
                            continue
                        if a not in trees:
                            if len(trees) > 1:
                                trees.clear()
                            trees[a] = line.search(a, wanted[a])
                        trail = [b] if b in trees[a] else []
                        while trail and (up := trees[a][trail[-1]]) is not None:
                            trail.append(up)
                        for x, y in zip(trail[::-1][:-1], trail[::-1][1:], strict=True):
                            seq += 1
                            rows.append((q, seq, x, y))
                        if len(rows) >= ROWS:
                            yield found(batch, i, line, paths_, rows)
                            rows = []
                if rows:
                    yield found(batch, i, line, paths_, rows)

    def found(batch: pa.RecordBatch, i: int, line: _Line, paths_: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        q, seq, x, y = (pa.array(c, pa.int32()) for c in zip(*rows, strict=True))
        fixed = [pa.repeat(batch[c][i], len(rows)) for c in ("country", "line")]
        return pa.RecordBatch.from_arrays([*fixed, paths_.take(q), seq, line.names.take(x), line.names.take(y)], names)

    hops = dealt.mapInArrow(run, "country string, line string, path string, seq int, src string, dst string")
    keys = ["country", "line", "src", "dst"]
    cheapest = edges.groupBy(*keys).agg(F.min_by(F.struct("cost", "length", "speed", "electrified", "start_km", "end_km"), F.struct("cost", "length")).alias("e")).select(*keys, "e.*")
    return hops.join(cheapest, keys)


def paths_of_lines(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """The route of each line (country, line, uopids) through its points in order, on its own edges."""
    own = on_lines(edges, lines.select("country", "line", F.concat_ws("/", "country", "line").alias("path"), F.col("uopids").alias("waypoints")))
    return paths.first_edge_fix(own)


def speed_profile(path: DataFrame, edges: DataFrame) -> DataFrame:
    """Compacted paths, each piece replaced by the route on its line between its ends, compacted where the speed is the same."""
    pieces = paths.compact(path).select("country", "line", F.struct("path", "seq").alias("piece"), F.array("src", "dst").alias("waypoints"))
    own = on_lines(edges, pieces.withColumn("path", F.to_json("piece")))
    fast = paths.compact(own, by_speed=True).withColumn("piece", F.from_json("path", "struct<path: string, seq: int>"))
    seq = F.row_number().over(Window.partitionBy("piece.path").orderBy("piece.seq", "seq"))
    return fast.select(F.col("piece.path").alias("path"), seq.alias("seq"), *[c for c in fast.columns if c not in ("path", "seq", "piece")])


def expand(edges: DataFrame) -> DataFrame:
    """Line-change arcs: board (10, 0), ride (0, cost), alight (10, 0), each once, as (tail, head, costs, edge key)."""
    on, off = (F.concat_ws("/", F.col(c), F.col("country"), F.col("line")) for c in ("src", "dst"))
    arc = lambda t, h, line, cost: F.struct(t.alias("tail"), h.alias("head"), F.lit(line).cast("long").alias("line_cost"), cost.cast("long").alias("distance_cost"))
    return edges.select(F.inline(F.array(arc(F.col("src"), on, 10, F.lit(0)), arc(on, off, 0, F.col("cost")), arc(off, F.col("dst"), 10, F.lit(0))))).distinct()


def mo_graph(edges: DataFrame) -> DataFrame:
    """(node, edges) of the multi-criteria graph with all attributes of the edges, each edge once, for export."""
    on, off = (F.concat_ws("/", F.col(c), F.col("country"), F.col("line")) for c in ("src", "dst"))

    def arc(tail, head, line_cost, cost, own: bool):
        zero = {"speed": F.lit(0), "electrified": F.lit(False), "start_km": F.lit(0.0), "end_km": F.lit(0.0), "length": F.lit(0.0)}
        rest = [(F.col(k) if own else v).alias(k) for k, v in zero.items()]
        return F.struct(tail.alias("tail"), head.alias("head"), F.lit(line_cost).cast("long").alias("line_cost"), cost.cast("long").alias("distance_cost"), "line", "country", *rest)

    arcs = edges.select(F.inline(F.array(arc(F.col("src"), on, 10, F.lit(0), False), arc(on, off, 0, F.col("cost"), True), arc(off, F.col("dst"), 10, F.lit(0), False)))).distinct()
    of = [c for c in arcs.columns if c != "tail"]
    return arcs.groupBy(F.col("tail").alias("node")).agg(F.array_sort(F.collect_list(F.struct(*of))).alias("edges"))


def dense_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs with dense node numbers, for graph texts: (arc_id, tail, head, costs). Numbers follow the order of names and of (tail, head, costs).

    Keys are numbered inside ranges whose sizes are added up first, so no task sorts all of them. The arcs, which are read
    for their tails, their heads and themselves, are written first.
    """
    arcs = cut(arcs)
    names = arcs.select(F.col("tail").alias("name")).union(arcs.select("head")).distinct()
    nodes = _dense(names, ["name"], "id")
    side = lambda c: nodes.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    keyed = arcs.join(side("tail"), "tail").join(side("head"), "head").select("tail_id", "head_id", "line_cost", "distance_cost")
    return _dense(keyed, keyed.columns, "arc_id").select("arc_id", F.col("tail_id").alias("tail"), F.col("head_id").alias("head"), F.array("line_cost", "distance_cost").alias("costs"))


def _dense(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with numbers from 0 in the order of the keys: ranges of keys as found by Spark, their sizes added up (a row each), numbers inside."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges are found by a pass of its own, which shouldn't make the rows again
    df = cut(df)
    ranged = cut(df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))
    drop_cut(df)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    placed = ranged.withColumn("_at", number).join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return cut(placed.withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before"))


def reverse_index(arcs: DataFrame) -> DataFrame:
    """arcs (arc_id, tail, head, costs) with each arc's place among the arcs into its head and out of its tail, checked against the degrees."""
    into, out = Window.partitionBy("head"), Window.partitionBy("tail")
    placed = arcs.withColumns({"rev_index": F.row_number().over(into.orderBy("arc_id")) - 1, "out_index": F.row_number().over(out.orderBy("arc_id")) - 1, "in_degree": F.count("*").over(into), "out_degree": F.count("*").over(out)})
    ok = (F.col("rev_index") < F.col("in_degree")) & (F.col("out_index") < F.col("out_degree")) & (F.col("tail") >= 0) & (F.col("head") >= 0)
    return placed.where(F.when(ok, True).otherwise(F.raise_error(F.lit("an arc is out of range")).cast("boolean")))


@dataclass(frozen=True)
class Packed:
    """Arcs as arrays, to be read by node without a search through all arcs.

    nodes (chunk, first, degree): of ``size`` consecutive nodes where the arcs of each begin and how many there are; arcs
    (chunk, other, arc, costs): of ``size`` consecutive arcs the node at the other end, the number, the costs. No row holds
    more than ``size`` of them, however many arcs a node has: these go on in the next rows.
    """

    nodes: DataFrame
    arcs: DataFrame
    size: int

    def numbers(self) -> DataFrame:
        """(node): all nodes."""
        return self.nodes.select(F.posexplode("first").alias("i", "first"), "chunk").select((F.col("chunk") * self.size + F.col("i")).alias("node"))

    def arcs_of(self, asked: DataFrame) -> DataFrame:
        """asked (node) -> (node, place, other, arc, costs): the arcs of each, counted from 0; unknown and null nodes have none."""
        size, c = F.lit(self.size).cast("long"), F.col
        asked = asked.select(c("node").cast("long").alias("node")).distinct().withColumn("chunk", F.floor(c("node") / size))
        i = (c("node") - c("chunk") * size).cast("int")
        found = asked.join(self.nodes, "chunk").select("node", F.get("first", i).alias("first"), F.get("degree", i).alias("degree")).where("degree > 0")
        rows = found.withColumn("chunk", F.explode(F.sequence(F.floor(c("first") / size), F.floor((c("first") + c("degree") - 1) / size))))
        begin = F.greatest(c("first") - c("chunk") * size, F.lit(0).cast("long"))
        end = F.least(c("first") + c("degree") - c("chunk") * size, size)
        part = F.slice(F.arrays_zip("other", "arc", "costs"), (begin + 1).cast("int"), (end - begin).cast("int"))
        read = rows.join(self.arcs, "chunk").select("node", (c("chunk") * size + begin - c("first")).alias("before"), F.posexplode(part).alias("at", "x"))
        return read.select("node", (c("before") + c("at")).alias("place"), "x.other", "x.arc", "x.costs")


def turned(arcs: DataFrame) -> DataFrame:
    """arcs (arc_id, tail, head, costs) from head to tail, in the order of heads, with the number they had as ``arc``."""
    back = _dense(arcs.select("head", "arc_id", "tail", "costs"), ["head", "arc_id"], "id")
    return back.select(F.col("id").alias("arc_id"), F.col("head").alias("tail"), F.col("tail").alias("head"), "costs", F.col("arc_id").alias("arc"))


def pack(arcs: DataFrame, size: int = 1024) -> Packed:
    """arcs (arc_id, tail, head, costs) as of ``dense_arcs`` or ``turned``: numbers from 0 without gaps, arcs in the order of tails, else it is an error."""
    arcs = arcs if "arc" in arcs.columns else arcs.withColumn("arc", F.col("arc_id"))
    chunk = lambda number: F.floor(F.col(number) / F.lit(size))

    def whole(number: str) -> Column:
        """Whether a chunk's rows begin where it does and have all numbers to the last."""
        r = F.col("r")
        return (r[0][number] == F.col("chunk") * size) & (F.element_at(r, -1)[number] - r[0][number] == F.size(r) - 1)

    def checked(rows: DataFrame, ok: Column, *columns: Column) -> DataFrame:
        return cut(rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit("numbers of nodes or arcs have gaps, or arcs aren't in the order of tails")).cast("boolean"))).select("chunk", *columns))

    ends = arcs.select(F.col("tail").alias("node")).union(arcs.select("head")).distinct()
    spans = arcs.groupBy(F.col("tail").alias("node")).agg(F.min("arc_id").alias("first"), F.max("arc_id").alias("last"), F.count("*").alias("degree"))
    zero = F.lit(0).cast("long")
    known = ends.join(spans, "node", "left").select("node", F.coalesce("first", zero).alias("first"), F.coalesce("degree", zero).alias("degree"), F.coalesce(F.col("last") - F.col("first") + 1, zero).alias("width"))
    nodes = known.groupBy(chunk("node").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("node", "first", "degree", "width"))).alias("r"))
    rows = arcs.groupBy(chunk("arc_id").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("arc_id", "head", "arc", "costs"))).alias("r"))
    together = F.forall("r", lambda x: x["width"] == x["degree"])
    of = lambda name: F.col(f"r.{name}")
    return Packed(checked(nodes, whole("node") & together, of("first"), of("degree")), checked(rows, whole("arc_id"), of("head").alias("other"), of("arc"), of("costs")), size)


class _Line:
    """One line's arcs (src, dst, cost) as arrays: nodes by number in the order of their names, the arcs out of a node side by side, by head and cost."""

    def __init__(self, arcs: pa.StructArray):
        src, dst = arcs.field("src"), arcs.field("dst")
        names = pc.unique(pa.concat_arrays([src, dst]))
        self.names = names.take(pc.sort_indices(names))
        tail, head = (pc.index_in(c, self.names).to_numpy(zero_copy_only=False) for c in (src, dst))
        order = np.lexsort((arcs.field("cost").to_numpy(zero_copy_only=False), head, tail))
        self.begin = array("q", np.searchsorted(tail[order], np.arange(len(self.names) + 1)).astype(np.int64).tobytes())
        self.head, self.cost = (array("q", v[order].astype(np.int64).tobytes()) for v in (head, arcs.field("cost").to_numpy(zero_copy_only=False)))

    def number(self, names: pa.Array) -> list[int | None]:
        return pc.index_in(names, self.names).to_pylist()

    def least(self, tail: int, head: int) -> int:
        """The cost of the cheapest arc between two neighbours."""
        return self.cost[bisect_left(self.head, head, self.begin[tail], self.begin[tail + 1])]

    def ride(self, starts: pa.StructArray) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Nodes, cheapest costs to them, boarding at any of the starts (cost, node), and where."""
        cost, boarded = [None] * len(self.names), array("q", bytes(8 * len(self.names)))
        heap = [(c, n, n) for c, n in zip(starts.field("cost").to_pylist(), self.number(starts.field("node")), strict=True)]
        heapq.heapify(heap)
        while heap:
            so_far, start, node = heapq.heappop(heap)
            if cost[node] is not None:
                continue
            cost[node], boarded[node] = so_far, start
            for i in range(self.begin[node], self.begin[node + 1]):
                if cost[self.head[i]] is None:
                    heapq.heappush(heap, (so_far + self.cost[i], start, self.head[i]))
        costs = pa.array(cost, pa.int64())
        there = costs.is_valid()
        return self.names.filter(there), costs.filter(there), self.names.take(pa.array(np.frombuffer(boarded, np.int64))).filter(there)

    def search(self, start: int, targets: set[int]) -> dict[int, int | None]:
        """Nodes with the smallest before each on a cheapest path, until all targets are found or can't be."""
        best, ways, before, heap, left = {start: (0, 0)}, defaultdict(list), {}, [(0, 0, start)], set(targets)
        while heap and left:
            cost, hops, node = heapq.heappop(heap)
            if node in before:
                continue
            before[node] = min((n for n, c, h in ways.pop(node, ()) if c > 0 or h < hops), default=None)
            left.discard(node)
            for i in range(self.begin[node], self.begin[node + 1]):
                head, c = self.head[i], self.cost[i]
                if head in before:
                    continue
                new, old = (cost + c, hops + 1), best.get(head)
                if old is None or new[0] < old[0]:
                    ways.pop(head, None)
                if old is None or new < old:
                    best[head] = new
                    heapq.heappush(heap, (*new, head))
                if new[0] == best[head][0]:
                    ways[head].append((node, c, hops))
        return before


def pareto_rides(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, runs, cost, country, line, boarded): the front of line runs and cost, each with its last ride.

    A run costs twice 10 on boarding and alighting, so the front of the expanded graph is (20 * runs, cost). A round boards
    every line at the nodes that the round before made cheaper; one line's arcs are in memory at a time. It ends when no
    node gets cheaper, which with costs of 0 or more is at fewer runs than there are nodes.
    """
    arcs = edges.groupBy("src", "dst", "country", "line").agg(F.min("cost").alias("cost"))
    lines = cut(arcs.groupBy("country", "line").agg(F.collect_list(F.struct("src", "dst", "cost")).alias("arcs")))
    stops = cut(arcs.select("country", "line", F.col("src").alias("node")).distinct())

    def ride(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nodes, costs, boarded = _Line(_inside(batch["arcs"], i)).ride(_inside(batch["starts"], i))
                fixed = [pa.repeat(batch[c][i], len(nodes)) for c in ("source", "country", "line")]
                for at in range(0, len(nodes), ROWS):
                    yield pa.RecordBatch.from_arrays([c.slice(at, ROWS) for c in (*fixed, nodes, costs, boarded)], ["source", "country", "line", "node", "new", "boarded"])

    way = [F.lit(None).cast("string").alias(c) for c in ("country", "line", "boarded")]
    best = front = cut(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("runs"), F.lit(0).cast("long").alias("cost"), *way).distinct())
    found, runs = [front], 0
    while True:
        runs += 1
        boarded = front.select("source", "node", "cost").join(stops, "node").groupBy("source", "country", "line").agg(F.collect_list(F.struct("cost", "node")).alias("starts"))
        # lines are few and dear: deal them out over all cores
        dealt = boarded.join(lines, ["country", "line"]).select("source", "country", "line", "starts", "arcs").repartition(edges.sparkSession.sparkContext.defaultParallelism)
        step = dealt.mapInArrow(ride, "source string, country string, line string, node string, new long, boarded string")
        step = step.groupBy("source", "node").agg(F.min(F.struct("new", "country", "line", "boarded")).alias("n"))
        known = reduce(DataFrame.unionByName, found).groupBy("source", "node").agg(F.min("cost").alias("cost"))
        better = step.join(known, ["source", "node"], "left").where(F.col("cost").isNull() | (F.col("n.new") < F.col("cost")))
        front = cut(better.select("source", "node", F.lit(runs).alias("runs"), F.col("n.new").alias("cost"), "n.country", "n.line", "n.boarded"))
        if front.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(front)


def pareto_front(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, runs, cost): cheapest cost with at most each number of line runs, where one more run is cheaper."""
    return pareto_rides(edges, sources).select("source", "node", "runs", "cost")


def pareto_answers(rides: DataFrame, questions: DataFrame, most: int | None = None) -> DataFrame:
    """(source, target, sol, runs, cost): solutions of ``pareto_rides`` to each question, or their first ``most``; no route is followed."""
    asked = questions.select("source", "target").distinct()
    sol = F.row_number().over(Window.partitionBy("source", "target").orderBy("runs"))
    front = rides.withColumnRenamed("node", "target").join(asked, ["source", "target"]).withColumn("sol", sol)
    return (front if most is None else front.where(F.col("sol") <= most)).select("source", "target", "sol", "runs", "cost")


def pareto_costs(edges: DataFrame, questions: DataFrame) -> DataFrame:
    """(source, target, sol, costs) of ``pareto_routes``, for which no route is followed."""
    front = pareto_answers(pareto_rides(edges, questions.select("source").distinct()), questions)
    return front.select("source", "target", "sol", F.array((F.col("runs") * 20).cast("long"), "cost").alias("costs"))


def _rides_back(rides: DataFrame, front: DataFrame) -> DataFrame:
    """(id, runs, country, line, boarded, node, cost, so_far): the rides of solutions (source, target, sol, runs), each with its own cost and that of the rides before."""
    here, up = F.struct("source", "node", "runs"), F.struct("source", F.col("boarded").alias("node"), (F.col("runs") - 1).alias("runs"))
    ends = front.select(F.struct("source", "target", "sol").alias("id"), F.struct("source", F.col("target").alias("node"), "runs").alias("key"))
    chain = trace(rides.where("runs > 0").select(here.alias("key"), up.alias("up")), ends)
    before = rides.select("source", F.col("node").alias("boarded"), (F.col("runs") + 1).alias("runs"), F.col("cost").alias("so_far"))
    known = rides.where("runs > 0").join(before, ["source", "boarded", "runs"]).withColumn("cost", F.col("cost") - F.col("so_far"))
    return chain.select("id", "key.*").join(known, ["source", "node", "runs"]).select("id", "runs", "country", "line", "boarded", "node", "cost", "so_far")


def pareto_legs(edges: DataFrame, questions: DataFrame) -> DataFrame:
    """(source, target, sol, seq, country, line, src, dst, cost): the rides of the solutions of ``pareto_routes`` in their order, without the nodes between."""
    rides = cut(pareto_rides(edges, questions.select("source").distinct()))
    legs = _rides_back(rides, cut(pareto_answers(rides, questions)))
    return legs.select("id.*", F.col("runs").alias("seq"), "country", "line", F.col("boarded").alias("src"), F.col("node").alias("dst"), "cost")


def _ridden(edges: DataFrame, asked: DataFrame, listed: bool) -> DataFrame:
    """asked (country, line, boarded, node) -> with what the costs along the ride on its line add up to and whether they rise (``total``, ``rises``).

    If ``listed``, with the ride's nodes in the line-change graph and the costs so far instead (``stops``, ``costs``). A task holds a line; rides
    from one point are one search, whose costs are added up once a node, so without lists the work doesn't grow with the rides' lengths.
    """
    own = edges.select("country", "line", "src", "dst", "cost").groupBy("country", "line").agg(F.collect_list(F.struct("src", "dst", "cost")).alias("arcs"))
    part = F.pmod(F.xxhash64("boarded", *(["node"] if listed else [])), F.lit(PARTS))
    questions = asked.groupBy("country", "line", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("boarded", "node"))).alias("asked"))
    dealt = own.join(questions, ["country", "line"]).select("country", "line", "arcs", "asked").repartition(edges.sparkSession.sparkContext.defaultParallelism)
    found = {"stops": pa.list_(pa.string()), "costs": pa.list_(pa.int64())} if listed else {"total": pa.int64(), "rises": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                line, own = _Line(_inside(batch["arcs"], i)), _inside(batch["asked"], i)
                stops = pc.binary_join_element_wise(line.names, batch["country"][i], batch["line"][i], "/") if listed else None
                starts, ends = (line.number(own.field(c)) for c in ("boarded", "node"))
                wanted = defaultdict(set)
                for a, b in zip(starts, ends, strict=True):
                    wanted[a].add(b)
                at, before, total, rises = None, {}, {}, {}
                rows, ways, sums, sizes = [], array("q"), array("q"), []
                for row, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    if a != at:
                        at, before, total, rises = a, line.search(a, wanted[a]), {a: 0}, {a: True}
                        # a node comes after the one before it
                        for node, up in before.items():
                            if up is not None:
                                step = line.least(up, node)
                                total[node], rises[node] = total[up] + step, rises[up] and step >= 0
                    if b not in before:
                        continue
                    rows.append(row)
                    if listed:
                        trail = [b]
                        while (up := before[trail[-1]]) is not None:
                            trail.append(up)
                        trail.reverse()
                        ways.extend(trail)
                        sums.extend([total[n] for n in trail])
                        sizes.append(len(trail))
                    else:
                        sums.append(total[b])
                        sizes.append(rises[b])
                    if len(sums) >= ROWS:
                        yield told(batch, i, own, rows, stops, ways, sums, sizes)
                        rows, ways, sums, sizes = [], array("q"), array("q"), []
                if rows:
                    yield told(batch, i, own, rows, stops, ways, sums, sizes)

    def told(batch: pa.RecordBatch, i: int, own: pa.StructArray, rows: list[int], stops: pa.Array | None, ways: array, sums: array, sizes: list) -> pa.RecordBatch:
        values = [pa.array(np.frombuffer(sums, np.int64)), pa.array(sizes)]
        if listed:
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            values = [pa.ListArray.from_arrays(ends, v) for v in (stops.take(pa.array(np.frombuffer(ways, np.int64))), values[0])]
        own = own.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*[pa.repeat(batch[c][i], len(rows)) for c in ("country", "line")], own.field("boarded"), own.field("node"), *[v.cast(t) for v, t in zip(values, found.values(), strict=True)]], ["country", "line", "boarded", "node", *found])

    kinds = "stops array<string>, costs array<bigint>" if listed else "total bigint, rises boolean"
    return dealt.mapInArrow(run, f"country string, line string, boarded string, node string, {kinds}")


RIDE = ["country", "line", "boarded", "node"]


def pareto_routes(edges: DataFrame, questions: DataFrame, most: int | None = None) -> DataFrame:
    """questions (source, target) -> (source, target, sol, costs, nodes, trail) in the line-change graph of ``expand``, without building it.

    The solutions are those of ``pareto_rides``; a solution's rides are followed back run by run, and each distinct ride is
    a route on its own line, which comes as one list: solutions are put together from lists.
    """
    edges = cut(edges.select("src", "dst", "country", "line", "cost"))
    rides = cut(pareto_rides(edges, questions.select("source").distinct()))
    front = cut(pareto_answers(rides, questions, most))
    legs = cut(_rides_back(rides, front).drop("cost"))
    ridden = _ridden(edges, legs.select(*RIDE).distinct(), listed=True)
    change = F.col("runs").cast("long") * 20
    cost = lambda c: F.col("so_far") + c
    nodes = F.concat("stops", F.array("node"))
    trail = F.concat(F.transform("costs", lambda c: F.array(change - 10, cost(c))), F.array(F.array(change, cost(F.element_at("costs", -1)))))
    ways = legs.join(ridden, RIDE).select("id", F.struct("runs", nodes.alias("nodes"), trail.alias("trail")).alias("s")).groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("w"))
    ways = front.select(F.struct("source", "target", "sol").alias("id")).join(ways, "id", "left")
    none = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    whole = lambda first, of: F.concat(F.array(first), F.coalesce(F.flatten(F.col(f"w.{of}")), F.array()))
    out = ways.select("id.*", whole(F.col("id.source"), "nodes").alias("nodes"), whole(none, "trail").alias("trail"))
    return out.select("source", "target", "sol", F.element_at("trail", -1).alias("costs"), "nodes", "trail")


def pareto_sums(edges: DataFrame, questions: DataFrame, most: int | None = None) -> DataFrame:
    """(source, target, sol, costs, adds_up): the solutions of ``pareto_routes``, and whether the costs along their nodes rise to these and end at the target.

    The costs along a ride are those of all rides from the same point, so they are added up once for all and no route is listed.
    """
    edges = cut(edges.select("src", "dst", "country", "line", "cost"))
    rides = cut(pareto_rides(edges, questions.select("source").distinct()))
    front = cut(pareto_answers(rides, questions, most))
    legs = cut(_rides_back(rides, front).drop("cost", "so_far"))
    added = legs.join(_ridden(edges, legs.select(*RIDE).distinct(), listed=False), RIDE)
    legs = added.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("runs", "boarded", "node", "total", "rises"))).alias("w"))
    found = front.select(F.struct("source", "target", "sol").alias("id"), "runs", "cost").join(legs, "id", "left")
    w = F.coalesce("w", F.array())
    # each ride goes on where the one before ended
    joined = F.concat(F.array("id.source"), F.transform(w, lambda x: x["node"])) == F.concat(F.transform(w, lambda x: x["boarded"]), F.array("id.target"))
    adds_up = joined & (F.size(w) == F.col("runs")) & F.forall(w, lambda x: x["rises"]) & (F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + x["total"]) == F.col("cost"))
    return found.select("id.*", F.array((F.col("runs") * 20).cast("long"), "cost").alias("costs"), adds_up.alias("adds_up"))


def route_legs(solutions: DataFrame, edges: DataFrame) -> DataFrame:
    """Solutions of ``pareto_routes`` -> (source, target, sol, seq, src, dst, line, ...): what is ridden, runs of one line as one edge.

    Boarding and alighting are no rows, so a solution from a point to itself has none; a hop is the cheapest edge of its line.
    """
    hop = F.expr("transform(sequence(2, greatest(size(nodes), 2)), i -> struct(i - 1 as at, nodes[i - 2] as a, get(nodes, i - 1) as b))")
    steps = solutions.select(F.struct("source", "target", "sol").alias("path"), F.inline(hop))
    a, b = m.mo_node_parts(F.col("a")), m.mo_node_parts(F.col("b"))
    rides = steps.where(a.isNotNull() & b.isNotNull()).select("path", F.col("at").alias("seq"), a["op"].alias("src"), b["op"].alias("dst"), a["country"].alias("country"), a["line"].alias("line"))
    keys = ["src", "dst", "country", "line"]
    cheapest = edges.groupBy(*keys).agg(F.min_by(F.struct("cost", "length", "speed", "electrified", "start_km", "end_km"), F.struct("cost", "length")).alias("e")).select(*keys, "e.*")
    legs = paths.compact(rides.join(cheapest, keys))
    return legs.select("path.*", *[c for c in legs.columns if c != "path"])


def choose_solution(front: DataFrame, percent: float) -> DataFrame:
    """Of each question's solutions (question, sol, cost): the one for a tolerance. Solutions are in ascending line cost."""
    by = Window.partitionBy("question")
    s = front.withColumns({"n": F.count("*").over(by), "first_cost": F.min_by("cost", "sol").over(by), "last_cost": F.max_by("cost", "sol").over(by), "last": F.max("sol").over(by), "one": F.min("sol").over(by)})
    within = F.min(F.when(F.col("cost") <= F.col("last_cost") * (1 + percent / 100), F.col("sol"))).over(by)
    s = s.withColumn("within", within)
    if percent <= 0:
        pick = F.col("last")
    else:
        first = F.lit(percent >= 100) | (F.col("n") == 2) | (F.col("first_cost") <= F.col("last_cost"))
        pick = F.when(F.col("n") == 1, F.col("one")).when(first, F.col("one")).otherwise(F.coalesce("within", "one"))
    return s.where(F.col("sol") == pick).select("question", "sol", "cost")


def search_gr(spark: SparkSession, path: str, source: int, target: int, most: int | None = 1000, counters: dict[str, int] | None = None) -> DataFrame:
    """(sol, seq, node, costs): the first ``most`` solutions (None: all) between two nodes of a graph text, with the costs so far."""
    arcs = read_gr(spark, path).select(F.col("tail").cast("string").alias("tail"), F.col("head").cast("string").alias("head"), "costs")
    asked = spark.range(1).select(F.lit(str(source)).alias("source"), F.lit(str(target)).alias("target"))
    found = pareto_solutions(arcs, asked, most, counters).select("sol", F.posexplode(F.arrays_zip("nodes", "trail")).alias("seq", "x"))
    return found.select("sol", "seq", F.col("x.nodes").cast("long").alias("node"), F.col("x.trail").alias("costs"))


def path_of_line(edges: DataFrame, country: str, line: str) -> DataFrame:
    """Edges along a line in order of kilometre."""
    own = edges.where((F.col("country") == country) & (F.col("line") == line) & (F.col("start_km") < F.col("end_km")))
    seq = F.row_number().over(Window.partitionBy("line").orderBy("start_km", "src"))
    return paths.first_edge_fix(own.select(F.lit(line).alias("path"), seq.alias("seq"), *own.columns))
