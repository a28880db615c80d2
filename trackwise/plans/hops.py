"""Pareto-optimal paths over two costs and the number of hops.

Every label of a round has one hop more than those of the round before, so what a round keeps is final: only labels with as
many hops or fewer beat a label, and of these all are known. Nodes are dealt to parts by ranges of their numbers. A task
holds a part: its arcs, the least second cost by first cost at each of its nodes, and the labels of the last round with their
routes. A round sends candidates to the parts of their heads, after those of one task that beat each other are gone;
the parts themselves stay where they are. What is found leaves for a table every few rounds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import cut, drop_cut, remove, shared_folder, small_batches
from .search import _dense

#: arcs of a part, and arcs from which a part is worth a task of its own
PART_ARCS, FEW_ARCS = 100_000, 5_000
#: bits of the sums of a cost, and of the numbers of (source, node) in a part
COST_BITS, PLACE_BITS = 44, 18
#: candidates made at a time
CANDIDATES = 2_000_000
#: rounds after which labels are written and parts are checkpointed
ROUNDS = 16
#: bytes of routes that leave a task at a time
ROUTE_BYTES = 1 << 22


@dataclass
class _Labels:
    """Labels of as many hops in the order of (place, first, second): places number (source, node) in a part; routes have a row of names each."""

    place: np.ndarray
    first: np.ndarray
    second: np.ndarray
    routes: np.ndarray


@dataclass
class _Sent:
    """Candidates from a part; ``rows`` are the labels there that they go on from, ``routes`` those labels' routes if they are another part's."""

    part: int
    place: np.ndarray
    first: np.ndarray
    second: np.ndarray
    rows: np.ndarray
    routes: np.ndarray | None = None


@dataclass
class _Graph:
    """A part's nodes and their arcs side by side: ``lowest`` is its first node's number, heads are numbered in the whole graph."""

    part: int
    lowest: int
    names: np.ndarray
    begin: np.ndarray
    head: np.ndarray
    first: np.ndarray
    second: np.ndarray
    starts: np.ndarray


@dataclass
class _State:
    """What a part knows: its staircase in the order of ``key`` (place and first cost), the last round's labels, what goes on from them."""

    key: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    second: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    found: _Labels | None = None
    own: list[_Sent] = field(default_factory=list)
    sent: list[tuple[int, _Sent]] = field(default_factory=list)

    def open(self, key: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which labels nothing of the staircase beats."""
        if not len(self.key):
            return np.ones(len(key), bool)
        at = np.searchsorted(self.key, key, side="right") - 1
        step = np.maximum(at, 0)
        return (at < 0) | (self.key[step] >> COST_BITS != key >> COST_BITS) | (self.second[step] > second)

    def settle(self, key: np.ndarray, second: np.ndarray) -> None:
        at = np.searchsorted(self.key, key)
        key, second = np.insert(self.key, at, key), np.insert(self.second, at, second)
        keep = _least(key >> COST_BITS, second)
        self.key, self.second = key[keep], second[keep]


def _own(part: int) -> int:
    return part


def _keys(place: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    if len(first) and (max(first.max(), second.max()) >> COST_BITS or place.max() >> PLACE_BITS):
        raise ValueError(f"a sum of costs has more than {COST_BITS} bits, or a part's sources and nodes more than {PLACE_BITS}")
    return (place << COST_BITS) | first


def _least(place: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of rows in the order of places and first costs, those with a second cost below all before them at their place."""
    lower = second - (place << COST_BITS)
    keep = np.ones(len(lower), bool)
    keep[1:] = lower[1:] < np.minimum.accumulate(lower)[:-1]
    return keep


def _front(key: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Rows on the front of their place, in order; the first of equal ones."""
    order = np.lexsort((second, key))
    return order[_least(key[order] >> COST_BITS, second[order])]


def _candidates(graph: _Graph, state: _State, parts: int, nodes: int) -> Iterator[_Sent]:
    """What one more hop makes of the labels found, by the part of the head (as ``part``)."""
    found, size = state.found, len(graph.names)
    node = found.place % size
    degree = graph.begin[node + 1] - graph.begin[node]
    made = np.cumsum(degree)
    bounds = [0, *np.unique(np.searchsorted(made, np.arange(CANDIDATES, made[-1] if len(made) else 0, CANDIDATES), side="right")), len(node)]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        d = degree[low:high]
        rows = np.repeat(np.arange(low, high), d)
        arc = np.arange(len(rows)) + np.repeat(graph.begin[node[low:high]] - (np.cumsum(d) - d), d)
        head = graph.head[arc]
        to = head * parts // nodes
        order = np.argsort(to, kind="stable")
        ends = np.flatnonzero(np.diff(to[order], append=-1)) + 1
        for at, end in zip(np.append(0, ends)[: len(ends)], ends, strict=True):
            of = order[at:end]
            part, row, a = int(to[of[0]]), rows[of], arc[of]
            lowest, above = -(-part * nodes // parts), -(-(part + 1) * nodes // parts)
            place = found.place[row] // size * (above - lowest) + head[of] - lowest
            first, second = found.first[row] + graph.first[a], found.second[row] + graph.second[a]
            key = _keys(place, first, second)
            if part == graph.part:
                there = state.open(key, second)
                place, first, second, row, key = place[there], first[there], second[there], row[there], key[there]
            keep = _front(key, second)
            if len(keep):
                yield _Sent(part, place[keep], first[keep], second[keep], row[keep])


def _round(parts: int, nodes: int):
    """A part's next round: of the candidates for it those that nothing beats, and the candidates that they make."""

    def run(records: Iterable) -> Iterator[tuple[int, _State]]:
        graph, state, came = None, None, []
        for _, value in records:
            if isinstance(value, _Graph):
                graph = value
            elif isinstance(value, _State):
                state = value
            else:
                came.append(value)
        if graph is None:
            return
        if state is None:
            state = _State()
            zero = np.zeros(len(graph.starts), np.int64)
            came.append(_Sent(-1, graph.starts, zero, zero, np.arange(len(zero)), np.empty((len(zero), 0), "S1")))
        # of equal labels the one with the first node before it stays: parts, and a part's labels, are in the order of nodes
        came = sorted(came + state.own, key=lambda s: (s.part, *s.rows[:1]))
        place, first, second = (np.concatenate([getattr(s, c) for s in came] or [np.empty(0, np.int64)]) for c in ("place", "first", "second"))
        key = _keys(place, first, second)
        there = np.flatnonzero(state.open(key, second))
        there = there[_front(key[there], second[there])]
        before = [state.found.routes if s.routes is None else s.routes for s in came]
        hops = max((r.shape[1] for r in before), default=0)
        routes = np.empty((len(there), hops + 1), np.result_type(graph.names.dtype, *[r.dtype for r in before]))
        begin = 0
        for s, r in zip(came, before, strict=True):
            mine = np.flatnonzero((there >= begin) & (there < begin + len(s.place)))
            at = there[mine] - begin
            routes[mine, :hops] = r[s.rows[at] if s.routes is None else at]
            begin += len(s.place)
        routes[:, hops] = graph.names[place[there] % len(graph.names)]
        state.found = _Labels(place[there], first[there], second[there], routes)
        if len(there):
            state.settle(key[there], second[there])
        state.own, state.sent = [], []
        for s in _candidates(graph, state, parts, nodes):
            if s.part == graph.part:
                state.own.append(s)
            else:
                state.sent.append((s.part, _Sent(graph.part, s.place, s.first, s.second, s.rows, routes[s.rows])))
        yield graph.part, state

    return run


def _found(record: tuple[int, _State]) -> Iterator[bytes]:
    """The labels of a part's last round, in pieces."""
    f = record[1].found
    size = max(1, ROUTE_BYTES // max(1, f.routes.shape[1] * f.routes.itemsize))
    for at in range(0, len(f.first), size):
        yield pickle.dumps((f.first[at : at + size], f.second[at : at + size], f.routes[at : at + size]), protocol=5)


def _strings(names: np.ndarray) -> pa.Array:
    """Padded names as strings."""
    flat = np.ascontiguousarray(names).reshape(-1)
    length = np.char.str_len(flat)
    letters = flat.view(np.uint8).reshape(len(flat), flat.itemsize)
    data = letters if (length == flat.itemsize).all() else letters[np.arange(flat.itemsize) < length[:, None]]
    ends = np.zeros(len(flat) + 1, np.int32)
    np.cumsum(length, out=ends[1:])
    return pa.StringArray.from_buffers(len(flat), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in batch["piece"]:
            first, second, routes = pickle.loads(piece.as_buffer())
            n, width = routes.shape
            costs = np.stack([first, np.full(n, width - 1), second], axis=1).reshape(-1)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w), pa.int32()), v) for w, v in ((3, pa.array(costs, pa.int64())), (width, _strings(routes)))]
            yield pa.RecordBatch.from_arrays([_strings(routes[:, 0]), _strings(routes[:, -1]), *lists], ["source", "target", "costs", "nodes"])


def _written(spark: SparkSession, pieces: list[RDD]) -> DataFrame:
    rows = spark.sparkContext.union(pieces).coalesce(pieces[0].getNumPartitions()).map(lambda piece: (piece,))
    with small_batches(spark):
        return cut(spark.createDataFrame(rows, "piece binary").mapInArrow(_unpacked, "source string, target string, costs array<bigint>, nodes array<string>"))


def _packed(arcs: DataFrame, nodes: DataFrame, starts: DataFrame, parts: int, count: int) -> RDD:
    """(part, _Graph) of arcs (tail, head, first, second) and numbered nodes (name, id) and starts (name, id)."""
    none = lambda kind, *c: [F.lit(None).cast(kind).alias(n) for n in c]
    side = lambda c: nodes.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    own = nodes.join(starts.withColumnRenamed("id", "start"), "name", "left").select("id", *none("long", "head", "first", "second"), "name", "start")
    rows = arcs.join(side("tail"), "tail").join(side("head"), "head").select(F.col("tail_id").alias("id"), F.col("head_id").alias("head"), "first", "second", *none("string", "name"), *none("long", "start"))
    rows = own.unionByName(rows).withColumn("part", F.expr(f"cast(id * {parts} div {count} as int)"))

    def pack(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("head", "ascending"), ("first", "ascending"), ("second", "ascending")])
        is_node = rows["name"].is_valid()
        own, arcs = rows.filter(is_node), rows.filter(rows["name"].is_null())
        number, tail = own["id"].to_numpy(), arcs["id"].to_numpy()
        names = [n.encode() for n in own["name"].to_pylist()]
        if any(n.endswith(b"\0") for n in names):
            raise ValueError("a name ends with a zero character")
        begin = np.searchsorted(tail, np.append(number, number[-1] + 1))
        start = own["start"].fill_null(-1).to_numpy()
        places = start[start >= 0] * len(names) + np.flatnonzero(start >= 0)
        graph = _Graph(key[0].as_py(), int(number[0]), np.array(names), begin, *(arcs[c].to_numpy() for c in ("head", "first", "second")), places)
        return pa.table({"part": pa.array([graph.part], pa.int32()), "packed": pa.array([pickle.dumps(graph, protocol=5)], pa.binary())})

    packed = rows.groupBy("part").applyInArrow(pack, "part int, packed binary")
    return packed.rdd.map(lambda r: (r["part"], pickle.loads(r["packed"])))


def pareto_by_hops(arcs: DataFrame, questions: DataFrame) -> DataFrame:
    """arcs (tail, head, costs) of two costs and questions (source, target) -> (source, target, sol, costs, nodes): the fronts of (first cost, hops, second cost).

    Costs are 0 or more and their sums below 2^44, else it is an error. Of routes with equal costs the one whose last node but one is the smallest stays,
    then the one with the least costs there. Rounds are as many as the hops of the longest route.
    """
    spark = arcs.sparkSession
    asked = cut(questions.select("source", "target").where("source is not null and target is not null").distinct())
    cost = lambda i: F.when(F.col("costs")[i].between(0, (1 << COST_BITS) - 1), F.col("costs")[i].cast("long")).otherwise(F.raise_error(F.lit(f"a cost is negative, null or has more than {COST_BITS} bits")).cast("long"))
    arcs = cut(arcs.where("tail is not null and head is not null").select("tail", "head", cost(0).alias("first"), cost(1).alias("second")).distinct())
    sources = asked.select(F.col("source").alias("name")).distinct()
    nodes = _dense(arcs.select(F.col("tail").alias("name")).union(arcs.select("head")).union(sources).distinct(), ["name"], "id")
    starts = _dense(sources, ["name"], "id")
    count, of_arcs, of_starts = nodes.count(), arcs.count(), starts.count()
    if not of_starts:
        return spark.createDataFrame([], "source string, target string, sol int, costs array<bigint>, nodes array<string>")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    parts = min(count, max(-(-of_arcs // PART_ARCS), -(-(of_starts * count) // (1 << PLACE_BITS - 1)), min(context.defaultParallelism, 1 + of_arcs // FEW_ARCS)))
    run = _round(parts, count)
    graph = _packed(arcs, nodes, starts, parts, count).partitionBy(parts, _own).persist(StorageLevel.MEMORY_AND_DISK)
    state, kept, pieces, tables, more, turn = None, None, [], [], True, 0
    while more:
        sent = [] if state is None else [state, state.flatMap(lambda r: r[1].sent).partitionBy(parts, _own)]
        records = graph
        for other in sent:
            records = records.union(other)
        after = records.mapPartitions(run, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        turn += 1
        if turn % ROUNDS == 0:
            after.checkpoint()
        pieces.append(after.flatMap(_found).persist(StorageLevel.MEMORY_AND_DISK))
        more = pieces[-1].count() > 0
        if state is not None:
            state.unpersist()
        state = after
        if turn % ROUNDS == 0 or not more:
            tables.append(_written(spark, pieces))
            for piece in pieces:
                piece.unpersist()
            # nothing goes back behind this round any more
            if kept:
                remove(spark, kept)
            pieces, kept = [], state.getCheckpointFile()
    for held in (state, graph):
        held.unpersist()
    if kept:
        remove(spark, kept)
    for table in (arcs, nodes, starts):
        drop_cut(table)
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table)
    sol = F.row_number().over(Window.partitionBy("source", "target").orderBy("costs"))
    return found.join(asked, ["source", "target"]).select("source", "target", sol.alias("sol"), "costs", "nodes")
