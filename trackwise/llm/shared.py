"""Tables in the folder that driver and executors share, and components over links."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import remove, shared_folder


class Scratch:
    """Written tables of one operator call; each write cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", set()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.names.add(name)
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            remove(self.spark, f"{self.root}/{name}")
        self.names -= set(names)

    def keep(self, *names: str) -> None:
        """Remove all tables but these."""
        self.drop(*(self.names - set(names)))

    def close(self) -> None:
        """Remove all tables of the call."""
        remove(self.spark, self.root)


def labelled_sample(texts: DataFrame, known: DataFrame, scratch: Scratch, rows: int, chars: int) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """(text, label) of at most ``rows`` labelled documents with ``chars`` characters together, and how many have either label.

    texts (doc_id, text), known (doc_id, label 0 or 1), a row each. Both classes have a half, in the order of a hash of the
    doc_id, texts of more than a fiftieth of ``chars`` last. All texts are read once: those of the first ``rows`` ids are written.
    """
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    halves = [known.where(F.col("label") == label).orderBy(order, "doc_id").limit(rows // 2) for label in (0, 1)]
    picked = [(r["doc_id"], r["label"]) for r in halves[0].unionByName(halves[1]).collect()]
    chosen = texts.sparkSession.createDataFrame(picked, "doc_id long, label int")
    held = scratch.write(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")
    within, total = [], [0, 0]
    for r in held.select("doc_id", "label", F.length("text").alias("n"), order.alias("at")).orderBy(F.col("n") > chars // 50, "at", "doc_id").collect():
        if total[r["label"]] + r["n"] <= chars // 2:
            total[r["label"]] += r["n"]
            within.append((r["doc_id"],))
    kept = held.join(F.broadcast(texts.sparkSession.createDataFrame(within, "doc_id long")), "doc_id").orderBy(order, "doc_id").collect()
    return [(r["text"], r["label"]) for r in kept], (counts.get(0, 0), counts.get(1, 0))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to Python in batches of about 8 MB and at most 1000 rows, which bounds buffers on both sides; for what runs inside only."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(column: str) -> str:
    """A column's name as an identifier, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of an undirected link table (a, b); component is the smallest node reached.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their roots by pointer doubling, and contracts the links to roots; the
    number of nodes at least halves. All tables stay distributed.
    """
    edges = scratch.write(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    nodes, step = None, 0
    while not edges.isEmpty():
        step += 1
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
        hooks, turn = scratch.write(hooks, f"{name}-h{step}-0"), 0
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("upper"))
            turn += 1
            jumped = scratch.write(hooks.join(up, "root").select("node", F.col("upper").alias("root"), (F.col("upper") != F.col("root")).alias("moved")), f"{name}-h{step}-{turn}")
            done = jumped.where("moved").isEmpty()
            hooks = jumped.select("node", "root")
            if done:
                break
        if nodes is None:
            nodes = hooks
        else:
            nodes = nodes.join(hooks.select(F.col("node").alias("root"), F.col("root").alias("upper")), "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
        low = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        high = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = scratch.write(edges.join(low, "a").join(high, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-e{step}")
    if nodes is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return scratch.write(nodes.select("node", F.col("root").alias("component")), f"{name}-cc")
