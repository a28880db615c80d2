"""Compression of vectors to codes of four bytes: product codebooks by Elkan's form of Lloyd's algorithm.

Components become integers, so distances, ties and means are exact. A vector is cut
into ``PARTS`` equal parts; each part has a codebook of up to ``ENTRIES`` entries.
The table of a round holds, for each vector and part, the entry it has, an upper
bound of the distance to it, and a lower bound of the distance to every entry. When
entries move, the bounds are shifted by how far each moved. An entry is passed over
only if its lower bound, or half its distance from the entry at hand, is strictly
above the upper bound; what is left is decided by exact squared distances, equal
ones for the lower index. Bounds are rounded outwards (lower bounds to 16 bits), so
rounding costs a comparison at most and never a result.

Each round is a written table of the vectors, made from the one before; sums of the
parts by entry are added up in the tasks and then by Spark, and what comes to the
driver are the codebooks: PARTS * ENTRIES rows of a part's length at any size.

Defined cases: rows whose vector is null or holds null or non-finite components are
dropped; rows with a null vec_id come after all others when entries are first
chosen, and rows with one vec_id in the order of their vectors; with fewer than 256
vectors there are as many entries; vectors of another length than the one with the
smallest vec_id, or of a length that isn't a multiple of four, stay in the result
without code and errors; components of 2^18 and above in size are an error, as
their squares would not fit; an empty table gives an empty result; labels that are
null count as one label; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, small_batches

PARTS, ENTRIES, SCALE = 4, 256, 1024
#: largest size of a component times SCALE
MOST = 1 << 28
STATE = "vec_id long, label int, x array<int>, a array<int>, upper array<float>, lower binary, checked long"


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, x): rows with finite vectors, as integers."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * SCALE))
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sized = F.when(F.exists("x", lambda v: F.abs(v) >= MOST), F.raise_error(F.lit("a component is too large"))).otherwise(F.col("x").cast("array<int>"))
    return rows.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), x.alias("x")).withColumn("x", sized)


def _above(x: np.ndarray) -> np.ndarray:
    """Upper bounds in 32 bits."""
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    """Lower bounds in 16 bits, 0 at least."""
    return np.maximum(np.nextafter(np.minimum(x * (1 - 1e-12), 65504).astype(np.float16), np.float16(-np.inf)), np.float16(0))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(-1)


def first_bounds(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, upper bound, lower bounds of each part (n x d) by all distances."""
    found = np.stack([squared(x, entry) for entry in book], 1)
    a = found.argmin(1)
    return a, _above(np.sqrt(found[np.arange(len(x)), a])), _below(np.sqrt(found))


def next_bounds(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, moved: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after entries moved, and how many distances were taken; half: half the distances between entries."""
    a, upper = a.copy(), _above(upper.astype(np.float64) + moved[a])
    lower = _below(np.maximum(lower.astype(np.float64) - moved, 0))

    def near(rows: np.ndarray) -> np.ndarray:
        out = (lower[rows] <= upper[rows, None]) & (half[a[rows]] <= upper[rows, None])
        out[np.arange(len(rows)), a[rows]] = False
        return out

    rows = np.arange(len(x))
    rows = rows[near(rows).any(1)]
    own = squared(x[rows], book[a[rows]])
    upper[rows], lower[rows, a[rows]] = _above(np.sqrt(own)), _below(np.sqrt(own))
    i, j = np.nonzero(near(rows))
    found = squared(x[rows[i]], book[j])
    lower[rows[i], j] = _below(np.sqrt(found))
    known = np.full((len(rows), len(book)), np.iinfo(np.int64).max)
    known[np.arange(len(rows)), a[rows]], known[i, j] = own, found
    a[rows] = known.argmin(1)
    upper[rows] = _above(np.sqrt(known.min(1))) if len(rows) else upper[rows]
    return a, upper, lower, len(rows) + len(i)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.ravel(), kind))


def _parts(batch: pa.RecordBatch) -> np.ndarray:
    """PARTS x n x width."""
    n = batch.num_rows
    return batch["x"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, PARTS, -1).transpose(1, 0, 2)


def _assign(shipped, first: bool):
    """A round's table from (vec_id, label, x) or the table before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved, half = shipped.value
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                parts, entries, checked = _parts(batch), len(books[0]), 0
                if first:
                    found = [first_bounds(x, book) for x, book in zip(parts, books, strict=True)]
                    checked = len(parts[0]) * entries * PARTS
                else:
                    a = batch["a"].flatten().to_numpy().reshape(-1, PARTS)
                    upper = batch["upper"].flatten().to_numpy().reshape(-1, PARTS)
                    lower = np.frombuffer(b"".join(batch["lower"].to_pylist()), np.float16).reshape(-1, PARTS, entries)
                    found = []
                    for p, x in enumerate(parts):
                        *bounds, taken = next_bounds(x, a[:, p], upper[:, p], lower[:, p], books[p], moved[p], half[p])
                        found.append(bounds)
                        checked += taken
                a, upper, lower = (np.stack(c, 1) for c in zip(*found, strict=True))
                share = np.zeros(batch.num_rows, np.int64)
                share[0] = checked
                columns = [batch["vec_id"], batch["label"], batch["x"], _lists(a, pa.int32()), _lists(upper, pa.float32()), pa.array([row.tobytes() for row in lower], pa.binary()), pa.array(share)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x", "a", "upper", "lower", "checked"])

    return run


def _sums(entries: int):
    """(cell, total): sums of the parts by part, entry and position, with the count at the position behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for batch in batches:
            parts, a = _parts(batch), batch["a"].flatten().to_numpy().reshape(-1, PARTS)
            if totals is None:
                totals = np.zeros((PARTS, entries, parts.shape[2] + 1), np.int64)
            for p in range(PARTS):
                np.add.at(totals[p, :, :-1], a[:, p], parts[p])
                totals[p, :, -1] += np.bincount(a[:, p], minlength=entries)
        if totals is not None:
            used = np.repeat(totals[:, :, -1].ravel() > 0, totals.shape[2])
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(used)), pa.array(totals.ravel()[used])], ["cell", "total"])

    return run


def _moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of its parts' mean; unused entries stay."""
    parts, entries, width = books.shape
    sums = state.select("x", "a").mapInArrow(_sums(entries), "cell long, total long").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total, out = {r["cell"]: int(r["total"]) for r in sums.collect()}, books.copy()
    for slot in range(parts * entries):
        if count := total.get(slot * (width + 1) + width):
            out[slot // entries, slot % entries] = [total[slot * (width + 1) + i] // count for i in range(width)]
    return out


def _geometry(books: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codebooks, how far entries moved (rounded up), half the distances between entries (rounded down)."""
    moved = np.sqrt(squared(books, before)) * (1 + 1e-12)
    half = np.stack([np.sqrt(np.stack([squared(book, entry) for entry in book])) * (0.5 - 1e-12) for book in books])
    return books, moved, half


def encode(rows: DataFrame, rounds: int = 4) -> tuple[DataFrame, np.ndarray | None, list[int]]:
    """(vec_id, label, a, error) of rows (vec_id, embedding, label), the codebooks, and how many distances each round took."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "vector-codes")
    vectors = scratch.write(whole_vectors(rows), "vectors")
    order = [F.asc_nulls_last("vec_id"), F.asc("x")]
    one = vectors.orderBy(*order).select(F.size("x").alias("n")).first()
    none = lambda df: df.select("vec_id", "label", F.lit(None).cast("array<int>").alias("a"), F.lit(None).cast("long").alias("error"))
    if one is None or one["n"] == 0 or one["n"] % PARTS:
        return none(vectors), None, []
    fitting = vectors.where(F.size("x") == one["n"])
    seeds = np.array([r["x"] for r in fitting.orderBy(*order).limit(ENTRIES).collect()], np.int64)
    books = seeds.reshape(len(seeds), PARTS, -1).transpose(1, 0, 2).copy()
    state, before, taken = fitting, books, []
    with small_batches(spark):
        for turn in range(rounds + 1):
            shipped = spark.sparkContext.broadcast(_geometry(books, before))
            state = scratch.write(state.mapInArrow(_assign(shipped, turn == 0), STATE), f"round{turn}")
            taken.append(state.agg(F.sum("checked")).first()[0])
            shipped.unpersist()
            if turn:
                scratch.drop(f"round{turn - 1}")
            if turn < rounds:
                before, books = books, _moved_books(state, books)
    shipped = spark.sparkContext.broadcast(books)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch["a"].flatten().to_numpy().reshape(-1, PARTS)
            error = sum(squared(x, book[a[:, p]]) for p, (x, book) in enumerate(zip(_parts(batch), shipped.value, strict=True)))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["a"], pa.array(error)], ["vec_id", "label", "a", "error"])

    with small_batches(spark):
        coded = scratch.write(state.select("vec_id", "label", "x", "a").mapInArrow(errors, "vec_id long, label int, a array<int>, error long"), "coded")
    return coded.unionByName(none(vectors.where(F.size("x") != one["n"]))), books, taken


def code_table(rows: DataFrame, rounds: int = 4) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes of two hexadecimal digits for each part."""
    coded, books, _ = encode(rows, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("a", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
