"""Benchmark decontamination with one FM-index for each shard of the training texts.

A shard is about ``SHARD_WORDS`` words of documents. Words that no phrase with all
its words in the shard has can't be part of an occurrence, so the shard's index
holds only the maximal runs of the other words that are long enough for the
shortest such phrase. The suffix order is built by prefix doubling; phrases are
searched backwards, all at once, through the ranks of a wavelet matrix over the
Burrows-Wheeler transform; occurrences are located by walking to sampled suffix
positions; their word spans are merged per document.

The benchmark is cut into pieces of at most ``PIECE`` words (which share all but
one of a phrase's words with the next piece of the item), and pieces are dealt to
blocks of about ``block_words`` words by a hash. A block is arrays of word numbers,
some 100 bytes for each word. One pass over the texts ships at most ``BLOCKS``
blocks and searches each shard's one index for all of them; a larger benchmark
takes more passes, whose spans are merged afterwards.

Defined cases: null or empty text has no words; an item without words has no
phrase; an item shorter than ``n`` words is one phrase; a null item_id counts as
an item with an empty name; rows are judged row by row, repeated ones and those
without a doc_id too; empty tables give empty results or no hits; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch
from .textkernel import alnum_words

#: words of texts in a shard's index, and documents at most
SHARD_WORDS, SHARD_ROWS = 1 << 19, 20_000
SAMPLE = 8
#: benchmark words in a piece, and blocks in a pass
PIECE, BLOCKS = 4096, 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of a non-negative integer array by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Occurrences of a symbol before a position, one bit plane after another."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.zeros, self.ones, current = [], [], symbols
        for level in reversed(range(self.bits)):
            bit = (current >> level) & 1
            self.ones.append(np.append(0, np.cumsum(bit)).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(at), at.copy()
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


class FMIndex:
    """Index of a symbol array in which 0 ends each run; no phrase contains 0."""

    def __init__(self, text: np.ndarray):
        # the ends of runs get ranks of their own, so that no comparison reaches into the next run
        ends = text == 0
        m = int(ends.sum())
        ranked = text + m
        ranked[ends] = np.arange(m)
        order = suffix_array(ranked)
        self.bwt = text[order - 1]
        self.wavelet = WaveletMatrix(self.bwt)
        counts = np.bincount(text, minlength=2)
        self.before = np.append(0, np.cumsum(counts))
        first = np.append(True, ends[:-1])
        keep = (order % SAMPLE == 0) | first[order]
        self.sample = np.where(keep, order, -1)

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases of one length, searched from their last symbol."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        live = np.arange(len(phrases))
        top = len(self.before) - 1
        for j in reversed(range(phrases.shape[1])):
            c = phrases[live, j]
            seen = c < top
            high[live[~seen]] = low[live[~seen]]
            live, c = live[seen], c[seen]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to the nearest sampled one are added."""
        at, steps, todo = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(todo := todo[self.sample[at[todo]] < 0]):
            c = self.bwt[at[todo]]
            at[todo] = self.before[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
        return self.sample[at] + steps


@dataclass
class Block:
    """Windows of pieces, once each, by length: rows of numbers into ``words``, and the numbers of their items in ``names``."""

    names: list[str]
    words: list[bytes]
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def block_of(pieces: list[tuple[str, str]], n: int) -> Block:
    """pieces: (item, words joined by blanks)."""
    names = sorted({name for name, _ in pieces})
    place, vocabulary = {name: i for i, name in enumerate(names)}, _Numbers(0)
    windows: dict[int, list[np.ndarray]] = {}
    items: dict[int, list[np.ndarray]] = {}
    for name, joined in pieces:
        ids = vocabulary.of(joined.encode("utf-8", "surrogatepass").split(b" "))
        width = min(n, len(ids))
        windows.setdefault(width, []).append(np.lib.stride_tricks.sliding_window_view(ids, width))
        items.setdefault(width, []).append(np.full(len(ids) - width + 1, place[name], np.int32))
    by_length = []
    for width in sorted(windows):
        rows, which = np.unique(np.concatenate(windows[width]), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel().astype(np.int32), np.concatenate(items[width])], 1), axis=0)
        by_length.append((rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1]))
    return Block(names, list(vocabulary), by_length)


class _Numbers(dict):
    """word -> number, in the order of appearance."""

    def __init__(self, first: int):
        super().__init__()
        self.first = first

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + self.first
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _pieces(n: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = alnum_words(text)
                for at in range(0, max(len(words) - n + 1, min(1, len(words))), most):
                    part = words[at : at + most + n - 1]
                    out.append((item, at, b" ".join(part).decode("utf-8", "surrogatepass"), len(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["item", "at", "words", "n"])

    return run


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = int(counts.sum())
    return np.repeat(starts - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(total)


class _Shard:
    """Documents (row, tag, n_words) and their words as numbers from 1; 0 stands between documents."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.numbers, self.size = _Numbers(1), 0

    def add(self, row, tag: int, words: list[bytes]) -> None:
        self.docs.append((row, tag, len(words)))
        self.ids += [self.numbers.of(words), np.zeros(1, np.int32)]
        self.size += len(words)

    def _known(self, blocks: list[Block]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """For each block and length: windows whose words all are in the shard, as its numbers, and their places."""
        out = []
        for block in blocks:
            get = self.numbers.get
            own = np.fromiter((get(w, 0) for w in block.words), np.int32, len(block.words))
            known = []
            for windows, _, _ in block.by_length:
                at = np.flatnonzero((own[windows] > 0).all(axis=1))
                known.append((own[windows[at]], at))
            out.append(known)
        return out

    def search(self, blocks: list[Block]) -> pa.RecordBatch:
        known = self._known(blocks)
        used = np.zeros(len(self.numbers) + 1, bool)
        for block in known:
            for windows, _ in block:
                used[windows.ravel()] = True
        widths = [windows.shape[1] for block in known for windows, _ in block if len(windows)]
        spans, items = [np.zeros((0, 3), np.int64)], [np.zeros((0, 3), np.int64)]
        if widths:
            flat = np.concatenate(self.ids)
            begins = np.cumsum([0, *(len(x) for x in self.ids)])[:-1:2]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], used[flat], [False]])))
            low, high = edge[::2], edge[1::2]
            keep = high - low >= min(widths)
            low, lengths = low[keep], (high - low)[keep] + 1
            if len(low):
                symbol = np.cumsum(used).astype(np.int64) * used
                # each run with the 0, or unused word, that follows it
                text = symbol[flat[_expand(low, lengths)]]
                begin = np.append(0, np.cumsum(lengths)[:-1])
                text[begin + lengths - 1] = 0
                own = np.searchsorted(begins, low, side="right") - 1
                off = low - begins[own]
                index = FMIndex(text)
                for b, block in enumerate(known):
                    for (windows, at), (_, item_at, item) in zip(block, blocks[b].by_length, strict=True):
                        if not len(windows):
                            continue
                        first, last = index.ranges(symbol[windows])
                        hit = np.flatnonzero(last > first)
                        counts = (last - first)[hit]
                        position = index.locate(_expand(first[hit], counts))
                        which = np.repeat(at[hit], counts)
                        run = np.searchsorted(begin, position, side="right") - 1
                        start = position - begin[run] + off[run]
                        spans.append(np.stack([own[run], start, start + windows.shape[1]], 1))
                        sizes = item_at[which + 1] - item_at[which]
                        items.append(np.stack([np.repeat(own[run], sizes), np.full(int(sizes.sum()), b), item[_expand(item_at[which], sizes)]], 1))
        return self._merged(np.concatenate(spans), np.unique(np.concatenate(items), axis=0), blocks)

    def _merged(self, span: np.ndarray, found: np.ndarray, blocks: list[Block]) -> pa.RecordBatch:
        span = span[np.lexsort((span[:, 1], span[:, 0]))]
        starts: list[list[int]] = [[] for _ in self.docs]
        ends: list[list[int]] = [[] for _ in self.docs]
        names: list[set[str]] = [set() for _ in self.docs]
        for d, a, b in span.tolist():
            if ends[d] and a <= ends[d][-1]:
                ends[d][-1] = max(ends[d][-1], b)
            else:
                starts[d].append(a)
                ends[d].append(b)
        for d, block, item in found.tolist():
            names[d].add(blocks[block].names[item])
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in self.docs]), pa.array([x[1] for x in self.docs], pa.int64()), pa.array([x[2] for x in self.docs], pa.int64()), pa.array(starts, ints), pa.array(ends, ints), pa.array([sorted(x) for x in names], pa.list_(pa.string()))],
            ["row", "tag", "n_words", "starts", "ends", "items"],
        )


def _scan(shipped, kind: pa.DataType, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, shard = [s.value for s in shipped], _Shard()

        def searched() -> pa.RecordBatch:
            out = shard.search(blocks)
            return out.set_column(0, "row", out["row"].cast(kind))

        for batch in batches:
            for row, tag, text in zip(*(batch[c].to_pylist() for c in ("row", "tag", "text")), strict=True):
                shard.add(row, tag, alnum_words(text))
                if shard.size >= shard_words or len(shard.docs) >= SHARD_ROWS:
                    yield searched()
                    shard = _Shard()
        if shard.docs:
            yield searched()

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans [starts, ends) by start, those that overlap or touch made one."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    first = np.append(True, starts[1:] > reach[:-1])
    return starts[first], reach[np.append(first[1:], True)]


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted spans of each row merged, in one pass over them."""
    for batch in batches:
        pairs = [merged(np.asarray(a.values), np.asarray(b.values)) if len(a.values) else ((), ()) for a, b in zip(batch["starts"], batch["ends"], strict=True)]
        for name, side in (("starts", 0), ("ends", 1)):
            at = batch.schema.get_field_index(name)
            batch = batch.set_column(at, name, pa.array([pair[side] for pair in pairs], pa.list_(pa.int32())))
        yield batch


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_words: int = 1 << 17, id_type: str = "long", piece_words: int = PIECE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, merged word spans [starts, ends) of all occurrences, and the items (as strings, sorted).

    id_type: "long" or "string", to which doc_id is cast.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "benchmark")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    pieces = scratch.write(items.mapInArrow(_pieces(n, piece_words), "item string, at long, words string, n long"), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    number = F.pmod(F.xxhash64("item", "at"), F.lit(blocks))
    passes = -(-blocks // BLOCKS)
    rows = docs.select(F.col("doc_id").cast(id_type).alias("row"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tag", F.xxhash64("text") if passes > 1 else F.lit(0).cast("long")).select("row", "tag", "text")
    kind = pa.int64() if id_type == "long" else pa.string()
    schema = f"row {id_type}, tag long, n_words long, starts array<int>, ends array<int>, items array<string>"
    found = None
    for first in range(0, blocks, BLOCKS):
        shipped = [spark.sparkContext.broadcast(block_of([(r["item"], r["words"]) for r in pieces.where(number == b).collect()], n)) for b in range(first, min(blocks, first + BLOCKS))]
        hits = rows.mapInArrow(_scan(shipped, kind, shard_words), schema)
        if passes > 1:
            # a pass ends before the next one's blocks are made
            hits = scratch.write(hits, f"pass-{first}")
            for block in shipped:
                block.unpersist()
        found = hits if found is None else found.unionByName(hits)
    if passes > 1:
        # merge the spans of a document again
        spans = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
        found = found.groupBy("row", "tag", "n_words").agg(F.count("*").alias("times"), F.array_sort(spans).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = found.withColumn("copy", F.explode(F.expr(f"sequence(1L, times div {passes})")))
        found = found.select("row", "tag", "n_words", F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends"), "items").mapInArrow(_merge_spans, schema)
    return found.drop("tag").withColumnRenamed("row", "doc_id")
