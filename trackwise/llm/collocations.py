"""Phrase collocations by hashed bucket counts (PCY, DHP) and Apriori pruning.

Pass k over the texts (k = 1 to 4) does two things at once:

* it counts the k-word phrases that can still be frequent, exactly: both (k-1)-word
  phrases inside must be frequent (Apriori) and so must the phrase's hash bucket,
  which the pass before has counted (PCY);
* it counts hash buckets of the (k+1)-word phrases whose k-word parts may be
  frequent (DHP), a number from 0 to ``least`` for each of ``BUCKETS`` buckets.

Bucket counts become a bitmap of buckets with ``least`` or more occurrences, and
the frequent k-word phrases another; these two, of BUCKETS bits each at any size of
the corpus, are all that is broadcast. Both only say "perhaps" too often, never too
rarely, so phrases are counted by their own words and every count is exact. On a
corpus so large that all buckets fill, pruning is left to Apriori.

Texts are cut to words in Python, a batch at a time, and equal phrases of a batch
are added up there; all that follows (sums, cuts, containment, ranks) is joins and
aggregates by (lang, phrase). Ranks are taken in parts of each language first.

Defined cases: null text is empty, null lang is ``und``; rows count one by one,
whatever their doc_id, so repeated rows count repeatedly; empty texts and texts
without words add nothing; an empty table gives an empty result; phrases of equal
score and count are in the byte order of their text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, small_batches
from .textkernel import mix, sequence_hashes

LONGEST = 4
BUCKETS, CHUNK = 1 << 24, 1 << 16
#: stands between pieces and texts; no byte of UTF-8
EDGE = b"\xff"
CUT = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))
#: counts have chunk -1, others are bucket counts of a chunk: places and numbers, or with n = 1 a number for each place
PASS = "chunk int, lang string, phrase binary, n long"


class _Words(dict):
    """word -> its number in this task (0: the edge of a piece), with its fingerprint."""

    def __init__(self) -> None:
        super().__init__({EDGE: 0})
        self.names, self.prints = [EDGE], np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        number = len(self.names)
        if number == len(self.prints):
            self.prints = np.concatenate([self.prints, np.zeros_like(self.prints)])
        self.prints[number] = xxhash.xxh3_64_intdigest(word)
        self.names.append(word)
        self[word] = number
        return number

    def of(self, texts: list[bytes]) -> np.ndarray:
        cut = EDGE.join(texts).translate(CUT).replace(EDGE, b" \xff ").split()
        return np.fromiter(map(self.__getitem__, cut), np.int64, len(cut))


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    out: dict = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
        out.setdefault(lang, []).append(text)
    return out


def _buckets(prints: np.ndarray, k: int, lang: str) -> np.ndarray:
    """Bucket of each k consecutive words of a language."""
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=k))
    with np.errstate(over="ignore"):
        return (mix(sequence_hashes(prints, k)[0] ^ seed) >> np.uint64(40)).astype(np.int64)


def _has(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8) & 1).astype(bool)


def _inside(numbers: np.ndarray, k: int) -> np.ndarray:
    """Whether k consecutive words hold no edge."""
    edges = np.cumsum(np.concatenate([[0], numbers == 0]))
    return edges[k:] == edges[: len(edges) - k]


def _distinct(numbers: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the k-word phrases at these places, one place of each and how many there are."""
    key = numbers[at]
    for j in range(1, k):
        if j > 1:  # two numbers of 32 bits always fit, so longer phrases are numbered anew
            key = np.unique(key, return_inverse=True)[1]
        key = (key << 32) | numbers[at + j]
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    return at[first], times


def _chunks(counts: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
    """(chunk, payload, whether dense) of the bucket counts that aren't 0."""
    for chunk in range(len(counts) // CHUNK):
        part = counts[chunk * CHUNK : (chunk + 1) * CHUNK]
        at = np.flatnonzero(part)
        if 3 * len(at) >= CHUNK:
            yield chunk, part.tobytes(), 1
        elif len(at):
            yield chunk, at.astype("<u2").tobytes() + part[at].tobytes(), 0


def _chunk_rows(counts: np.ndarray) -> pa.RecordBatch | None:
    rows = list(_chunks(counts))
    if not rows:
        return None
    chunk, payload, dense = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.nulls(len(rows), pa.string()), pa.array(payload, pa.binary()), pa.array(dense, pa.int64())], ["chunk", "lang", "phrase", "n"])


def _add(counts: np.ndarray, buckets: np.ndarray, most: int) -> None:
    at, times = np.unique(buckets, return_counts=True)
    counts[at] = np.minimum(counts[at] + times, most)


def _count_rows(lang: str, phrases: list[bytes], times: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), pa.array([lang] * n, pa.string()), pa.array(phrases, pa.binary()), pa.array(times, pa.int64())], ["chunk", "lang", "phrase", "n"])


def _pass(k: int, least: int, shipped, most_words: int = 1_000_000):
    """Counts of k-word phrases and of the buckets of (k+1)-word phrases; at most ``most_words`` words are numbered at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, singles = _Words(), {}
        counts = np.zeros(BUCKETS if k < LONGEST else 0, np.uint8)
        maps = shipped.value if shipped else None

        def words_so_far() -> Iterator[pa.RecordBatch]:
            for lang, times in singles.items():
                at = np.flatnonzero(times)
                for low in range(0, len(at), 50_000):
                    some = at[low : low + 50_000]
                    yield _count_rows(lang, [words.names[i] for i in some], times[some])

        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                numbers = words.of(texts)
                n = len(numbers) - k + 1
                if n <= 0:
                    continue
                prints = words.prints[numbers]
                alive = _inside(numbers, k)
                if k == 1:
                    times = np.bincount(numbers, minlength=len(words.names))
                    times[0] = 0
                    old = singles.get(lang, times[:0])
                    times[: len(old)] += old
                    singles[lang] = times
                else:
                    part = _has(maps[0], _buckets(prints, k - 1, lang))
                    alive &= part[:n] & part[1 : n + 1]
                    alive[alive] = _has(maps[1], _buckets(prints, k, lang)[alive])
                    at, times = _distinct(numbers, np.flatnonzero(alive), k)
                    for low in range(0, len(at), 50_000):
                        some = at[low : low + 50_000]
                        columns = [[words.names[i] for i in numbers[some + j]] for j in range(k)]
                        yield _count_rows(lang, [b" ".join(x) for x in zip(*columns, strict=True)], times[low : low + 50_000])
                if k < LONGEST and n > 1:
                    _add(counts, _buckets(prints, k + 1, lang)[alive[:-1] & alive[1:]], least)
            if len(words.names) > most_words:
                yield from words_so_far()
                words, singles = _Words(), {}
        yield from words_so_far()
        if (rows := _chunk_rows(counts)) is not None:
            yield rows

    return run


def _marks(k: int, least: int):
    """Bucket counts with ``least`` for each given phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint8)
        for batch in batches:
            by: dict = {}
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True):
                by.setdefault(lang, []).extend(map(xxhash.xxh3_64_intdigest, phrase.split(b" ")))
            for lang, prints in by.items():
                counts[_buckets(np.array(prints, np.uint64).reshape(-1, k), k, lang)[:, 0]] = least
        if (rows := _chunk_rows(counts)) is not None:
            yield rows

    return run


def _summed(least: int):
    """(chunk, bits of its buckets with ``least`` or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict = {}
        for batch in batches:
            for chunk, payload, dense in zip(batch["chunk"].to_pylist(), batch["phrase"].to_pylist(), batch["n"].to_pylist(), strict=True):
                total = totals.setdefault(chunk, np.zeros(CHUNK, np.uint8))
                if dense:
                    total[:] = np.minimum(total + np.frombuffer(payload, np.uint8), least)
                else:
                    size = len(payload) // 3
                    at = np.frombuffer(payload, "<u2", size)
                    total[at] = np.minimum(total[at] + np.frombuffer(payload, np.uint8, size, 2 * size), least)
        if totals:
            bits = [np.packbits(t >= least, bitorder="little").tobytes() for t in totals.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(bits, pa.binary())], ["chunk", "bits"])

    return run


def _bitmap(counts: DataFrame, least: int) -> np.ndarray:
    """Bits of all buckets; a row of 8 KB for each of the 256 chunks comes to the driver."""
    out = np.zeros(BUCKETS // 8, np.uint8)
    for row in counts.where("chunk >= 0").repartition("chunk").mapInArrow(_summed(least), "chunk int, bits binary").collect():
        out[row["chunk"] * CHUNK // 8 : (row["chunk"] + 1) * CHUNK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = 30) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, f) of the phrases of 1 to 4 words with f >= least, and (lang, n) of all words."""
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    found, sizes, shipped = [], None, None
    for k in range(1, LONGEST + 1):
        with small_batches(spark):
            counted = scratch.write(texts.mapInArrow(_pass(k, least, shipped), PASS), f"pass{k}")
            sums = counted.where("chunk = -1").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
            found.append(scratch.write(sums.where(F.col("f") >= least), f"frequent{k}"))
            if k == 1:
                sizes = scratch.write(counted.where("chunk = -1").groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
            if shipped:
                shipped.unpersist()
            if k < LONGEST:
                marks = found[-1].select("lang", "phrase").mapInArrow(_marks(k, least), PASS)
                shipped = spark.sparkContext.broadcast((_bitmap(marks, least), _bitmap(counted, least)))
        scratch.drop(f"pass{k}")
    return [f.select("lang", F.col("phrase").cast("string").alias("phrase"), "f") for f in found], sizes


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000, parts: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to 4 words in docs (text, lang).

    A phrase's score is that of its weakest cut in two, floor(2000000 * a / (l + r)); phrases that mostly (``percent``)
    occur inside a longer candidate are left out.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    found, sizes = frequent_phrases(docs, scratch, least)
    every, longer = found[0], found[2].unionByName(found[3])
    for f in found[1:]:
        every = every.unionByName(f)
    candidates = found[1].unionByName(longer).withColumnRenamed("f", "a")

    words = F.split("phrase", " ")
    joined = lambda at, n: f"array_join(slice(w, {at}, {n}), ' ')"
    cuts = candidates.withColumn("w", words).withColumn("cut", F.expr(f"explode(transform(sequence(1, size(w) - 1), k -> struct(k, {joined(1, 'k')} as first, {joined('k + 1', 'size(w)')} as rest)))"))
    cuts = cuts.select("lang", "phrase", "a", F.col("cut.k").alias("k"), F.col("cut.first").alias("first"), F.col("cut.rest").alias("rest"))
    side = lambda name, count: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("score", F.expr("cast(2000000bd * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))

    held = longer.withColumn("w", words).withColumn("phrase", F.expr(f"explode(flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> {joined('i', 'm')}))))"))
    held = held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < percent * wide("a")))
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    some = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
