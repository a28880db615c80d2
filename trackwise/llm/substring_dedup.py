"""Substring deduplication over a log-structured fingerprint index.

A window is ``window`` consecutive words. Its fingerprint is the smallest hash
of the word grams of half its length, so equal windows have equal fingerprints
and neighbouring windows mostly share one: a document has about one fingerprint
per fourteen windows.

The index is a log in a folder that outlives a call. ``add`` takes a batch of
documents, which come after all documents added before:

1. Its (fingerprint, doc_id) postings become a sorted run, not yet committed, dealt
   to buckets by fingerprint.
2. The run's keys are merge-joined with those of the earlier runs, bucket by bucket:
   only the batch's keys are shuffled. A key that an earlier run or another document
   of the batch has is repeated.
3. Windows with a repeated fingerprint are verified: by 128 bits of the hash of
   their whole word sequence, against those of the batch and of the earlier
   documents that share a fingerprint, whose texts the caller's corpus has.
4. The verified result is written, then the run is committed by one renaming.

So a call that is lost leaves the log as it was. ``compact`` merges the runs into
one and leaves out documents that only copy an earlier one; it is called by ``add``
when there are more than ``max_runs``. A batch whose doc_ids don't come after all
earlier ones, and a corpus without a text that is needed, are errors. What it replaces counts
as removed from the moment of its commit, and is deleted then or by the next call.

A document whose whole word sequence an earlier one has (128-bit hash of its
text's words) loses all words without looking at its windows.

Defined cases: null or empty text has no words and no windows; a text with
fewer words than a window loses nothing; rows with one doc_id are judged
separately and don't remove each other's words; a null doc_id is compared with
nothing and keeps all its words; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import file_system, remove, shared_folder
from .shared import Scratch
from .textkernel import WordLanes, blank_words, sequence_hashes, signed, sliding_min

#: words that are hashed at once, unless one text has more
CHUNK = 1 << 16
POSTING = "h long, g long, doc_id long, whole boolean"
KEY = ["h", "g", "whole"]


def _whole(words: list[bytes]) -> tuple[int, int]:
    """128-bit identity of a word sequence, as two signed numbers."""
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _chunks(rows: Iterator[tuple], text_at: int) -> Iterator[list[tuple]]:
    """Lists of (row, words) with about ``CHUNK`` words together."""
    held, size = [], 0
    for row in rows:
        words = blank_words(row[text_at])
        held.append((row, words))
        size += len(words)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _hashed(chunk: list[tuple], cache: WordLanes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a chunk one after another: where each text begins, window fingerprints, and both lanes of window hashes.

    Values at windows that reach over the end of a text mean nothing.
    """
    starts = np.cumsum([0, *(len(words) for _, words in chunk)])
    lanes = cache.of([w for _, words in chunk for w in words])
    gram = window // 2
    grams, windows = sequence_hashes(lanes, gram, window)
    n = max(0, lanes.shape[1] - window + 1)
    prints = sliding_min(grams[0], window - gram + 1) if n else np.empty(0, np.uint64)
    return starts, prints, windows[:, :n]


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch[c].to_pylist() for c in names), strict=True)


def _postings(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordLanes()
        for batch in batches:
            for chunk in _chunks(((d, t) for d, t in _rows(batch, "doc_id", "text") if d is not None), 1):
                starts, prints, _ = _hashed(chunk, cache, window)
                hs, gs, ids, whole = [], [], [], []
                for ((doc, _), words), start in zip(chunk, starts.tolist(), strict=False):
                    if len(words) < window:
                        continue
                    found = np.unique(prints[start : start + len(words) - window + 1])
                    h, g = _whole(words)
                    hs += [signed(found), np.array([h], np.int64)]
                    gs += [np.zeros(len(found), np.int64), np.array([g], np.int64)]
                    ids.append(np.full(len(found) + 1, doc, np.int64))
                    whole.append(np.arange(len(found) + 1) == len(found))
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, gs, ids, whole)], ["h", "g", "doc_id", "whole"])

    return run


def _prepare(window: int):
    """A row for each document; those with repeated fingerprints keep their text for the windows to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, shared, copy_of in _rows(batch, "doc_id", "text", "shared", "copy_of"):
                words = blank_words(text)
                seq = _whole(words) if shared or copy_of else (0, 0)
                copy = bool(copy_of) and seq in {(c["h"], c["g"]) for c in copy_of}
                live = bool(shared) and not copy and len(words) >= window
                kept = b"" if copy else b" ".join(words)
                out.append((doc, seq[0] if live else 0, len(words), len(words) if copy else 0, None if live else hashlib.sha256(kept).hexdigest(), text if live else None, shared if live else None))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "seq", "n_words", "n_removed", "kept_sha256", "text", "shared"])

    return run


def _windows(window: int):
    """Hashes of the windows whose fingerprint is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordLanes()
        for batch in batches:
            for chunk in _chunks(_rows(batch, "doc_id", "seq", "text", "shared"), 2):
                starts, prints, windows = _hashed(chunk, cache, window)
                parts: list[list[np.ndarray]] = [[], [], [], [], []]
                for ((doc, seq, _, shared), words), start in zip(chunk, starts.tolist(), strict=False):
                    n = max(0, len(words) - window + 1)
                    at = np.flatnonzero(np.isin(signed(prints[start : start + n]), np.array(shared, np.int64)))
                    for part, x in zip(parts, (signed(windows[0, start + at]), signed(windows[1, start + at]), np.full(len(at), doc, np.int64), np.full(len(at), seq, np.int64), at.astype(np.int32)), strict=True):
                        part.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], ["k1", "k2", "doc_id", "seq", "pos"])

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, gone, sha, text, at in _rows(batch, "doc_id", "n_words", "n_removed", "kept_sha256", "text", "at"):
                spans: list[list[int]] = []
                if text is not None:
                    words = blank_words(text)
                    for p in sorted(at or ()):
                        if spans and p <= spans[-1][1]:
                            spans[-1][1] = p + window
                        else:
                            spans.append([p, p + window])
                    kept, end = [], 0
                    for a, b in spans:
                        kept += words[end:a]
                        end = b
                    kept += words[end:]
                    gone, sha = n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()
                elif gone:
                    spans = [[0, n]]
                out.append((doc, n, gone, sha, [s[0] for s in spans], [s[1] for s in spans]))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "starts", "ends"])

    return run


class FingerprintLog:
    """Sorted immutable runs ``run-<first batch>-<last batch>`` in a folder, each with its postings and the doc_ids of mere copies."""

    def __init__(self, spark: SparkSession, root: str, window: int = 50, max_runs: int = 4, buckets: int | None = None):
        """buckets: of the runs to be written, as many as the session has shuffle partitions unless given."""
        self.spark, self.root, self.window, self.max_runs = spark, root.rstrip("/"), window, max_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: set[str] = set()

    def runs(self) -> list[tuple[int, int]]:
        """Committed runs, without those that a larger one replaces (which are deleted)."""
        system, at = file_system(self.spark, self.root)
        names = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
        found = [(int(m[1]), int(m[2])) for n in names if (m := re.fullmatch(r"run-(\d+)-(\d+)", n))]
        live = [r for r in found if not any(r != o and o[0] <= r[0] and r[1] <= o[1] for o in found)]
        for r in set(found) - set(live):
            remove(self.spark, self._path(r))
        return sorted(live)

    def _path(self, run: tuple[int, int]) -> str:
        return f"{self.root}/run-{run[0]:08d}-{run[1]:08d}"

    def _write_postings(self, postings: DataFrame, path: str) -> None:
        """Postings dealt to buckets by fingerprint and sorted inside them; the number of buckets is in the folder's name."""
        name = f"trackwise_{uuid.uuid4().hex}"
        dealt = postings.repartition(self.buckets, *KEY).write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY, "doc_id")
        dealt.option("path", f"{path}/postings-{self.buckets}").saveAsTable(name)
        self.spark.sql(f"drop table {name}")

    def _postings_path(self, run: tuple[int, int]) -> str:
        system, at = file_system(self.spark, self._path(run))
        return next(f"{self._path(run)}/{n}" for f in system.listStatus(at) if (n := f.getPath().getName()).startswith("postings-"))

    def _postings_of(self, run: tuple[int, int]) -> DataFrame:
        """A run as a bucketed table, which joins by fingerprint without a shuffle of its rows."""
        path = self._postings_path(run)
        name = f"trackwise_{hashlib.md5(path.encode()).hexdigest()}"
        columns = ", ".join(f"{c.split()[0]} {c.split()[1]}" for c in POSTING.replace("long", "bigint").split(", "))
        self.spark.sql(f"create table if not exists {name} ({columns}) using parquet clustered by ({', '.join(KEY)}) sorted by ({', '.join(KEY)}, doc_id) into {path.rpartition('-')[2]} buckets location '{path}'")
        self.tables.add(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Forget the tables of runs; the log itself stays."""
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        self.tables.clear()

    def last(self, runs: list[tuple[int, int]]) -> int | None:
        """The largest doc_id so far."""
        return self._read(runs, "last", "last long").agg(F.max("last")).first()[0]

    def _read(self, runs: list[tuple[int, int]], table: str, schema: str) -> DataFrame:
        paths = [f"{self._path(r)}/{table}" for r in runs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _commit(self, pending: str, run: tuple[int, int]) -> None:
        system, at = file_system(self.spark, pending)
        if not system.rename(at, self.spark._jvm.org.apache.hadoop.fs.Path(self._path(run))):
            raise OSError(f"{pending} can't be renamed")

    def compact(self) -> None:
        """Merge all runs into one."""
        runs = self.runs()
        if len(runs) < 2:
            return
        pending, run = f"{self.root}/pending-{uuid.uuid4().hex}", (runs[0][0], runs[-1][1])
        postings, copies = self.spark.read.schema(POSTING).parquet(*map(self._postings_path, runs)), self._read(runs, "copies", "doc_id long")
        self._write_postings(postings.join(copies, "doc_id", "left_anti").select("h", "g", "doc_id", "whole"), pending)
        copies.limit(0).write.parquet(f"{pending}/copies")
        self._read(runs, "last", "last long").agg(F.max("last").alias("last")).write.parquet(f"{pending}/last")
        self._commit(pending, run)
        self.runs()

    def add(self, docs: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
        """Judge and index a batch; corpus: the texts (doc_id, text) of the documents added before, other rows don't matter.

        doc_id, n_words, n_removed, kept_sha256 and the removed word spans [starts, ends) of each document of the batch.
        """
        runs = self.runs()
        if len(runs) > self.max_runs:
            self.compact()
            runs = self.runs()
        if runs and corpus is None:
            raise ValueError("the texts of earlier documents are needed to verify windows")
        serial = runs[-1][1] + 1 if runs else 0
        pending, scratch = f"{self.root}/pending-{uuid.uuid4().hex}", Scratch(self.spark, "substring-dedup")
        docs = _slim(docs)
        edge = docs.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        first, known = edge.first()["first"], self.last(runs) if runs else None
        if None not in (first, known) and first <= known:
            raise ValueError(f"doc_id {first} doesn't come after {known}, the last one added")
        edge.select("last").write.parquet(f"{pending}/last")
        self._write_postings(docs.mapInArrow(_postings(self.window), POSTING), pending)
        own = self.spark.read.schema(POSTING).parquet(f"{pending}/postings-{self.buckets}")

        keys = own.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).withColumn("old", F.lit(False))
        for run in runs:  # the rows of a run stay where they are, the batch's keys go to them
            there = self._postings_of(run).select(*KEY).distinct().withColumn("there", F.lit(True))
            keys = keys.join(there.hint("merge"), KEY, "left").withColumn("old", F.col("old") | F.coalesce("there", F.lit(False))).drop("there")
        keys = keys.where("old or first < last")
        keys = scratch.write(keys.select(*KEY, "old", "first"), "keys")

        hits = own.join(keys, KEY)
        copies = hits.where("whole and (old or doc_id > first)").select("doc_id", "h", "g")
        by_doc = hits.where("not whole or old or doc_id > first").groupBy("doc_id").agg(
            F.collect_set(F.when(~F.col("whole"), F.col("h"))).alias("shared"), F.collect_set(F.when(F.col("whole"), F.struct("h", "g"))).alias("copy_of")
        )
        rows = docs.join(by_doc, "doc_id", "left").select("doc_id", "text", "shared", "copy_of")
        prepared = scratch.write(rows.mapInArrow(_prepare(self.window), "doc_id long, seq long, n_words long, n_removed long, kept_sha256 string, text string, shared array<long>"), "prepared")
        # doc_ids all of whose rows are copies
        rest = own.where("whole").join(copies.withColumn("copy", F.lit(True)), ["doc_id", "h", "g"], "left").groupBy("doc_id").agg(F.bool_and(F.coalesce("copy", F.lit(False))).alias("copy"))
        rest.where("copy").select("doc_id").write.parquet(f"{pending}/copies")

        shape = "k1 long, k2 long, doc_id long, seq long, pos int"
        windows = prepared.where("text is not null").select("doc_id", "seq", "text", "shared").mapInArrow(_windows(self.window), shape).withColumn("old", F.lit(False))
        if runs:
            shared = keys.where("old and not whole").select(*KEY)
            parts = [self._postings_of(run).join(shared, KEY) for run in runs]
            earlier = reduce(DataFrame.unionByName, parts).join(self._read(runs, "copies", "doc_id long"), "doc_id", "left_anti")
            earlier = scratch.write(earlier.groupBy("doc_id").agg(F.collect_set("h").alias("shared")), "earlier")
            texts = _slim(corpus).join(earlier, "doc_id").select("doc_id", F.lit(0).cast("long").alias("seq"), "text", "shared")
            windows = windows.unionByName(texts.mapInArrow(_windows(self.window), shape).withColumn("old", F.lit(True)))
        windows = scratch.write(windows, "windows")
        if runs:
            # an earlier document that shares a fingerprint has a window of it
            wanted, found = earlier.count(), windows.where("old").select("doc_id").distinct().count()
            if found < wanted:
                raise ValueError(f"the corpus lacks the texts of {wanted - found} earlier documents that are needed")
            scratch.drop("earlier")
        new = F.when(~F.col("old"), F.col("doc_id"))
        first = windows.groupBy("k1", "k2").agg(F.max("old").alias("before"), F.min(new).alias("first"), F.max(new).alias("last"))
        first = scratch.write(first.where("first < last or before and first is not null").select("k1", "k2", "before", "first"), "first")
        removed = windows.where("not old").join(first, ["k1", "k2"]).where("before or doc_id > first").groupBy("doc_id", "seq").agg(F.collect_set("pos").alias("at"))
        final = prepared.drop("shared").join(removed, ["doc_id", "seq"], "left").select("doc_id", "n_words", "n_removed", "kept_sha256", "text", "at")
        final = scratch.write(final.mapInArrow(_remove(self.window), "doc_id long, n_words long, n_removed long, kept_sha256 string, starts array<int>, ends array<int>"), "result")
        self._commit(pending, (serial, serial))
        scratch.drop("keys", "prepared", "windows", "first")
        return final


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def substring_dedup(docs: DataFrame, window: int = 50, cuts: tuple[float, ...] = (0.15, 0.3), max_runs: int = 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word spans [starts, ends) of each document.

    The table is added to a new log in batches of ascending doc_id, which end at the quantiles ``cuts``.
    """
    spark = docs.sparkSession
    log = FingerprintLog(spark, f"{shared_folder(spark)}/substring-log-{uuid.uuid4().hex}", window, max_runs)
    docs = _slim(docs)
    bounds = sorted({int(c) for c in docs.approxQuantile("doc_id", list(cuts), 0.01)}) if cuts else []
    out = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = docs if low is None else docs.where(F.col("doc_id") >= low)
        # rows without an identifier are compared with nothing: they go with the first batch
        part = part if high is None else part.where((F.col("doc_id") < high) if low is not None else (F.col("doc_id").isNull() | (F.col("doc_id") < high)))
        got = log.add(part, None if low is None else docs.where(F.col("doc_id") < low))
        out = got if out is None else out.unionByName(got)
    log.close()
    remove(spark, log.root)
    return out
