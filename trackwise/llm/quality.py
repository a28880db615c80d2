"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

A token's index vector is sparse, ternary and seeded by the token itself; its
word vector adds the index vectors of its neighbours over the training sample.
Tokens outside the vocabulary fall back to the vector of their shape; a token
that repeats one of the two before it has a vector of its own kind. A document
is the mean of its tokens' vectors and the logarithm of their number. A network
of one hidden layer is fitted in numpy; a held-back quarter of the sample
calibrates the temperature of its probabilities.

The sample is bounded, as the driver's memory is: at most ``rows`` labelled
documents, evenly from both classes in the order of a hash of the identifier, and
of those as many as have ``chars`` characters together, texts of more than a
fiftieth of that last. Of its words, the ``words`` most frequent ones have vectors
of their own. Scores use whole texts of all documents and nothing but their text.

Defined cases: null text is empty; an empty text has a score like any other; a
document with several labels counts with its smallest; null labels are left out;
without labels of both classes the score is the share of label 1, or 0.5 without
any; rows without a doc_id are scored, never learned from and not held out;
repeated rows score alike; an empty table gives an empty result; other columns are
ignored, whatever their names, unless they are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import quoted

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: stands for a token that equals one of the two before it
AGAIN = "\0again"
WIDTH, HIDDEN, NONZERO = 32, 24, 6
#: neutral tokens added to every mean, so that a few words say little
PULL = 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return f"\0{token[0]}{min(len(token), 3)}"
    if token.isdigit():
        return "\0digits"
    case = "upper" if token.isupper() else "lower" if token.islower() else "title" if token.istitle() else "mixed"
    return f"\0{case}{'+' if len(token) > 14 else ''}"


def tokenize(text: str | None) -> list[str]:
    """Words and runs of other characters; a token that repeats one of the two before it becomes ``AGAIN``."""
    found = TOKEN.findall(text or "")
    return [AGAIN if t == a or t == b else t for t, a, b in zip(found, ["", *found], ["", "", *found], strict=False)]


def index_vector(token: str) -> np.ndarray:
    """Sparse ternary vector seeded by the token."""
    bits = xxhash.xxh3_128_intdigest(token.encode("utf-8", "surrogatepass"))
    out = np.zeros(WIDTH, np.float32)
    for _ in range(NONZERO):
        bits, place = divmod(bits, WIDTH)
        bits, sign = divmod(bits, 2)
        out[place] += 1.0 if sign else -1.0
    return out


@dataclass
class QualityModel:
    vocabulary: dict[str, int]
    vectors: np.ndarray
    layers: tuple[np.ndarray, ...] | None
    temperature: float
    prior: float

    def ids(self, text: str | None, shapes: dict[str, int]) -> list[int]:
        get, out = self.vocabulary.get, []
        for token in tokenize(text):
            at = get(token)
            if at is None:
                at = shapes.get(token)
                if at is None:
                    if len(shapes) > 100_000:
                        shapes.clear()
                    at = shapes[token] = get(_shape(token), 0)
            out.append(at)
        return out

    def features(self, texts: list[str | None], shapes: dict[str, int], chunk: int = 200_000) -> np.ndarray:
        out = np.zeros((len(texts), WIDTH + 1), np.float32)
        for i, text in enumerate(texts):
            ids = np.array(self.ids(text, shapes), np.int32)
            for low in range(0, len(ids), chunk):
                # frequencies first: the sum over distinct tokens reads each vector once
                distinct, times = np.unique(ids[low : low + chunk], return_counts=True)
                out[i, :WIDTH] += times.astype(np.float32) @ self.vectors[distinct]
            out[i, :WIDTH] /= len(ids) + PULL
            out[i, WIDTH] = np.log1p(len(ids)) / 10
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2, mean, scale = self.layers
        return (np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2).astype(np.float64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def numbered(texts: Iterable[str | None]) -> tuple[dict[str, int], list[np.ndarray]]:
    """All tokens of the texts by number, in the order they are met, and each text as numbers: no text's tokens are kept as words."""
    numbers: dict[str, int] = {}
    return numbers, [np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokenize(text)), np.int32) for text in texts]


def word_vectors(texts: Iterable[str | None], most: int, least: int = 3) -> tuple[dict[str, int], np.ndarray]:
    """Vocabulary (shapes included) and vectors: own index vector plus the mean of the neighbours'."""
    numbers, docs = numbered(texts)
    counts = np.zeros(len(numbers), np.int64)
    for doc in docs:
        np.add.at(counts, doc, 1)
    known = [t for t, c in sorted(zip(numbers, counts.tolist(), strict=True), key=lambda x: (-x[1], x[0])) if c >= least][:most]
    vocabulary = {"\0": 0, AGAIN: 1}
    for t in known:
        vocabulary.setdefault(t, len(vocabulary))
    for t in sorted({_shape(t) for t in numbers}):
        vocabulary.setdefault(t, len(vocabulary))
    place = np.array([i if (i := vocabulary.get(t)) is not None else vocabulary[_shape(t)] for t in numbers], np.int64)
    index = np.stack([index_vector(t) for t in vocabulary])
    context, seen = np.zeros_like(index), np.zeros(len(vocabulary), np.float32)
    for doc in docs:
        ids = place[doc]
        for gap in (1, 2):
            for a, b in ((ids[:-gap], ids[gap:]), (ids[gap:], ids[:-gap])):
                np.add.at(context, a, index[b] / gap)
        np.add.at(seen, ids, 1)
    context /= np.maximum(seen, 1)[:, None]
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return vocabulary, (index + context / np.maximum(norm, 1e-6)).astype(np.float32)


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 600, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, ...]:
    """Two layers, cross entropy, Adam over the full batch."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    params = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        h = np.tanh(z @ params[0] + params[1])
        p = 1 / (1 + np.exp(-(h @ params[2] + params[3])))
        d = (p - y) * weight
        back = np.outer(d, params[2]) * (1 - h * h)
        grads = [z.T @ back + decay * params[0], back.sum(0), h.T @ d + decay * params[2], d.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return (*[np.asarray(p, np.float32) for p in params], mean, scale)


def calibrate(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Temperature with the least cross entropy on rows the network hasn't seen."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [float((weight * np.logaddexp(0, np.where(y > 0.5, -logits, logits) / t)).sum()) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_model(texts: list[str | None], labels: list[int], positives: int, negatives: int, words: int = 60_000) -> QualityModel:
    """positives, negatives: labels of each class in all training rows, to which the sample is weighted."""
    prior = positives / (positives + negatives) if positives + negatives else 0.5
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return QualityModel({"\0": 0}, np.zeros((1, WIDTH), np.float32), None, 1.0, prior)
    fit = np.arange(len(y)) % 4 != 3
    fit |= len(set(y[fit])) < 2
    vocabulary, vectors = word_vectors((t for t, f in zip(texts, fit, strict=True) if f), words)
    model = QualityModel(vocabulary, vectors, None, 1.0, prior)
    x = model.features(texts, {})
    share = np.where(y > 0.5, prior / max(1e-9, (y > 0.5).mean()), (1 - prior) / max(1e-9, (y < 0.5).mean()))
    model.layers = fit_network(x[fit].astype(np.float64), y[fit], share[fit])
    if not fit.all():
        model.temperature = calibrate(model.logits(x[~fit]), y[~fit], share[~fit])
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, chars: int = 24_000_000, words: int = 60_000) -> QualityModel:
    """Fit on labelled rows that aren't held out, at most ``rows`` of them and ``chars`` characters."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("quality"))
    known = known.where(~held_out(F.col("doc_id")))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    sample = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).orderBy(order, "doc_id").limit(rows // 2)
        sample = part if sample is None else sample.unionByName(part)
    picked = [(r["doc_id"], r["quality"]) for r in sample.collect()]
    spark = docs.sparkSession
    chosen = spark.createDataFrame(picked, "doc_id long, quality int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sizes = texts.groupBy("doc_id", "quality").agg(F.max(F.length("text")).alias("n")).collect()
    within, total = {}, {0: 0, 1: 0}
    for r in sorted(sizes, key=lambda r: (r["n"] > chars // 50, xxhash.xxh3_64_intdigest(str(r["doc_id"])))):
        if total[r["quality"]] + r["n"] <= chars // 2:
            total[r["quality"]] += r["n"]
            within[r["doc_id"]] = r["quality"]
    chosen = spark.createDataFrame(sorted(within.items()), "doc_id long, quality int")
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = sorted((xxhash.xxh3_64_intdigest(str(r["doc_id"])), r["text"], r["quality"]) for r in got.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect())
    return fit_model([t for _, t, _ in found], [q for _, _, q in found], counts.get(1, 0), counts.get(0, 0), words)


def _score(shipped):
    """Scores of the last column, behind all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shapes = shipped.value, {}
        for batch in batches:
            scores = model.scores(model.features(batch[batch.num_columns - 1].to_pylist(), shapes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.asarray(scores, np.float64))], [*batch.schema.names, "score"])

    return run


def score_documents(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` and ``text`` of docs, with the calibrated probability of label 1 in a column of another name than these."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in dict.fromkeys(keep) if c != "text"] + ["text"]
    # names that any engine part can read
    cols = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)])
    scored = cols.mapInArrow(_score(shipped), StructType([*cols.schema.fields, StructField("score", DoubleType())]))
    order = [*dict.fromkeys(keep), *(["text"] if "text" not in keep else [])]
    return scored.select(*[F.col(f"c{kept.index(c)}").alias(c) for c in order], F.col("score").alias(name))
