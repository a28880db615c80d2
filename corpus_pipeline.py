"""A training-data pipeline over ``documents``: each stage's output is written as Parquet and read by the next.

Every stage decides by row, keeps the rows' columns as they are, whatever their names, and takes an empty table to an
empty one. Rows are told apart by doc_id and text; null is a value of its own in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise.llm import decontaminate, jaccard_join, mixing, quality, sharding
from trackwise.llm.shared import Scratch, fresh, quoted, small_batches


def _key() -> Column:
    """128 bits for each pair of doc_id and text; rows that agree in both are one document."""
    text = F.col("text").cast("string")
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.concat(F.lit("text "), text), F.lit("null"))).cast("binary"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in docs.columns]


def _one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows of each key, which agree in doc_id and text, the one whose other columns come first; without the key."""
    names = [c for c in rows.columns if c != key]

    def ordered(name: str) -> Column:
        column = F.col(quoted(name))
        # maps have no order, their texts do
        return F.to_json(F.struct(column)) if "map<" in rows.schema[name].dataType.simpleString() else column

    others = [ordered(c) for c in names if c not in ("doc_id", "text")] or [F.lit(0)]
    whole = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)])
    first = rows.groupBy(key).agg(F.min_by(whole, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(others)])).alias("first"))
    return first.select(*[F.col(f"first.c{i}").alias(c) for i, c in enumerate(names)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (a score of 0.5 or more).

    Null and empty texts have a score like others; without labels of both classes all or none are kept.
    """
    score = fresh(docs, "score")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(docs, model, tuple(docs.columns), score).where(F.col(score) >= 0.5).select(*_columns(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked at 0.8 on five-word shingles, the one with the smallest doc_id.

    Of rows that agree in doc_id and text the first by its other columns is kept, rows of one doc_id with other texts are documents of their own,
    and rows without a doc_id take part and come last in a component. Texts without words are linked with nothing.
    """
    key = fresh(docs, "key")
    rows = docs.select(_key().alias("key"), "doc_id", "text")
    with small_batches(spark):
        found = jaccard_join.jaccard_components(rows.select(F.col("key").alias("doc_id"), "text"), k=5, num=80, den=100, id_type="string")
    named = found.select(F.col("doc_id").alias("key"), "component_id").distinct().join(rows.select("key", "doc_id"), "key")
    first = named.groupBy("component_id").agg(F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias(key)).select(key)
    return _one_of_each(docs.withColumn(key, _key()).join(first, key, "left_semi"), key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs, each row judged by its own text."""
    key = fresh(docs, "key")
    with small_batches(spark):
        hits = decontaminate.contamination(docs.select(_key().alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_type="string")
        bad = Scratch(spark, "contaminated").write(hits.where("size(starts) > 0").select(F.col("doc_id").alias(key)).distinct(), "keys")
    return docs.withColumn(key, _key()).join(bad, key, "left_anti").select(*_columns(docs))


#: share of the tokens that the mixture takes, weights of the languages, seed of the order
MIX_SHARE, MIX_WEIGHTS, MIX_SEED = 80, {"lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}, 17


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A prefix of each source's seeded order, at most once each, by hierarchical budgets.

    Null domain, language and source are values of their own; rows of one doc_id, or without one, share a place in the
    order and are taken together; texts without words are taken when the prefix reaches their place.
    """
    domain, key = mixing.domain_of(F.col("d.source")), F.col("d.doc_id").cast("long")
    rows = docs.alias("d").select(key.alias("doc_id"), domain.alias("domain"), F.col("d.lang").alias("lang"), F.col("d.source").alias("source"), mixing.token_count(F.col("d.text")).alias("n_tokens"))
    plan = mixing.leaf_plan(rows, MIX_SHARE, MIX_WEIGHTS, 1, MIX_SEED, Scratch(spark, "mixing")).alias("p")
    match = [domain.eqNullSafe(F.col("p.domain")), F.col("d.lang").eqNullSafe(F.col("p.lang")), F.col("d.source").eqNullSafe(F.col("p.source"))]
    taken = (F.col("p.whole") > 0) | (mixing.order_key(MIX_SEED, F.col("p.whole"), key) <= F.col("p.cut"))
    return docs.alias("d").join(plan, match).where(taken).select(*[F.col(f"d.{quoted(c)}") for c in docs.columns])


def place_on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their slot and shard, by doc_id; rows without one go where an empty text goes."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_to_weights),
    ("sharding", place_on_shards),
]

#: SQL can't express the classifier; tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{i}")
        scratch.keep(f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
