"""Pipeline stages on rows without an id, repeated ids and empty tables."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "source1", len(t or "")) for i, t in rows], SCHEMA)


def _text(word):
    return " ".join(f"{word}{i}" for i in range(60))


def _kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_copies_by_row(spark):
    a, b, c, d = (_text(w) for w in "abcd")
    rows = [(3, a), (5, a + " more"), (5, b), (5, b), (None, c), (None, d), (None, d + " more"), (None, a + " again"), (7, c + " more")]
    got = _kept(cp.keep_one_of_near_copies(spark, _docs(spark, rows), SF))
    null = [t for i, t in got if i is None]
    # of the two without an id either may stay
    assert len(null) == 1 and null[0] in (d, d + " more")
    assert [x for x in got if x[0] is not None] == [(3, a), (5, b), (7, c + " more")]


def test_contamination_by_row(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r["text"].split()) >= 12)
    rows = [(1, item), (1, _text("a")), (None, item), (None, _text("b")), (2, _text("c"))]
    got = _kept(cp.drop_contaminated(spark, _docs(spark, rows), SF))
    assert got == sorted([rows[1], rows[3], rows[4]], key=repr)


def test_other_stages(spark):
    rows = [(1, _text("a")), (1, _text("b")), (None, _text("c")), (None, _text("d"))]
    assert _kept(cp.place_on_shards(spark, _docs(spark, rows), SF)) == sorted(rows, key=repr)
    mixed = _kept(cp.mix_to_weights(spark, _docs(spark, rows), SF))
    # rows that share a place are taken together
    assert set(mixed) <= set(rows) and all(sum(i == k for i, _ in mixed) in (0, 2) for k in (1, None))


def test_quality_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["text"] for r in cp.keep_quality(spark, docs, SF).collect()}
    rows = docs.unionByName(docs.selectExpr("cast(null as bigint) as doc_id", *[c for c in docs.columns if c != "doc_id"]))
    got = [r["text"] for r in cp.keep_quality(spark, rows, SF).collect() if r["doc_id"] is None]
    assert set(got) == want


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES])
def test_any_table(spark, stage):
    """Empty tables; null, empty and long texts, ties, repeated rows, and columns with the names that stages use inside."""
    assert stage(spark, _docs(spark, []), SF).count() == 0
    real = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = _docs(spark, [(None, None), (None, ""), (900, None), (900, ""), (901, _text("a")), (901, _text("a")), (902, " ".join(f"w{i % 9000}" for i in range(60_000)))])
    rows = real.select(*odd.columns).unionByName(odd)
    names = ("score", "key", "_key", "_text", "component_id", "node", "gram", "a.b", "we`ird", "_domain", "domain", "whole", "cut", "leaf", "slot", "shard", "row", "tag", "p", "d")
    wide = rows.select("*", *[F.lit(f"v{i}").alias(n) for i, n in enumerate(names)])
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.checkpoint.dir")}
    plain, got = stage(spark, rows, SF).collect(), stage(spark, wide, SF)
    last = stage is cp.STAGES[-1][1]
    assert sorted(got.columns) == sorted(wide.columns) and (last or got.columns == wide.columns)
    key = lambda r: repr((r["doc_id"], r["text"]))
    kept = got.collect()
    assert sorted(map(key, kept)) == sorted(map(key, plain)) and len(plain) > 0
    assert all(r[n] == f"v{i}" for r in kept for i, n in enumerate(names) if n not in ("slot", "shard") or not last)
    assert {k: spark.conf.get(k) for k in before} == before
    if "near" in stage.__name__:
        assert sum(r["doc_id"] == 901 for r in plain) == 1 and sum(not r["text"] for r in plain) == 4
    if "shard" in stage.__name__ or "contaminated" in stage.__name__:
        assert sum(r["doc_id"] == 901 for r in plain) == 2 and sum(r["doc_id"] is None for r in plain) == 2


def test_one_of_equal_rows(spark):
    """Rows that agree in doc_id and text: the first by their other columns, in whatever order they come."""
    rows = [(1, _text("a"), "fr", {"z": 1}), (1, _text("a"), "de", {"y": 2}), (1, _text("a"), "de", {"x": 3}), (2, _text("b"), None, None), (2, _text("b"), "en", None)]
    for order in (rows, rows[::-1]):
        found = spark.createDataFrame(order, "doc_id long, text string, lang string, `odd.name` map<string,int>").repartition(3)
        kept = cp.keep_one_of_near_copies(spark, found, SF)
        assert kept.columns == found.columns and sorted(tuple(r) for r in kept.collect()) == [rows[2], rows[3]]
