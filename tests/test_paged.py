"""The source of result pages: partitions, filters, tries."""

import json

import pytest
from pyspark.sql import functions as F

from trackwise.functions.decode import COUNTRY_PREFIXES
from trackwise.plans import rawdata
from trackwise.sources import files, paged


def _binding(n, code):
    country = {} if code is None else {"country": {"type": "uri", "value": COUNTRY_PREFIXES[0] + code}}
    return {"n": {"type": "literal", "value": str(n)}, **country}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    codes = ["DEU", "FRA", "DEU", None, "FRA", "AUT", "DEU"]
    for page in range(3):
        rows = [_binding(n, c) for n, c in enumerate(codes) if n // 3 == page]
        (at / f"ops-{page * 3}.json").write_text(json.dumps({"head": {"vars": []}, "results": {"bindings": rows}}))
    (at / "ops-9.json").write_text(json.dumps({"head": {"vars": []}, "results": {"bindings": []}}))
    (at / "_SUCCESS").write_text("")
    return str(at)


def _rows(df):
    return sorted((r.page, r.binding_idx, r.country, r.b["n"]["value"]) for r in df.select("page", "binding_idx", F.coalesce("country", F.lit("")).alias("country"), "b").collect())


ALL = [(0, 0, "DEU", "0"), (0, 1, "FRA", "1"), (0, 2, "DEU", "2"), (3, 0, "", "3"), (3, 1, "FRA", "4"), (3, 2, "AUT", "5"), (6, 0, "DEU", "6")]


def test_pages(spark, folder):
    got = paged.read_pages(spark, folder)
    assert _rows(got) == ALL and got.rdd.getNumPartitions() == 4
    assert _rows(paged.read_pages(spark, f"file://{folder}")) == ALL
    same = files.read_bindings(spark, folder)
    assert sorted((r.page, r.binding_idx, r.b["n"]["value"]) for r in same.collect()) == [(p, i, n) for p, i, _, n in ALL]
    assert _rows(paged.read_pages(spark, folder, ["DEU", "AUT"])) == [r for r in ALL if r[2] in ("DEU", "AUT")]


def test_pushed_filters(spark, folder):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        paged.register(spark)
        rows = spark.read.format(paged.NAME).option("pushdown", "true").load(folder)
        few = rows.where("page = 3 and country in ('FRA', 'DEU') and binding_idx >= 0")
        assert _rows(few) == [(3, 1, "FRA", "4")] and few.rdd.getNumPartitions() == 1
        assert _rows(rows.where("country = 'DEU' and country in ('DEU', 'FRA')")) == [r for r in ALL if r[2] == "DEU"]
        assert _rows(rows.where("country is null")) == [ALL[3]] and rows.where("page = 0 and page = 3").count() == 0
    finally:
        spark.conf.set(key, before)


def test_tries():
    said, waits = [OSError("a"), OSError("b"), b"x"], []

    def read():
        waits.append(1)
        out = said[len(waits) - 1]
        if isinstance(out, OSError):
            raise out
        return out

    assert paged.tried(read, 3, 0.0) == b"x" and len(waits) == 3
    waits.clear()
    with pytest.raises(OSError, match="b"):
        paged.tried(read, 2, 0.0)
    assert paged.page_number("/a/page=7/part-0.txt") == 0 and paged.page_number("/x/ops-12.json") == 12


def test_many_documents_in_a_page(spark, tmp_path):
    """Lines of documents count their bindings together; batches don't change them."""
    doc = json.dumps({"results": {"bindings": [_binding(n, "DEU") for n in range(1500)]}})
    (tmp_path / "p4.json").write_text(f"{doc}\n{doc}\n")
    got = paged.read_pages(spark, str(tmp_path))
    assert got.agg(F.count("*"), F.count_distinct("binding_idx"), F.max("binding_idx"), F.max("page")).first() == (3000, 3000, 2999, 4)


def test_documents_are_bounded(spark, tmp_path):
    """A page of many rows is several documents, a reader of which holds one at a time; none is lost, and both readers find the page."""
    path = f"file://{tmp_path}/raw"
    text = F.when(F.col("id") % 3 > 0, rawdata.term(F.concat(F.lit('a "quoted"\nline '), F.col("id").cast("string"))))
    rows = spark.range(0, 5000, 1, 3).select((F.col("id") % 2).alias("page"), rawdata.term(F.col("id")).alias("k"), text.alias("t"))
    rows = rows.unionByName(rows.where("k.value = '7'"))
    texts = rows.select("page", F.to_json(F.struct("k", "t")).alias("value"))
    rawdata.write_documents(texts, path, '{"results":{"bindings":[', "]}}", rows=200)
    sizes = files.read_bindings(spark, path).groupBy("file").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    assert 20 <= sizes.n <= 28 and sizes.most < 400
    got = files.read_bindings(spark, path).select(F.col("b")["k"]["value"].cast("long").alias("k"), F.try_element_at("b", F.lit("t"))["value"].alias("t")).collect()
    assert sorted((r.k, r.t) for r in got) == sorted((n, f'a "quoted"\nline {n}' if n % 3 else None) for n in [*range(5000), 7])
    paged_rows = paged.read_pages(spark, path).groupBy("page").agg(F.count("*").alias("n")).collect()
    assert sorted((r.page, r.n) for r in paged_rows) == [(0, 2500), (1, 2501)]
