"""Each pipeline stage against a brute-force version on its own input, and the whole run."""

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp  # noqa: E402

from test_operators import brute_components, brute_contamination, brute_copies, brute_score  # noqa: E402
from trackwise.llm import quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES:
        after = stage(spark, before, SF)
        old, new = texts(before), texts(after)
        if name == "quality classifier":
            model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {i for i, t in old.items() if brute_score(model, t) >= 0.5}
        elif name == "n-gram jaccard join":
            want = {c for _, _, c in brute_components(sorted(old.items()), 5, 80, 100)}
        elif name == "benchmark decontamination":
            ids = sorted(old)
            want = {ids[i] for i, _, hit, _ in brute_contamination([old[i] for i in ids], bench, 10) if not hit}
        elif name == "mixing to target weights":
            rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in before.collect()]
            want = {r[0] for r, (_, _, copies) in zip(rows, brute_copies(rows, cp.MIX_SHARE, cp.MIX_WEIGHTS, 1, cp.MIX_SEED), strict=True) if copies}
        else:
            want = set(old)
        assert set(new) == want and all(old[i] == new[i] for i in new), name
        assert name == "sharding" or after.columns == before.columns
        assert 0 < len(new) <= len(old)
        before = after
    assert set(texts(cp.run(spark, SF))) == set(new)
