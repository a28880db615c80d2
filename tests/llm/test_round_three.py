"""Collocations, toxicity and vector codes against brute force; the fingerprint log's refusals."""

import hashlib
import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("trackwise.llm")
from trackwise.llm import collocations, substring_dedup, toxicity, vector_codes  # noqa: E402

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_collocations(rows, least, percent, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(words)
            f.update((lang, words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = {}
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, words), a in candidates.items():
        if any(other == lang and len(long) > len(words) and any(long[i : i + len(words)] == words for i in range(len(long))) and 100 * b >= percent * a for (other, long), b in candidates.items()):
            continue
        cuts = [(int(Fraction(2_000_000 * a, f[lang, words[:k]] + f[lang, words[k:]]) // 1), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, rank, phrase.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)}


def test_collocations(spark):
    rng = random.Random(1)
    words = ["the", "THE", "of", "a", "é", "x y", "\x1c", "zz"]
    texts = [("".join(rng.choice(words) + rng.choice([" ", " ", "\t", ". ", "\n", "\x0b", " ; "]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None])) for _ in range(60)]
    texts += [(None, "en"), ("", None), (" \t.\n", "en"), ("solo", "fr")] + [("lo and behold", "en")] * 12 + [("w " * 30_000, "long")]
    df = spark.createDataFrame([(t, lang, 1) for t, lang in texts], "text string, lang string, phrase int")
    for least, percent, top in ((5, 80, 2000), (3, 50, 7), (1, 80, 40)):
        small = texts if least > 1 else texts[:8]
        got = collocations.collocations(df.limit(len(small)) if least > 1 else spark.createDataFrame([(t, lang, 1) for t, lang in small], "text string, lang string, phrase int"), least, percent, top)
        assert {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()} == brute_collocations(small, least, percent, top)
    assert collocations.collocations(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        collocations.collocations(df, 300)


def test_bucket_counts_add_up():
    """Chunks of counts, sparse and dense, summed over tasks, mark exactly the buckets with enough occurrences."""
    rng = np.random.default_rng(2)
    tasks = [np.minimum(rng.poisson(rate, collocations.BUCKETS), 30).astype(np.uint8) for rate in (0.001, 3.0)]
    batches = [collocations._chunk_rows(t) for t in tasks]
    rows = {r["chunk"]: r["bits"] for b in collocations._summed(5)(iter(batches)) for r in b.to_pylist()}
    bits = np.unpackbits(np.frombuffer(b"".join(rows[c] for c in sorted(rows)), np.uint8), bitorder="little")
    assert (bits.astype(bool) == (tasks[0].astype(int) + tasks[1] >= 5)).all()


def brute_codes(rows, rounds=4):
    kept = sorted((i, [int(np.floor(1024 * np.float64(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:256]] for p in range(4)]
    away = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    assign = lambda: [[min((away(part(v, p), e), j) for j, e in enumerate(books[p])) for p in range(4)] for _, v, _ in kept]
    for _ in range(rounds):
        codes = assign()
        for p in range(4):
            for j in range(len(books[p])):
                own = [part(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    errors, by = [sum(d for d, _ in c) for c in codes], Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return {(i, "".join(f"{j:02x}" for _, j in c), e, by[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)}


@pytest.mark.parametrize("count", [5, 400])
def test_vector_codes(spark, count):
    """Coarse components, so that ties, equal entries and repeated vectors abound."""
    rng = random.Random(count)
    value = lambda: rng.choice([rng.randint(-3, 3) / 1024, rng.uniform(-0.01, 0.01), rng.uniform(-40, 40)])
    rows = [(7 * i % 1009, [value() if i % 3 else rng.randint(-2, 2) / 1024 for _ in range(8)], rng.choice([0, 1, None])) for i in range(count)]
    rows += [(2000, None, 1), (2001, [0.0] * 7 + [None], 1), (2002, [float("nan")] * 8, 0), (2003, [float("inf")] * 8, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    got = {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.code_table(df).collect()}
    assert got == brute_codes([(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])
    _, _, taken = vector_codes.encode(df)
    assert len(taken) == 5 and (count < 100 or sum(taken[1:]) < 2 * taken[0])


def test_vector_codes_edges(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert vector_codes.code_table(spark.createDataFrame([], shape)).collect() == []
    rows = [(1, [1.0] * 8, 0), (None, [2.0] * 8, 0), (2, [1.0] * 4, None), (1, [0.5] * 8, 0), (3, [], 5)]
    got = {(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.code_table(spark.createDataFrame(rows, shape)).collect()}
    assert got == {(1, "01010101", 0, 0), (None, "02020202", 0, 0), (2, None, None, None), (1, "00000000", 0, 0), (3, None, None, None)}
    assert {r.code for r in vector_codes.code_table(spark.createDataFrame([(1, [1.0] * 7, 0)], shape)).collect()} == {None}
    with pytest.raises(Exception, match="too large"):
        vector_codes.code_table(spark.createDataFrame([(1, [1e9] * 8, 0)], shape)).collect()


def test_bounds_hold():
    """Shifted bounds stay outside the true distances, and the entries are those of all distances."""
    rng = np.random.default_rng(4)
    x, book = rng.integers(-50, 50, (300, 4)), rng.integers(-50, 50, (40, 4))
    a, upper, lower = vector_codes.first_bounds(x, book)
    for _ in range(5):
        before, book = book, book + rng.integers(-3, 4, book.shape)
        _, moved, half = vector_codes._geometry(book[None], before[None])
        a, upper, lower, taken = vector_codes.next_bounds(x, a, upper, lower, book, moved[0], half[0])
        true = np.sqrt(np.stack([vector_codes.squared(x, e) for e in book], 1))
        assert (a == true.argmin(1)).all() and taken < true.size
        assert (lower <= true).all() and (upper >= true[np.arange(len(x)), a]).all()


def test_label_model():
    """Rates of planted voters are found from few labels, and a copied voter counts as dependent on its original."""
    rng = np.random.default_rng(5)
    y = rng.random(20_000) < 0.2
    rates = np.array([[0.02, 0.7], [0.05, 0.6], [0.01, 0.5], [0.1, 0.4]])
    bits = (rng.random((len(y), 4)) < rates[:, y.astype(int)].T).astype(np.int64)
    bits = np.column_stack([bits, np.where(rng.random(len(y)) < 0.95, bits[:, 3], 1 - bits[:, 3])])
    masks = (bits << np.arange(5)).sum(1)
    distinct, at, times = np.unique(masks, return_inverse=True, return_counts=True)
    known = np.zeros((2, len(distinct)), np.int64)
    np.add.at(known, (y[:400].astype(int), at[:400]), 1)
    model = toxicity.fit_label_model(distinct, times, known, 5, kinds=1)
    found = model.posterior(toxicity.as_bits(distinct, 5))
    assert abs(model.shares[1] - 0.2) < 0.04 and {model.parent[3], model.parent[4]} & {3, 4} and model.correlation[3, 4] > 0.6
    assert np.mean((found[at] >= 0.5) == y) > 0.93
    # the posterior by hand, for each mask
    for mask, p in zip(distinct, found, strict=True):
        b = toxicity.as_bits(np.array([mask]), 5)[0]
        odds = list(model.shares)
        for c, v in itertools.product(range(2), range(5)):
            up = model.parent[v]
            q = model.chance[c, b[up] if up >= 0 else 0, v]
            odds[c] *= q if b[v] else 1 - q
        assert abs(odds[1] / sum(odds) - p) < 1e-9


def test_regression():
    """At the end the gradient of the loss with its penalty is near 0."""
    rng = np.random.default_rng(6)
    x = rng.random((300, 6)) * (rng.random((300, 6)) < 0.4)
    y = 1 / (1 + np.exp(-(x @ np.array([3, -2, 1, 0, 0, 4.0]) - 1)))
    rows = [{j: float(v) for j, v in enumerate(r) if v} for r in x]
    w, b = toxicity.fit_regression(rows, y, np.ones(300), 6, penalty=1e-3, steps=4000, rate=0.02)
    d = (1 / (1 + np.exp(-(x @ w + b))) - y) / 300
    assert np.abs(x.T @ d + 1e-3 * w).max() < 1e-3 and abs(d.sum()) < 1e-3


def test_toxicity(spark):
    """Held-out texts of two invented languages; scores are those of the plain sum over words; defined cases."""
    rng = random.Random(7)
    plain, bad = ["".join(p) for p in itertools.product("bdfglmnp", "aeiou", "rst", "aeo")], {"x": ["idiot", "loser", "scum"], "y": ["grokur", "grokam", "grokes", "blifor"]}
    rows, labels = [], []
    for i in range(700):
        toxic, words = i % 5 == 0, rng.choices(plain, k=rng.randint(5, 60))
        if toxic:
            for word in rng.choices(bad["xy"[i % 2]], k=4):
                words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), None if i % 3 else 1))
    extra = [(None, "you idiot"), (9000, None), (9001, ""), (9002, "idiot " * 100_000)]
    docs = spark.createDataFrame([(*r, "t") for r in rows + extra], "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(3, 1, 0), (9000, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, known, rows=600)
    got = [(r.doc_id, r.score) for r in toxicity.score_documents(docs, model).collect()]
    scores = {d: s for d, s in got if d is not None}
    assert len(got) == len(rows) + 4 and all(0 <= s <= 1 for _, s in got) and scores[9000] == scores[9001] < 0.5 < scores[9002]
    held = {r.doc_id for r in docs.where(toxicity.held_out(docs.doc_id)).collect()}
    right = [(scores[i] >= 0.5) == bool(t) for i, t, _ in labels if i in held]
    assert len(right) > 100 and sum(right) >= 0.98 * len(right)
    for i, text in rows[:50]:
        counts = Counter(s for w in re.findall(r"[^\W\d_]+", text.lower()) for s in toxicity.stems(w))
        total = model.bias + sum(model.weights[s] * np.log1p(c) for s, c in counts.items() if s in model.weights)
        assert abs(1 / (1 + np.exp(-total)) - scores[i]) < 1e-9
    one = known.where("toxic = 1")
    assert {r.score > 0.99 for r in toxicity.score_documents(docs, toxicity.train(docs, one)).collect()} == {True}
    assert {r.score < 0.01 for r in toxicity.score_documents(docs, toxicity.train(docs, known.limit(0))).collect()} == {True}
    assert toxicity.score_documents(docs.limit(0), model).collect() == []


def test_log_refuses(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(40))
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    log = substring_dedup.FingerprintLog(spark, f"file://{tmp_path}/log", 10)
    log.add(docs((1, words)))
    with pytest.raises(ValueError, match="lacks the texts of 1"):
        log.add(docs((2, words)), docs((5, "other")))
    with pytest.raises(ValueError, match="doesn't come after"):
        log.add(docs((1, words)), docs((1, words)))
    assert [r.n_removed for r in log.add(docs((2, words)), docs((1, words))).collect()] == [40]
    keys = spark.read.schema(substring_dedup.POSTING).parquet(log._postings_path((0, 0))).select(*substring_dedup.KEY).distinct()
    plan = keys.join(log._postings_of((1, 1)).hint("merge"), substring_dedup.KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan.split("SortMergeJoin")[1] and "Exchange" not in plan[plan.index("trackwise_") - 600 : plan.index("trackwise_")]
    log.close()
