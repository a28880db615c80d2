"""Packed adjacency, and builds of one country, against plain versions."""

import random

import pytest

from trackwise.plans import search

ARC = "arc_id long, tail long, head long, costs array<long>"


def _arcs(spark, pairs):
    return spark.createDataFrame([(i, a, b, [i, 1]) for i, (a, b) in enumerate(sorted(pairs))], ARC)


@pytest.mark.parametrize("size", [1, 3, 7, 1024])
def test_packed(spark, size):
    """A third of the arcs leave one node, many enter another, some nodes have none; repeated arcs stay."""
    random.seed(5)
    pairs = [(4, random.randrange(12)) for _ in range(20)] + [(random.randrange(12), 7) for _ in range(20)] + [(random.randrange(6), random.randrange(12)) for _ in range(20)] + [(0, 11), (0, 0)]
    arcs = _arcs(spark, pairs)
    pairs = sorted(pairs)
    for way, packed in (("out", search.pack(arcs, size)), ("in", search.pack(search.turned(arcs), size))):
        own = lambda p: p[0] if way == "out" else p[1]  # noqa: E731, B023
        want = sorted((n, at, p[1] if way == "out" else p[0], i, [i, 1]) for n in range(12) for at, (i, p) in enumerate([(i, p) for i, p in enumerate(pairs) if own(p) == n]))
        assert sorted(r.node for r in packed.numbers().collect()) == list(range(12))
        assert sorted(tuple(r) for r in packed.arcs_of(packed.numbers()).collect()) == want
        asked = spark.createDataFrame([(4,), (4,), (7,), (99,), (None,)], "node long")
        assert sorted(tuple(r) for r in packed.arcs_of(asked).collect()) == [w for w in want if w[0] in (4, 7)]


def test_packed_edges(spark):
    empty = search.pack(spark.createDataFrame([], ARC))
    assert empty.arcs_of(empty.numbers()).count() == 0
    for rows in ([(0, 0, 2, [1])], [(0, 0, 1, [1]), (2, 1, 0, [1])], [(0, 0, 1, [1]), (1, 1, 0, [1]), (2, 0, 1, [1])]):
        with pytest.raises(Exception, match="gaps"):
            search.pack(spark.createDataFrame(rows, ARC))
