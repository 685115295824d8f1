import random

import pytest

from quarrymill.llm import grouping


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("local_edges", [0, 5, 200_000])
def test_groups(spark, local_edges):
    random.seed(9)
    ids = [f"p{i:03d}" for i in range(120)]
    pairs = [(random.choice(ids), random.choice(ids)) for _ in range(70)] + [(f"k{i:02d}", f"k{i + 1:02d}") for i in range(40)] + [("hub", f"l{i}") for i in range(60)] + [("a", None), (None, "b"), ("self", "self")]
    pairs += [(b, a) for a, b in pairs[:20]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = rows(grouping.connected_groups(spark.createDataFrame(pairs, "a string, b string"), local_edges=local_edges))
    assert got == sorted((x, find(x)) for x in root)
    assert grouping.connected_groups(spark.createDataFrame([("self", "self")], "a string, b string")).count() == 0


def test_similar_pairs(spark):
    m = spark.createDataFrame([("a", "b", 0.95, "x"), ("a", "c", 95.0, None), ("a", "d", 0.9499999, "auto_merge"), ("a", "e", None, "x"), ("a", "f", -1.0, "x"), ("a", "g", 94.99, "x"), ("a", "h", float("nan"), "x")], "pattern_a string, pattern_b string, similarity double, decision string")
    assert rows(grouping.similar_pairs(m)) == [("a", "b"), ("a", "c")]
