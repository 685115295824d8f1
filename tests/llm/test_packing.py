"""Packing against a plain best fit, and its invariants."""

import bisect
import random
from collections import Counter, defaultdict

import pytest

from quarrymill.llm import packing as K


def plain(capacity, items):
    gaps, n = [], 0
    for s in sorted(items, reverse=True):
        k = bisect.bisect_left(gaps, s)
        g = gaps.pop(k) if k < len(gaps) else capacity
        n += g == capacity
        if g > s:
            bisect.insort(gaps, g - s)
    return n


def test_sweep_equals_plain_best_fit():
    random.seed(2)
    for _ in range(150):
        capacity = random.randint(1, 50)
        items = [random.randint(1, capacity) for _ in range(random.randint(0, 150))]
        intervals, opened = K.best_fit(capacity, Counter(items))
        fill, seen = Counter(), Counter()
        for size, a, b, first, each, start, place in intervals:
            for r in range(a, b):
                fill[first + (r - a) // each] += size
                seen[size] += 1
        assert opened == plain(capacity, items) and seen == Counter(items) and len(fill) == opened and max(fill.values(), default=0) <= capacity


def test_pack(spark):
    random.seed(4)
    sizes = [(i, random.choice([0, None, 1, 5, 5, 5, 7, 9, 10, 23, 40])) for i in range(300)]
    df = spark.createDataFrame([(i, s, 1) for i, s in sizes], "doc_id bigint, size bigint, capacity int")
    caps = spark.createDataFrame([("ten", 10), ("ten_too", 10), ("twenty", 20), ("none", 0), ("ten", 10)], "capacity_name string, capacity_tokens bigint")
    rows = K.pack(df, caps).collect()
    for name, c in (("ten", 10), ("ten_too", 10), ("twenty", 20)):
        mine = [r for r in rows if r.capacity_name == name]
        assert {r.doc_id for r in mine} == set(range(300))
        boxes, parts = defaultdict(list), defaultdict(int)
        for r in mine:
            parts[r.doc_id] += r.tokens
            if r.tokens:
                boxes[r.container_id].append((r.place, r.start_token, r.tokens))
        assert all(parts[i] == (s or 0) for i, s in sizes)
        assert set(boxes) == set(range(len(boxes)))
        for b in boxes.values():
            b.sort()
            assert [p for p, _, _ in b] == list(range(len(b))) and sum(t for *_, t in b) <= c
            assert all(s == sum(t for _, _, t in b[:k]) for k, (_, s, _) in enumerate(b))
        assert all(len([r for r in mine if r.doc_id == i]) == 1 for i, s in sizes if (s or 0) <= c)
    assert not any(r.capacity_name == "none" for r in rows)
    assert K.pack(df.limit(0), caps).count() == 0 and K.pack(df, caps.limit(0)).count() == 0
    fill = {r.capacity_name: r.fill for r in K.fill_levels(K.pack(df, caps), caps).collect()}
    assert fill["ten"] == pytest.approx(fill["ten_too"]) and 0.8 < fill["ten"] <= 1
