"""Shared spans against brute force over all windows."""

import random

import numpy as np

from quarrymill.llm import shared_spans as S

DOC = "doc_id bigint, text string, phrase string, pos int"


def brute(texts, least):
    where = {}
    for i, t in texts.items():
        for k in range(len(t) - least + 1):
            where.setdefault(t[k : k + least], set()).add(i)
    pairs, spans = set(), set()
    for i, t in texts.items():
        cover = [False] * len(t)
        for k in range(len(t) - least + 1):
            if len(where[t[k : k + least]]) > 1:
                cover[k : k + least] = [True] * least
        edges = np.flatnonzero(np.diff(np.r_[0, np.array(cover, int), 0])) if t else []
        spans |= {(i, int(a) + 1, int(b)) for a, b in zip(edges[::2], edges[1::2])}
    for docs in where.values():
        pairs |= {(a, b) for a in docs for b in docs if a < b}
    return pairs, spans


def check(spark, texts, least, size, extra=()):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in [*texts.items(), *extra]], DOC)
    s = S.SharedSpans(df, least, size)
    pairs, spans = brute(texts, least)
    got = [tuple(r) for r in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert sorted(tuple(r) for r in s.spans().select("doc_id", "start_pos", "end_pos").collect()) == sorted(spans)
    return s, df


def test_against_brute_force(spark):
    random.seed(8)
    parts = ["".join(random.choice("ab c\né😀") for _ in range(random.randint(15, 90))) for _ in range(12)]
    texts = {i: "".join(random.choice(parts) if random.random() < 0.5 else "".join(random.choice("abcdef") for _ in range(25)) for _ in range(random.randint(0, 6))) for i in range(40)}
    texts |= {100: texts[3] + "tail", 101: texts[3] + "tail", 102: "-" * 120, 103: "x" + "-" * 80 + "y", 104: "ab" * 70, 105: "zab" * 40, 106: ""}
    s, df = check(spark, texts, 20, 8, [(200, None)])
    shared = {r.doc_id: r for r in S.shared_amounts(df, s.spans()).collect()}
    assert shared[200].shared_chars == 0 and shared[106].share == 0 and shared[100].share == 1.0 and len(shared) == len(df.collect())


def test_exact_length(spark):
    random.seed(1)
    w = "".join(random.choice("abcdefghij") for _ in range(200))
    texts = {1: "1" + w + "2", 2: "3" + w + "4", 3: "5" + w[:-1] + "6", 4: w}
    check(spark, texts, 200, 64)


def test_hot_phrase_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    texts = {i: f"{i:05d}" + "the licence text that all have" + f"{i * 7919:09d}" for i in range(25)}
    check(spark, texts, 25, 10)


def test_long_runs(spark):
    """Rules and padding of thousands of characters meet without comparing every place with every other."""
    texts = {1: "a" + "-" * 3000, 2: "-" * 2500 + "b", 3: "c" + "-=" * 1500 + "d", 4: "=-" * 900, 5: "x" * 150 + "-" * 199, 6: "-" * 200}
    s, _ = check(spark, texts, 200, 64)
    assert s.occurrences.count() < 3000


def test_empty(spark):
    s = S.SharedSpans(spark.createDataFrame([], DOC))
    assert s.pairs().count() == 0 and s.spans().count() == 0


def test_sampling():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, run = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        h = rng.integers(0, 6, n).astype(np.uint64)
        want = {s + run - 1 - int(np.argmin(h[s : s + run][::-1])) for s in range(n - run + 1)}
        assert set(S.sampled(h, run).tolist()) == want


def test_hot_phrase_over_the_cluster(spark, monkeypatch):
    """Phrases with more windows than one task takes are looked up string by string."""
    monkeypatch.setattr(S, "HOT", 3)
    random.seed(4)
    common = "".join(random.choice("abcdefgh") for _ in range(24))
    texts = {i: "".join(random.choice("xyz") for _ in range(i % 7)) + common[i % 3 :] + "".join(random.choice("uv") for _ in range(i % 5)) for i in range(30)}
    texts |= {50: "-" * 60, 51: "-" * 45 + "a", 52: "b" + "-" * 40, 53: "-" * 60}
    check(spark, texts, 20, 8)


def test_meetings_are_those_of_all_pairs():
    random.seed(6)
    for n in (5, 60):
        draw = lambda: "".join(random.choice("ab") for _ in range(random.randint(0, 6)))
        classes = list({(draw(), draw()) for _ in range(n)})
        want = {(i, j) for i in range(len(classes)) for j in range(i) if S._common(classes[i][0], classes[j][0]) + S._common(classes[i][1], classes[j][1]) >= 6}
        got = [(max(i, j), min(i, j)) for xs, ys, _, _ in S._meetings(classes, 6) for k, i in enumerate(xs) for j in (ys[:k] if xs is ys else ys)]
        assert len(got) == len(set(got)) and set(got) == want


def test_one_phrase_in_many_texts(spark):
    """A line shorter than the least span, in 20,000 texts, links none of them; with one string more, two of them."""
    line = "// Licensed under some terms, see the file of that name at the root of this tree, or ask its authors for it"
    rng = random.Random(5)
    own = lambda: f"{rng.getrandbits(600):0150x}"
    rows = [(i, own() + line + own(), "", 0) for i in range(20_000)]
    tail = "the same hundred characters follow the line in these two texts, and in none of the other ones, so they link."
    rows += [(30_000 + k, f"{k}" * 150 + line + tail, "", 0) for k in (1, 2)]
    s = S.SharedSpans(spark.createDataFrame(rows, DOC))
    linked = s.pairs().collect()
    assert [tuple(r) for r in linked] == [(30_001, 30_002)]
