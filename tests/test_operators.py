"""Operators that no table of the driver exercises: small cases."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import numeric
from quarrymill.operators import graph, matching, merges, scoring, similarity, statistics, temporal, upkeep, vectors
from quarrymill.sources import readers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quantiles():
    assert numeric.beta_quantile(0.5, 2.0, 2.0) == pytest.approx(0.5)
    assert numeric.beta_cdf(0.3, 2.0, 5.0) == pytest.approx(0.579825, abs=1e-6)
    assert float(numeric.student_quantile(0.975, 10)) == pytest.approx(2.228139, abs=1e-5)
    assert numeric.grubbs_criticals(10)[-1] == pytest.approx(2.290, abs=1e-3)


def test_esd(spark):
    values = [(1, k, 10 + (k % 5) * 0.1) for k in range(24)] + [(1, 100, 30.0), (1, 101, -8.0)] + [(2, k, float(k)) for k in range(5)]
    df = spark.createDataFrame(values, "g int, k int, v double")
    assert rows(statistics.esd_outliers(df, "g", "k", "v")) == [(1, 100), (1, 101)]


def test_credible_interval(spark):
    df = spark.createDataFrame([(2.0, 2.0), (0.0, 1.0), (3e6, 1e6), (None, 1.0)], "a double, b double")
    got = [r.i for r in df.select(statistics.credible_interval("a", "b").alias("i")).collect()]
    assert (got[0].low, got[0].high) == (pytest.approx(0.0943, abs=1e-3), pytest.approx(0.9057, abs=1e-3))
    assert (got[1].low, got[1].high) == (0.0, 1.0) == (got[3].low, got[3].high)
    assert got[2].low == pytest.approx(0.75 - 1e-6) and got[2].high == pytest.approx(0.75 + 1e-6)


def test_similar_sets_against_all_pairs(spark):
    import random

    random.seed(6)
    sets = {f"s{i:02d}": sorted({f"t{random.randint(0, 14)}" for _ in range(random.randint(0, 9))}) for i in range(60)}
    df = spark.createDataFrame([(k, v + v[:1]) for k, v in sets.items()] + [("null", None), ("inner", [None])], "id string, items array<string>")
    for t in (0.5, 0.8):
        pairs, members = similarity.similar_sets(df, "id", "items", t)
        reps = dict(rows(members))
        assert set(reps) == {k for k, v in sets.items() if v} and all(sets[k] == sets[r] for k, r in reps.items())
        keys = sorted(set(reps.values()))
        want = {(a, b) for a in keys for b in keys if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= t}
        assert {(r.a, r.b) for r in pairs.collect()} == want


def test_near_names(spark):
    names = ["handler", "handlers", "handlr", "hndler", "other", "another", "ab", "abc", "b"]
    df = spark.createDataFrame([("d", n) for n in names] + [("e", "handlex")], "dir string, name string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for most in (1, 2):
        want = sorted(("d", a, b, lev(a, b)) for a in names for b in names if a < b and lev(a, b) <= most)
        assert rows(similarity.near_names(df, "dir", "name", most)) == want


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "x"), ("g", "a")], "src string, dst string")
    assert rows(graph.strong_components(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert graph.strong_components(e.where("src = 'g'")).count() == 0
    assert graph.cover(e.where("src <> 'x'"), "src", "dst") == [("c", 2), ("a", 1), ("b", 1), ("d", 1), ("e", 1)]
    assert rows(graph.closes_cycle(e, spark.createDataFrame([("a", "c"), ("f", "a"), ("f", "z")], "src string, dst string"), 5)) == [("a", "c"), ("f", "a")]


def test_gates():
    assert matching.run_gates({"a": [], "b": ["a"], "c": ["b"]}, {"a": True, "b": False, "c": True}) == [("a", "passed"), ("b", "failed"), ("c", "skipped")]
    with pytest.raises(Exception):
        matching.ordered_gates({"a": ["b"], "b": ["a"]})


def test_contracts_and_suppression(spark):
    b = spark.createDataFrame([(1, "GET", "/Users/{id}"), (2, "POST", "/orders"), (3, "GET", "/a/b/c")], "id int, method string, path string")
    f = spark.createDataFrame([(9, "GET", "/users/:uid/"), (8, "GET", "/orders"), (7, "GET", "/z/y/c")], "id int, method string, path string")
    assert rows(matching.contract_matches(b, f)) == [(1, 9, 1.0), (2, 8, 0.75), (3, 7, 0.625)]  # an empty first segment counts as equal
    v = spark.createDataFrame([(1, "x", 2, "r1"), (2, "x", 3, "r1"), (3, "x", 3, "r2"), (4, "y", 2, "r1")], "id int, file string, line int, rule_id string")
    lines = spark.createDataFrame([("x", 2, "a = 1  # noqa: r1"), ("y", 5, "# noqa")], "file string, line int, text string")
    assert [r.id for r in matching.suppressed(v, lines).where("suppressed_inline").orderBy("id").collect()] == [1, 2]


def test_registers(spark):
    s = spark.createDataFrame([("k", "a", 1, "x"), ("k", "b", 1, "y"), ("k", "a", 0, "z"), ("k", "a", 1, "x")], "k string, agent string, at int, v string")
    assert rows(merges.last_writer(s, "k", "at", "agent", "v")) == [("k", "y")]
    assert [(r.k, r["values"]) for r in merges.concurrent_values(s, "k", "agent", "at", "v").collect()] == [("k", ["x", "y"])]
    doubled = s.unionByName(s)
    assert rows(merges.counter(s, "k", "agent", "at")) == rows(merges.counter(doubled, "k", "agent", "at")) == [("k", 2)]
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.9), ("a", "c", 0.1)], "src string, dst string, w double")
    assert rows(merges.without_cycles(e, "src", "dst", "w")) == [("a", "c", 0.1), ("b", "a", 0.9)]


def test_corrections(spark):
    t = spark.createDataFrame([("k", 0, 10, "a"), ("k", 10, None, "b")], "k string, s int, e int, v string")
    fix = spark.createDataFrame([("k", 4, "x"), ("k", 12, "y"), ("k", 15, "z"), ("other", 1, "q")], "k string, s int, v string")
    assert rows(temporal.corrected(t, fix, "k", "s", "e", "v")) == [("k", 0, 4, "a"), ("k", 10, 12, "b"), ("k", 12, 15, "y"), ("k", 15, None, "z"), ("k", 4, 10, "x")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.env").write_text("# c\nexport A=1\nB = \"two\"\n\nbroken\n")
    (tmp_path / "log").write_text("commit\tabc\tann\t100\n\n3\t1\tx.py\n2\t0\ty.py\ncommit\tdef\tbob\t200\n\n1\t1\tz\n")
    assert [(r.name, r.value) for r in readers.settings(spark, f"{tmp_path}/a.env").collect()] == [("A", "1"), ("B", "two")]
    assert rows(readers.commits(spark, f"{tmp_path}/log")) == [("abc", "ann", 100, 2, 5, 1), ("def", "bob", 200, 1, 1, 1)]
    files = readers.scan_folder(spark, str(tmp_path))
    known = files.where(F.col("path").endswith("log")).unionByName(spark.createDataFrame([("gone", 1, None, 5)], "path string, size bigint, modified timestamp, hash bigint"))
    assert sorted(r.status for r in readers.classify_files(files, known).collect()) == ["added", "removed", "unchanged"]
    specs = spark.createDataFrame([(1, '{"paths":{"/a":{"get":{},"post":{}},"/b":{"x-y":{}}}}'), (2, "broken")], "id int, t string")
    assert rows(readers.openapi_endpoints(specs, "id", "t")) == [(1, "GET", "/a"), (1, "POST", "/a")]
    gql = spark.createDataFrame([(1, "type User {\n  id: ID!\n  posts(n: Int): [Post]\n}\n")], "id int, t string")
    assert rows(readers.graphql_fields(gql, "id", "t")) == [(1, "User", "id", "ID!"), (1, "User", "posts", "[Post]")]
    proto = spark.createDataFrame([(1, "message M {\n  string a = 1;\n  repeated int32 b = 2;\n}\n")], "id int, t string")
    assert rows(readers.protobuf_fields(proto, "id", "t")) == [(1, "M", "a", "string", 1), (1, "M", "b", "repeated int32", 2)]
    assert rows(readers.rules_from_toml(spark, '[[rules]]\nid="r"\npattern="x"\ncategory="c"\n')) == [("r", "x", "c", 0.5)]


def test_small_expressions(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 2.0], "a\nb", "a\nc\nd")], "id int, x array<double>, y array<double>, s string, u string")
    r = df.select(vectors.cosine(F.col("x"), F.col("y")).alias("c"), vectors.cosine(F.col("x"), F.array(F.lit(1.0))).alias("z"), scoring.ramp_decay(F.lit(50)).alias("d"), similarity.jaccard(F.array(), F.array(), 1.0).alias("j")).first()
    assert (r.c, r.z, r.j) == (0.0, 0.0, 1.0) and r.d == pytest.approx(1 - 0.9 * 43 / 83)
    assert rows(upkeep.line_changes(df, "id", "s", "u")) == [(1, 2, 1)]


def test_cheapest_of_any_length(spark):
    e = spark.createDataFrame([(f"n{k}", f"n{k + 1}", 0.125) for k in range(7)] + [("n0", "n7", 1.0), ("n7", "n0", 0.5), ("n7", "x", 0.25), ("y", "n0", 0.1)], "src string, dst string, cost double")
    want = [(f"n{k}", 0.125 * k) for k in range(8)] + [("x", 1.125)]
    assert rows(graph.cheapest(e, "n0")) == want
    assert dict(rows(graph.cheapest(e, "n0", 2))) == {"n0": 0.0, "n1": 0.125, "n2": 0.25, "n7": 1.0, "x": 1.25}
    with pytest.raises(ValueError):
        graph.cheapest(e.withColumn("cost", F.col("cost") - 1), "n0")


def test_reach_of_any_length_against_closure(spark):
    import random

    random.seed(11)
    chain = [(f"c{k}", f"c{k + 1}") for k in range(4)]
    links = sorted({*chain, ("u", "u"), *((f"n{random.randint(0, 23)}", f"n{random.randint(0, 23)}") for _ in range(26))})
    nodes = sorted({x for e in links for x in e})
    starts = [n for k, n in enumerate(nodes) if k % 3 == 0]
    seen = {n: set() for n in nodes}
    for n in nodes:
        stack = [n]
        while stack:
            new = {b for a, b in links if a == stack[-1]} - seen[n]
            stack.pop()
            seen[n] |= new
            stack += new
    e = spark.createDataFrame(links, "src string, dst string")
    s = spark.createDataFrame([(x,) for x in starts], "node string")
    counts = {n: sum(n in seen[x] for x in starts if x != n) for n in nodes}
    assert dict(rows(graph.reach_counts(e, s))) == {n: c for n, c in counts.items() if c}
    new = [("c4", "c0"), ("c0", "c4"), *((f"n{k}", f"n{23 - k}") for k in range(12))]
    assert rows(graph.closes_cycle(e, spark.createDataFrame(new, "src string, dst string"))) == sorted((a, b) for a, b in new if a in seen.get(b, ()))
    left, want = {x: seen[x] - {x} for x in starts}, []
    while any(left.values()):
        best = min(left, key=lambda x: (-len(left[x]), x))
        want.append((best, len(left[best])))
        gone = set(left[best])
        left = {x: v - gone for x, v in left.items()}
    assert graph.reach_cover(e, s) == want


def test_outliers_of_large_groups(spark):
    values = [(1, k, 10 + (k * 7 % 11) * 0.1) for k in range(1200)] + [(1, 2000, 1e9), (1, 2001, 30.0), (1, 2002, -8.0)] + [(2, k, float(k % 2)) for k in range(40)] + [(3, k, 0.1) for k in range(60)] + [(3, 99, 7.0)]
    df = spark.createDataFrame(values, "g int, k int, v double")
    assert rows(statistics.esd_outliers(df, "g", "k", "v")) == [(1, 2000), (1, 2001), (1, 2002), (3, 99)]
    got = {r.g_: r for r in statistics.grubbs_outlier(df.withColumnRenamed("g", "g_"), "g_", "k", "v").collect()}
    assert {k: (r.k, r.outlier) for k, r in got.items()} == {1: (2000, True), 2: (0, False), 3: (99, True)}
    assert got[2].critical == pytest.approx(numeric.grubbs_criticals(40)[-1], abs=1e-12)


def test_minhash_recall_and_classes(spark):
    import random

    random.seed(12)
    base = [[random.randint(0, 400) for _ in range(30)] for _ in range(40)]
    sets = []
    for k, b in enumerate(base):
        for j in range(4):
            x = list(b)
            for _ in range(j % 3):
                x[random.randrange(30)] = random.randint(0, 400)
            sets.append((f"s{k:02d}{j}", [str(v) for v in x]))
    sets += [("hot%03d" % i, ["a", "b", "c", "d", "e", "f", "g", "h", "i", str(i)]) for i in range(60)] + [("empty", []), ("null", [None])]
    df = spark.createDataFrame(sets, "id string, items array<string>")
    exact = {(r.a, r.b) for r in similarity.similar_sets(df, "id", "items", 0.8)[0].collect()}
    found = {(r.a, r.b) for r in similarity.minhash_pairs(df, "id", "items", 0.8).collect()}
    assert found <= exact and len(exact) > 1700 and len(found) >= 0.99 * len(exact)
    got = {r.id: (r["class"], r.links) for r in similarity.similar_classes(df, "id", "items", 0.8).collect()}
    assert got["hot059"] == ("hot000", 59) and "empty" not in got and "null" not in got


def test_as_of_join_over_chunks(spark):
    import random
    from datetime import datetime, timedelta

    random.seed(2)
    at = lambda: datetime(2025, 1, 1) + timedelta(minutes=random.randint(0, 5000))
    right = [(random.choice("xyz"), at(), n, n if random.random() < 0.8 else None) for n in range(300)]
    left = [(random.choice("xyzw"), at(), i) for i in range(200)] + [(None, at(), 900), ("x", None, 901)]
    r, l = spark.createDataFrame(right, "k string, ts timestamp, nr bigint, v bigint"), spark.createDataFrame(left, "k string, ts timestamp, i bigint")
    got = {x.i: x.v for x in temporal.as_of_join(l, r, "k", "ts", "v", "nr").collect()}
    for k, t, i in left:
        old = [(b, n, v) for a, b, n, v in right if k and t and a == k and b <= t and v is not None]
        assert got[i] == (max(old)[2] if old else None)
    assert len(got) == len(left)


def test_index_recall(spark):
    """The index finds nine of ten of the exact neighbours, and every query has its rows."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 100 = 0")
    exact = {(r["query"], r.vec_id) for r in vectors.nearest(e, "vec_id", "embedding", q, 10).collect()}
    found = {(r["query"], r.vec_id) for r in vectors.indexed_nearest(e, "vec_id", "embedding", q, 10).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact), len(found & exact) / len(exact)
    assert vectors.indexed_nearest(e.limit(0), "vec_id", "embedding", q, 10).count() == 0


def knots(copies, size, tail):
    """Separate rings of `size` nodes, each with a way of `tail` nodes to it and one from it."""
    return [(f"{c}{p}{k}", f"{c}{q}{j}") for c in range(copies) for p, q, n in (("r", "r", size), ("i", "i", tail), ("o", "o", tail)) for k in range(n) for j in [(k + 1) % n if p == "r" else k + 1]] + [x for c in range(copies) for x in ((f"{c}i{tail}", f"{c}r0"), (f"{c}r0", f"{c}o0"))]


@pytest.fixture
def written(monkeypatch):
    """How many rows each table has that graph operators write."""
    from quarrymill.operators import ways
    from quarrymill.plans import session

    sizes = []

    def noting(df):
        out = real(df)
        sizes.append(out.count())
        return out

    real = session.cut
    monkeypatch.setattr(session, "cut", noting)
    monkeypatch.setattr(graph, "cut", noting)
    assert ways.LOCAL_EDGES > 1000
    return sizes


def test_cycles_of_separate_knots_write_no_pairs(spark, written):
    links = knots(4, 40, 20)
    e = spark.createDataFrame(links, "src string, dst string")
    new = [(f"{c}o20", f"{c}i0") for c in range(4)] + [(f"{c}r5", f"{c}r3") for c in range(4)] + [("0i0", "1o3"), ("q", "q"), ("q", "p")]
    assert rows(graph.closes_cycle(e, spark.createDataFrame(new, "src string, dst string"))) == sorted(x for x in new if x[0] == "q" and x[1] == "q" or x[0][0] == x[1][0] and x[0] != "q")
    assert sum(written) <= len(links) + len(new)


def test_cover_of_separate_knots_writes_no_pairs(spark, written):
    links = knots(4, 40, 20)
    e = spark.createDataFrame(links, "src string, dst string")
    starts = spark.createDataFrame([(f"{c}{x}",) for c in range(4) for x in ("i0", "i9", "r7", "o3")], "node string")
    assert graph.reach_cover(e, starts) == [(f"{c}i0", 81) for c in range(4)]
    assert sum(written) <= len(links) + 16


def test_coverage_of_separate_knots_writes_no_pairs(spark, written):
    links = knots(4, 40, 20)
    e = spark.createDataFrame(links, "src string, dst string")
    starts = spark.createDataFrame([(f"{c}{x}",) for c in range(4) for x in ("i0", "r7", "o3")], "node string")
    want = {f"{c}i{k}": 1 for c in range(4) for k in range(1, 21)} | {f"{c}r{k}": 2 - (k == 7) for c in range(4) for k in range(40)} | {f"{c}o{k}": 2 + (k > 3) for c in range(4) for k in range(21)}
    assert dict(rows(graph.reach_counts(e, starts, "tests"))) == want
    assert sum(written) <= len(links) + 12


def test_callers_of_separate_knots_write_no_pairs(spark, written):
    links = knots(4, 40, 20)
    e = spark.createDataFrame(links, "src string, dst string")
    want = {f"{c}i{k}": k for c in range(4) for k in range(1, 21)} | {f"{c}r{k}": 60 for c in range(4) for k in range(40)} | {f"{c}o{k}": 61 + k for c in range(4) for k in range(21)}
    assert dict(rows(graph.reach_counts(e, e.select(F.col("src").alias("node")), "callers"))) == want
    assert sum(written) <= 2 * len(links)


def test_components_behind_long_ways_take_few_rounds(spark, written):
    e = spark.createDataFrame(knots(2, 3, 15), "src string, dst string")
    assert rows(graph.strong_components(e)) == [(f"{c}r{k}", f"{c}r0") for c in range(2) for k in range(3)]
    assert len(written) <= 3


def test_graphs_beyond_one_task(spark, monkeypatch):
    from quarrymill.operators import ways

    monkeypatch.setattr(ways, "LOCAL_EDGES", 0)
    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "a")]
    e, s = spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([("a",), ("x",)], "node string")
    assert rows(graph.strong_components(e)) == [("a", "a"), ("b", "a")]
    assert rows(graph.reach_counts(e, s)) == [("a", 1), ("b", 2), ("c", 2), ("d", 2)]
    assert graph.reach_cover(e, s) == [("x", 4)]
    assert rows(graph.closes_cycle(e, spark.createDataFrame([("d", "a"), ("a", "d"), ("z", "z")], "src string, dst string"))) == [("d", "a"), ("z", "z")]


def shuffled(spark):
    """Records that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_callers_are_counted_where_the_edges_lie(spark, written):
    links = knots(4, 40, 20)
    e = spark.createDataFrame(links + links[:50] + [("q", "q")], "src string, dst string").repartition(2).localCheckpoint()
    want = {f"{c}i{k}": k for c in range(4) for k in range(1, 21)} | {f"{c}r{k}": 60 for c in range(4) for k in range(40)} | {f"{c}o{k}": 61 + k for c in range(4) for k in range(21)}
    before = shuffled(spark)
    assert dict(rows(graph.reach_counts(e, name="callers"))) == want
    assert shuffled(spark) - before <= 2 and not written  # one row a partition, to count the edges


def test_transitive_callers_of_the_query_move_nothing(spark, written):
    from quarrymill.queries.graphs import QUERIES

    before = shuffled(spark)
    got = QUERIES["blast_radius_transitive"](spark, "/root/testdata/sf0.01").collect()
    assert got and shuffled(spark) - before <= 2 and not written


def test_callers_beyond_one_task(spark, monkeypatch):
    from quarrymill.operators import ways

    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "a")]
    e = spark.createDataFrame(links * 2, "src string, dst string")
    for most in (9, 4):  # the repeated edges are too many; the different ones are too many
        monkeypatch.setattr(ways, "LOCAL_EDGES", most)
        assert rows(graph.reach_counts(e)) == [("a", 2), ("b", 2), ("c", 3), ("d", 4)]


def common_sets(n):
    """Sets that nearly all have some items in common, few of them most."""
    import random

    random.seed(13)
    return [(f"s{k:03d}", sorted(f"w{x:02d}" for x in random.sample(range(30), 10))) for k in range(n)]


def test_similar_sets_move_no_candidates(spark):
    sets = common_sets(600)
    before = shuffled(spark)
    got = rows(similarity.similar_sets(spark.createDataFrame(sets, "id string, items array<string>"), "id", "items", 0.6)[0])
    moved = shuffled(spark) - before
    sim = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert got == [(a, b, sim(x, y)) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if sim(x, y) >= 0.6] and got
    assert 0 < moved < 40_000


def test_bucketed_sets_against_all_pairs(monkeypatch):
    import math
    import random

    import pyarrow as pa

    from quarrymill.operators import overlap

    for seed in range(60):
        random.seed(seed)
        size, t, buckets = random.choice([5, 12, 40, 300]), random.choice([1 / 3, 0.5, 0.6, 0.8, 0.9, 1.0]), random.choice([1, 2, 5])
        monkeypatch.setattr(overlap, "CHUNK", random.choice([3, 50, 1_000_000]))
        monkeypatch.setattr(overlap, "MOST_KEYS", random.choice([1, 30, 400]))
        base = [random.sample(range(size), min(size, random.randint(2, 60))) for _ in range(10)]
        sets = {k: (random.choice([0, 0, -7]), sorted({*random.choice(base)[random.randint(0, 1) :], *random.sample(range(size), 2)})) for k in range(40)}
        placed = [{"bucket": b, "s": k, "g": g, "items": x} for k, (g, x) in sets.items() for b in {v % buckets for v in x[: len(x) - math.ceil(len(x) * t - 1e-9) + 1]}]
        got = [(min(r["x"], r["y"]), max(r["x"], r["y"])) for b in overlap.similar(iter(pa.Table.from_pylist(placed, overlap.SCHEMA).to_batches(max_chunksize=9)), t, buckets) for r in b.to_pylist()]
        same = lambda x, y: len({*x} & {*y}) >= t * len({*x} | {*y}) - 1e-9 and {*x} & {*y}
        assert sorted(got) == [(i, j) for i in sets for j in sets if i < j and sets[i][0] == sets[j][0] and same(sets[i][1], sets[j][1])]


def test_minhash_moves_no_candidates(spark):
    sets = [*common_sets(600), ("t1", list("abcdefghij")), ("t2", list("abcdefghik"))]
    before = shuffled(spark)
    got = rows(similarity.minhash_pairs(spark.createDataFrame(sets, "id string, items array<string>"), "id", "items", 0.8))
    moved = shuffled(spark) - before
    sim = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    exact = {(a, b): sim(x, y) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if sim(x, y) >= 0.8}
    assert {(a, b): s for a, b, s in got}.items() <= exact.items() and len(got) >= 0.9 * len(exact) and got
    assert 0 < moved < 20_000
