"""Small cases of the general problems: nulls, ties, repeats, empty tables, loops, hot keys, extra columns."""

import random
from datetime import datetime

import pytest

from quarrymill.operators import changefeed, hierarchy, references, trailing

METRIC = "id bigint, metric_name string, metric_value double, recorded_at bigint, total double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_trailing_against_brute_force(spark):
    random.seed(5)
    series = {(k, d): random.randint(1, 40) / 4 for k in "abc" for d in random.sample(range(20000, 20100), 30)}
    df = spark.createDataFrame([(k, d, v) for (k, d), v in series.items()] + [("a", None, 1.0), (None, 20000, 1.0), ("a", 20001, None)], "key string, day bigint, value double")
    got = {(r.key, r.day): r for r in trailing.trailing(trailing.daily_series(df), (7, 30)).collect()}
    for k in "abc":
        days = [d for kk, d in series if kk == k]
        for d in range(min(days), max(days) + 1):
            r = got.pop((k, d))
            for n in (7, 30):
                inside = [series[(k, x)] for x in range(d - n + 1, d + 1) if (k, x) in series]
                assert r[f"total_{n}"] == pytest.approx(sum(inside)) and r[f"n_{n}"] == len(inside)
    assert not got


def test_metric_cases(spark):
    day = 86400
    data = [(1, " A ", 4.0, 0, 0.0), (1, " A ", 4.0, 0, 0.0), (2, "a", 4.0, 40 * day * 1000 + 10**12, 0.0), (3, "a", -1.0, 5 * day, 0.0), (4, "a", None, 6 * day, 0.0), (5, None, 1.0, day, 0.0), (6, "  ", 1.0, day, 0.0), (7, "a", float("nan"), day, 0.0), (None, "b", 2.0, 0, 0.0)]
    df = spark.createDataFrame(data, METRIC)
    readings = rows(trailing.metric_readings(df))
    assert readings == [("a", 0, 4.0), ("a", (40 * day + 10**9) // day, 4.0), ("b", 0, 2.0)]
    found = trailing.silences_and_surges(df)
    assert {r.metric_name for r in found.collect()} == {"a"} and all(r.kind in ("silent", "surge") for r in found.collect())
    assert trailing.silences_and_surges(spark.createDataFrame([], METRIC)).count() == 0


def _tables(spark):
    f = spark.createDataFrame([(1, " V1 ", 100, "x"), (1, " V1 ", 100, "x"), (2, "gone", 100, "x"), (3, None, 100, "x"), (4, "  ", 100, "x"), (5, "v2", 50, "x"), (6, "v1", None, "x")], "id bigint, violation_id string, created_at bigint, period string")
    v = spark.createDataFrame([("v1", 10, "p"), ("v1", 10, "p"), ("V2", 60, "p"), (None, 1, "p")], "id string, created_at bigint, key string")
    g = spark.createDataFrame([(1, "M1", 10), (2, "m1", 25), (3, "m1", 35), (4, "m2", 10), (5, "m3", 1)], "id bigint, memory_id string, created_at bigint")
    t = lambda s: datetime.fromtimestamp(s)
    e = spark.createDataFrame(
        [(1, "m1", t(5), "Created"), (2, "m1", t(20), "archived"), (2, "m1", t(40), "archived"), (3, "m1", t(30), "Restored"), (4, "m3", t(9), "created"), (5, "m4", t(1), "archived")],
        "event_id bigint, memory_id string, recorded_at timestamp, event_type string",
    )
    return f, v, g, e


@pytest.mark.parametrize("least", [1, 1000])
def test_orphans(spark, monkeypatch, least):
    import os
    import time

    monkeypatch.setitem(os.environ, "TZ", "UTC")
    time.tzset()
    f, v, g, e = _tables(spark)
    got = rows(references.orphan_references(f, v, g, e, most=3, least=least).select("source_table", "row_id", "reason"))
    assert got == [("bridge_grounding_results", 2, "deleted"), ("bridge_grounding_results", 4, "missing"), ("bridge_grounding_results", 5, "late"), ("feedback", 2, "missing"), ("feedback", 5, "late")]
    none = references.orphan_references(f.limit(0), v.limit(0), g, e.limit(0))
    assert {r.reason for r in none.collect()} == {"missing"} and none.count() == 5


def test_forest(spark):
    n = 400
    links = [(f"n{i:04d}", f"n{i - 1:04d}" if i else None) for i in range(n)] + [(f"c{i:03d}", f"c{(i + 1) % 150:03d}") for i in range(150)] + [(f"s{i}", "c007") for i in range(50)] + [("self", "self"), ("alone", None)]
    df = spark.createDataFrame(links, "id string, parent string")
    for capacity in (60, 10_000):
        got = {r.id: r for r in hierarchy.solve_forest(df, True, capacity).collect()}
        assert len(got) == len(links)
        assert all((got[f"n{i:04d}"].root_id, got[f"n{i:04d}"].depth, len(got[f"n{i:04d}"].path)) == ("n0000", i, i + 1) for i in range(n))
        assert all((got[x].root_id, got[x].depth, got[x].path) == ("c000", -1, None) for x in ("c000", "c149", "s3"))
        assert (got["self"].root_id, got["self"].depth) == ("self", -1) and (got["alone"].root_id, got["alone"].depth) == ("alone", 0)
    assert hierarchy.solve_forest(df.limit(0)).count() == 0
    d = rows(hierarchy.descendants(hierarchy.solve_forest(df.where("id <= 'n0003' AND id >= 'n'"), True)))
    assert d == [("n0000", "n0001", 1), ("n0000", "n0002", 2), ("n0000", "n0003", 3), ("n0001", "n0002", 1), ("n0001", "n0003", 2), ("n0002", "n0003", 1)]


def test_pattern_links(spark):
    p = spark.createDataFrame(
        [("a", None, ["b", None, "x"], 1), ("a", None, ["b"], 0), ("b", "unknown", None, 1), ("c", "a", [], 1), ("c", "a", [], 1), (None, "a", [], 1), ("d", None, ["b"], 2)],
        "pattern_id string, parent_id string, child_ids array<string>, updated_at bigint",
    )
    assert rows(hierarchy.pattern_links(p)) == [("a", None), ("b", "a"), ("c", "a"), ("d", None)]


EVENT = "event_id bigint, memory_id string, recorded_at timestamp, event_type string, delta string, schema_version int, content_hash string"


def test_changes(spark):
    t = lambda s: datetime(2025, 1, 1 + s // 1000, 0, 0, s % 60, s % 1000)
    data = [
        (1, "a", t(1000), "content_updated", '{"new_content_hash":"early"}', 1, ""),
        (2, "a", t(2000), "Created", '{"content_hash":"h1"}', 1, ""),
        (3, "a", t(3000), "ContentUpdated", '{"content_hash":{"new":"h2"}}', 2, ""),
        (3, "a", t(9000), "ContentUpdated", '{"content_hash":{"new":"h2"}}', 2, ""),
        (4, "a", t(3500), "content_updated", '{"new_content_hash":"h3', 1, ""),
        (5, "a", t(3600), "content_updated", None, 1, ""),
        (6, "a", t(3700), "content_updated", '{"new_summary":"s"}', 1, ""),
        (7, "b", t(1000), "created", '{"content_hash":"b1"}', 1, ""),
        (8, "b", t(1001), "archived", "{}", 1, ""),
        (9, "c", t(1000), "created", '{"content_hash":"c1"}', 1, ""),
        (10, "c", t(1001), "superseded", "{}", 1, ""),
        (11, "c", t(5000), "created", '{"content_hash":"c2"}', 2, ""),
        (12, "d", t(1000), "archived", "{}", 1, ""),
        (13, "e", t(1000), "created", "null", 1, ""),
        (14, "f", t(1000), "created", "{}", 1, ""),
        (None, "g", t(1000), "created", "{}", 1, ""),
    ]
    df = spark.createDataFrame(data, EVENT)
    assert rows(changefeed.live_memories(df)) == [("a", "h2"), ("c", "c2"), ("f", None)]
    base = spark.createDataFrame([("d", "d0", False, False), ("z", "z0", None, None), ("b", "old", False, True)], "memory_id string, content_hash string, archived boolean, superseded boolean")
    assert rows(changefeed.apply_changes(df, base)) == [("a", "h2", False, False), ("b", "b1", True, False), ("c", "c2", False, False), ("d", "d0", True, False), ("f", None, False, False), ("z", "z0", False, False)]
    assert changefeed.live_memories(df.limit(0)).count() == 0


def test_composition_is_associative(spark):
    random.seed(3)
    kinds = ["created", "content_updated", "archived", "restored", "superseded"]
    data = []
    for i in range(400):
        k = random.choice(kinds)
        data.append((i, random.choice("xyz"), datetime(2025, 1, random.randint(1, 9), 0, 0, random.randint(0, 5)), k, '{"content_hash":"h%d","new_content_hash":"h%d"}' % (i, i), 1, ""))
    state = {}
    for e in sorted(data, key=lambda e: (e[2], e[0])):
        s = state.get(e[1])
        if e[3] == "created":
            state[e[1]] = [f"h{e[0]}", False, False]
        elif s:
            if e[3] == "content_updated":
                s[0] = f"h{e[0]}"
            elif e[3] == "superseded":
                s[2] = True
            else:
                s[1] = e[3] == "archived"
    random.shuffle(data)
    assert rows(changefeed.apply_changes(spark.createDataFrame(data, EVENT))) == sorted((k, *v) for k, v in state.items())


def test_shared_folder_must_be_set_on_a_cluster(monkeypatch):
    from quarrymill.plans.session import shared_folder

    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

    class Session:
        conf = Conf({"spark.master": "local-cluster[3,2,1024]"})

    with pytest.raises(ValueError):
        shared_folder(Session())
    Session.conf["spark.checkpoint.dir"] = "file:///shared/"
    assert shared_folder(Session()) == "file:///shared"
