"""Compare registered queries with their SQL in DuckDB: python -m tests.compare [-d FOLDER] [NAME...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings bridge_metrics violations feedback bridge_grounding_results "
    "memory_events aggregated_patterns pattern_locations merge_candidates scan_history pack_capacities"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if hasattr(x, "as_tuple"):
        return round(float(x), 6) + 0.0
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, query, sql: str, folder: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, folder)
    a = rows_of(df.columns, df.collect())
    cur = duck(folder).execute(sql)
    b = rows_of([c[0] for c in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        from collections import Counter

        x, y = Counter(map(repr, a[1])), Counter(map(repr, b[1]))
        return f"rows {len(a[1])} and {len(b[1])}; only Spark: {list((x - y).elements())[:3]}; only SQL: {list((y - x).elements())[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    from quarrymill.plans.session import local_session

    args = sys.argv[1:]
    skip = args[:1] == ["--own"] and args.pop(0)  # without the numbered problems
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        folder, args = args[1], args[2:]
    spark, queries, sql = local_session(), entry.queries(), entry.oracle_sql()
    for name in [q for q in queries if (not args or any(q.startswith(a) for a in args)) and not (skip and q[:1] == "p" and q[1:2].isdigit())]:
        began = time.time()
        try:
            said = difference(spark, queries[name], sql[name], folder) if name in sql else f"no SQL; {queries[name](spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"error: {str(e)[:400]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
