"""Run registered queries next to their SQL and compare the values.

    python -m workloads.compare [name-prefix ...] [--sf FOLDER]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    """One comparable form for values of both engines."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def difference(spark: SparkSession, con, folder: str, name: str) -> str | None:
    """What differs between a query and its SQL, or None; rows-only when it has no SQL."""
    from workloads import ORACLES, QUERIES

    df = QUERIES[name](spark, folder)
    got = df.collect()
    if name not in ORACLES:
        return None if got else "no rows"
    cur = con.execute(ORACLES[name])
    want_columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} against {sorted(want_columns)}"
    a, b = rows_of(df.columns, got), rows_of(want_columns, want)
    if a == b:
        return None if a else "both sides are empty"
    return f"{len(got)} against {len(want)} rows; only here {list((a - b))[:3]}; only there {list((b - a))[:3]}"


def main() -> None:
    from keyweave import build_session
    from workloads import ORACLES, QUERIES

    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if "--sf" in args:
        at = args.index("--sf")
        folder = args[at + 1]
        del args[at : at + 2]
    spark = build_session(master="local[8]", shuffle_partitions=8, extra={"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    con = duck(folder)
    bad = 0
    for name in QUERIES:
        if args and not any(name.startswith(prefix) for prefix in args):
            continue
        start = time.time()
        try:
            problem = difference(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok " if problem is None else "BAD"
        bad += problem is not None
        print(f"{mark} {name} {time.time() - start:.1f}s {'' if name in ORACLES else '(rows only)'} {problem or ''}", flush=True)
    print("differences:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
