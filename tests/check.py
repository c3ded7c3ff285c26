"""Run registered queries against their check SQL on one data folder.

    python tests/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted((tuple(normal(r[i]) for i in order) for r in rows), key=str),
    )


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark_df, con, check_sql):
    """None if both sides agree, else a description of the difference."""
    mine = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(check_sql)
    theirs = table([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} vs {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine[1])} rows differ, first:\n  spark {wrong[0][0]}\n  check {wrong[0][1]}"
    return None


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf_dir, argv = argv[1], argv[2:]
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from churnspark.session import local_session, release

    spark = local_session(os.environ.get("CORES", "8"))
    con = duck(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in checks:
                problem = compare(df, con, checks[name])
                n = len(con.execute(checks[name]).fetchall())
            else:
                problem, n = None, df.count()
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        failed += problem is not None
        release(spark)
        mark = "FAIL" if problem else ("ok  " if name in checks else "rows")
        print(f"{mark} {name:32s} {n:7d} rows {time.time() - start:6.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
