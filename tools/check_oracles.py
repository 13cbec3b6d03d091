"""Compare every registered query with its SQL on DuckDB: columns, types, rows and values.

usage: python tools/check_oracles.py [sf_dir] [key-or-prefix* ...]
"""

from __future__ import annotations

import sys
import tempfile
import time
import traceback
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from orefield.session import build_session  # noqa: E402
from orefield.workload import all_entries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    return repr(value)


def duck_type(spark_type):
    if spark_type.startswith("decimal"):
        return spark_type.upper()
    return KINDS.get(spark_type, spark_type)


def compare(df, con, sql):
    """Problems found, empty when the two agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = dict(zip(names, [str(d[1]) for d in result.description], strict=True))
    theirs = result.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, dtype in df.dtypes:
        if duck_type(dtype) != types[name]:
            problems.append(f"type of {name}: {dtype} != {types[name]}")
    order = sorted(names)
    at = [names.index(n) for n in order]
    ours = Counter(tuple(plain(r[n]) for n in order) for r in df.select(*order).collect())
    them = Counter(tuple(plain(r[i]) for i in at) for r in theirs)
    if ours != them:
        only, missing = ours - them, them - ours
        problems.append(
            f"rows {sum(ours.values())} vs {sum(them.values())}; {sum(only.values())} differ\n"
            f"    columns {order}\n    ours   {list(only)[:3]}\n    oracle {list(missing)[:3]}"
        )
    return problems


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session(
        "check", master="local[8]", shuffle_partitions=8, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="orefield-check-")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad, n, rows_only = [], 0, 0
    for key, e in all_entries().items():
        if args and not any(key == a or (a.endswith("*") and key.startswith(a[:-1])) for a in args):
            continue
        n += 1
        t0 = time.time()
        try:
            df = e(spark, sf_dir)
            if e.sql:
                problems = compare(df, con, e.sql)
            else:
                rows_only += 1
                problems = [] if df.count() else ["no rows"]
        except Exception as exc:  # noqa: BLE001
            text = str(exc) if str(exc) else traceback.format_exc()
            problems = [f"{type(exc).__name__}: {text[:700]}"]
        took = time.time() - t0
        if problems or took > 4:
            print(f"{'FAIL' if problems else 'ok'} {key} {took:.1f}s")
        for p in problems:
            print("   ", p)
        if problems:
            bad.append(key)
    print(f"{n} queries, {n - rows_only} against SQL, {len(bad)} bad: {' '.join(bad)}")


if __name__ == "__main__":
    main()
