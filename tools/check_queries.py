"""Run each query on Spark and its SQL on DuckDB over the same folder and compare all rows.

    python tools/check_queries.py [--dir FOLDER] [--only SUBSTRING ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tableloom.plans import load  # noqa: E402
from tableloom.plans.registry import SCHEMAS, Tables  # noqa: E402
from tableloom.session import local_session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, folder, query, con):
    return compare_frame(query.run(Tables(spark, folder)), query, con)


def compare_frame(df, query, con):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return True, f"rows only: {len(got[1])}"
    rel = con.sql(query.sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} vs {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, f"{len(got[1])} vs {len(want[1])} rows; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
    types = {c: t for c, t in df.dtypes}
    return True, f"{len(got[1])} rows {types if not got[1] else ''}"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--dir", default="/root/testdata/sf0.01")
    ap.add_argument("--only", nargs="*", default=[])
    args = ap.parse_args()
    spark = local_session()
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in SCHEMAS:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{args.dir}/{name}.parquet'")
    bad = 0
    for name, q in load().items():
        if args.only and not any(o in name for o in args.only):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, args.dir, q, con)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {note}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
