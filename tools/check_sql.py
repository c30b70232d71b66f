"""Compare named queries with their SQL: ``python tools/check_sql.py [folder] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyhouse.plans import load_queries  # noqa: E402
from tallyhouse.session import build_session  # noqa: E402
from tallyhouse.sources.tables import TABLE_SCHEMAS  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return f"decimal:{v}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return repr(v)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for name in TABLE_SCHEMAS:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name, q in load_queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = q(spark, folder)
            got = [r.asDict() for r in df.collect()]
            cols = sorted(df.columns)
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {str(e)[:600]}")
            continue
        took = time.time() - start
        if q.sql is None:
            print(f"rows {name}: {len(got)} rows, {took:.2f}s")
            continue
        try:
            res = duck.execute(q.sql)
            want_cols = [d[0] for d in res.description]
            want = [dict(zip(want_cols, r, strict=True)) for r in res.fetchall()]
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: SQL: {str(e)[:600]}")
            continue
        a = sorted(tuple(plain(r[c]) for c in cols) for r in got)
        same_cols = cols == sorted(want_cols)
        b = sorted(tuple(plain(r[c]) for c in cols) for r in want) if same_cols else None
        if a == b:
            print(f"ok   {name}: {len(a)} rows, {took:.2f}s{'  EMPTY' if not a else ''}")
            continue
        bad += 1
        print(f"DIFF {name}: cols {cols} / {sorted(want_cols)}, rows {len(got)} / {len(want)}")
        if same_cols:
            sa, sb = set(a), set(b)
            print("   only here:", [x for x in a if x not in sb][:3])
            print("   only SQL: ", [x for x in b if x not in sa][:3])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
