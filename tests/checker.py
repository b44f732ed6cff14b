"""Side-by-side comparison of registered queries with their oracle SQL.

Run as a script:  python tests/checker.py [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("CHECK_SF", "/root/testdata/sf0.01")


def _kind(values):
    for v in values:
        if v is None:
            continue
        if isinstance(v, bool):
            return "bool"
        if isinstance(v, int):
            return "int"
        if isinstance(v, (float, decimal.Decimal)):
            return type(v).__name__
        if isinstance(v, datetime.datetime):
            return "timestamp" + ("tz" if v.tzinfo else "")
        return type(v).__name__
    return "null"


def compare(spark, name, fn, sql, con):
    """Return (ok, message)."""
    df = fn(spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if sql is None:
        return True, f"rows-only {len(got)}"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    if not got and not want:
        return False, "both empty"
    gk, wk = [_kind(x) for x in zip(*got)], [_kind(x) for x in zip(*want)]
    bad = [(c, a, b) for c, a, b in zip(cols, gk, wk) if a != b and "null" not in (a, b)]
    if bad:
        return False, f"types {bad}"
    a, b = sorted(map(repr, got)), sorted(map(repr, want))
    if a == b:
        return True, f"{len(a)} rows equal"
    sa, sb = set(a) - set(b), set(b) - set(a)
    return False, (f"rows {len(a)} vs {len(b)}; cols {cols}\n   spark only {len(sa)}: " + "\n     ".join(sorted(sa)[:3])
                   + f"\n   oracle only {len(sb)}: " + "\n     ".join(sorted(sb)[:3]))


def connect():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def main(prefixes):
    from __spark_entry__ import oracle_sql, queries
    from wireloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(), oracle_sql(), []
    for name, fn in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, name, fn, sqls.get(name), con)
        except Exception as exc:  # report and go on
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
