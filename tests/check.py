"""Run registered queries against their SQL in DuckDB: python tests/check.py [prefix ...]"""

from __future__ import annotations

import math
import sys
import threading
import time

sys.path.insert(0, "/root/repo")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return f"{type(v).__name__}:{v}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)} rows {t1 - t0:.1f}s", True
    timer = threading.Timer(60, con.interrupt)
    timer.start()
    try:
        cur = con.execute(sql)
    finally:
        timer.cancel()
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(df.columns) != sorted(want_cols):
        return f"COLUMNS {sorted(df.columns)} != {sorted(want_cols)}", False
    a, b = rows_of(df.columns, [tuple(x) for x in got]), rows_of(want_cols, want)
    note = f"{len(a)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if a == b:
        return note + (" EMPTY" if not a else ""), bool(a)
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return f"{note} vs {len(b)} DIFF\n   cols  {sorted(df.columns)}\n   spark {only_a}\n   duck  {only_b}"[:1800], False


def main(argv):
    import __spark_entry__ as e
    from shelfsight.session import local_session
    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("sf"):
        sf_dir = f"/root/testdata/{argv.pop(0)}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = []
    for name, fn in e.queries().items():
        if argv and not any(name == p or name.startswith(p + "_") or (p.endswith("*") and name.startswith(p[:-1])) for p in argv):
            continue
        try:
            note, ok = compare(spark, con, name, fn, e.oracle_sql().get(name), sf_dir)
        except Exception as ex:  # noqa: BLE001
            note, ok = f"ERROR {type(ex).__name__} {str(ex)[:700]}", False
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failing", *bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
