"""Side-by-side run of a registered query and its SQL twin.

Run as a script: ``python -m tests.compare [sf] [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return repr(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return rows_of(columns, cur.fetchall())


TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def type_mismatch(con, sql, df):
    got = dict(df.dtypes)
    want = {r[0]: TYPES.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v and "[]" not in v}


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from wavemill.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in argv[1:] or qs:
        try:
            t0 = time.time()
            df = qs[name](spark, sf_dir)
            cols, got = spark_rows(df)
            t1 = time.time()
            if name not in sqls:
                print(f"rows  {name} {len(got)} {t1 - t0:.1f}s")
                continue
            want_cols, want = duck_rows(con, sqls[name])
            t2 = time.time()
            types = type_mismatch(con, sqls[name], df)
            ok = cols == want_cols and got == want and not types
            bad += not ok
            print(f"{'ok   ' if ok else 'DIFF '} {name} {len(got)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s")
            if not ok:
                print("   columns", cols, want_cols, len(got), len(want), types)
                for a, b in [(a, b) for a, b in zip(got, want) if a != b][:3]:
                    print("   ", a, "\n    ", b)
        except Exception as e:
            bad += 1
            print(f"FAIL  {name} {type(e).__name__} {str(e)[:600]}")
    print("bad", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
