"""Run queries and their SQL side by side: python tests/check_oracles.py [folder] [name ...]"""

import math
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from segue.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fixed = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(fixed, key=repr)


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def main(folder, names):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    stages = tempfile.mkdtemp(prefix="segue-check-")
    spark = local_session(8, 8, **{"spark.driver.memory": "16g", "spark.checkpoint.dir": stages})
    spark.sparkContext.setLogLevel("ERROR")
    todo = names or list(queries())
    bad = 0
    for name in todo:
        s = time.time()
        try:
            df = queries()[name](spark, folder)
            got = df.collect()
            took = time.time() - s
            if name not in oracle_sql():
                print(f"{name}: rows only, {len(got)} rows, {took:.1f}s", flush=True)
                continue
            s = time.time()
            rel = con.execute(oracle_sql()[name])
            cols = [d[0] for d in rel.description]
            want = rel.fetchall()
            duck = time.time() - s
            gc, g = rows_of(df.columns, got)
            wc, w = rows_of(cols, want)
            ok = gc == wc and g == w
            print(f"{name}: {'ok' if ok else 'DIFFERENT'}, {len(got)} rows, {took:.1f}s, sql {duck:.1f}s", flush=True)
            if not ok:
                bad += 1
                print("   ", gc, wc, len(g), len(w))
                diff = [(a, b) for a, b in zip(g, w) if a != b][:3]
                print("   ", diff, flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:600]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    main(args[0] if args else "/root/testdata/sf0.001", args[1:])
