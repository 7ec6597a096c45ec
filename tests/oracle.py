"""Run registered queries beside their SQL twins on the same parquet files.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("railtap")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return "0.0" if v == 0 else f"{v:.6g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "item"):
        return _cell(v.item())
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str):
    """(ok, message, spark seconds)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    took = time.time() - t0
    cols = sorted(df.columns)
    types = dict(df.dtypes)
    if sql is None:
        return len(rows) > 0, f"{len(rows)} rows, no SQL twin", took
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
    if sorted(dcols) != cols:
        return False, f"columns differ: spark {cols} sql {sorted(dcols)}", took
    want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = [f"{c}: {types[c]} vs {dtypes[c]}" for c in cols if want.get(types[c], dtypes[c]) != dtypes[c]]
    a = sorted(tuple(_cell(r[c]) for c in cols) for r in rows)
    b = sorted(tuple(_cell(r[c]) for c in cols) for r in drows)
    note = f"; types {off}" if off else ""
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        return False, f"rows {len(a)} vs {len(b)}; cols {cols}\n  spark only {only_a}\n  sql only   {only_b}{note}", took
    return not off, f"{len(a)} rows equal{note}", took


def main(argv):
    import __spark_entry__ as entry
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark, con = session(), duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            ok, msg, took = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, msg, took = False, f"{type(e).__name__}: {str(e)[:1500]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.2f}s {msg}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
