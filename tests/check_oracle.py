"""Run queries next to their SQL: python tests/check_oracle.py [sf_dir] [name ...]"""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, columns):
    """Sorted rows of values as text, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def kinds(rows, columns):
    out = {}
    for i, c in enumerate(columns):
        types = {type(r[i]).__name__ for r in rows if r[i] is not None}
        out[c] = types
    return out


def compare(spark, con, name, fn, sql, sf_dir):
    """Problem text, or None when Spark and SQL agree in names, types and values."""
    df = fn(spark, sf_dir)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} / {sorted(want_columns)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}", len(got)
    a, b = canonical(got, got_columns), canonical(want, want_columns)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} rows differ, first {str(diff[0])[:700]}", len(got)
    ka, kb = kinds(got, got_columns), kinds(want, want_columns)
    if ka != kb:
        return f"types {ka} / {kb}", len(got)
    return None, len(got)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from calltrail.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            sql = oracle_sql().get(name)
            if sql is None:
                problem, n = None, queries()[name](spark, sf_dir).count()
                note = "rows only"
            else:
                problem, n = compare(spark, con, name, queries()[name], sql, sf_dir)
                note = "ok"
        except Exception as e:
            problem, n = "".join(traceback.format_exception_only(e))[:900], -1
        bad += problem is not None
        print(f"{name:28s} {n:8d} {time.time() - start:6.2f}s  {problem or note}", flush=True)
    print("bad:", bad)
