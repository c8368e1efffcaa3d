"""Run registered queries and their SQL side by side; also usable as a script."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir) -> str:
    """Blank when both agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from rowferry.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    folder, picked = sys.argv[1], sys.argv[2:]
    con, sql = connect(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if picked and name not in picked:
            continue
        start = time.time()
        try:
            said = compare(spark, con, query, sql[name], folder) if name in sql else "no oracle"
        except Exception as error:  # noqa: BLE001
            said = f"{type(error).__name__}: {str(error)[:500]}"
        print(f"{name:26s} {time.time() - start:6.2f}s {said or 'ok'}", flush=True)
