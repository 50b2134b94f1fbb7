"""Compares queries with their SQL in DuckDB, order aside; run as a script with query names."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings crawl_runs index_rows listing_pairs listing_views discovered_listings opportunity_details sources eval_items curated_places fx_rates pay_periods mix_targets listing_snapshots".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal, int)):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    return str(x)


def normal(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, query, sql: str, sf_dir: str, con=None) -> tuple[bool, str]:
    t = time.time()
    df = query(spark, sf_dir)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    cur = (con or connect(sf_dir)).execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = normal(columns, cur.fetchall())
    same = sorted(columns) == sorted(df.columns) and mine == theirs
    note = f"{name}: {len(mine)} rows, {took:.1f} s" + ("" if same else f" against {len(theirs)}; columns {sorted(df.columns)} {sorted(columns)}; only here {[x for x in mine if x not in set(theirs)][:3]}; only there {[x for x in theirs if x not in set(mine)][:3]}")
    return same, note


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from skein.session import local_session

    where = next((a for a in sys.argv[1:] if "/" in a), "/root/testdata/sf0.01")
    names = [a for a in sys.argv[1:] if "/" not in a] or list(e.queries())
    spark, con, sql, queries = local_session(8), connect(where), e.oracle_sql(), e.queries()
    bad = 0
    for n in [q for q in queries if any(q == a or a.endswith("*") and q.startswith(a[:-1]) for a in names)]:
        try:
            if n in sql:
                ok, note = compare(spark, n, queries[n], sql[n], where, con)
            else:
                t = time.time()
                ok, note = True, f"{n}: {queries[n](spark, where).count()} rows, no SQL, {time.time() - t:.1f} s"
        except Exception as ex:
            ok, note = False, f"{n}: {str(ex)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", note, flush=True)
    print("failed:", bad)
