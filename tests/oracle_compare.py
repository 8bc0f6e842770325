"""Compare a registered Spark query with its DuckDB oracle SQL.

Mirrors the correctness gate: row count, column names, column kinds and an
order-insensitive comparison of canonicalised values.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v, tol=False):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, int):
        return f"n{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"n{round(v, 6) if tol else v!r}"
    if isinstance(v, decimal.Decimal):
        return f"n{float(v)!r}"
    if isinstance(v, dt.datetime):
        return f"t{v.replace(tzinfo=None).isoformat()}"
    if isinstance(v, dt.date):
        return f"d{v.isoformat()}"
    return f"s{v}"


def _kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    if isinstance(v, decimal.Decimal):
        return "decimal"
    if isinstance(v, dt.datetime):
        return "timestamp"
    if isinstance(v, dt.date):
        return "date"
    return "str"


def compare(spark, name: str, sf_dir: str, queries: dict, oracles: dict) -> dict:
    sdf = queries[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    con = duck(sf_dir)
    cur = con.execute(oracles[name])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    out = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows)}
    out["columns_match"] = sorted(s_cols) == sorted(d_cols)
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols
        out["ok"] = False
        return out
    s_idx = [s_cols.index(c) for c in sorted(s_cols)]
    d_idx = [d_cols.index(c) for c in sorted(d_cols)]
    kinds = {}
    for rows, idx, tag in ((s_rows, s_idx, "s"), (d_rows, d_idx, "d")):
        for r in rows:
            for j, i in enumerate(idx):
                k = _kind(r[i])
                if k:
                    kinds.setdefault((j, tag), k)
    kind_bad = [sorted(s_cols)[j] for j in range(len(s_idx))
                if kinds.get((j, "s")) and kinds.get((j, "d"))
                and kinds[(j, "s")] != kinds[(j, "d")]]
    out["kind_mismatch"] = kind_bad
    for tol in (False, True):
        a = Counter(tuple(_canon(r[i], tol) for i in s_idx) for r in s_rows)
        b = Counter(tuple(_canon(r[i], tol) for i in d_idx) for r in d_rows)
        out["exact" if not tol else "tolerant"] = a == b
        if not tol and a != b:
            out["only_spark"] = list((a - b).items())[:3]
            out["only_oracle"] = list((b - a).items())[:3]
    out["ok"] = out["exact"] and len(s_rows) == len(d_rows) and not kind_bad
    return out


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from spineworks.session import build_session
    sf = sys.argv[1]
    names = sys.argv[2:] or sorted(E.oracle_sql())
    spark = build_session("local[8]", shuffle_partitions=8)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf, qs, os_)
        except Exception as ex:  # report and go on
            r = {"name": n, "ok": False, "error": repr(ex)[:500]}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "FAIL"), r if not r["ok"] else
              f"{n} rows={r['spark_rows']}", flush=True)
    print("failures:", bad, "of", len(names))
