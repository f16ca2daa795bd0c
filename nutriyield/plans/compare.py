"""Compare a registered Spark query with its DuckDB oracle (tests and dev)."""

from __future__ import annotations

import hashlib
import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 12)) if abs(v) < 1e15 else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if len(v.isoformat()) >= 10 else v.isoformat()
    return str(v)


def table_hash(cols, rows) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(str(_norm(r[i])) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> dict:
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "cols_match": sorted(s_cols) == sorted(d_cols)}
    res["hash_match"] = res["cols_match"] and table_hash(s_cols, s_rows) == table_hash(d_cols, d_rows)
    if not res["hash_match"]:
        res["spark_cols"], res["oracle_cols"] = s_cols, d_cols
        if res["cols_match"]:
            so = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
            do = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
            a = sorted("|".join(str(_norm(r[i])) for i in so) for r in s_rows)
            b = sorted("|".join(str(_norm(r[i])) for i in do) for r in d_rows)
            res["only_spark"] = [x for x in a if x not in set(b)][:3]
            res["only_oracle"] = [x for x in b if x not in set(a)][:3]
    return res
