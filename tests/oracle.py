"""Runs a registered query and its SQL twin on the same files and compares them."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("SET memory_limit = '8GB'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")
    return str(v)


def kind(type_name: str) -> str:
    t = str(type_name).lower()
    if t in ("int", "integer"):
        return "int"
    if t in ("bigint", "long"):
        return "bigint"
    if t in ("varchar", "string"):
        return "string"
    if t == "timestamp_ntz":
        return "timestamp"
    return t.split("(")[0]


def spark_side(df):
    names = sorted(df.columns)
    types = [kind(dict(df.dtypes)[n]) for n in names]
    rows = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    return names, types, rows


def sql_side(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: kind(d[1]) for d in cur.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    return [names[i] for i in order], [types[names[i]] for i in order], rows


def differences(df, con, sql: str) -> list[str]:
    start = time.time()
    n1, t1, r1 = spark_side(df)
    middle = time.time()
    n2, t2, r2 = sql_side(con, sql)
    print(f"[{middle - start:5.1f} {time.time() - middle:5.1f}]", end=" ", flush=True)
    out = []
    if n1 != n2:
        return [f"columns {n1} != {n2}"]
    loose = [(n, a, b) for n, a, b in zip(n1, t1, t2) if a != b and not a.startswith("array")]
    if loose:
        out.append(f"types {loose}")
    if len(r1) != len(r2):
        out.append(f"rows {len(r1)} != {len(r2)}")
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        out.append(f"{len(bad)} of {len(r1)} rows differ, first {n1}: {str(bad[0])[:600]}")
    if not r1:
        out.append("no rows")
    return out
