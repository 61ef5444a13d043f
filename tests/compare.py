"""Spark rows against DuckDB rows, order aside."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.6g}" if abs(x) > 1e6 else f"{round(x, 6) + 0.0:.6f}"
    return str(x)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    """What differs, as text; empty if nothing does."""
    found = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in found.description}
    a, b = normal(df.columns, [tuple(r) for r in df.collect()]), normal(list(kinds), found.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for c, t in df.dtypes:
        if same.get(t, t) != kinds[c]:
            return f"type of {c}: {t} and {kinds[c]}"
    if a[1] != b[1]:
        only = lambda x, y: [r for r in x if r not in set(y)][:4]
        return f"{len(a[1])} and {len(b[1])} rows; only in Spark {only(a[1], b[1])}; only in SQL {only(b[1], a[1])}"
    return ""
