"""Run a query in Spark and its SQL in DuckDB over the same tables and compare schema and rows, whatever their order."""

import math
import os

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in NAMES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


def difference(con, text, df):
    """None where both agree, else what differs first."""
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = [tuple(r) for r in df.collect()]
    a, b = canonical(got, df.columns), canonical(want, names)
    if a == b:
        return None
    first = next(((x, y) for x, y in zip(a, b, strict=False) if x != y), (a[len(b) :][:1], b[len(a) :][:1]))
    return f"{len(a)} and {len(b)} rows of {sorted(names)}: {first[0]} / {first[1]}"
