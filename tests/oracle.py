"""Compare a query with its DuckDB twin, order aside."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted("|".join(shown(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def twin(sql, directory):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted("|".join(shown(r[i]) for i in order) for r in found.fetchall())
