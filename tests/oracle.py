"""Holds a query against its SQL on the driver's tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def here() -> bool:
    return Path(DATA).is_dir()


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(_cell(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_sql(sql: str) -> list[tuple]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(sql)
    names = list(rel.columns)
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(_cell(r[i]) for i in order) for r in rel.fetchall()), key=repr)
