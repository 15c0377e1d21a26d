"""Compare a query with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return db


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    try:
        return round(float(v), 6) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=repr)


def difference(spark, sf_dir: str, query, sql: str) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    if got != want:
        only = [r for r in got if r not in want][:2], [r for r in want if r not in got][:2]
        return f"{len(got)} and {len(want)} rows; only here {only[0]}; only there {only[1]}"
    return None
