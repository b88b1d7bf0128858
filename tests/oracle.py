"""Rows of a query and of its oracle, in one comparable form."""

from collections import Counter
from pathlib import Path

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    db = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        db.execute(f"create view {p.stem} as select * from read_parquet('{files}')")
    return db


def compare(spark, db, name, query, sql, sf_dir):
    """None, or what differs."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    cursor = db.execute(sql)
    names, kinds = [d[0] for d in cursor.description], {d[0]: str(d[1]) for d in cursor.description}
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(r[k] for k in order) for r in cursor.fetchall())
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if KINDS.get(t, t) != kinds[c]}
    if odd:
        return f"types {odd}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
    return None if got else "no rows"
