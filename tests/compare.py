"""Run a registered query and its SQL twin, and compare whole results."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SPARK_KIND = {"bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool"}
DUCK_KIND = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool"}


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), "" if v is None else v) for v in row)


def _clean(v):
    if isinstance(v, float) and v != v:
        return "NaN"
    if isinstance(v, float) and v == 0.0 and str(v).startswith("-"):
        return "-0.0"
    return v


def mismatch(df, con, sql: str, counts: dict | None = None) -> str | None:
    """None when equal, else a short description; ``counts`` receives both row counts."""
    rel = con.sql(sql)
    want_cols = dict(zip(rel.columns, [str(t) for t in rel.types]))
    have_cols = dict(df.dtypes)
    if sorted(want_cols) != sorted(have_cols):
        return f"columns {sorted(have_cols)} != {sorted(want_cols)}"
    names = sorted(have_cols)
    for n in names:
        a, b = SPARK_KIND.get(have_cols[n], have_cols[n]), DUCK_KIND.get(want_cols[n], want_cols[n])
        if a != b:
            return f"type of {n}: {have_cols[n]} vs {want_cols[n]}"
    have = sorted((tuple(_clean(r[n]) for n in names) for r in df.collect()), key=_key)
    idx = [rel.columns.index(n) for n in names]
    want = sorted((tuple(_clean(r[i]) for i in idx) for r in rel.fetchall()), key=_key)
    if counts is not None:
        counts.update(spark=len(have), sql=len(want))
    if len(have) != len(want):
        return f"rows {len(have)} != {len(want)}; only spark {list(set(have) - set(want))[:2]}; only sql {list(set(want) - set(have))[:2]}"
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(have)} rows differ in {names}: {bad[0]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from sensorframe import local_session
    from sensorframe.catalog import ORACLE_SQL, QUERIES

    folder, *wanted = sys.argv[1:]
    spark, con = local_session(8), duck(folder)
    names = [n for n in QUERIES if not wanted or any(n.startswith(w) for w in wanted)]
    failed = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, folder)
            if n in ORACLE_SQL:
                counts: dict = {}
                why = mismatch(df, con, ORACLE_SQL[n], counts)
                rows = f"{counts.get('spark')} rows, sql {counts.get('sql')}"
            else:
                why, rows = None, f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            why, rows = f"{type(e).__name__}: {str(e)[:700]}", ""
        failed += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {n} {time.time() - t0:.2f}s {rows} {why or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
