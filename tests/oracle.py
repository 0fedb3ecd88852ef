"""Run a registered query and its SQL twin on the same tables and compare the rows.

``python -m tests.oracle [name ...]`` checks by hand; the test suite uses ``compare``.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return str(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str = FOLDER) -> tuple[bool, str]:
    from florilege.plans import ORACLES, QUERIES

    t0 = time.time()
    df = QUERIES[name](spark, folder)
    got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if name not in ORACLES:
        return True, f"{len(got[1])} rows only, {t1 - t0:.1f}s"
    res = con.execute(ORACLES[name])
    want = _sorted_rows([c[0] for c in res.description], res.fetchall())
    note = f"{len(got[1])} rows, spark {t1 - t0:.1f}s, sql {time.time() - t1:.1f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} <> {want[0]}"
    if got[1] != want[1]:
        only_got = [r for r in got[1] if r not in set(want[1])][:3]
        only_want = [r for r in want[1] if r not in set(got[1])][:3]
        return False, f"{note}; want {len(want[1])} rows\n  columns   {got[0]}\n  only spark {only_got}\n  only sql   {only_want}"
    return True, note


def main(names: list[str]) -> int:
    from florilege.plans import QUERIES
    from florilege.session import local_session

    spark = local_session()
    con = connection()
    bad = 0
    for name in names or list(QUERIES):
        try:
            ok, note = compare(spark, con, name)
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
