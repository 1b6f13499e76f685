"""Runs queries beside their SQL: python -m checks.compare [sf_dir] [query ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracles import ORACLES
from checks.queries import REGISTRY
from checks.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = REGISTRY[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == want:
        return True, f"{len(got)} rows"
    left, right = set(got) - set(want), set(want) - set(got)
    return False, f"{len(got)} vs {len(want)} rows\n  spark only: {sorted(left)[:2]}\n  sql only:   {sorted(right)[:2]}"


def main() -> int:
    from corpuslens.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = build_session("compare")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        if name not in ORACLES:
            print(f"rows {name}: {REGISTRY[name](spark, sf_dir).count()}", flush=True)
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, note = False, str(error)[:700]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note} ({time.time() - start:.1f}s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
