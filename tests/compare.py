"""Side-by-side comparison of Spark results with DuckDB results."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

from pipelytics.views import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "item"):
        return v.item()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    """Human-readable differences; empty when both sides agree exactly."""
    rel = con.execute(sql)
    d_names = [c[0] for c in rel.description]
    want = _rows(d_names, rel.fetchall())
    got = _rows(df.columns, df.collect())
    out = []
    if sorted(df.columns) != sorted(d_names):
        return [f"columns {sorted(df.columns)} != {sorted(d_names)}"]
    if len(want) != len(got):
        out.append(f"{len(got)} rows, expected {len(want)}")
    if not got:
        out.append("no rows at all")
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        out += [f"only spark: {x}" for x in sorted(a - b)[:limit]]
        out += [f"only duckdb: {x}" for x in sorted(b - a)[:limit]]
        if not (a - b) and not (b - a):
            out.append("same values, other multiplicity")
    return out


def main(argv: list[str]) -> None:
    from pipelytics.session import build_session
    import __spark_entry__ as entry

    folder = argv[0]
    spark = build_session("local[8]")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = [k for k in queries if len(argv) < 2 or any(k.startswith(a) for a in argv[1:])]
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            df = queries[k](spark, folder)
            if k in oracles:
                diff = differences(df, con, oracles[k])
            else:
                n = df.count()
                diff = [] if n else ["no rows at all"]
        except Exception as e:  # noqa: BLE001
            diff = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {k} {time.time() - t0:.2f}s"
              + ("" if k in oracles else " (rows only)"), flush=True)
        for d in diff:
            print("     ", d[:1500])
    print(f"{len(keys) - bad} of {len(keys)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
