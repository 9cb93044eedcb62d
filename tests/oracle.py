"""Compare queries with their SQL: python tests/oracle.py SF_DIR [NAME...]; also used by the tests."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(value):
    """One form for values of both engines: floats to 9 digits, containers as tuples."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf: str, query, sql: str) -> str:
    """Empty if the results are equal, else what differs."""
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    want = rows(names, out.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    a, b = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} and {len(want)} rows; only Spark {sorted(a, key=repr)[:3]}; only SQL {sorted(b, key=repr)[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    from corpusloom.runtime import get_spark

    spark = get_spark(cpus=8, **{"spark.sql.shuffle.partitions": "4"})
    spark.sparkContext.setLogLevel("ERROR")
    sf, con, sql = sys.argv[1], connect(sys.argv[1]), entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        began = time.time()
        try:
            if name in sql:
                bad = compare(spark, con, sf, query, sql[name])
                print(name, "ok" if not bad else f"DIFFERS {bad[:600]}", f"{time.time() - began:.1f}s", flush=True)
            else:
                print(name, query(spark, sf).count(), "rows", f"{time.time() - began:.1f}s", flush=True)
        except Exception as e:  # the next queries are still of interest
            print(name, "FAILED", str(e)[:700], flush=True)
