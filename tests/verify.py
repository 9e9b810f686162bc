"""Compare queries with their SQL in DuckDB: python tests/verify.py [--sf DIR] [NAME...]."""

from __future__ import annotations

import decimal
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def session(name: str = "verify") -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName(name).config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def clean(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(clean(x) for x in v)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    return v


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*' if p.is_dir() else ''}'")
    return c


def main(args: list[str]) -> int:
    import __spark_entry__ as e

    sf = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for i, a in enumerate(args) if a != "--sf" and args[i - 1] != "--sf"] or list(e.queries())
    spark, con, bad = session(), oracle(sf), []
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        began = time.time()
        try:
            got = e.queries()[name](spark, sf)
            names, got = got.columns, [tuple(r.values()) for r in got.toArrow().to_pylist()]
            took = time.time() - began
            if name not in e.oracle_sql():
                print(f"{name}: {len(got)} rows, no SQL ({took:.1f} s)", flush=True)
                continue
            c = con.execute(e.oracle_sql()[name])
            other, want = [d[0] for d in c.description], c.fetchall()
            a, b = rows_of(names, got), rows_of(other, want)
            same = sorted(names) == sorted(other) and a == b
            print(f"{name}: {'ok' if same else 'DIFFERS'} {len(a)} {len(b)} ({took:.1f} s)", flush=True)
            if not same:
                bad.append(name)
                print("   columns", sorted(names), sorted(other))
                sa, sb = set(map(repr, a)), set(map(repr, b))
                print("   only ours", list(sa - sb)[:4], "\n   only SQL", list(sb - sa)[:4])
        except Exception as x:
            bad.append(name)
            print(f"{name}: FAILED {str(x)[:1500]}", flush=True)
    print("bad:", bad)
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
