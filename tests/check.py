"""Compares registered queries with their SQL on DuckDB, the way the driver does.

Usage: python tests/check.py [name or prefix ...] [--sf 0.01]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return ("null",) if math.isnan(f) else ("n", f + 0.0)
    if hasattr(v, "isoformat"):
        return ("t", v.isoformat())
    return ("s", str(v))


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, queries, oracles, sf_dir):
    started = time.time()
    df = queries[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if name not in oracles:
        return f"rows-only {len(rows)} rows", took, len(rows) > 0
    started = time.time()
    res = con.execute(oracles[name])
    cols = [d[0] for d in res.description]
    expected = res.fetchall()
    sql_took = time.time() - started
    a, b = table_of(df.columns, rows), table_of(cols, expected)
    if a[0] != b[0]:
        return f"COLUMNS {a[0]} vs {b[0]}", took, False
    if len(a[1]) != len(b[1]):
        return f"ROWS {len(a[1])} vs {len(b[1])}", took, False
    diff = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if diff:
        return f"VALUES {len(diff)} of {len(rows)} rows differ: {a[0]} spark {diff[0][0]} sql {diff[0][1]}", took, False
    return f"ok {len(rows)} rows (sql {sql_took:.1f}s)", took, True


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    from riskspark.session import clear_scratch, get_session
    import __spark_entry__ as entry

    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="check-"),
        "spark.driver.extraJavaOptions": "-Dlog4j2.level=ERROR"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, queries, oracles = duck(sf_dir), entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or n.startswith(a) for a in argv)]
    bad = 0
    for n in names:
        try:
            message, took, good = compare(spark, con, n, queries, oracles, sf_dir)
        except Exception as exc:  # noqa: BLE001
            message, took, good = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", 0.0, False
        clear_scratch(spark)
        bad += not good
        print(f"{'PASS' if good else 'FAIL'} {n} {took:.1f}s {message}", flush=True)
    print(f"{len(names) - bad} of {len(names)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
