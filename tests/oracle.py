"""Compare registered queries with their SQL twins on the same parquet tables.

    python tests/oracle.py <sf_dir> [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """Returns (message or None, spark rows, spark seconds)."""
    t0 = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sec = time.time() - t0
    if sql is None:
        return None, len(got[1]), sec
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1]), sec
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return (
            f"rows {len(got[1])} vs {len(want[1])}; spark only {sorted(a - b)[:3]}; sql only {sorted(b - a)[:3]}",
            len(got[1]),
            sec,
        )
    return None, len(got[1]), sec


def main(argv):
    import __spark_entry__ as entry
    from lorebook.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = argv[0], argv[1:]
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or qs:
        try:
            t0 = time.time()
            msg, n, sec = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
            total = time.time() - t0
        except Exception as e:  # noqa: BLE001
            msg, n, sec, total = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0, 0.0
        bad += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {name:28s} rows={n} spark={sec:.2f}s sql={total - sec:.2f}s {'' if name in sqls else '(no sql)'} {(msg or '')[:900]}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
