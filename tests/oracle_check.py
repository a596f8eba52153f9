"""Compare registered queries with their oracle SQL on one scale factor.

    python tests/oracle_check.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("isoscope-check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf: str):
    con = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return str(int(f)) if f == int(f) and abs(f) < 1e15 else f"{f:.9g}"
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted(tuple(_cell(v) for v in r) for r in pdf[cols].itertuples(index=False))


def compare(spark, con, sf: str, name: str, query, sql: str | None):
    """(verdict, rows, seconds)."""
    start = time.time()
    got = query(spark, sf).toPandas()
    took = time.time() - start
    if sql is None:
        return ("rows-only" if len(got) else "EMPTY"), len(got), took
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} / {sorted(want.columns)}", len(got), took
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return ("ok" if a else "ok-EMPTY"), len(a), took
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return f"DIFF {len(a)}/{len(b)} spark={only_a} duck={only_b}", len(a), took


def main() -> None:
    import __spark_entry__ as entry

    sf, *prefixes = sys.argv[1:]
    spark, con = session(), connect(sf)
    sqls, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            verdict, n, took = compare(spark, con, sf, name, query, sqls.get(name))
        except Exception as exc:  # report every query of the run
            verdict, n, took = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}", 0, 0.0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:38s} {n:7d} {took:6.2f}s {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
