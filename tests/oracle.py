"""Run a query and its oracle side by side and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent.parent))

import __spark_entry__ as entry


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def compare(spark, con, name: str, sf_dir: str) -> list[str]:
    """Differences in columns, types or rows; empty when both sides agree."""
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    ours = _sorted([tuple(_plain(r[c]) for c in cols) for r in df.collect()])
    rel = con.sql(entry.oracle_sql()[name])
    names = list(rel.columns)
    out = []
    if sorted(names) != cols:
        return [f"columns {cols} != {sorted(names)}"]
    big = [n for n, t in zip(rel.columns, rel.types) if str(t) == "HUGEINT"]
    if big:
        out.append(f"oracle columns {big} are HUGEINT")
    at = [names.index(c) for c in cols]
    theirs = _sorted([tuple(_plain(r[i]) for i in at) for r in rel.fetchall()])
    if len(ours) != len(theirs):
        out.append(f"{len(ours)} rows != {len(theirs)} rows")
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        out.append(f"{len(bad)} rows differ, e.g. {cols}\n   spark  {bad[0][0]}\n   oracle {bad[0][1]}")
    if not ours:
        out.append("no rows at all")
    return out


def main(sf_dir: str, names: list[str]) -> int:
    from tidewatch.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    failed = 0
    for name in names or entry.queries():
        t = time.time()
        try:
            diff = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            diff = [f"{type(e).__name__}: {str(e)[:400]}"]
        failed += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {time.time() - t:.1f}s", *diff, sep="\n   " if diff else " ", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
