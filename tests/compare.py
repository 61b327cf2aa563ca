"""Compare each registered query with its SQL statement, value by value.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

VIEWS = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for view in VIEWS:
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{sf_dir}/{view}.parquet')")
    return con


def _cell(value):
    if isinstance(value, datetime):
        return ("date", str(value))
    if isinstance(value, bool):
        return ("int", int(value))
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        return ("float", value)
    return (type(value).__name__, str(value))


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql) -> str | None:
    """None when columns, types and all rows are equal; else what differs."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    ours = _bag(df.columns, [tuple(r) for r in df.collect()])
    theirs = _bag(names, expected.fetchall())
    if ours == theirs:
        return None
    order = sorted(names)
    return (
        f"{sum(ours.values())} rows != {sum(theirs.values())} rows or other values; {order}\n"
        f"  only ours:   {list((ours - theirs).items())[:2]}\n"
        f"  only theirs: {list((theirs - ours).items())[:2]}"
    )


def main() -> int:
    import __spark_entry__ as entry
    from tillwise.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "compare",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or oracles:
        began = time.time()
        try:
            found = differences(queries[name](spark, sf_dir), con, oracles[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:700]}"
        failed += found is not None
        print(f"{'FAIL' if found else 'ok':5}{name:28}{time.time() - began:6.2f}s {found or ''}")
    print(f"{failed} failed; without SQL: {sorted(set(queries) - set(oracles))}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
