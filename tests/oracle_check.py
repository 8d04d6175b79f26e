"""Run registered queries in Spark and DuckDB and compare them value by value.

    python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    return v if isinstance(v, int) and not isinstance(v, bool) else str(v)


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    made = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(made, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, key, folder, queries, oracles):
    """None when both sides agree, else a short account of the first difference."""
    df = queries[key](spark, folder)
    left_names, left = _sorted(df.columns, df.collect())
    if key not in oracles:
        return None if left else "no rows"
    got = con.execute(oracles[key])
    right_names, right = _sorted([d[0] for d in got.description], got.fetchall())
    if left_names != right_names:
        return f"columns {left_names} against {right_names}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    if not left:
        return "no rows on either side"
    wide = [d[0] for d in got.description if str(d[1]) == "HUGEINT" or str(d[1]).startswith("DECIMAL")]
    if wide:
        return f"wide numbers in DuckDB: {wide}"
    for i, n in enumerate(left_names):
        kinds = {type(r[i]) for r in (*left, *right) if r[i] is not None}
        if len(kinds) > 1:
            return f"types of {n} differ: {kinds}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, e.g. {left_names}: {wrong[0][0]} against {wrong[0][1]}"
    filled = [i for i in range(len(left_names)) if any(r[i] is not None for r in left)]
    if len(filled) < len(left_names):
        return f"only nulls in {[n for i, n in enumerate(left_names) if i not in filled]}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from quantloom.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = argv[1:] or list(queries)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for key in keys:
        began = time.time()
        try:
            verdict = compare(spark, con, key, folder, queries, oracles)
        except Exception as e:  # noqa: BLE001 - one broken query must not hide the rest
            verdict = "error: " + str(e).split("JVM stacktrace")[0][:700]
        took = time.time() - began
        if verdict or took > 12 or len(keys) < 15:
            print(f"{key}: {verdict or 'ok'} ({took:.1f}s)", flush=True)
        bad += bool(verdict)
    print(f"{len(keys) - bad} of {len(keys)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
