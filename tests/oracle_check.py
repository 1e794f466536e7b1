"""Runs registered queries next to their SQL twins and reports differences.

    python tests/oracle_check.py [prefix ...] [--sf DIR]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "-" if v is None else repr(v)
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> str:
    """Empty when names, types (by family), row counts and all values agree."""
    got = [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = canonical(got, spark_df.columns), canonical(want, names)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)}/{len(a)} rows differ, e.g. {wrong[0][0]} != {wrong[0][1]}"
    return ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("prefixes", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()

    from parcelsight.plans.catalog import oracles, queries
    from parcelsight.session import local_session

    spark, con = local_session("oracle-check"), connect(args.sf)
    twins, failed = oracles(), 0
    for name, query in queries().items():
        if args.prefixes and not any(name.startswith(p) for p in args.prefixes):
            continue
        start = time.time()
        try:
            df = query(spark, args.sf)
            if name in twins:
                problem = compare(df, con, twins[name])
                n = "checked"
            else:
                n, problem = f"{len(df.collect())} rows", ""
        except Exception as err:  # report and go on to the next query
            problem = f"{type(err).__name__}: {str(err)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:42s} {time.time() - start:6.2f}s "
              f"{problem or n}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
