"""Compare registered queries with their SQL, from the command line or from tests.

    python -m tests.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

import __spark_entry__ as entry

KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark, con, name: str, sf_dir: str) -> tuple[int, str]:
    """Rows of the query, and what is wrong with it (empty if nothing)."""
    got = entry.queries()[name](spark, sf_dir)
    kinds = {f.name: KINDS.get(f.dataType.simpleString()) for f in got.schema.fields}
    want = con.sql(entry.oracle_sql()[name])
    expected = dict(zip(want.columns, [str(t) for t in want.types]))
    if kinds != expected:
        return 0, f"schema {kinds} is not {expected}"
    left = ordered(got.toPandas())
    right = ordered(want.df())
    if len(left) != len(right):
        return len(left), f"{len(left)} rows, expected {len(right)}"
    try:
        pd.testing.assert_frame_equal(left, right, check_exact=True, check_dtype=False)
    except AssertionError as e:
        return len(left), str(e)
    return len(left), ""


def main(sf_dir: str, names: list[str]) -> int:
    from tests.conftest import make_session

    spark, con, bad = make_session(), connect(sf_dir), 0
    for name in names or entry.queries():
        began = time.time()
        try:
            rows, wrong = compare(spark, con, name, sf_dir)
        except Exception as e:  # report, go on with the next query
            rows, wrong = 0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(wrong)
        print(f"{name:26} {rows:8} {time.time() - began:6.1f} s  {wrong or 'ok'}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
