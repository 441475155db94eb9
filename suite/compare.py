"""Runs registered queries and their SQL side by side: python -m suite.compare [sf_dir] [name ...]"""

from __future__ import annotations

import collections
import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from rowgate.session import local_session
from suite.queries import ORACLES, QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> tuple[int, list[str]]:
    """(rows of the Spark result, up to six differences)."""
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(r[c] for c in columns) for r in df.collect())
    total = sum(got.values())
    if name not in ORACLES:
        return total, []
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return total, [f"columns {columns} against {sorted(names)}"]
    order = [names.index(c) for c in columns]
    want = collections.Counter(tuple(r[i] for i in order) for r in result.fetchall())
    found = [f"only Spark {n} x {row}" for row, n in list((got - want).items())[:3]]
    found += [f"only SQL   {n} x {row}" for row, n in list((want - got).items())[:3]]
    return total, found


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8, "rowgate-compare")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            rows, found = differences(spark, con, sf_dir, name)
        except Exception as e:  # the report goes on with the other queries
            rows, found = -1, [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(found)
        print(f"{'DIFF' if found else 'ok':5}{name:28}{rows:9} rows {time.time() - start:7.2f} s", *found, sep="\n      " if found else "", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
