"""Run registered jobs and their SQL side by side and report rows, columns and values.

usage: python tools/compare.py [--sf 0.01] [--time] [name-or-prefix ...]
"""

from __future__ import annotations

import argparse
import logging
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortline.plans.registry import load_all  # noqa: E402
from cohortline.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--cpus", default="8")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(args.cpus)
    spark.sparkContext.setLogLevel("OFF")
    for quiet in ("DataFrameQueryContextLogger", "SQLQueryContextLogger"):
        logging.getLogger(quiet).setLevel(logging.CRITICAL + 1)
    con = database(sf_dir)
    bad = 0
    for name, q in load_all().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = q.job(spark, sf_dir)
            got, got_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(error).__name__}: {str(error)[:1500]}", flush=True)
            continue
        spent = time.time() - start
        if q.sql is None:
            print(f"rows {name}: {len(got)} rows, no SQL, {spent:.2f}s", flush=True)
            continue
        try:
            result = con.execute(q.sql)
            columns = [d[0] for d in result.description]
            kinds = {d[0]: str(d[1]) for d in result.description}
            want, want_columns = rows_of(columns, result.fetchall())
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"SQL? {name}: {str(error)[:1500]}", flush=True)
            continue
        spark_kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        if got_columns == want_columns and got == want and got:
            odd = {c: (spark_kinds[c], kinds[c]) for c in got_columns if not same_kind(spark_kinds[c], kinds[c])}
            print(f"ok   {name}: {len(got)} rows, {spent:.2f}s{' TYPES ' + str(odd) if odd else ''}", flush=True)
            continue
        bad += 1
        print(f"DIFF {name}: {len(got)} vs {len(want)} rows; columns {got_columns} vs {want_columns}")
        missing = [r for r in want if r not in set(got)][:4]
        extra = [r for r in got if r not in set(want)][:4]
        print("   spark only:", *extra, sep="\n     ")
        print("   sql only:", *missing, sep="\n     ", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


def same_kind(spark_kind: str, sql_kind: str) -> bool:
    table = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
    }
    return table.get(spark_kind, spark_kind) == sql_kind or spark_kind.startswith(("array", "map", "struct"))


if __name__ == "__main__":
    sys.exit(main())
