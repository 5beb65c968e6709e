"""Compare registered queries with their SQL in DuckDB.

    python tests/check_oracle.py [sf folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_points  # noqa: E402
from stratalog.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([tidy(v) for v in value])
    if isinstance(value, dict):
        return str({k: tidy(v) for k, v in value.items()})
    return str(value)


def rows_of(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    types = [str(table.schema.field(n).type).replace("large_", "").replace("string_view", "string") for n in names]
    return names, types, sorted(tuple(tidy(v) for v in row) for row in zip(*columns))


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("CHECK_GROUP_ROWS"):
        # force the ways for heavy keys
        spark.conf.set("stratalog.groupRows", os.environ["CHECK_GROUP_ROWS"])
    if os.environ.get("CHECK_TIME_ZONE"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["CHECK_TIME_ZONE"])
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    bad = 0
    for name, function in queries.items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            mine = rows_of(function(spark, folder).toArrow())
        except Exception:
            bad += 1
            print(f"FAIL  {name}: {''.join(traceback.format_exc().splitlines(True)[-12:])}", flush=True)
            continue
        spent = time.time() - started
        if name not in oracles:
            print(f"rows  {name}: {len(mine[2])} rows, {spent:.1f} s", flush=True)
            continue
        try:
            theirs = rows_of(connection.execute(oracles[name]).to_arrow_table())
        except Exception as error:
            bad += 1
            print(f"FAIL  {name}: sql: {error}", flush=True)
            continue
        same = mine[0] == theirs[0] and mine[2] == theirs[2]
        note = "" if mine[1] == theirs[1] else f" types {list(zip(mine[0], mine[1], theirs[1]))}"
        print(f"{'ok   ' if same else 'DIFF '} {name}: {len(mine[2])} rows, {spent:.1f} s{note}", flush=True)
        if not same:
            bad += 1
            print("   ", mine[0], theirs[0], len(mine[2]), len(theirs[2]))
            for a, b in zip(sorted(set(mine[2]) - set(theirs[2]))[:3], sorted(set(theirs[2]) - set(mine[2]))[:3]):
                print("    spark", a, "\n    sql  ", b)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
