"""Run catalog queries beside their SQL and compare the results value by value.

Usage: python -m checks.compare <folder> [query ...]
"""

import math
import sys
import time

import duckdb

from checks import catalog, oracle
from orderlens.scratch import scratch_scope

# the type a Spark column must have on the SQL side
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}
TABLES = "region nation customer supplier part orders lineitem".split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def spark_result(name, spark, folder):
    with scratch_scope(spark):
        df = catalog.run(name, spark, folder)
        types = {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema}
        return *canonical(df.columns, [tuple(r) for r in df.collect()]), types


def sql_result(name, con):
    result = con.execute(oracle.statement(oracle.BODIES[name]))
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    return *canonical(names, result.fetchall()), types


def difference(name, spark, con, folder):
    """None when equal, else a short description."""
    a, b = spark_result(name, spark, folder), sql_result(name, con)
    if a[0] != b[0]:
        return f"columns {a[0]} != {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} != {len(b[1])}"
    if a[2] != b[2]:
        return f"types differ: {[(c, t, b[2][c]) for c, t in a[2].items() if t != b[2][c]]}"
    # repr also tells 1 from 1.0 and from true
    bad = [(x, y) for x, y in zip(a[1], b[1]) if repr(x) != repr(y)]
    return f"{len(bad)} of {len(a[1])} rows, first {bad[0]} in {a[0]}" if bad else None


def main(folder, names):
    from orderlens.session import build_session

    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    failed = 0
    for name in names or catalog.QUERIES:
        start = time.time()
        try:
            found = difference(name, spark, con, folder)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:400]}"
        failed += found is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if found is None else found}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
