"""Compare every registered query with its SQL on one scale directory.

    python tests/check_queries.py [sf_dir] [query ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from runledger.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf_dir):
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (int, str)):
        return repr(value)
    if hasattr(value, "isoformat"):
        text = value.isoformat(" ")if hasattr(value, "hour") else f"{value.isoformat()} 00:00:00"
        return text
    return repr(value)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


def type_differences(df, result):
    theirs = {d[0]: str(d[1]) for d in result.description}
    return [(f.name, f.dataType.simpleString(), theirs.get(f.name)) for f in df.schema.fields
            if f.dataType.simpleString() in KINDS
            and theirs.get(f.name) != KINDS[f.dataType.simpleString()]]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, connection, sql):
    """None when both sides agree, else a short text."""
    mine = rows_of(df.columns, df.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = type_differences(df, result)
    if kinds:
        return f"types {kinds}"
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} and {b}"
    return None


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = set(argv[1:])
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = database(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                verdict = difference(df, connection, oracles[name])
            else:
                verdict = None if df.count() else "no rows"
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += verdict is not None
        print(f"{name:24s} {time.time() - start:6.2f}s {'ok' if verdict is None else verdict}",
              flush=True)
    print(f"{bad} differences")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
