"""Runs a registered query on Spark and its SQL on DuckDB and compares names, types, rows and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(value: object) -> object:
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, cell(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, cell(v)) for k, v in value.asDict().items()))
    return value


# Spark and DuckDB names of the types the registered queries return.
SAME_TYPE = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    relation = con.sql(sql)
    theirs = sorted(relation.columns)
    if names != theirs:
        return f"columns differ: {names} / {theirs}"
    kinds = dict(zip(relation.columns, (str(t) for t in relation.types)))
    wrong = [
        (f.name, f.dataType.simpleString(), kinds[f.name])
        for f in df.schema.fields
        if SAME_TYPE.get(f.dataType.simpleString(), kinds[f.name]) != kinds[f.name]
    ]
    if wrong:
        return f"types differ: {wrong}"
    mine = sorted((tuple(cell(r[n]) for n in names) for r in df.collect()), key=repr)
    at = [relation.columns.index(n) for n in names]
    other = sorted((tuple(cell(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    if len(mine) != len(other):
        return f"rows differ: {len(mine)} / {len(other)}"
    different = [(a, b) for a, b in zip(mine, other) if a != b]
    if different:
        return f"{len(different)} of {len(mine)} rows differ in {names}; first: {different[0][0]} / {different[0][1]}"
    return "" if mine else "no rows"


def main(names: list[str], sf_dir: str) -> int:
    from __spark_entry__ import oracle_sql, queries
    from flowguard.session import build_session

    spark = build_session(8, spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, fn, sqls[name], sf_dir)
            else:
                rows = fn(spark, sf_dir).collect()
                problem = "" if rows else "no rows"
                print("   ", name, rows[:6])
        except Exception as error:  # reported per query, so that one failure does not hide the others
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    folder = sys.argv[1]
    sys.exit(1 if main(sys.argv[2:], folder) else 0)
