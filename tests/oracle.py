"""Run registered queries next to their SQL: ``python -m tests.oracle [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from workloads.views import TABLES


def duck(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(row[i]) for i in order) for row in rows), key=repr)


def _value(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    return v


def compare(df, sql: str, connection) -> str | None:
    """None if both give the same rows, else what differs."""
    table = df.toArrow()
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(table.column_names) != sorted(names):
        return f"columns {sorted(table.column_names)} and {sorted(names)}"
    mine = _rows(table.column_names, zip(*[c.to_pylist() for c in table.columns]) if table.num_columns else [])
    theirs = _rows(names, cursor.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    for a, b in zip(mine, theirs):
        if a != b or list(map(type, a)) != list(map(type, b)):
            return f"row {a}\n     and {b} of {sorted(names)}"
    return None if mine else "no rows"


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    import __spark_entry__ as entry
    from nbgauge.session import build_session

    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, failed = duck(sf_dir), entry.oracle_sql(), 0
    for name, function in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = function(spark, sf_dir)
            problem = compare(df, oracles[name], connection) if name in oracles else None
            note = problem or ("ok" if name in oracles else f"rows only: {df.count()}")
        except Exception as error:  # noqa: BLE001 - the report goes on
            problem = note = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else '    '} {name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
