"""Run queries in Spark and DuckDB and compare all rows."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def list_pairs(spark, hyps, refs):
    """A pair table of two lists, or of one hypothesis and one reference."""
    lists = [x if isinstance(x, list) else [x] for x in (hyps, refs)]
    return spark.createDataFrame([("A", i, h, r) for i, (h, r) in enumerate(zip(*lists))],
                                 "system string, utt_id bigint, hyp string, ref string")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(frame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    found = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in found.description], found.fetchall())
    have_columns, have = rows_of(frame.columns, frame.collect())
    if have_columns != want_columns:
        return f"columns {have_columns} != {want_columns}"
    if len(have) != len(want):
        return f"{len(have)} rows != {len(want)}"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    return f"{len(bad)} rows differ, e.g. {bad[:2]}" if bad else ""


def main(folder: str, names: list[str]) -> None:
    from tests.conftest import make_session
    import __spark_entry__ as e

    spark = make_session()
    con = connect(folder)
    sqls = e.oracle_sql()
    for name, fn in e.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = fn(spark, folder)
            if name in sqls:
                problem = difference(frame, con, sqls[name])
            else:
                problem = f"rows only: {len(frame.collect())}"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {problem or 'ok'}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
