"""Registered queries against their SQL counterparts in DuckDB, value by value."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return value if math.isinf(value) else round(value, 9) + 0.0
    if isinstance(value, (datetime, date)):
        return str(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def spark_rows(df):
    return _rows(df.columns, df.collect())


def oracle_rows(con, sql):
    cursor = con.execute(sql)
    return _rows([d[0] for d in cursor.description], cursor.fetchall())


def difference(df, con, sql) -> str | None:
    got_columns, got = spark_rows(df)
    want_columns, want = oracle_rows(con, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got == want:
        return None
    extra = sorted(set(got) - set(want), key=repr)[:3]
    missing = sorted(set(want) - set(got), key=repr)[:3]
    return f"rows {len(got)} / {len(want)}; only here {extra}; only there {missing}"


def main(sf_dir: str, names: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import build_session

    spark, con = build_session(), connect(sf_dir)
    found, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or found:
        began = time.time()
        try:
            df = found[name](spark, sf_dir)
            problem = difference(df, con, sqls[name]) if name in sqls else f"rows only: {df.count()}"
        except Exception as error:  # keep going: the list of all problems is the point
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:30s} {time.time() - began:6.2f}s {problem or 'same'}", flush=True)
    print("different:", bad, "of", len(names or found))


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
