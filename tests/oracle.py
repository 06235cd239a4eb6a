"""Compare a Spark result with DuckDB, value by value, in any row order."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    return (1, value if isinstance(value, str) else str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


_DUCK = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean"}


def compare(df, con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: _DUCK.get(str(d[1]), str(d[1])) for d in cursor.description}
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert dict(df.dtypes) == kinds
    actual = [tuple(row) for row in df.collect()]
    assert len(actual) == len(expected)
    assert _rows(df.columns, actual) == _rows(names, expected)
    return len(actual)
