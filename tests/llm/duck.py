"""Runs a query's SQL in DuckDB over rows of a test."""

import duckdb
import pyarrow as pa


def rows(sql, columns, **tables):
    c = duckdb.connect()
    for name, (schema, data) in tables.items():
        table = pa.table({n: pa.array([r[i] for r in data], t) for i, (n, t) in enumerate(schema)})
        c.register(f"_{name}", table)
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    return sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=str)


def got(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


DOCS = [("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())]
