"""Compare a query with its SQL as multisets of rows, columns by name."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return c


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 9)
    return x if isinstance(x, (str, bool, int)) else int(x) if hasattr(x, "__index__") else repr(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def same(spark_df, connection, sql):
    rel = connection.sql(sql)
    assert sorted(spark_df.columns) == sorted(rel.columns)
    assert rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()]) == rows_of(rel.columns, rel.fetchall())
